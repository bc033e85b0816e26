"""Near-duplicate vectors by NN-descent.

A neighbour graph is started from vectors that fall together when sorted by random projections, and refined: whoever
two neighbours of a vector are, they are compared with each other (neighbours-of-neighbours joins), and lists keep the
best. Only lists that changed take part in the next round. A list whose last entry is still a link is saturated: there
may be more links than it has room for. Every pair that was compared and is a link bonds its ends, whether or not a list
has room for it; saturated lists are enlarged to the whole component that the bonds make up, whose links are counted
block by block for each vector (and not written pair by pair).
Recall is audited against brute force for a sample of vectors, each vector by its own links, and if it falls short the
graph is started again with more projections on top of what is known; a recall that stays short is an error. Links are
the pairs at the threshold or above it in double precision.

Equal vectors are one vector for all this and count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._graph import components
from ._runtime import durable, parts

LINK = 0.9
EDGES = "a long, b long, sim double, bond long"
#: Length of neighbour lists; similarity from which neighbours are kept; vectors of a chunk in the start.
LIST, FLOOR, CHUNK = 12, 0.6, 128
#: The sim of rows that are bonds only.
NO_LIST = -9.0
TABLES, ROUNDS = 12, 6
#: Chance that a pair at the threshold meets in no cell of the start; starts before the recall is given up.
MISS, TRIES = 0.005, 5
#: Vectors of a block in comparisons of whole components; audited vectors, and the recall asked for.
BLOCK, AUDIT, RECALL = 512, 2000, 0.97
#: Vectors with about as many links are audited apart, if at least so many of them were drawn.
STRATUM = 20


class RecallError(RuntimeError):
    """Too many links are missing after all starts."""


def distinct_vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(vec_id, rep) of every row, rep null where the vector can't be compared; and (id, many, v) of each distinct one.

    v: the components as doubles, scaled to length 1.
    """
    v = F.col("v")
    bad = F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))
    rows = embeddings.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.withColumn("v", F.when(~bad & F.exists(v, lambda x: x != 0) & F.col("vec_id").isNotNull(), F.transform(v, lambda x: x + F.lit(0.0))))
    classes = durable(rows.where("v IS NOT NULL").groupBy("v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("many")))
    member = rows.join(classes.select("v", F.col("id").alias("rep")), "v", "left").select("vec_id", "rep")

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column("v").to_pylist():
                x = np.array(x, float)
                x = x / np.abs(x).max()
                out.append((x / np.sqrt(x @ x)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("many"), pa.array(out, pa.binary())], names=["id", "many", "v"])

    return member, durable(classes.select("id", "many", "v").mapInArrow(unit, "id long, many long, v binary"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.frombuffer(x) for x in column])


def _by_size(vectors: DataFrame) -> list[tuple[int, int]]:
    """Dimensions that occur, with their counts; vectors of different dimensions are never compared."""
    return [(r["d"], r["n"]) for r in vectors.groupBy((F.octet_length("v") / 8).cast("int").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()]


def _top(x: np.ndarray, ids: np.ndarray, many: int, link: float) -> pd.DataFrame:
    """Each vector's `many` best among the others, from FLOOR on, and the bonds of all links."""
    sim = x @ x.T
    np.fill_diagonal(sim, -2)
    if len(x) - 1 > many:
        best = np.argpartition(-sim, many, axis=1)[:, :many]
    else:
        best = np.tile(np.arange(len(x)), (len(x), 1))
    value = np.take_along_axis(sim, best, axis=1)
    row, col = np.nonzero(value >= FLOOR)
    near = pd.DataFrame({"a": ids[row], "b": ids[best[row, col]], "sim": value[row, col], "bond": 0})
    return pd.concat([near, _bonds(sim >= link, ids)])


def _bonds(linked: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
    """(a, b) from each vector to the first of its component, where `linked` is a symmetric matrix of links.

    These stars are as good as all the links for telling components, and no more than there are vectors.
    """
    if not linked.any():
        return pd.DataFrame({"a": ids[:0], "b": ids[:0], "sim": np.empty(0), "bond": np.empty(0, int)})
    least = ids.copy()
    while True:
        lower = np.minimum(least, np.where(linked, least[None, :], least[:, None]).min(axis=1))
        if (lower == least).all():
            break
        least = lower
    away = least != ids
    return pd.DataFrame({"a": ids[away], "b": least[away], "sim": NO_LIST, "bond": 1})


def _bits(count: int) -> int:
    return max(0, int(np.ceil(np.log2(max(1, count) / CHUNK))))


def tables_for(count: int, link: float = LINK) -> int:
    """So many tables that a pair at the threshold misses the same cell in all of them with a chance of MISS.

    Two vectors at an angle lie on the same side of a random plane with a chance of 1 - angle / pi, and cells have more
    planes the more vectors there are.
    """
    hit = (1 - np.arccos(np.clip(link, -1, 1)) / np.pi) ** _bits(count)
    return TABLES if hit >= 1 else max(TABLES, int(np.ceil(np.log(MISS) / np.log1p(-hit))))


def start(vectors: DataFrame, dim: int, count: int, seed: int, tables: int = TABLES, link: float = LINK) -> DataFrame:
    """Edges (a, b, sim, bond) between vectors that fall into one chunk of a random projection.

    Vectors are dealt by the signs of as many projections as leave about CHUNK in a cell; fuller cells (alike vectors)
    are cut along one more projection, with the ids to tell equals apart.
    """
    bits = _bits(count)
    rng = np.random.default_rng(seed)
    planes = rng.standard_normal((tables, bits + 1, dim))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([np.frombuffer(b) for b in batch.column("v").to_pylist()])
            for t in range(tables):
                side = x @ planes[t].T
                cell = ((side[:, :bits] > 0) @ (1 << np.arange(bits))).astype(np.int64) if bits else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int64)), pa.array(cell), pa.array(side[:, bits]), batch.column("id"), batch.column("v")], names=["t", "cell", "along", "id", "v"])

    dealt = vectors.mapInArrow(deal, "t long, cell long, along double, id long, v binary")
    n = parts(vectors.sparkSession, count * tables, 40_000)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows come by; a chunk ends with its cell or when it is full."""
        held, at = [], None

        def out(rows: list) -> Iterator[pa.RecordBatch]:
            if len(rows) > 1:
                yield pa.RecordBatch.from_pandas(_top(np.stack([np.frombuffer(v) for _, v in rows]), np.array([i for i, _ in rows]), LIST, link), preserve_index=False)

        for batch in batches:
            for t, c, i, v in zip(*(batch.column(k).to_pylist() for k in ("t", "cell", "id", "v")), strict=True):
                if (t, c) != at or len(held) >= CHUNK * 3 // 2:
                    yield from out(held)
                    held = held[-CHUNK // 2 :] if (t, c) == at else []
                    at = (t, c)
                held.append((i, v))
        yield from out(held)

    return dealt.repartitionByRange(n, "t", "cell", "along", "id").sortWithinPartitions("t", "cell", "along", "id").mapInArrow(near, EDGES)


def best_lists(edges: DataFrame, size: int) -> DataFrame:
    """The `size` best distinct neighbours of each vector. fresh: whether an edge is new to the lists."""
    one = edges.groupBy("a", "b").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    order = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    return one.withColumn("place", F.row_number().over(order)).where(F.col("place") <= size)


def lists_and_bonds(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lists of LIST neighbours (a, b, sim, fresh), and all bonds (a, b) among `edges`, in one pass over them."""
    one = edges.groupBy("a", "b").agg(F.max("sim").alias("sim"), F.min(F.when(F.col("bond") == 0, F.col("fresh"))).alias("fresh"), F.max("bond").alias("bond"))
    placed = one.withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b")))
    listed = (F.col("place") <= LIST) & (F.col("sim") > NO_LIST)
    both = durable(placed.withColumn("listed", listed).where("listed OR bond = 1").drop("place"))
    return both.where("listed").select("a", "b", "sim", "fresh"), both.where("bond = 1").select("a", "b")


def descend(lists: DataFrame, vectors: DataFrame, count: int, size: int = LIST, link: float = LINK) -> tuple[DataFrame, DataFrame]:
    """One round: the neighbours of each vector, in either direction, are compared with each other.

    Pairs of two old neighbours have been compared before and are left out. Returns the lists and the round's bonds.
    """
    both = lists.select("a", "b", "sim", "fresh").unionByName(lists.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim", "fresh"))
    # A vector that very many have in their lists keeps the best of them.
    around = best_lists(both, 2 * size)
    moved = around.groupBy("a").agg(F.max("fresh").alias("new")).where("new = 1").select("a")
    joined = around.join(moved, "a").join(vectors.select(F.col("id").alias("b"), "v"), "b")
    n = parts(lists.sparkSession, count * size, 200_000)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, vs, fresh = None, [], [], []

        def out() -> Iterator[pd.DataFrame]:
            if len(ids) > 1 and any(fresh):
                x, new, own = np.stack([np.frombuffer(v) for v in vs]), np.array(fresh, bool), np.array(ids)
                sim = x @ x.T
                row, col = np.nonzero((sim >= FLOOR) & (new[:, None] | new[None, :]) & (own[:, None] != own[None, :]))
                yield pd.DataFrame({"a": own[row], "b": own[col], "sim": sim[row, col], "bond": 0})
                yield _bonds((sim >= link) & (own[:, None] != own[None, :]), own)

        made = []
        for batch in batches:
            for a, b, f, v in zip(*(batch.column(k).to_pylist() for k in ("a", "b", "fresh", "v")), strict=True):
                if a != at:
                    made += out()
                    at, ids, vs, fresh = a, [], [], []
                ids.append(b)
                vs.append(v)
                fresh.append(f)
            if sum(map(len, made)) > 200_000:
                yield _unique(made)
                made = []
        made += out()
        if made:
            yield _unique(made)

    found = joined.select("a", "b", "fresh", "v").repartition(n, "a").sortWithinPartitions("a").mapInArrow(compare, EDGES)
    return lists_and_bonds(lists.select("a", "b", "sim", F.lit(0).alias("fresh"), F.lit(0).alias("bond")).unionByName(found.withColumn("fresh", F.lit(1))))


def _unique(made: list[pd.DataFrame]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pandas(pd.concat(made).drop_duplicates(["a", "b", "bond"]), preserve_index=False)


def enlarge(lists: DataFrame, bonds: DataFrame, vectors: DataFrame, link: float, size: int = LIST) -> tuple[DataFrame, DataFrame]:
    """(id, component) of the vectors whose component (by links and bonds) has a saturated list, and (id, others): how many
    other rows each of them is linked with.

    Members of such a component are compared with all others of it, in blocks of BLOCK x BLOCK vectors, each a task's
    work; of a block only each vector's count comes out.
    """
    links = lists.where(F.col("sim") >= link)
    full = links.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= size).select(F.col("a").alias("id"))
    if full.isEmpty():
        none = links.select(F.col("a").alias("id"), F.col("b").alias("component")).limit(0)
        return none, none.withColumnRenamed("component", "others")
    place = durable(components(links.select("a", "b").unionByName(bonds)))
    wanted = place.join(full, "id").select("component").distinct()
    sizes = place.join(wanted, "component").groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    # The blocks of a component: dealt by a hash of the id, so that no order over all its members is needed.
    blocks = F.expr(f"cast((n + {BLOCK - 1}) div {BLOCK} as int)")
    inside = durable(place.join(sizes, "component").join(vectors, "id").select("component", "id", "many", "v", blocks.alias("k")).withColumn("block", F.expr("cast(pmod(xxhash64(id), k) as int)")))
    left = inside.withColumn("other", F.explode(F.expr("sequence(0, k - 1)"))).select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "many", "v")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        i, j = int(rows["i"].iloc[0]), int(rows["j"].iloc[0])
        one, two = rows[rows["block"] == i], rows[rows["block"] == j]
        if not len(one) or not len(two):
            return pd.DataFrame({"id": np.empty(0, np.int64), "others": np.empty(0, np.int64)})
        linked = (_matrix(one["v"]) @ _matrix(two["v"]).T >= link) & (one["id"].to_numpy()[:, None] != two["id"].to_numpy()[None, :])
        there = pd.DataFrame({"id": one["id"].to_numpy(), "others": linked.astype(np.int64) @ two["many"].to_numpy()})
        if i == j:
            return there
        return pd.concat([there, pd.DataFrame({"id": two["id"].to_numpy(), "others": linked.T.astype(np.int64) @ one["many"].to_numpy()})])

    counts = left.groupBy("component", "i", "j").applyInPandas(compare, "id long, others long")
    return inside.select("id", "component"), counts.groupBy("id").agg(F.sum("others").alias("others"))


def audit(links: DataFrame, vectors: DataFrame, link: float, count: int, inside: DataFrame | None = None) -> float:
    """The recall of AUDIT vectors (chosen by a hash), by brute force against all vectors.

    It is the mean over vectors of the share of their links that were found, so that a vector with one link counts as
    much as one in a large group; the least of this mean over all and over those with few, some and very many links.
    inside: (id, component) of vectors whose component was compared whole; links within one are found.
    """
    share = min(1.0, AUDIT / max(1, count))
    drawn = F.pmod(F.xxhash64("id", F.lit("audit")), F.lit(1 << 30)) < int(share * (1 << 30))
    queries = vectors.where(drawn).select("id", "v").limit(4 * AUDIT).collect()
    if not queries:
        return 1.0
    by: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for d in {len(r["v"]) for r in queries}:
        own = [r for r in queries if len(r["v"]) == d]
        by[d] = (np.array([r["id"] for r in own]), np.stack([np.frombuffer(bytes(r["v"])) for r in own]))

    def true(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                a, b = [], []
                for d, (ids, q) in by.items():
                    rows = [(i, v) for i, v in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist(), strict=True) if len(v) == d]
                    if rows:
                        sim = q @ np.stack([np.frombuffer(v) for _, v in rows]).T
                        own = np.array([i for i, _ in rows])
                        r, c = np.nonzero((sim >= link) & (ids[:, None] != own[None, :]))
                        a += ids[r].tolist()
                        b += own[c].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    there = vectors.select("id", "v").mapInArrow(true, "a long, b long")
    met = there.join(links.select("a", "b", F.lit(1).alias("hit")), ["a", "b"], "left")
    if inside is not None:
        ends = [inside.select(F.col("id").alias(k), F.col("component").alias(f"in_{k}")) for k in ("a", "b")]
        met = met.join(ends[0], "a", "left").join(ends[1], "b", "left").withColumn("hit", F.coalesce("hit", F.when(F.col("in_a") == F.col("in_b"), 1)))
    each = met.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("hits"))
    stratum = F.when(F.col("n") < 4, 0).when(F.col("n") < LIST, 1).when(F.col("n") < BLOCK, 2).otherwise(3)
    rows = each.groupBy(stratum.alias("stratum")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("hits") / F.col("n")).alias("recall")).collect()
    if not rows:
        return 1.0
    return min([sum(r["recall"] for r in rows) / sum(r["n"] for r in rows)] + [r["recall"] / r["n"] for r in rows if r["n"] >= STRATUM])


def find_links(vectors: DataFrame, link: float = LINK) -> tuple[DataFrame, DataFrame, float]:
    """(id, others): how many other rows each linked vector is linked with; (id, component); and the audited recall, which
    is RECALL at least."""
    none = vectors.sparkSession.range(0).select(F.col("id").alias("id"), F.col("id").alias("others"))
    counts = _by_size(vectors)
    count = sum(n for _, n in counts)
    lists, recall, links, bonds = None, 1.0, None, None
    for attempt in range(TRIES):
        for d, n in counts:
            begun = start(vectors.where(F.octet_length("v") == 8 * d), d, n, 100 * attempt + 7, tables_for(n, link) * (attempt + 1), link).withColumn("fresh", F.lit(1))
            lists = begun if lists is None else lists.unionByName(begun)
        if lists is None:
            return none, none.withColumnRenamed("others", "component"), 1.0
        lists, tied = lists_and_bonds(lists.select("a", "b", "sim", "fresh", "bond"))
        bonds = tied if bonds is None else bonds.unionByName(tied)
        known = None
        for _ in range(ROUNDS):
            state = lists.where(F.col("sim") >= link).count()
            if known is not None and state <= known * 1.001:
                break
            known = state
            lists, tied = descend(lists, vectors, count, link=link)
            bonds = bonds.unionByName(tied)
        inside, more = enlarge(lists, bonds, vectors, link)
        # A link is in the list of one end at least; whole components take the place of the lists of their members.
        own = lists.where(F.col("sim") >= link).select("a", "b").join(inside.select(F.col("id").alias("a")), "a", "left_anti")
        links = durable(own.unionByName(own.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
        recall = audit(links, vectors, link, count, inside)
        if recall >= RECALL:
            few = links.join(vectors.select(F.col("id").alias("b"), "many"), "b").groupBy(F.col("a").alias("id")).agg(F.sum("many").alias("others"))
            return few.unionByName(more), components(links).unionByName(inside), recall
        lists = lists.select("a", "b", "sim", F.lit(0).alias("fresh"), F.lit(0).alias("bond"))
    raise RecallError(f"an audited recall of {recall:.4f} after {TRIES} starts is below {RECALL}")


def near_vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", link: float = LINK) -> DataFrame:
    """Link vectors with a cosine of `link` or more: vec_id, n_links, component_id, kept.

    n_links counts the other rows linked directly, equal vectors included; component_id is the smallest id reachable;
    kept rows are their component's smallest id. Null, zero and non-finite vectors and vectors with null or non-finite
    components, or with a null id, are linked with nothing and are their own component; vectors of different dimensions
    are not linked. Ids must be unique: rows that share one are taken for different vectors of one name. Other columns
    are ignored, and an empty table gives an empty result. Links are found with an audited recall of RECALL at least, of
    the vectors drawn; with less, a RecallError is raised.
    """
    member, vectors = distinct_vectors(embeddings, id_col, vector_col)
    others, place, _ = find_links(vectors, link)
    classes = durable(vectors.select("id", "many").join(others, "id", "left").join(place, "id", "left").select(F.col("id").alias("rep"), (F.col("many") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id")))
    out = member.join(classes, "rep", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
