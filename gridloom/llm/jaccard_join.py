"""Exact Jaccard self-join on word shingles, with skipping by set relations.

Answer level: sets that are very alike have nearly the same answers. Equal sets are one set from the start. Each other
set is compared once with a leader that it seems alike to, and is from then on its leader and the shingles that differ.
Where the threshold is met it takes over its leader's component, and two sets of one component are never paired. Two
followers of one leader differ by what their differences do not share, so they are joined on their differences alone,
which are few and rare; and the overlap of two sets is derived from that of their leaders, which is counted once.

Index level: of an inverted index over prefixes (of sets, and of followers' differences), a pair is formed only where
both positions would do for its first shared shingle. Lists are kept in blocks by what their entries ask of a partner,
each in order of what positions leave; a bisection finds the run that will do, and the rest of the block is skipped.

Prefixes use one global order of shingles: those of one set only, rare ones, then frequent ones by frequency (each by
hash). The order decides only how much work there is; every order gives the same links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._runtime import durable, parts, sieved, tidy
from ._words import WIDTH, mix, shingle_sets, slices

#: Min-hashes of a set; the first KEYS of them look for a leader.
HASHES, KEYS, ALIKE = 16, 6, 9
#: Sizes of what is sent to all executors: 2**SEEN_BITS bits (least and most) for the hashes of shingles in two sets or
#: more, and the frequent shingles.
SEEN_BITS, FREQUENT, FREQUENT_LEAST = (26, 28), 1 << 19, 64
#: Shingles that are counted at a time; pairs that share a load of one set; entries of a list that are paired in one task.
COUNTED, SHARE, LISTED = 1 << 20, 256, 1 << 18
#: Lists of fewer entries are paired many at a time.
SHORT = 24
ENTRY = np.dtype([("token", "<u8"), ("id", "<i8"), ("comp", "<i8"), ("group", "<i8"), ("n", "<i4"), ("d", "<i4"), ("pos", "<i4")])


def enough(overlap: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes a and b with this overlap are linked: 100 * overlap >= percent * union."""
    return (100 + percent) * overlap >= percent * (a + b)


def prefix_size(n: int, percent: int) -> int:
    """How many of a set's first shingles must meet any linked set's first shingles."""
    return n - -(-percent * n // 100) + 1


def _short(tokens: np.ndarray) -> np.ndarray:
    return (tokens & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _docs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))


def describe_sets(docs: DataFrame, width: int) -> DataFrame:
    """id, n, k1, k2 (a 128-bit key of the set) and HASHES min-hashes of each row."""
    seeds = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column("text"), width)
                n = np.array([len(s) for s in sets], np.int64)
                flat = np.concatenate([*sets, np.zeros(1, np.uint64)])
                begin = np.cumsum(n) - n
                some = n > 0
                at = begin[some]

                def each(op: np.ufunc, values: np.ndarray, at: np.ndarray = at, some: np.ndarray = some) -> np.ndarray:
                    out = np.zeros(len(some), np.uint64)
                    if len(at):
                        out[some] = op.reduceat(values[:-1], at)
                    return out

                k1, k2 = each(np.add, mix(flat ^ seeds[0])), each(np.add, mix(flat + seeds[1]))
                hashes = np.stack([each(np.minimum, (flat ^ s) * np.uint64(0xE7037ED1A0B428DB) ^ (flat >> np.uint64(29))) for s in seeds], axis=1)
                hashes = (hashes >> np.uint64(32)).astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(n), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(list(hashes.view(np.int32)), pa.list_(pa.int32()))],
                    names=["id", "n", "k1", "k2", "hashes"],
                )

    return docs.mapInArrow(tidy(run), "id long, n long, k1 long, k2 long, hashes array<int>")


def _count_frequent(docs: DataFrame, width: int, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of all shingles over all documents.

    Every shingle is counted: where an edited copy's own shingles all come first, its prefix holds so few of those that
    its group shares that most pairs of the group are never formed.

    They are told by their place in pieces (the first bits) and their short hash in there, so that with more shingles
    there are more bits to tell them by.

    Returns the sorted short hashes of the frequent ones (FREQUENT at most: the limit is raised until they fit), the
    logarithm (to 2) of their counts, and a bit map of those in two sets or more.
    """
    spark = docs.sparkSession
    pieces = min(1 << 15, 1 << int(np.ceil(np.log2(4 * parts(spark, total, 1 << 21)))))
    shift = 64 - int(np.log2(pieces))
    seen_bits = min(max(int(np.ceil(np.log2(max(total, 1)))), SEEN_BITS[0]), SEEN_BITS[1])

    def cut(held: list[np.ndarray]) -> pa.RecordBatch:
        tokens, counts = np.unique(np.concatenate([*held, np.zeros(0, np.uint64)]), return_counts=True)
        short = _short(tokens)
        cuts = np.searchsorted(tokens >> np.uint64(shift), np.arange(pieces + 1, dtype=np.uint64))
        full = np.flatnonzero(np.diff(cuts))
        blobs = [short[cuts[p] : cuts[p + 1]].astype("<u4").tobytes() + np.minimum(counts[cuts[p] : cuts[p + 1]], 65535).astype("<u2").tobytes() for p in full]
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(blobs, pa.binary())], names=["p", "blob"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in batches:
            for part in slices(batch):
                held += shingle_sets(part.column("text"), width)
                many = sum(map(len, held))
                if many >= COUNTED:
                    yield cut(held)
                    held = []
        yield cut(held)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[bytes]] = {}
        for batch in batches:
            for p, blob in zip(batch.column("p").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                by.setdefault(p, []).append(blob)
        ps, bits, hot = [], [], []
        for p, blobs in by.items():
            short = np.concatenate([np.frombuffer(b, "<u4", len(b) // 6) for b in blobs])
            times = np.concatenate([np.frombuffer(b, "<u2", len(b) // 6, len(b) // 6 * 4) for b in blobs]).astype(np.int64)
            order = np.argsort(short, kind="stable")
            short, times = short[order], times[order]
            first = np.flatnonzero(np.concatenate(([True], short[1:] != short[:-1])))
            sums = np.add.reduceat(times, first)
            short = short[first]
            seen = np.zeros((1 << seen_bits) // pieces, np.uint8)
            seen[short[sums > 1] & np.uint32(len(seen) - 1)] = 1
            frequent = sums >= FREQUENT_LEAST
            ps.append(p)
            bits.append(np.packbits(seen).tobytes())
            hot.append(short[frequent].astype("<u4").tobytes() + np.minimum(sums[frequent], 2**31 - 1).astype("<u4").tobytes())
        if ps:
            yield pa.RecordBatch.from_arrays([pa.array(ps, pa.int64()), pa.array(bits, pa.binary()), pa.array(hot, pa.binary())], names=["p", "bits", "hot"])

    counted = durable(docs.mapInArrow(tidy(deal), "p long, blob binary").repartition(parts(spark, pieces, 4), "p").mapInArrow(tidy(count), "p long, bits binary, hot binary"))

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(32, np.int64)
        for batch in batches:
            for blob in batch.column("hot").to_pylist():
                total += np.bincount(np.log2(np.maximum(np.frombuffer(blob, "<u4", len(blob) // 8, len(blob) // 2), 1)).astype(int), minlength=32)[:32]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(32)), pa.array(total)], names=["bin", "n"])

    least, many = FREQUENT_LEAST, 0
    for row in sorted(counted.select("hot").mapInArrow(tidy(bins), "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect(), key=lambda r: -r["bin"]):
        many += row["n"]
        if many > FREQUENT:
            least = max(least, 2 << row["bin"])
            break

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for blob in batch.column("hot").to_pylist():
                n = len(blob) // 8
                times = np.frombuffer(blob, "<u4", n, 4 * n)
                use = times >= least
                out.append(np.frombuffer(blob, "<u4", n)[use].tobytes() + np.log2(times[use]).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("p"), batch.column("bits"), pa.array(out, pa.binary())], names=["p", "bits", "hot"])

    rows = sorted(counted.mapInArrow(tidy(chosen), "p long, bits binary, hot binary").collect(), key=lambda r: r["p"])
    seen = np.zeros((1 << seen_bits) // 8, np.uint8)
    step = len(seen) // pieces
    for r in rows:
        seen[r["p"] * step : (r["p"] + 1) * step] = np.frombuffer(r["bits"], np.uint8)[:step]
    size = [len(r["hot"]) // 5 for r in rows]
    hot = np.concatenate([np.frombuffer(r["hot"], "<u4", n) for r, n in zip(rows, size, strict=True)] or [np.zeros(0, "<u4")])
    log = np.concatenate([np.frombuffer(r["hot"], np.uint8, n, 4 * n) for r, n in zip(rows, size, strict=True)] or [np.zeros(0, np.uint8)])
    order = np.argsort(hot, kind="stable")
    return hot[order], log[order], seen.reshape(pieces, step)


def _ranks(tokens: np.ndarray, hot: np.ndarray, log: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Where a shingle stands in the global order: 0 in one set only, 1 rare, from 2 on by frequency."""
    short = _short(tokens)
    pieces, step = seen.shape
    piece = (tokens >> np.uint64(64 - int(np.log2(pieces)))).astype(np.int64) if pieces > 1 else np.zeros(len(tokens), np.int64)
    at = short & np.uint32(8 * step - 1)
    out = (seen[piece, at >> 3] >> (np.uint8(7) - (at & np.uint32(7)).astype(np.uint8))) & np.uint8(1)
    if len(hot) and len(short):
        at = np.minimum(np.searchsorted(hot, short), len(hot) - 1)
        out = np.where(hot[at] == short, log[at] + np.uint8(2), out)
    return out


def _in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values


def _of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of `docs` with an id in `ids` (column id), and few others: texts are never dealt by their ids."""
    return sieved(docs, "id", ids).where("sieved").drop("sieved")


def _shingles(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """id, shingles (sorted 64-bit hashes) of the documents with an id in `ids`, and of few others."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([s.tobytes() for s in shingle_sets(part.column("text"), width)], pa.binary())], names=["id", "shingles"])

    # Repeated rows of one id have equal sets: one is enough.
    return _of(docs, ids).mapInArrow(tidy(sets), "id long, shingles binary").groupBy("id").agg(F.first("shingles").alias("shingles"))


class _Answers:
    """Overlaps of sets that are given as a base and the sorted shingles in which they differ from it.

    Two bases are held at a time. Their overlap is counted once; that of two sets follows from it by their differences.
    """

    def __init__(self, percent: int):
        self.percent, self.hub, self.base, self.common = percent, np.zeros(0, np.uint64), np.zeros(0, np.uint64), 0

    def meet(self, base: np.ndarray) -> None:
        self.base = base
        short, long = (base, self.hub) if len(base) < len(self.hub) else (self.hub, base)
        self.common = int(np.count_nonzero(_in(short, long)))

    def linked(self, da: np.ndarray, db: np.ndarray) -> bool:
        """Whether base with `da` changed and hub with `db` changed are linked."""
        common, na, nb = self.common, len(self.base), len(self.hub)
        if len(da):
            out, there = np.where(_in(da, self.base), -1, 1), _in(da, self.hub)
            na, common = na + int(out.sum()), common + int(out[there].sum())
        if len(db):
            out = np.where(_in(db, self.hub), -1, 1)
            there = _in(db, self.base) ^ _in(db, da)
            nb, common = nb + int(out.sum()), common + int(out[there].sum())
        return na > 0 and nb > 0 and bool(enough(common, na, nb, self.percent))


def answers(docs: DataFrame, pairs: DataFrame, width: int, percent: int, follow: bool = False) -> DataFrame:
    """Whether each of `pairs` is linked: a, b, linked; with `follow` also the shingles in which a's base and hub differ
    (change), and a bit for each that is the hub's (lost).

    pairs: a, base, da, b, hub, db: set a is the set of document `base` with the shingles `da` changed (null: none), set
    b the same with `hub` and `db`. A hub is loaded once for SHARE pairs or so, and each base that it meets once there.
    """
    spark = docs.sparkSession
    many = pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("many"))
    salted = durable(pairs.join(many, "hub").withColumn("salt", F.expr(f"cast(pmod(xxhash64(a, b), (many + {SHARE - 1}) div {SHARE}) as int)")).drop("many"))
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    loads = salted.select(F.col("hub").alias("id"), "hub", "salt", none("base", "long")).unionByName(salted.select(F.col("base").alias("id"), "hub", "salt", "base"))
    loads = durable(loads.distinct())
    # Sets are dealt by id once, and from there to their hubs.
    held = loads.join(_shingles(docs, loads.select("id").distinct(), width), "id").select("hub", "salt", "base", none("a", "long"), none("b", "long"), "shingles", none("da", "binary"), none("db", "binary"))
    rows = held.unionByName(salted.select("hub", "salt", "base", "a", "b", none("shingles", "binary"), "da", "db"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, change, lost = _Answers(percent), b"", b""
        words = lambda x: np.frombuffer(x.as_buffer(), np.uint64) if x.is_valid else np.zeros(0, np.uint64)
        for batch in batches:
            a, b, linked, changes, gone = [], [], [], [], []
            for base, x, y, s, da, db in zip(*(batch.column(c) for c in ("base", "a", "b", "shingles", "da", "db")), strict=True):
                if not base.is_valid:
                    state.hub = words(s).copy()
                elif not x.is_valid:
                    state.meet(words(s).copy())
                    apart = np.setxor1d(state.base, state.hub, assume_unique=True)
                    change, lost = apart.tobytes(), np.packbits(_in(apart, state.hub)).tobytes()
                else:
                    a.append(x.as_py())
                    b.append(y.as_py())
                    linked.append(state.linked(words(da), words(db)))
                    changes.append(change if follow else None)
                    gone.append(lost if follow else None)
            columns = [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(linked, pa.bool_()), pa.array(changes, pa.binary()), pa.array(gone, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "linked", "change", "lost"])

    # Nulls come first: a hub before its bases, a base before its pairs.
    n = parts(spark, salted.count(), 1 << 16)
    dealt = rows.repartition(n, "hub", "salt").sortWithinPartitions("hub", "salt", "base", "a", "b")
    return dealt.mapInArrow(tidy(compare), "a long, b long, linked boolean, change binary, lost binary")


def leader_pairs(reps: DataFrame) -> DataFrame:
    """Each set (a) with a leader (b) that it shares one of KEYS min-hashes with.

    The leader of a min-hash value is the set whose own values are shared by most (then the smallest id): in a group of
    edited copies that is the text that most of them are near to. Of its leaders a set takes the first by that order
    that is ALIKE by an estimate from all min-hashes. All this chooses where to look first and decides nothing.
    """
    keys = reps.select("id", F.posexplode(F.slice("hashes", 1, KEYS)).alias("at", "hash"))
    shared = keys.groupBy("at", "hash").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    keys = durable(keys.join(shared, ["at", "hash"]))
    weight = keys.groupBy("id").agg(F.sum("many").alias("weight")).join(reps.select("id", "hashes"), "id")
    keys = durable(keys.drop("many").join(weight, "id"))
    best = F.max(F.struct("weight", (-F.col("id")).alias("id"), F.col("hashes").alias("theirs"))).alias("best")
    leaders = keys.groupBy("at", "hash").agg(best).select("at", "hash", (-F.col("best.id")).alias("leader"), F.col("best.weight").alias("above"), "best.theirs")
    likeness = F.aggregate(F.zip_with("hashes", "theirs", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    close = keys.join(leaders, ["at", "hash"]).where("id <> leader").select("id", "leader", "above", likeness.alias("alike")).where(F.col("alike") >= ALIKE)
    return close.groupBy("id").agg(F.max(F.struct("above", (-F.col("leader")).alias("leader"))).alias("best")).select(F.col("id").alias("a"), (-F.col("best.leader")).alias("b"))


def _may_link(run: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether entries i and j of a list may be of linked sets and share their first shingle here.

    Sets may differ in `most` shingles; of d + d those that are shared count for neither. All shared ones stand at the
    first one's positions or later, so both positions must leave that many.
    """
    n, d, pos = (run[k].astype(np.int64) for k in ("n", "d", "pos"))
    most = (100 - percent) * (n[i] + n[j]) // (100 + percent)
    least = (d[i] + d[j] - most + 1) // 2
    return (run["comp"][i] != run["comp"][j]) & (run["group"][i] != run["group"][j]) & (pos[i] <= d[i] - least) & (pos[j] <= d[j] - least)


def _short_lists(runs: np.ndarray, size: int, percent: int) -> np.ndarray:
    """Pairs of many lists of `size` entries each, that stand on end."""
    i, j = np.triu_indices(size, 1)
    i, j = ((np.arange(0, len(runs), size)[:, None] + x[None, :]).ravel() for x in (i, j))
    use = _may_link(runs, i, j, percent)
    return np.stack((runs["id"][i[use]], runs["id"][j[use]]), axis=1)


def _list_pairs(run: np.ndarray, percent: int, found: list[np.ndarray]) -> None:
    """Pairs of different components and groups in one index list that may share their first shingle here.

    With r the share of both sizes that may differ, the position of y will do for x if `left` of y (d + r n - 2 pos) is
    `need` of x (d - r n) at least. Blocks hold entries of about one need, each in descending order of what is left.
    Entries of the component or group that has most of them are met by the others only.
    """
    main, most = None, 0
    for k in ("comp", "group"):
        values, counts = np.unique(run[k], return_counts=True)
        if len(values) < 2:
            return
        if counts.max() > most:
            main, most = run[k] == values[np.argmax(counts)], counts.max()
    r = (100 - percent) / (100 + percent)
    need = run["d"] - r * run["n"]
    left = run["d"] + r * run["n"] - 2.0 * run["pos"]
    block = np.floor(np.log2(np.maximum(need, 1)) * 3).astype(np.int64)
    order = np.lexsort((-left, block))
    run, main, need, left, block = run[order], main[order], need[order], left[order], block[order]
    others = np.flatnonzero(~main)
    bounds = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1], [True])))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        # What x leaves must do for the least need of the block, else the block is skipped.
        x = others[left[others] >= need[a:b].min() - 2]
        width = np.searchsorted(-left[a:b], 2 - need[x], "right")
        x, width = x[width > 0], width[width > 0]
        upto, begin = np.cumsum(width), 0
        while begin < len(x):
            # As many entries at a time as make some million pairs.
            before = upto[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(upto, before + 1_000_000, "right")))
            w = width[begin:end]
            i = np.repeat(x[begin:end], w)
            j = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w) + a
            # Two entries outside the main part meet twice; once is enough.
            i, j = (v[main[j] | (i < j)] for v in (i, j))
            use = _may_link(run, i, j, percent)
            if use.any():
                found.append(np.stack((run["id"][i[use]], run["id"][j[use]]), axis=1))
            begin = end


def candidates(docs: DataFrame, reps: DataFrame, width: int, percent: int, total: int) -> DataFrame:
    """Distinct pairs (a, b) of sets of different components that may be linked.

    reps: id, n, component, leader, change and lost (what differs from the leader, and a bit for each that is the
    leader's; null where there is none). Of equal sets only one is counted and listed, but for what the sieve lets pass.
    """
    spark = docs.sparkSession
    docs = _of(docs, reps.select("id"))
    sent = spark.sparkContext.broadcast(_count_frequent(docs, width, total))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ids, rows = part.column("id").to_pylist(), []
                for s in shingle_sets(part.column("text"), width):
                    rank = _ranks(s, *sent.value)
                    order = np.argsort(rank, kind="stable")[: prefix_size(len(s), percent)] if len(s) else np.zeros(0, np.int64)
                    at = np.flatnonzero(rank[order])
                    rows.append(s[order][at].astype("<u8").tobytes() + at.astype("<i4").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.binary())], names=["id", "prefix"])

    entries = max(1, total * (100 - percent) // 100)
    pieces, listed = 8 * parts(spark, entries, 1 << 19), LISTED

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for i, n, comp, leader, change, lost, blob in zip(*(batch.column(c).to_pylist() for c in ("id", "n", "component", "leader", "change", "lost", "prefix")), strict=True):
                k = len(blob or b"") // 12
                e = np.empty(k, ENTRY)
                e["token"], e["pos"] = np.frombuffer(blob or b"", "<u8", k), np.frombuffer(blob or b"", "<i4", k, 8 * k)
                e["d"], e["group"] = n, i if leader is None else leader
                parts = [e]
                if change:
                    # Differences have lists of their own for each leader; there all are of different groups.
                    change = np.frombuffer(change, np.uint64)
                    rank = _ranks(change, *sent.value)
                    order = np.argsort(rank, kind="stable")
                    # What only the leader has is lost by each follower that lacks it: that is shared by their differences.
                    theirs = np.unpackbits(np.frombuffer(lost, np.uint8), count=len(change))
                    at = np.flatnonzero((rank | theirs)[order])
                    at = at[2 * at * (100 + percent) <= len(change) * (100 + percent) + (100 - percent) * (2 * n + len(change))]
                    e = np.empty(len(at), ENTRY)
                    e["token"], e["pos"] = mix(change[order][at] ^ mix(np.array([leader]).astype(np.uint64))), at
                    e["d"], e["group"] = len(change), i
                    parts.append(e)
                for e in parts:
                    e["id"], e["comp"], e["n"] = i, comp, n
                made += parts
            if not made:
                continue
            made = _parted(np.concatenate(made), *sent.value[:2], listed)
            piece = (mix(made["token"]) % np.uint64(pieces)).astype(np.int64)
            made = made[order := np.argsort(piece, kind="stable")]
            cuts = np.searchsorted(piece[order], np.arange(pieces + 1))
            full = np.flatnonzero(np.diff(cuts))
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array([made[cuts[p] : cuts[p + 1]].tobytes() for p in full], pa.binary())], names=["p", "blob"])

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[bytes]] = {}
        for batch in batches:
            for p, blob in zip(batch.column("p").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                by.setdefault(p, []).append(blob)
        while by:
            made = np.frombuffer(b"".join(by.popitem()[1]), ENTRY)
            made = made[np.argsort(made["token"], kind="stable")]
            first = np.flatnonzero(np.concatenate(([True], made["token"][1:] != made["token"][:-1])))
            size = np.diff(np.append(first, len(made)))
            found: list[np.ndarray] = []
            for k in range(2, SHORT):
                at = first[size == k]
                step = max(1, (1 << 20) // (k * k))
                for c in range(0, len(at), step):
                    found.append(_short_lists(made[(at[c : c + step, None] + np.arange(k)[None, :]).ravel()], k, percent))
            for a, k in zip(first[size >= SHORT].tolist(), size[size >= SHORT].tolist(), strict=True):
                _list_pairs(made[a : a + k], percent, found)
                if sum(map(len, found[-64:])) > 500_000 or len(found) > 20_000:
                    found = [distinct(found)]
                    if len(found[0]) > 250_000:
                        yield batched(found.pop())
            if found:
                yield batched(distinct(found))

    def distinct(found: list[np.ndarray]) -> np.ndarray:
        both = np.sort(np.concatenate(found), axis=1)
        both = both[np.lexsort((both[:, 1], both[:, 0]))]
        return both[np.concatenate((np.ones(min(1, len(both)), bool), (both[1:] != both[:-1]).any(axis=1)))]

    def batched(both: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    # Repeated rows of one id are one set.
    prefixed = docs.mapInArrow(tidy(prefixes), "id long, prefix binary").where(F.octet_length("prefix") > 0).groupBy("id").agg(F.first("prefix").alias("prefix"))
    joined = reps.select("id", "n", "component", "leader", "change", "lost").join(prefixed, "id", "left").where("prefix IS NOT NULL OR change IS NOT NULL")
    return joined.mapInArrow(tidy(deal), "p long, blob binary").repartition(parts(spark, entries, 1 << 19), "p").mapInArrow(tidy(lists), "a long, b long").distinct()


def _parted(entries: np.ndarray, hot: np.ndarray, log: np.ndarray, listed: int) -> np.ndarray:
    """The entries, those of very long lists as often as their list has parts.

    A list of more than `listed` sets is cut into k parts by a hash of the id, and each two parts (and each with itself)
    are a list of their own, so that no task has to hold a list whole. Pairs that meet in several are one in the end.
    """
    rank = _ranks(entries["token"], hot, log, np.zeros((1, 1), np.uint8)).astype(np.int64) - 2
    long = np.maximum(rank + 1 - int(np.log2(listed)), 0)
    out = [entries[long == 0]]
    for bits in np.unique(long[long > 0]):
        k = 1 << int(bits)
        own = entries[long == bits]
        part = (mix(own["id"].astype(np.uint64)) % np.uint64(k)).astype(np.int64)
        for other in range(k):
            cell = np.minimum(part, other) * k + np.maximum(part, other) + 1
            copy = own.copy()
            copy["token"] = mix(own["token"] ^ mix(cell.astype(np.uint64)))
            out.append(copy)
    return np.concatenate(out)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = 80) -> DataFrame:
    """Link documents whose shingle sets have a Jaccard similarity of `percent` per cent or more.

    Words are runs of characters other than 0x20 and 0x09 to 0x0D, A-Z lower-cased; shingles are compared by 64-bit
    hashes. Returns a row per input row: doc_id, n_shingles, component_id (the smallest id reachable by links, itself
    included) and class_id (the smallest id with an equal set).

    Null and empty texts and texts without words have no shingles and are linked with nothing. Rows with a null id are
    linked with nothing and have a null component. Repeated rows of one id have one component. Ids must be integers;
    rows of one id are taken to have one text. Other columns are ignored.
    """
    texts = _docs(docs, id_col, text_col)
    every = durable(describe_sets(texts, width))
    known = texts.where(F.col("id").isNotNull())
    some = every.where((F.col("n") > 0) & F.col("id").isNotNull())
    classes = durable(some.groupBy("k1", "k2", "n").agg(F.min("id").alias("rep"), F.first("hashes").alias("hashes")))
    reps = classes.select(F.col("rep").alias("id"), "n", "hashes").dropDuplicates(["id"])
    total = reps.agg(F.sum("n")).first()[0] or 0
    none = lambda name: F.lit(None).cast("binary").alias(name)
    led = durable(leader_pairs(reps)).select("a", F.col("a").alias("base"), none("da"), "b", F.col("b").alias("hub"), none("db"))
    near = durable(answers(known, led, width, percent, follow=True))
    first = components(near.where("linked").select("a", "b"))
    # From here on a follower is its leader and what differs.
    follows = near.select(F.col("a").alias("id"), F.col("b").alias("leader"), "change", "lost")
    placed = reps.select("id", "n").join(first, "id", "left").select("id", "n", F.coalesce("component", "id").alias("component"))
    placed = durable(placed.join(follows, "id", "left"))
    far = durable(candidates(known, placed, width, percent, total))
    side = lambda i, base, change: follows.select(F.col("id").alias(i), F.col("leader").alias(base), F.col("change").alias(change))
    changed = far.join(side("a", "base", "da"), "a", "left").join(side("b", "hub", "db"), "b", "left").withColumns({"base": F.coalesce("base", "a"), "hub": F.coalesce("hub", "b")})
    # The one that more pairs ask for is the hub.
    asked = durable(changed.select(F.explode(F.array("base", "hub")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("many")))
    weighed = changed.join(asked.select(F.col("id").alias("base"), F.col("many").alias("mb")), "base").join(asked.select(F.col("id").alias("hub"), F.col("many").alias("mh")), "hub")
    turned = F.when(F.col("mb") > F.col("mh"), F.struct(F.col("b").alias("a"), F.col("hub").alias("base"), F.col("db").alias("da"), F.col("a").alias("b"), F.col("base").alias("hub"), F.col("da").alias("db"))).otherwise(F.struct("a", "base", "da", "b", "hub", "db"))
    linked = durable(answers(known, weighed.select(turned.alias("t")).select("t.*"), width, percent).where("linked").select("a", "b"))
    last = durable(components(near.where("linked").select("a", "b").unionByName(linked)))
    owner = classes.select("k1", "k2", "n", "rep").join(last.withColumnRenamed("id", "rep"), "rep", "left").select("k1", "k2", "n", F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("component_id"))
    joined = some.select("id", "n", "k1", "k2").join(owner, ["k1", "k2", "n"]).select("id", "n", "component_id", "class_id")
    alone = every.where((F.col("n") == 0) | F.col("id").isNull()).select("id", "n", F.col("id").alias("component_id"), F.col("id").alias("class_id"))
    return joined.unionByName(alone).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", "class_id")
