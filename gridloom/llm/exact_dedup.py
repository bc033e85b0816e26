"""Exact deduplication by deterministic block naming.

A text is cut into blocks of a fixed number of characters. The distinct blocks of the corpus are sorted and numbered,
so that equal blocks get equal integer names; then adjacent pairs of names are numbered in the same way, round after
round, until one name is left of each document. Two documents share a last name exactly if their texts are equal.

Distinct blocks are found on the texts themselves. For the way back from a block to its name a row carries only a
128-bit key of its block. The keys are compared with the texts first: if two different blocks of this corpus share a
key, the next seed is tried, and after the last seed the block itself is the key. So no collision can join two texts.

Everything here is DataFrame operations. A hot block or pair is pre-aggregated before each shuffle, and the joins back
to names have one row for each key on one side, so that adaptive execution can split a hot key on the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._runtime import durable, text_of

BLOCK = 2048
SEEDS = (11, 23, 47)


def normalised(text: Column) -> Column:
    """The text without characters 0x20 and 0x09 to 0x0D; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def _blocks(norm: Column, block: int) -> Column:
    """Blocks of `block` code points, in one pass over the text; the empty text is one empty block."""
    return F.when(F.char_length(norm) <= block, F.array(norm)).otherwise(F.regexp_extract_all(norm, F.lit(f"(?s).{{1,{block}}}"), F.lit(0)))


def _key(seed: int | None, block: Column) -> list[Column]:
    if seed is None:
        return [block.alias("k1"), F.lit(0).cast("long").alias("k2")]
    return [F.xxhash64(F.lit(seed), block).alias("k1"), F.xxhash64(F.lit(seed + 1), block, F.lit(seed)).alias("k2")]


def _named(distinct: DataFrame, by: list[str]) -> DataFrame:
    """Sort the distinct rows and number them: an integer name for each."""
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return durable(distinct.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id()))


def block_names(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per input row: _row (its number), doc_id, n_chars, text_sha256, level and name (the text's identity)."""
    norm = normalised(F.col(text_col))
    texts = docs.select(F.explode(_blocks(norm, block)).alias("block"))
    for seed in (*SEEDS, None):
        k1, k2 = _key(seed, F.col("block"))
        distinct = texts.select(k1, k2, "block").groupBy("k1", "k2", "block").agg(F.lit(1).alias("one"))
        keys = durable(distinct.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("texts")))
        if seed is None or keys.where("texts > 1").isEmpty():
            break
    names = _named(keys.select("k1", "k2"), ["k1", "k2"])

    def keyed(b: Column) -> Column:
        k1, k2 = _key(seed, b)
        return F.struct(k1, k2)

    rows = durable(
        docs.select(F.col(id_col).alias("doc_id"), F.char_length(text_of(text_col)).cast("long").alias("n_chars"), norm.alias("_norm"))
        .select("doc_id", "n_chars", F.sha2(F.encode("_norm", "UTF-8"), 256).alias("text_sha256"), F.transform(_blocks(F.col("_norm"), block), keyed).alias("keys"))
        .withColumn("_row", F.monotonically_increasing_id())
    )
    # The keys are ready; from here on rows are a few integers each.
    level, here = 0, rows.select("_row", F.size("keys").alias("n"), F.posexplode("keys").alias("pos", "key")).select("_row", "n", "pos", "key.k1", "key.k2")
    here = durable(here.join(names, ["k1", "k2"]).select("_row", "n", "pos", "name"))
    done = here.where("n = 1").select("_row", F.lit(0).alias("level"), "name")
    here = here.where("n > 1")
    while not here.isEmpty():
        level += 1
        odd = F.col("pos") % 2 == 1
        pairs = here.groupBy("_row", "n", F.expr("pos div 2").cast("int").alias("pos")).agg(F.max(F.when(~odd, F.col("name"))).alias("k1"), F.coalesce(F.max(F.when(odd, F.col("name"))), F.lit(-1)).alias("k2"))
        pairs = durable(pairs.withColumn("n", F.expr("(n + 1) div 2").cast("int")))
        names = _named(pairs.groupBy("k1", "k2").agg(F.lit(1).alias("one")).select("k1", "k2"), ["k1", "k2"])
        here = durable(pairs.join(names, ["k1", "k2"]).select("_row", "n", "pos", "name"))
        done = done.unionByName(here.where("n = 1").select("_row", F.lit(level).alias("level"), "name"))
        here = here.where("n > 1")
    return rows.drop("keys").join(done, "_row")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Group equal texts and choose the one that stays.

    Texts are equal when identical without white space (see `normalised`). Of equal texts the row with the most code
    points in its original text stays, then the smallest id. Returns a row per input row: doc_id, keep_id, group_size,
    kept, text_sha256.

    Null text counts as empty, and all empty texts are one group. A null id comes after all others; if a row that
    stays has no id, keep_id is null. Of repeated rows (same id and text) exactly one is kept. Other columns are
    ignored, whatever their names. An empty table gives an empty result.
    """
    named = durable(block_names(docs, id_col, text_col, block))
    # The complement orders integers the other way round, without overflow; a null id loses to any other.
    best = F.max(F.struct("n_chars", F.col("doc_id").isNotNull().alias("known"), F.bitwise_not("doc_id").alias("order"), F.bitwise_not("_row").alias("row"), "doc_id"))
    groups = named.groupBy("level", "name").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best"))
    groups = groups.select("level", "name", "group_size", F.col("best.doc_id").alias("keep_id"), F.bitwise_not("best.row").alias("_keep"))
    return named.join(groups, ["level", "name"]).select("doc_id", "keep_id", "group_size", (F.col("_keep") == F.col("_row")).alias("kept"), "text_sha256")
