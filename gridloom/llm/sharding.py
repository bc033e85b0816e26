"""Sharding along a Hilbert curve.

Several metadata columns are quantised to a fixed number of bits by the ranks of their values, rows are sorted by their place on the Hilbert curve
through those cells, and the sorted run is cut into shards with the same number of rows. Neighbours on the curve are
close in every dimension, so each shard (and each file and row group in it) covers a small range of all of them and
filters on any of them can skip most files.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ._runtime import durable, fresh, global_rank, text_of

BITS = 10


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of `cells` (n x dims, values under 2**bits; dims * bits under 63).

    The axes are transformed bit plane by bit plane as in J. Skilling, "Programming the Hilbert curve" (2004).
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flips = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flips = np.where((x[dims - 1] & q) != 0, flips ^ (q - 1), flips)
        q >>= 1
    x ^= flips
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def hilbert_order(df: DataFrame, dims: dict[str, Column], bits: int = BITS, curve: str = "curve") -> DataFrame:
    """Add `curve`: the place of each row's quantised `dims` on the Hilbert curve.

    The distinct values of a dimension are ranked (null first) and their ranks scaled to the cells, so that values that
    begin alike or lie close together still get cells of their own. `df` is read several times, so it should be durable;
    it must not have a column named like `curve`, other names don't matter.
    """
    if curve.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the table has a column {curve}")
    names = fresh(df, *[f"_dim{i}" for i in range(len(dims))])
    valued = df.select("*", *[c.alias(n) for n, c in zip(names, dims.values(), strict=True)])
    base = valued
    for n in names:
        distinct = durable(base.select(F.col(n).alias("value")).distinct())
        count = max(1, distinct.count())
        cell = F.expr(f"rank * {1 << bits} div {max(count, 1 << bits)}") if count > 1 << bits else F.expr(f"rank * {(1 << bits) - 1} div {max(count - 1, 1)}")
        cells = durable(global_rank(distinct, ["value"]).select("value", cell.cast("long").alias("cell")))
        rest = [c for c in valued.columns if c != n]
        valued = valued.join(cells, valued[n].eqNullSafe(cells["value"])).select(*[F.col(f"`{c}`") for c in rest], F.col("cell").alias(n))

    @F.pandas_udf(LongType())
    def place(*cells: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([c.to_numpy() for c in cells], axis=1), bits))

    return valued.withColumn(curve, place(*[F.col(n) for n in names])).drop(*names)


def document_meta(docs: DataFrame, whole: bool = False) -> DataFrame:
    """What the shards are cut by: doc_id, size (bytes and 1), text_crc32, lang and source; with `whole` also the row."""
    text = F.encode(text_of("text"), "UTF-8")
    extra = [F.col(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("lang", "source")]
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole else []
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), *extra, *row)


def _placed(meta: DataFrame, shards: int, bits: int) -> DataFrame:
    """`meta` with curve, shard and slot."""
    dims = {"source": F.col("source"), "lang": F.col("lang"), "size": F.col("size")}
    ordered = hilbert_order(durable(meta), dims, bits).drop("lang", "source")
    ranked = global_rank(ordered, ["curve", "doc_id", "size", "text_crc32"])
    total = ranked.count()
    ranked = ranked.withColumn("shard", F.expr(f"cast(rank * {shards} div {max(total, 1)} as int)"))
    first = F.expr(f"(shard * cast({total} as bigint) + {shards - 1}) div {shards}")
    return ranked.withColumn("slot", F.col("rank") - first).drop("rank")


def hilbert_shards(docs: DataFrame, shards: int = 8, bits: int = BITS) -> DataFrame:
    """Cut documents into `shards` runs along a Hilbert curve over source, language and size.

    The law is `rows`: the shards' row counts are at most one apart. Returns doc_id, size, text_crc32, law, shard, slot
    (place in the shard, from 0) and grown_shard (null: it is for shards by key), and the curve index.

    Null text counts as empty. Rows in one cell are ordered by id (null first), size and text_crc32; rows that all these
    leave tied are equal and take neighbouring slots. Missing lang or source columns count as null, other columns are
    ignored. With fewer rows than shards some shards stay empty.
    """
    placed = _placed(document_meta(docs), shards, bits)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def write_shards(docs: DataFrame, path: str, shards: int = 8, bits: int = BITS) -> None:
    """Write the documents themselves, each row once, as one folder per shard, in curve order within each file.

    The rows go along with their places, so repeated and null ids are like all others. A column named `shard` (whatever
    its case) can't be written beside the folders' and is an error.
    """
    if "shard" in {c.lower() for c in docs.columns}:
        raise ValueError("the table has a column shard")
    placed = _placed(document_meta(docs, whole=True), shards, bits)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.repartitionByRange(max(n, shards), "shard", "slot").sortWithinPartitions("shard", "slot")
    dealt.select("row.*", "shard").write.partitionBy("shard").parquet(path)
