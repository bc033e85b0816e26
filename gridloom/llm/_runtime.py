"""Session helpers shared by the operators: reading tables, durable steps, global ranks."""

from __future__ import annotations

import ctypes
import functools
import sys
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and go on from there.

    The folder is the one the session names in spark.checkpoint.dir; only on one machine (tests, a laptop) is a
    temporary one set where none is named.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="gridloom-"))
    return df.checkpoint(eager=True)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` for mapInArrow, after which a worker gives memory that it has freed back to the system.

    Spark uses its Python workers again for later tasks and stages; what the allocators keep would stand beside the
    executor's heap for as long.
    """

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
                if trim:
                    trim(0)

    return wrapped


def parts(spark: SparkSession, rows: int, per_part: int, least: int | None = None) -> int:
    """A number of partitions that grows with the rows."""
    return max(int(least or spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_part))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like `names` that `df` does not have (case aside)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def global_rank(df: DataFrame, order: list[str], name: str = "rank", partitions: int | None = None) -> DataFrame:
    """Add each row's place (from 0) in the total order of `order`, without a single-partition window.

    Rows are range-partitioned and sorted; what goes through one task is the row count of each partition. `order`
    must tell rows apart (or rows that it leaves tied must be interchangeable) and should be cheap to compute: pass a
    durable frame. `df` must not have a column `name`; other names don't matter.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = 33
    at, part, before = fresh(df, "_at", "_part", "_before")
    ranged = durable(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()))
    counts = ranged.groupBy(F.shiftright(at, bits).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    rows, total = [], 0
    for row in sorted(counts, key=lambda r: r["p"]):
        rows.append(f"({row['p']}L, {total}L)")
        total += row["n"]
    # A row for each partition, as a local relation of the plan: no Python workers make it.
    starts = spark.sql(f"SELECT p AS `{part}`, b AS `{before}` FROM VALUES {', '.join(rows or ['(0L, 0L)'])} AS t(p, b)")
    placed = ranged.withColumn(part, F.shiftright(at, bits)).join(F.broadcast(starts), part)
    return placed.withColumn(name, F.col(before) + F.col(at).bitwiseAND(F.lit((1 << bits) - 1))).drop(part, at, before)


def sieved(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """`df` with a column `sieved`: false only for rows whose `column` is not in `ids` (column id); some others are true.

    A bit for each id's hash is sent to all executors, in a map of 16 bits an id (32 MB at most), so that rows are chosen
    by their ids without being dealt by them. Ids are integers.
    """
    width, wide = 1 << 15, 16
    maps = 1 << min(13, max(0, (wide * ids.count() // width).bit_length()))
    place = lambda name: F.pmod(F.xxhash64(F.col(name).cast("long")), F.lit(maps * width))
    at, bit, own, bits = fresh(df, "_at", "_bit", "_own", "_bits")
    made = ids.select(place("id").alias(at)).groupBy(F.expr(f"{at} div {width}").alias(own)).agg(F.expr(f"bitmap_construct_agg({at} % {width})").alias(bits))
    placed = df.withColumn(bit, place(column)).withColumn(at, F.expr(f"{bit} div {width}")).withColumn(bit, F.expr(f"cast({bit} % {width} as int)"))
    byte = F.conv(F.hex(F.substring(bits, F.expr(f"{bit} div 8 + 1").cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(byte.bitwiseAND(F.expr(f"shiftleft(1, {bit} % 8)")) > 0, F.lit(False))
    return placed.join(F.broadcast(made), F.col(at) == F.col(own), "left").withColumn("sieved", hit).drop(at, bit, own, bits)


def text_of(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def fold(doc_id: str | Column, buckets: int) -> Column:
    """crc32 of the id as text, modulo `buckets`; null for a null id."""
    return F.crc32(F.encode(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id, "UTF-8")) % buckets
