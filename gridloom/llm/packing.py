"""Packing documents into training windows by minimum bin slack.

Every document is cut into full windows and a rest. Full windows stand alone. The rests are packed by their lengths
alone: the histogram of rest lengths (a count for each length under the window) is all that planning needs, however
many documents there are. Again and again the longest length left is put into an open window, a subset-sum table over
the other lengths, kept as a bitset in one integer, tells which fills can be reached, the one closest to the capacity is
taken and its multiset of lengths read back. The multiset is then used as often as the counts allow. Rests are ranked
within their length, so that each finds its window, and its place there, from its rank alone.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import durable, fresh, global_rank, tidy
from ._tokenize import encoder
from ._words import slices

WINDOW = 4096
END_ID = 2


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths (bounded by their counts) whose sum is the greatest up to `capacity`.

    Bit s of the table is set when some multiset sums to s. Each length is added in binary portions of its count; the
    tables in between are kept for the way back. The search ends early when the capacity is met.
    """
    mask, reach, steps = (1 << (capacity + 1)) - 1, 1, []
    goal = 1 << capacity
    for length in sorted((n for n in counts if n <= capacity and counts[n]), reverse=True):
        left, portion = min(counts[length], capacity // length), 1
        while left and not reach & goal:
            take = min(portion, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, portion = left - take, portion * 2
        if reach & goal:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return chosen


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """Patterns (a multiset of lengths) and how many windows each fills; together they use the histogram up."""
    left, out = {n: c for n, c in histogram.items() if c}, []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        chosen = fullest(rest, window - longest)
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[n] // k for n, k in chosen.items())
        out.append((chosen, times))
        for n, k in chosen.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return out


def layout(patterns: list[tuple[dict[int, int], int]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length its runs (first rank, first window, how many in a window, offset of the first), in rank order."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    window = 0
    for chosen, times in patterns:
        offset = 0
        for length in sorted(chosen, reverse=True):
            runs.setdefault(length, []).append((used.get(length, 0), window, chosen[length], offset))
            used[length] = used.get(length, 0) + chosen[length] * times
            offset += chosen[length] * length
        window += times
    return runs


def token_pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Tokenise whole texts and cut each into full windows and a rest: doc_id, start, length, ids_crc32, doc_tokens.

    With `ids`, the pieces' ids themselves follow (little-endian 32-bit integers).
    """
    end = end_id.to_bytes(4, "little")
    size = 4 * window

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        try:
            for batch in batches:
                for part in slices(batch):
                    out: list[list] = [[], [], [], [], [], []]
                    for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                        data = code.encode(text or "") + end
                        for at in range(0, len(data), size):
                            piece = data[at : at + size]
                            for column, value in zip(out, (doc, at // 4, len(piece) // 4, zlib.crc32(piece), len(data) // 4, piece), strict=True):
                                column.append(value)
                    kinds = [part.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
                    use = 6 if ids else 5
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out[:use], kinds, strict=False)], names=names[:use])
        finally:
            code.forget()

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(tidy(cut), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * ids)


def pack(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Give each piece its sequence_id and offset.

    `pieces` has doc_id, start, length (1 to `window`) and ids_crc32, and any other columns but sequence_id and offset;
    it is read several times and should be durable. Sequences are numbered from 0: first those of the plan, then the full windows. Pieces of one
    length are ranked by document and start; those that these leave tied are equal.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.where(F.col("length") < window).groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    patterns = plan(histogram, window)
    runs = layout(patterns)
    windows = sum(times for _, times in patterns)
    (place_in,) = fresh(pieces, "rank")
    ranked = global_rank(pieces, ["length", "doc_id", "start", "ids_crc32"], place_in)
    firsts, total = {}, 0
    for length in sorted(histogram):
        firsts[length], total = total, total + histogram[length]
    # At most one row for each length and pattern, and there are at most as many patterns as lengths.
    table = spark.sparkContext.broadcast({n: ([x[0] for x in r], r) for n, r in runs.items()})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = [], []
            for length, rank in zip(batch.column("length").to_pylist(), batch.column(place_in).to_pylist(), strict=True):
                if length >= window:
                    sequence.append(windows + rank - total)
                    offset.append(0)
                    continue
                starts, own = table.value[length]
                k = rank - firsts[length]
                first, window_at, many, at = own[bisect_right(starts, k) - 1]
                sequence.append(window_at + (k - first) // many)
                offset.append(at + (k - first) % many * length)
            columns = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != place_in]
            names = [n for n in batch.schema.names if n != place_in]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.array(sequence, np.int64)), pa.array(np.array(offset, np.int64))], names=[*names, "sequence_id", "offset"])

    schema = pieces.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).schema
    return ranked.mapInArrow(tidy(place), schema)


def pack_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pack whole documents: a row per piece with doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null text counts as empty: its document is the end id alone. Null ids and repeated rows are documents of their own.
    Documents of any length are cut into windows. An empty table gives an empty result; other columns are ignored.
    """
    return pack(durable(token_pieces(docs, tokenizer, window, end_id)), window)


def sequences(packed: DataFrame, window: int = WINDOW) -> DataFrame:
    """The sequences themselves, from pieces packed with their ids: sequence_id, ids, doc_starts, padding.

    A sequence whose length is a power of two is not padded, all others are padded to the window.
    """
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "start", "ids"))).alias("p"), F.sum("length").alias("n"))
    whole = F.pmod(F.log2("n"), F.lit(1.0)) == 0
    joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return rows.select("sequence_id", joined.alias("ids"), F.transform("p", lambda x: x["offset"]).alias("doc_starts"), F.when(whole, F.lit(0)).otherwise(F.lit(window) - F.col("n")).cast("long").alias("padding"))
