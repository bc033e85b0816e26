"""BPE encoding and decoding through a table of distinct words.

Texts are split into words, block by block; a block ends when it has WORDS distinct ones. What is kept of a text is the
places of its words in the block's word list. The blocks' words are dealt by a hash, so that all occurrences of a word
meet in one task and each distinct word of the corpus is encoded once there. The ids go back to their block, and texts
take them from it by position. Decoding joins ids to the pieces of the vocabulary, a table of a bounded size, by id.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tokenize import Encoder, encoder
from ._words import slices

#: Distinct words of a block, and slices of texts in it at most; hash pieces that words are dealt to, for each shuffle
#: partition.
WORDS, SLICES, PIECES = 200_000, 64, 4
#: The kind of rows that hold texts; others hold words or ids of one hash piece.
TEXTS = -1


def _planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers as their lowest bytes, then the next ones and so on: like with like, which compresses well."""
    return np.ascontiguousarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(data: bytes, n: int, at: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, 4 * n, at).reshape(4, n).T).view("<u4").reshape(n)


def _packed(*parts: bytes) -> bytes:
    """The parts on end, compressed."""
    data = b"".join(parts)
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpacked(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)


def _listed(places: np.ndarray, sizes: np.ndarray) -> bytes:
    """How many entries a list has, their ascending places (as steps) and their sizes; what they hold follows."""
    return len(places).to_bytes(4, "little") + _planes(np.diff(places.astype(np.int64), prepend=0)) + _planes(sizes)


def _entries(data: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Places, sizes, and where the rest begins."""
    n = int.from_bytes(data[:4], "little")
    return np.cumsum(_numbers(data, n, 4).astype(np.int64)), _numbers(data, n, 4 + 4 * n).astype(np.int64), 4 + 8 * n


def _runs(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The runs of `flat` with the numbers `at`, on end."""
    n = size[at]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(begin[at] - (ends - n), n) + np.arange(total)]


class Pieces:
    """The bytes of all ids, as one array with each id's begin and size."""

    def __init__(self, code: Encoder):
        rows = code.pieces
        top = max(i for i, _ in rows) + 1
        self.size, self.begin = np.zeros(top, np.int64), np.zeros(top, np.int64)
        self.flat = np.frombuffer(b"".join(p for _, p in rows), np.uint8)
        at = 0
        for i, p in rows:
            self.begin[i], self.size[i] = at, len(p)
            at += len(p)

    def decode(self, ids: np.ndarray) -> str:
        """The pieces of the ids on end; bytes that are no UTF-8 become replacement characters."""
        return _runs(self.flat, self.begin, self.size, ids.astype(np.int64)).tobytes().decode("utf-8", "replace")


def split(docs: DataFrame, tokenizer: str, pieces: int) -> DataFrame:
    """Blocks of texts as places in word lists: block, kind, ids (the documents'), data.

    kind TEXTS: how many words each text has, and their places in the block's list. Other kinds are hash pieces: the
    places, lengths and bytes of the words of that piece. A word that is an added token has the byte 0xFF before it.

    A block is named by a digest of its first document's id and its words; blocks of one name have the same words. Texts
    and words are read in two runs over `docs`; if these cut other blocks, the names differ, and texts without their words
    are an error and never wrong ids.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, table, texts, none = encoder(tokenizer), {}, [], None

        def row(block: int, kind: int, ids: pa.Array, data: bytes) -> pa.RecordBatch:
            ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([kind], pa.int32()), ids, pa.array([data], pa.binary())], names=["block", "kind", "ids", "data"])

        def closed() -> Iterator[pa.RecordBatch]:
            words = [b"\xff" + w if isinstance(w, bytes) else w.encode() for w in table]
            name = hashlib.blake2b(f"{texts[0][0][0].as_py()} ".encode() + b" ".join(words), digest_size=8)
            block = int.from_bytes(name.digest(), "little", signed=True)
            for ids, data in texts:
                yield row(block, TEXTS, ids, data)
            dealt: dict[int, tuple[list, list]] = {}
            for at, word in enumerate(words):
                held = dealt.setdefault(zlib.crc32(word) % pieces, ([], []))
                held[0].append(at)
                held[1].append(word)
            for piece, (at, own) in dealt.items():
                yield row(block, piece, none, _packed(_listed(np.array(at), np.array([len(w) for w in own])), b"".join(own)))

        for batch in batches:
            for part in slices(batch):
                places = [np.fromiter((table.setdefault(w, len(table)) for w in code.words_of(t or "")), "<u4") for t in part.column("text").to_pylist()]
                ids = part.column("doc_id")
                none = ids.slice(0, 0)
                texts.append((ids, _packed(_planes(np.array([len(p) for p in places], "<u4")), _planes(np.concatenate([*places, np.zeros(0, "<u4")])))))
                if len(table) >= WORDS or len(texts) >= SLICES:
                    yield from closed()
                    table.clear()
                    texts.clear()
        if texts:
            yield from closed()

    return docs.mapInArrow(run, f"block long, kind int, ids array<{kind}>, data binary")


def word_ids(words: DataFrame, tokenizer: str, pieces: int) -> DataFrame:
    """Encode the words of `split`'s hash pieces, each distinct word once: block, kind, ids (null), data (the places,
    numbers of ids and ids of the words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, table, at = encoder(tokenizer), {}, None
        for batch in batches:
            out = []
            for kind, data in zip(batch.column("kind").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if kind != at:
                    table, at = {}, kind
                data = _unpacked(data)
                places, size, begin = _entries(data)
                ids = []
                for k in size.tolist():
                    word = data[begin : begin + k]
                    begin += k
                    own = table.get(word)
                    if own is None:
                        own = table[word] = code.ids_of(word[1:] if word[:1] == b"\xff" else word.decode())
                    ids.append(own)
                out.append(_packed(_listed(places, np.array([len(x) for x in ids])), _planes(np.array([i for x in ids for i in x], "<u4"))))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("kind"), pa.array(out, pa.binary())], names=["block", "kind", "data"])

    n = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = words.select("block", "kind", "data").repartition(n, "kind").sortWithinPartitions("kind")
    return dealt.mapInArrow(run, "block long, kind int, data binary")


def _coded(docs: DataFrame, tokenizer: str, names: list[str], kinds: str, columns: Callable[[Pieces, list[np.ndarray]], list[pa.Array]]) -> DataFrame:
    """doc_id and what `columns` makes of the ids of each text."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = split(docs, tokenizer, PIECES * n)
    words = word_ids(blocks.where(F.col("kind") != TEXTS), tokenizer, PIECES * n)
    texts = blocks.where(F.col("kind") == TEXTS)
    rows = words.select("block", "kind", F.lit(None).cast(blocks.schema["ids"].dataType).alias("ids"), "data").unionByName(texts)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        pieces, at, held, table = Pieces(code), None, [], None
        for batch in batches:
            docs = batch.column("ids")
            for i, (block, kind, data) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("block", "kind", "data")), strict=True)):
                if block != at:
                    at, held, table = block, [], None
                data = _unpacked(data)
                if kind != TEXTS:
                    held.append(data)
                    continue
                if table is None:
                    table = _word_list(held)
                    held = []
                ids = docs[i].values
                size = _numbers(data, len(ids), 0).astype(np.int64)
                places = _numbers(data, int(size.sum()), 4 * len(ids))
                if len(places) and int(places.max()) >= len(table[1]):
                    raise RuntimeError("two runs over the texts differ: pass a table whose rows come in one order")
                ends = np.cumsum(size)
                # About a million words at a time.
                cuts = [0, *(np.flatnonzero(np.diff(ends >> 20)) + 1).tolist(), len(ids)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if b > a:
                        own = [_runs(*table, places[e - n : e]) for e, n in zip(ends[a:b].tolist(), size[a:b].tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), *columns(pieces, own)], names=["doc_id", *names])

    # A block's ids (kinds from 0 on) come before its texts.
    dealt = rows.withColumn("late", F.col("kind") == TEXTS).repartition(n, "block").sortWithinPartitions("block", "late").drop("late")
    return dealt.mapInArrow(run, f"doc_id {kind}, {kinds}")


def _word_list(held: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids of a block's words on end, and where each word's begin and how many they are."""
    places, sizes, ids = [], [], []
    for data in held:
        place, size, at = _entries(data)
        places.append(place)
        sizes.append(size)
        ids.append(_numbers(data, int(size.sum()), at))
    if not held:
        return np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)
    place, one = np.concatenate(places), np.concatenate(sizes)
    begin, size = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    begin[place], size[place] = np.cumsum(one) - one, one
    return np.concatenate(ids), begin, size


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) of each whole text, as the tokenizers library encodes it without special tokens.

    For byte-level tokenizers without word ends. Null text counts as empty and has no ids. Repeated rows and null ids
    are coded like all others; other columns are ignored, and an empty table gives an empty result. The table is read
    twice and its rows must come in one order each time, as from files or a durable frame; else an error is raised.
    """
    made = lambda pieces, ids: [pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))]
    return _coded(_source(docs, id_col, text_col), tokenizer, ["ids"], "ids array<int>", made)


def decode(coded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, text from the rows of `encode`; null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(encoder(tokenizer))
        for batch in batches:
            texts = [pieces.decode(np.array(x or [], np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    source = coded.select("doc_id", "ids")
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode each whole text: doc_id, n_tokens, ids_sha256, decoded_sha256 (see `encode`)."""

    def digests(pieces: Pieces, ids: list[np.ndarray]) -> list[pa.Array]:
        return [
            pa.array([len(x) for x in ids], pa.int64()),
            pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]),
            pa.array([hashlib.sha256(pieces.decode(x).encode()).hexdigest() for x in ids]),
        ]

    return _coded(_source(docs, id_col, text_col), tokenizer, ["n_tokens", "ids_sha256", "decoded_sha256"], "n_tokens long, ids_sha256 string, decoded_sha256 string", digests)
