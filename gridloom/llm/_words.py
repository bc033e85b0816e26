"""Vectorised word and shingle hashing over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at a time, and bytes of words that are hashed at a time.
BLOCK_BYTES, HASHED = 1 << 20, 1 << 18
WIDTH = 5

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: White space is 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: All but letters, digits and bytes of other scripts.
NOT_WORD = np.ones(256, dtype=bool)
NOT_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a permutation of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = BLOCK_BYTES, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Runs of `rows` rows and about `limit` bytes of text at most; a longer text is a run of its own."""
    if not batch.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = size[start - 1] if start else 0
        stop = max(start + 1, min(start + rows, int(np.searchsorted(size, before + limit, "right"))))
        yield batch.slice(start, stop - start)
        start = stop


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts on end, and where each begins (with the end of the last)."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, dtype=np.uint8)
    return raw, off - off[0]


def spans(raw: np.ndarray, off: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words: runs of bytes that are not in `apart`, within one text."""
    inside = ~apart[raw]
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = off[(off > 0) & (off < len(raw))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _polynomials(raw: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sum of (byte + 1) * base ** place over each word's lower-cased bytes, modulo 2**64."""
    begin = np.cumsum(size) - size
    local = np.arange(int(size.sum())) - np.repeat(begin, size)
    power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(int(size.max()), _BASE, np.uint64))), dtype=np.uint64)
    return np.add.reduceat((_LOWER[raw[np.repeat(starts, size) + local]].astype(np.uint64) + np.uint64(1)) * power[local], begin)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, cut: int | None = None) -> np.ndarray:
    """A 64-bit hash of each word with A-Z lower-cased; with `cut`, of its first `cut` bytes.

    Words are hashed in runs of HASHED bytes, and a longer word in pieces of as many, so that what is held for each
    byte does not grow with the text.
    """
    size = ends - starts
    if cut:
        size = np.minimum(size, cut)
    out, upto, begin = np.empty(len(starts), np.uint64), np.cumsum(size), 0
    while begin < len(starts):
        before = upto[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(upto, before + HASHED, "right")))
        if size[begin] <= HASHED:
            out[begin:end] = _polynomials(raw, starts[begin:end], size[begin:end])
        else:
            value = 0
            for at in range(0, int(size[begin]), HASHED):
                piece = _polynomials(raw, starts[begin:end] + at, np.minimum(size[begin:end] - at, HASHED))
                value += int(piece[0]) * pow(int(_BASE), at, 1 << 64)
            out[begin] = value % (1 << 64)
        begin = end
    return mix(out + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def counts_by_text(starts: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.diff(np.searchsorted(starts, off))


def shingle_sets(column: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    A text with fewer than `width` words has its whole word sequence as one shingle, a text without words none.
    """
    raw, off = utf8(column)
    starts, ends = spans(raw, off)
    words = word_hashes(raw, starts, ends)
    bounds = np.searchsorted(starts, off)
    rolled = np.zeros(len(words), np.uint64)
    factors = np.cumprod(np.full(width, 0x2545F4914F6CDD1D, np.uint64))
    for k in range(min(width, len(words))):
        rolled[: len(words) - k] += words[k:] * factors[k]
    rolled = mix(rolled)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            one = np.sort(rolled[a : b - width + 1])
            out.append(one[np.concatenate(([True], one[1:] != one[:-1]))])
        elif b > a:
            out.append(mix((words[a:b] * factors[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
