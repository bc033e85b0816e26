"""Toxic spans by a linear-chain conditional random field.

Words are tagged toxic or not by a two-state chain. Its features are hashes of the word, of its first 4 and 6 bytes and
of its neighbours; its marginals come from the forward-backward algorithm. Documents, not words, are labelled, so words
are labelled first: in toxic documents those whose word or beginning is found in toxic documents with significance and
hardly elsewhere. Marginals are added up to a document's score, and runs of toxic words are its offending spans.

Forward-backward runs over all words of a block of documents at once: chains are cut into chunks, the 2x2 products of
all chunks are formed in step, messages go from chunk to chunk, and the chunks are then filled in step. That is exact
and takes memory in proportion to the block, however long one document is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import fold
from ._words import NOT_WORD, slices, spans, utf8, word_hashes

BITS = 21
TABLE = 1 << BITS
CHUNK = 32
#: Bounds of the training sample: documents of each label, and their bytes of text.
TRAIN_TOXIC, TRAIN_CLEAN, TRAIN_BYTES = 1500, 2500, 8_000
#: A word labels toxicity with this share of toxic documents and this evidence (natural logarithm) against chance.
SHARE, EVIDENCE = 0.95, 13.0
PRIOR = 3.0


@dataclass
class Chain:
    weights: np.ndarray
    move: np.ndarray
    document: np.ndarray


def features(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Places in the weight table of each word's features (words x 5)."""
    word = word_hashes(raw, starts, ends)
    four, six = word_hashes(raw, starts, ends, 4), word_hashes(raw, starts, ends, 6)
    before, after = np.roll(word, 1), np.roll(word, -1)
    edge = np.unique(bounds[(bounds >= 0) & (bounds < len(word))])
    before[edge] = 1
    after[edge - 1] = 2
    salt = np.arange(1, 6, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)
    both = np.stack((word, four, six, before, after), axis=1)
    return (((both + salt) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)).astype(np.int32)


def marginals(score: np.ndarray, bounds: np.ndarray, move: np.ndarray, moves: np.ndarray | None = None) -> np.ndarray:
    """The probability of state 1 of each word; `moves`, if given, gets the expected number of steps between states.

    score: each word's advantage of state 1; bounds: where each document begins, and the end; move: potentials of the
    step from one state (row) to the next (column). Before its first word a document is in state 0.
    """
    total = len(score)
    if not total:
        return np.zeros(0)
    n = np.diff(bounds)
    chunks = -(-n // CHUNK)
    owner_begin = np.cumsum(chunks) - chunks
    count = int(chunks.sum())
    doc = np.repeat(np.arange(len(n)), chunks)
    part = np.arange(count) - np.repeat(owner_begin, chunks)
    begin = bounds[:-1][doc] + part * CHUNK
    size = np.minimum(CHUNK, bounds[1:][doc] - begin)
    gain = np.exp(np.clip(score, -30, 30))
    grid = np.ones((CHUNK, count))
    row = np.arange(CHUNK)[:, None]
    used = row < size
    grid[used] = gain[(begin + row)[used]]
    t = move

    def forward(a0: np.ndarray, a1: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        b0, b1 = a0 * t[0, 0] + a1 * t[1, 0], (a0 * t[0, 1] + a1 * t[1, 1]) * grid[k]
        s = b0 + b1
        on = used[k]
        return np.where(on, b0 / s, a0), np.where(on, b1 / s, a1)

    # Products of the chunks, as what becomes of either state before the chunk (only their ratio to each other matters
    # within one chunk, so both rows keep a common scale).
    p = np.zeros((2, 2, count))
    p[0, 0] = p[1, 1] = 1
    for k in range(CHUNK):
        q0 = p[:, 0] * t[0, 0] + p[:, 1] * t[1, 0]
        q1 = (p[:, 0] * t[0, 1] + p[:, 1] * t[1, 1]) * grid[k]
        s = (q0 + q1).sum(0)
        on = used[k]
        p = np.stack((np.where(on, q0 / s, p[:, 0]), np.where(on, q1 / s, p[:, 1])), axis=1)
    ahead, behind = np.zeros((2, count)), np.ones((2, count))
    ahead[0, owner_begin[n > 0]] = 1
    longest = int(chunks.max())
    by_part = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[by_part], np.arange(longest + 1))
    last = part == chunks[doc] - 1
    for j in range(1, longest):
        c = by_part[cuts[j] : cuts[j + 1]]
        a0, a1 = ahead[0, c - 1], ahead[1, c - 1]
        b0, b1 = a0 * p[0, 0, c - 1] + a1 * p[1, 0, c - 1], a0 * p[0, 1, c - 1] + a1 * p[1, 1, c - 1]
        s = b0 + b1
        ahead[0, c], ahead[1, c] = b0 / s, b1 / s
    for j in range(longest - 2, -1, -1):
        c = by_part[cuts[j] : cuts[j + 1]]
        c = c[~last[c]]
        z0, z1 = behind[0, c + 1], behind[1, c + 1]
        y0, y1 = p[0, 0, c + 1] * z0 + p[0, 1, c + 1] * z1, p[1, 0, c + 1] * z0 + p[1, 1, c + 1] * z1
        s = y0 + y1
        behind[0, c], behind[1, c] = y0 / s, y1 / s
    inside = np.empty((CHUNK, 2, count))
    a0, a1 = ahead
    for k in range(CHUNK):
        a0, a1 = forward(a0, a1, k)
        inside[k, 0], inside[k, 1] = a0, a1
    z0, z1 = behind
    out = np.empty((CHUNK, count))
    for k in range(CHUNK - 1, -1, -1):
        v0, v1 = inside[k, 0] * z0, inside[k, 1] * z1
        out[k] = v1 / (v0 + v1)
        if moves is not None:
            before = inside[k - 1] if k else ahead
            both = before[:, None] * t[:, :, None] * np.stack((z0, grid[k] * z1))
            moves += (both / both.sum((0, 1)))[:, :, used[k]].sum(2)
        y0, y1 = t[0, 0] * z0 + t[0, 1] * grid[k] * z1, t[1, 0] * z0 + t[1, 1] * grid[k] * z1
        s = y0 + y1
        on = used[k]
        z0, z1 = np.where(on, y0 / s, z0), np.where(on, y1 / s, z1)
    flat = np.empty(total)
    flat[(begin + row)[used]] = out[used]
    return flat


def label_words(found: np.ndarray, bounds: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Label 1 for words of toxic documents whose word or beginning is evidence of toxicity (features 0 to 2)."""
    doc = np.repeat(np.arange(len(toxic)), np.diff(bounds))
    label = np.zeros(len(found), bool)
    rate = max(1e-6, min(1 - 1e-6, toxic.mean()))
    for f in range(3):
        pair = np.unique(found[:, f].astype(np.int64) * len(toxic) + doc)
        place, of = pair // len(toxic), pair % len(toxic)
        every = np.bincount(place, minlength=TABLE).astype(float)
        bad = np.bincount(place, weights=toxic[of], minlength=TABLE)
        share = np.divide(bad, every, out=np.zeros(TABLE), where=every > 0)
        q = np.clip(share, 1e-9, 1 - 1e-9)
        evidence = every * (q * np.log(q / rate) + (1 - q) * np.log((1 - q) / (1 - rate)))
        label |= ((share >= SHARE) & (evidence >= EVIDENCE))[found[:, f]]
    return (label & (toxic[doc] > 0)).astype(float)


def summary(marginal: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """What a document's score is made of: a constant, the log-odds of its most toxic word, and the log of 1 and the
    sum of its marginals from a half on. Many faint marginals of a long text don't add up to a toxic one."""
    n = np.diff(bounds)
    total, top = np.zeros(len(n)), np.zeros(len(n))
    some = n > 0
    if some.any():
        total[some] = np.add.reduceat(np.where(marginal >= 0.5, marginal, 0.0), bounds[:-1][some])
        top[some] = np.maximum.reduceat(marginal, bounds[:-1][some])
    top = np.clip(top, 1e-4, 1 - 1e-4)
    return np.stack((np.ones(len(n)), np.log(top / (1 - top)) / 4, np.log1p(total)), axis=1)


def fit(found: np.ndarray, bounds: np.ndarray, toxic: np.ndarray, weight: np.ndarray, steps: int = 30) -> Chain:
    """Learn the chain on the labelled words, then the document score by Newton's method.

    Weights have a Gaussian prior (precision PRIOR) and take damped Newton steps with a bound of their curvature, so a
    feature that is seen rarely keeps a small weight.
    weight: what each document counts for in the document score, so that a sample balanced by label stands for all rows.
    """
    label = label_words(found, bounds, toxic)
    w, move = np.zeros(TABLE), np.array([[0.0, -2.0], [0.0, 0.0]])
    flat = found.ravel()
    curve = 0.25 * np.bincount(flat, minlength=TABLE) + PRIOR
    before = np.concatenate(([0.0], label[:-1])) if len(label) else label
    before[bounds[:-1][np.diff(bounds) > 0]] = 0
    made = np.array([[((1 - before) * (1 - label)).sum(), ((1 - before) * label).sum()], [(before * (1 - label)).sum(), (before * label).sum()]])
    for _ in range(steps):
        moves = np.zeros((2, 2))
        p = marginals(w[found].sum(1), bounds, np.exp(move), moves)
        w -= 0.4 * (np.bincount(flat, weights=np.repeat(p - label, found.shape[1]), minlength=TABLE) + PRIOR * w) / curve
        move -= 0.4 * (moves - made + PRIOR * move) / (0.25 * made.sum(1, keepdims=True) + PRIOR)
    move = np.exp(move)
    x = summary(marginals(w[found].sum(1), bounds, move), bounds)
    theta, ridge = np.zeros(3), np.diag((1e-3, 1e-2, 1e-2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge
        theta = theta - np.clip(np.linalg.solve(h, x.T @ (weight * (p - toxic)) + ridge @ theta), -2, 2)
    return Chain(w.astype(np.float32), move, theta)


def train(docs: DataFrame, labels: DataFrame) -> Chain | None:
    """Learn from labelled documents whose fold (crc32 of the id modulo 5) is not 0; None if a label is missing there.

    The sample is bounded by TRAIN_TOXIC and TRAIN_CLEAN documents and TRAIN_BYTES of text in a document, and is taken
    by a hash of the id. Labels other than 0 and 1 are not used; a document with several rows of labels is toxic if one is.
    """
    free = labels.where(F.col("toxic").isin(0, 1) & (fold("doc_id", 5) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    seen = {r["toxic"]: r["n"] for r in free.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if set(seen) != {0, 1}:
        return None
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("toxicity")), F.lit(1 << 40)) / float(1 << 40)
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, TRAIN_TOXIC / seen[1]))).otherwise(F.lit(min(1.0, TRAIN_CLEAN / seen[0])))
    chosen = free.where(draw < share)  # some TRAIN_TOXIC + TRAIN_CLEAN ids
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where(F.octet_length("text") <= TRAIN_BYTES)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                raw, off = utf8(part.column("text"))
                starts, ends = spans(raw, off, NOT_WORD)
                bounds = np.searchsorted(starts, off)
                found = features(raw, starts, ends, bounds)
                rows = [found[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic").cast(pa.int32()), pa.array(rows, pa.binary())], names=["doc_id", "toxic", "found"])

    rows = sorted(sample.mapInArrow(hashed, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, toxic int, found binary").collect(), key=lambda r: (r["doc_id"], bytes(r["found"])))
    toxic = np.array([r["toxic"] for r in rows], float)
    if not 0 < toxic.sum() < len(toxic):
        return None
    bounds = np.cumsum([0, *(len(r["found"]) // 20 for r in rows)])
    weight = np.where(toxic > 0, seen[1] / toxic.sum(), seen[0] / (len(toxic) - toxic.sum()))
    return fit(np.frombuffer(b"".join(bytes(r["found"]) for r in rows), np.int32).reshape(-1, 5), bounds, toxic, weight / weight.mean())


def tag(docs: DataFrame, chain: Chain | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and spans: begin and end (in characters) and probability of each run of toxic words.

    Null and empty texts and texts without words get the score of a text without toxic words and no spans. Without a
    chain every score is 0. Other columns are ignored; repeated rows are scored alike.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    # A table of a fixed size (8 MB) and a few numbers.
    sent = source.sparkSession.sparkContext.broadcast(chain)
    item = pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("p", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = sent.value
        for batch in batches:
            for part in slices(batch):
                raw, off = utf8(part.column("text"))
                rows: list[list[dict]] = [[] for _ in range(part.num_rows)]
                score = np.zeros(part.num_rows)
                if chain is not None:
                    starts, ends = spans(raw, off, NOT_WORD)
                    bounds = np.searchsorted(starts, off)
                    found = features(raw, starts, ends, bounds)
                    p = marginals(chain.weights[found].sum(1, dtype=np.float64), bounds, chain.move)
                    score = 1 / (1 + np.exp(-np.clip(summary(p, bounds) @ chain.document, -30, 30)))
                    bad = np.flatnonzero(p >= 0.5)
                    if len(bad):
                        chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
                        doc = np.searchsorted(bounds, bad, "right") - 1
                        new = np.concatenate(([True], (np.diff(bad) > 1) | (np.diff(doc) > 0)))
                        first = np.flatnonzero(new)
                        last = np.append(first[1:], len(bad)) - 1
                        for f, e, top in zip(first.tolist(), last.tolist(), np.maximum.reduceat(p[bad], first).tolist(), strict=True):
                            base = chars[off[doc[f]]]
                            rows[doc[f]].append({"begin": int(chars[starts[bad[f]]] - base), "end": int(chars[ends[bad[e]]] - base), "p": top})
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score), pa.array(rows, pa.list_(item))], names=["doc_id", "score", "spans"])

    return source.mapInArrow(run, f"doc_id {kind}, score double, spans array<struct<begin:long,end:long,p:double>>")
