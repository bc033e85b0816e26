"""Language identification with error-correcting output codes.

Every language has a codeword of bits. For each bit a binary classifier (logistic regression on hashed byte n-grams)
is learned that tells the languages with that bit from those without. A text gets the language whose codeword has the
least weighted loss against the classifiers' answers (loss-weighted decoding); the bits weigh as much as their
classifiers were right in training. Texts whose two best codewords are nearly as close are flagged as ambiguous.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._runtime import durable, fold, tidy
from ._words import slices, utf8

FEATURES = 4096
#: Bounds of the training sample: rows in all, and rows of one language.
TRAIN_ROWS = 4000
TRAIN_ROWS_EACH = 800
TRAIN_BYTES = 200_000
#: Rows of n-gram counts that are held at a time.
HELD_ROWS = 512
MARGIN = 0.2


def codewords(classes: int, seed: int = 7) -> np.ndarray:
    """A matrix of -1 and 1 with a row for each class.

    Up to 7 classes: the exhaustive code. More: the random code (fixed seed) with the largest least distance of 50.
    """
    if classes <= 7:
        bits = max(1, 2 ** (classes - 1) - 1)
        rows = [[1] * bits]
        for c in range(1, classes):
            run = 2 ** (classes - 1 - c)
            rows.append([1 if (i // run) % 2 else -1 for i in range(bits)])
        return np.array(rows, dtype=np.float64)
    rng = np.random.default_rng(seed)
    bits = int(np.ceil(10 * np.log2(classes)))
    best, apart = None, -1
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], size=(classes, bits))
        gram = code @ code.T
        np.fill_diagonal(gram, -bits)
        if (gap := (bits - gram.max()) / 2) > apart and (np.abs(code.sum(0)) < classes).all():
            best, apart = code, gap
    return best


def ngram_counts(column: pa.Array, features: int = FEATURES) -> np.ndarray:
    """Hashed counts of each text's byte 2- and 3-grams, square-rooted and scaled to length 1."""
    raw, off = utf8(pc.utf8_lower(column))
    out = np.zeros((len(off) - 1, features), dtype=np.float32)
    b = raw.astype(np.uint32)
    if len(b) < 2:
        return out
    two = b[:-1] * np.uint32(0x9E3779B1) ^ b[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) ^ b[2:] * np.uint32(0x27D4EB2F)
    shift = np.uint32(32 - int(np.log2(features)))
    two, three = (two * np.uint32(0x9E3779B1)) >> shift, (three * np.uint32(0x165667B1)) >> shift
    for i, (s, e) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
        if e - s >= 2:
            grams = np.concatenate((two[s : e - 1], three[s : max(s, e - 2)]))
            out[i] = np.bincount(grams, minlength=features)
    np.sqrt(out, out=out)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.maximum(norm, 1e-9)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Weighted logistic loss of each text (row) against each codeword (column), as a mean over bits."""
        f = x @ self.weights + self.bias
        return np.stack([(np.logaddexp(0, -row * f) * self.trust).sum(1) for row in self.code], axis=1) / self.trust.sum()

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, its share of belief (0 to 1), and whether the next one is nearly as close."""
        loss = self.losses(x)
        p = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        best = loss.argmin(1)
        order = np.sort(loss, axis=1)
        close = order[:, 1] - order[:, 0] < MARGIN if loss.shape[1] > 1 else np.zeros(len(loss), bool)
        return best, p[np.arange(len(best)), best], close


def fit(x: np.ndarray, languages: list[str], steps: int = 300, penalty: float = 1e-5) -> Model:
    """Learn the code's bit classifiers by full-batch Adam; rows weigh so that each language counts alike."""
    names = sorted(set(languages))
    y = np.array([names.index(v) for v in languages])
    code = codewords(len(names))
    target = code[y]
    weight = (1.0 / np.bincount(y, minlength=len(names)))[y][:, None] / len(names)
    x = x.astype(np.float32, copy=False)
    w, b = np.zeros((x.shape[1], code.shape[1])), np.zeros(code.shape[1])
    m, v = [np.zeros_like(w), np.zeros_like(b)], [np.zeros_like(w), np.zeros_like(b)]
    for t in range(1, steps + 1):
        f = x @ w.astype(np.float32) + b
        g = -target * weight / (1 + np.exp(np.clip(target * f, -50, 50)))
        for k, (p, d) in enumerate(((w, x.T @ g.astype(np.float32) + penalty * w), (b, g.sum(0)))):
            m[k] = 0.9 * m[k] + 0.1 * d
            v[k] = 0.999 * v[k] + 0.001 * d * d
            p -= 0.3 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-9)
    right = (((x @ w.astype(np.float32) + b) * target > 0) * weight).sum(0)
    return Model(names, code, w.astype(np.float32), b.astype(np.float32), np.maximum(right - 0.5, 0.01))


def train(docs: DataFrame, features: int = FEATURES) -> Model | None:
    """Learn from labelled rows whose fold is not 2; None if there are none.

    The sample is bounded by TRAIN_ROWS (TRAIN_ROWS_EACH of one language, but one row of each language at least, and
    TRAIN_BYTES of text in a row). Of each language the rows with the least hashes of id and text are drawn, so that
    the sample is the same in every run. Texts that are null or longer than TRAIN_BYTES are not learned from.
    """
    free = docs.where(F.col("lang").isNotNull() & (fold("doc_id", 4) != 2) & (F.octet_length("text") <= TRAIN_BYTES))
    seen = durable(free.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    languages = seen.count()
    if not languages:
        return None
    each = max(1, min(TRAIN_ROWS_EACH, TRAIN_ROWS // languages))
    # About twice as many rows as are wanted are drawn by their hash, so that few are ranked; a language of few rows is
    # drawn whole.
    draw = F.pmod(F.xxhash64(F.lit("language"), F.col("doc_id"), F.col("text")), F.lit(1 << 40))
    share = F.when(F.col("n") <= 20 * each, 1.0).otherwise(2.0 * each / F.col("n"))
    near = free.select("lang", "text", draw.alias("draw")).join(F.broadcast(seen) if languages <= 100_000 else seen, "lang").where(F.col("draw") < share * float(1 << 40))
    first = Window.partitionBy("lang").orderBy("draw", "text")
    sample = near.withColumn("place", F.row_number().over(first)).where(F.col("place") <= each).select("lang", "draw", "text")

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, rows=HELD_ROWS):
                x = ngram_counts(part.column("text"), features).astype(np.float16)
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("draw"), pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * features), len(x), [None, pa.py_buffer(x)]).cast(pa.binary())], names=["lang", "draw", "x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, x = [], []
        for batch in batches:
            lang += batch.column("lang").to_pylist()
            x += [np.frombuffer(v.as_buffer(), np.float16).copy() for v in batch.column("x")]
        if lang:
            whole = np.empty((len(x), features), np.float32)
            for row in whole:
                row[:] = x.pop(0)
            m = fit(whole, lang)
            parts = [json.dumps(m.languages).encode(), *(np.asarray(v, np.float64).tobytes() for v in (m.code, m.trust)), m.weights.tobytes(), m.bias.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary()), pa.array(range(len(parts)))], names=["part", "at"])

    # One task learns from the bounded sample, so that the driver gets the model only.
    counted = sample.mapInArrow(tidy(dense), "lang string, draw long, x binary").repartition(1).sortWithinPartitions("lang", "draw", "x")
    got = [bytes(r["part"]) for r in sorted(counted.select("lang", "x").mapInArrow(tidy(learn), "part binary, at long").collect(), key=lambda r: r["at"])]
    if not got:
        return None
    names, code, trust, weights, bias = json.loads(got[0]), *(np.frombuffer(v) for v in got[1:3]), *(np.frombuffer(v, np.float32) for v in got[3:])
    return Model(names, code.reshape(len(names), -1), weights.reshape(features, -1), bias, trust)


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Predict each row's language from its text alone: row (a struct of the id and `keep`'s columns), lang_pred, score,
    ambiguous.

    Null texts and texts without a letter get `und` with score 0, as does every text when there is no model. Columns
    in `keep` come out as they went in, whatever their names; repeated rows are labelled alike.
    """
    kept = list(dict.fromkeys([id_col, *(keep or [id_col])]))
    carried = docs.select(F.struct(*kept).alias("row"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letters"), *([] if text_col in kept else [F.col(text_col).alias("text")]))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row")
            text = row.field(kept.index(text_col)) if text_col in kept else batch.column("text")
            for part in slices(pa.RecordBatch.from_arrays([row, text, batch.column("letters")], names=["row", "text", "letters"]), rows=HELD_ROWS):
                letters = part.column("letters").to_numpy(zero_copy_only=False)
                if model is None:
                    names, score, close = ["und"] * len(letters), np.zeros(len(letters)), np.zeros(len(letters), bool)
                else:
                    best, score, close = model.predict(ngram_counts(part.column("text"), model.weights.shape[0]))
                    names = [model.languages[i] if ok else "und" for i, ok in zip(best.tolist(), letters.tolist(), strict=True)]
                    score, close = np.where(letters, score, 0.0), close & letters
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(names, pa.string()), pa.array(score.astype(np.float64)), pa.array(close)], names=["row", "lang_pred", "score", "ambiguous"])

    schema = carried.select("row").withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).withColumn("ambiguous", F.lit(False)).schema
    return carried.mapInArrow(tidy(label), schema)
