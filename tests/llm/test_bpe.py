"""Encoding through the distinct-word table against the library, and the digests of the round trip."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridloom.llm import bpe_codec

TEXTS = [
    None, "", " ", "a", "the cat sat on the mat, the cat's 12 mats", "Ünïcode İ ß \x1ća", "“curly” quotes — dashes… and nbsp here",
    "日本語のテキスト と 漢字", "Привет, мир! Это 42-й тест.", "مرحبا بالعالم ١٢٣", "emoji 👩‍👩‍👧‍👦🏳️‍🌈 ok", "<|endoftext|>", "x<|endoftext|> y<|endoftext|><|endoftext|>z 漢",
    "tabs\t\tand\r\nlines\n\n    wide", "𝔘𝔫𝔦 ² Ⅷ ½ ǆ ҈ ​ x", "word " * 30000 + "ẞ", "z" * 20000, "é" * 30000 + " x",
]


@pytest.fixture(scope="module")
def library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    made = Tokenizer.from_file(path)
    return path, made


def test_round_trip(spark, library):
    path, made = library
    rng = np.random.default_rng(1)
    marks = [chr(c) for c in rng.integers(32, 0x3000, 4000)]
    texts = TEXTS + ["".join(rng.choice(marks, 200)) for _ in range(100)] + TEXTS[:6]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, block int").repartition(3)
    rows = {r["doc_id"]: r for r in bpe_codec.round_trip(df, path).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        ids = made.encode(t or "", add_special_tokens=False).ids
        text = made.decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        assert (rows[i]["n_tokens"], rows[i]["ids_sha256"], rows[i]["decoded_sha256"]) == want, repr(t)[:80]


def test_each_distinct_word_is_encoded_once(spark, library):
    """Words of many blocks, dealt to hash pieces: no word is in two pieces."""
    path, _ = library
    df = spark.createDataFrame([(i, f"alpha beta{i} gamma{i % 7}") for i in range(200)], "doc_id long, text string").repartition(8)
    rows = bpe_codec.split(df, path, 5).where("kind >= 0").collect()
    seen: dict[bytes, set[int]] = {}
    for r in rows:
        data = bpe_codec._unpacked(bytes(r["data"]))
        _, sizes, at = bpe_codec._entries(data)
        for size in sizes.tolist():
            seen.setdefault(data[at : at + size], set()).add(r["kind"])
            at += size
    assert len({r["block"] for r in rows}) == 8 and all(len(v) == 1 for v in seen.values()) and b" gamma" in seen


def test_null_ids_and_none(spark, library):
    path, _ = library
    df = spark.createDataFrame([(None, "one two"), (None, "one two"), (1, None)], "doc_id long, text string")
    assert sorted(len(r["ids"]) for r in bpe_codec.encode(df, path).collect()) == [0, 2, 2]
    assert bpe_codec.encode(df.limit(0), path).count() == 0
