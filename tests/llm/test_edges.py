"""Each operator on nulls, empty and long texts, ties, repeated rows, empty tables and extra columns; against plain Python."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridloom.llm import bpe_codec, chat_format, embedding_dedup, exact_dedup, jaccard_join, language_id, packing, pii, sharding, toxicity

WORDS = "the quick brown fox jumps over the lazy dog and runs far away from here today with all of its friends".split()
BASE = " ".join(WORDS * 3)
TEXTS = [
    (1, BASE), (2, BASE), (2, BASE), (3, BASE.replace("lazy", "tired", 1)), (4, None), (5, ""), (6, " \t\n"), (7, "one two"),
    (8, "One  two"), (9, "é" * 5000 + " x"), (10, ("word%d " * 50) % tuple(range(50))), (None, "no id here at all"), (11, "<|endoftext|> Ünïcode İ ß\x1c ́a"), (12, "12345 !!"),
]
SCHEMA = "doc_id long, text string, kept string, rank int, row string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in TEXTS], SCHEMA).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, none):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    rows = exact_dedup.exact_dedup(docs, block=16).collect()
    assert len(rows) == len(TEXTS) and sum(r["kept"] for r in rows) == len({norm(t) for _, t in TEXTS})
    by = {r["doc_id"]: r for r in rows}
    for i, t in TEXTS:
        same = [(-len(u or ""), j) for j, u in TEXTS if norm(u) == norm(t) and j is not None] or [(0, None)]
        assert (by[i]["keep_id"], by[i]["group_size"]) == (min(same)[1], sum(norm(u) == norm(t) for _, u in TEXTS))
        assert by[i]["text_sha256"] == hashlib.sha256(norm(t).encode()).hexdigest()
    assert exact_dedup.exact_dedup(none).count() == 0


def test_jaccard(docs, none):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()

    rows = jaccard_join.jaccard_components(docs).collect()
    sets = {i: shingles(t) for i, t in TEXTS}
    assert all(r["n_shingles"] == len(sets[r["doc_id"]]) for r in rows) and len(rows) == len(TEXTS)
    root = {r["doc_id"]: r["component_id"] for r in rows}
    assert root[2] == 1 and root[8] == 7 and root[5] == 5 and root[None] is None
    linked = 100 * len(sets[1] & sets[3]) >= 80 * len(sets[1] | sets[3])
    assert (root[3] == 1) == linked
    assert jaccard_join.jaccard_components(none).count() == 0


def test_language(spark, docs, none):
    labelled = spark.createDataFrame([(i, ("der die das und ist " if i % 2 else "the and of is was ") * 5, "de" if i % 2 else "en") for i in range(200)], "doc_id long, text string, lang string")
    model = language_id.train(labelled)
    assert {r["row"]["doc_id"] % 2: r["lang_pred"] for r in language_id.identify(labelled, model).collect()} == {0: "en", 1: "de"}
    rows = {r["row"]["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in (4, 5, 6, 12)) and rows[1]["lang_pred"] == "en"
    assert language_id.identify(none, model).count() == 0 and language_id.train(labelled.limit(0)) is None
    code = language_id.codewords(4)
    assert code.shape == (4, 7) and min(int((a != b).sum()) for k, a in enumerate(code) for b in code[:k]) == 4


def test_shards(docs, none):
    rows = sharding.hilbert_shards(docs, 4).collect()
    counts = [sum(r["shard"] == s for r in rows) for s in range(4)]
    assert max(counts) - min(counts) <= 1 and all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s])) for s in range(4))
    assert sharding.hilbert_shards(none).count() == 0
    cells = np.array([(x, y) for x in range(8) for y in range(8)])
    order = cells[np.argsort(sharding.hilbert_index(cells, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def test_toxicity(spark, docs, none):
    rows = [(i, f"{BASE} word{i} " + ("you vile moron" if i % 3 == 0 else "you kind friend")) for i in range(150)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    chain = toxicity.train(labelled, labels)
    got = {r["doc_id"]: r for r in toxicity.tag(labelled, chain).collect()}
    assert all((got[i]["score"] >= 0.5) == (i % 3 == 0) for i, _ in rows)
    span = got[0]["spans"][0]
    assert "moron" in rows[0][1][span["begin"] : span["end"]]
    assert toxicity.tag(docs, chain).count() == len(TEXTS) and toxicity.tag(none, chain).count() == 0


def test_marginals_by_enumeration():
    rng = np.random.default_rng(1)
    score, move = rng.normal(size=7), np.exp(rng.normal(size=(2, 2)))
    weight = np.zeros((2,) * 7)
    for s in np.ndindex(*weight.shape):
        p, at = 1.0, 0
        for e, k in zip(score, s, strict=True):
            p, at = p * move[at, k] * np.exp(e * k), k
        weight[s] = p
    want = [weight.take(1, axis=k).sum() / weight.sum() for k in range(7)]
    assert np.allclose(toxicity.marginals(score, np.array([0, 7]), move), want)
    long = rng.normal(size=500)
    assert np.allclose(toxicity.marginals(np.concatenate((score, long)), np.array([0, 7, 7, 507]), move)[:7], want)


def test_pii(spark, docs, none):
    cases = ["card 4994226020900891 end", "not 4994226020900892", "a.b1@mail.example.com", "+1 (319) 555-5132", "10.20.30.40", "born 1980-02-29.", "2001-02-30", "GB82 WEST 1234 5698 7654 32", "078-05-1120", "12/31/1999 31.12.1999"]
    found = spark.createDataFrame([(i, c, "z") for i, c in enumerate([*cases, *cases])], "doc_id long, text string, _made2 string")
    rows = {r["doc_id"]: r["text"] for r in pii.pseudonymise(found, "k").collect()}
    n = len(cases)
    assert all(rows[i] == rows[i + n] and (i == 4 or len(rows[i]) == len(cases[i])) for i in range(n))
    assert rows[1] == cases[1] and rows[6] == cases[6] and all(rows[i] != cases[i] for i in (0, 2, 3, 4, 5, 7, 8, 9))
    digits = [int(c) for c in rows[0][5:21]]
    assert sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(reversed(digits))) % 10 == 0
    iban = rows[7].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    back = {r["doc_id"]: r["text"] for r in pii.pseudonymise(docs, "k").collect()}
    assert all(back[i] == t for i, t in TEXTS if i not in (2,)) and pii.pseudonymise(none, "k").count() == 0


def test_packing(docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs, path, window=64).collect()
    for i, t in TEXTS:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        own = [r for r in rows if r["doc_id"] == i]
        assert sum(r["length"] for r in own) == len(ids) * sum(j == i for j, _ in TEXTS)
        assert all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in own)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert sorted(bins) == list(range(len(bins))) and packing.pack_documents(none, path).count() == 0
    assert sum(packing.fullest({5: 2, 7: 1, 3: 4}, 19)[k] * k for k in packing.fullest({5: 2, 7: 1, 3: 4}, 19)) == 19


def test_bpe(docs, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = {r["doc_id"]: list(r["ids"]) for r in bpe_codec.encode(docs, path).collect()}
    assert all(rows[i] == library.encode(t or "", add_special_tokens=False).ids for i, t in TEXTS)
    texts = {r["doc_id"]: r["text"] for r in bpe_codec.decode(bpe_codec.encode(docs, path), path).collect()}
    assert all(texts[i] == library.decode(rows[i], skip_special_tokens=False) for i, _ in TEXTS)
    assert bpe_codec.round_trip(none, path).count() == 0


def test_chat(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"), (2, 1, "assistant", "no"), (3, 0, None, None), (3, 0, "user", "x")]
    df = spark.createDataFrame([(*t, "extra") for t in turns], "conv_id long, turn long, role string, text string, prompt string")
    rows = {r["chosen_id"]: r for r in chat_format.preferences(df).collect()}
    pair = next(r for r in rows.values() if {r["chosen_id"], r["rejected_id"]} == {1, 2})
    assert pair["prompt_turns"] == 1 and pair["prompt"] == "<|im_start|>user\nhi<|im_end|>\n"
    m = pair["chosen_mask"][0]
    assert pair["chosen"][m["begin"] : m["end"]] == "yes<|im_end|>"
    assert chat_format.preferences(df.limit(0)).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(3)
    x = [list(map(float, v)) for v in rng.normal(size=(60, 8))]
    x += [[a + 0.01 for a in v] for v in x[:20]] + [x[0], [0.0] * 8, [float("nan")] * 8, None, [1.0] * 3]
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, kept int")
    rows = {r["vec_id"]: r for r in embedding_dedup.near_vectors(df).collect()}
    good = [i for i, v in enumerate(x) if v and len(v) == 8 and all(np.isfinite(v)) and any(v)]
    m = np.array([np.float32(x[i]).astype(float) for i in good])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = (m @ m.T >= 0.9).sum(1) - 1
    assert [rows[i]["n_links"] for i in good] == near.tolist() and len(rows) == len(x)
    assert all(rows[i]["kept"] and rows[i]["n_links"] == 0 for i in range(len(x)) if i not in good)
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0
