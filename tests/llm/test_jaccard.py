"""The Jaccard join against brute force: large groups of edited copies, sizes at the threshold, very long lists."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import _words, jaccard_join


def brute(texts, percent=80):
    """component of each text, by all pairs of their shingle sets as rows of a bit matrix."""
    sets = [set(s.tolist()) for s in _words.shingle_sets(pa.array(texts, pa.string()))]
    columns = {x: i for i, x in enumerate(sorted(set().union(*sets)))}
    bits = np.zeros((len(sets), len(columns)), np.float32)
    for row, s in zip(bits, sets, strict=True):
        row[[columns[x] for x in s]] = 1
    size = bits.sum(1)
    both = bits @ bits.T
    linked = (100 * both >= percent * (size[:, None] + size[None, :] - both)) & (size[:, None] > 0) & (size[None, :] > 0)
    least = np.arange(len(sets))
    while True:
        lower = np.minimum(least, np.where(linked, least[None, :], least[:, None]).min(1))
        if (lower == least).all():
            return least.tolist()
        least = lower


def edited(rng, base, share):
    words = list(base)
    for k in np.flatnonzero(rng.random(len(words)) < share):
        words[k] = f"e{rng.integers(1 << 40)}"
    return words


def corpus(rng, copies, words=120):
    base = [f"w{rng.integers(5000)}" for _ in range(words)]
    out = [edited(rng, base, share) for share in rng.choice([0.01, 0.02, 0.03, 0.05, 0.08], copies)]
    out += [x[: len(x) - int(rng.integers(0, 30))] for x in out[:: max(1, copies // 40)]]
    out += [[f"w{rng.integers(5000)}" for _ in range(int(rng.integers(1, 80)))] for _ in range(copies // 3)]
    out += [x + [f"t{rng.integers(9)}" for _ in range(8)] for x in out[-20:]]
    rng.shuffle(out)
    return [" ".join(x) for x in out]


def components(spark, texts, **how):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = jaccard_join.jaccard_components(df, **how).collect()
    assert len(rows) == len(texts)
    return [r["component_id"] for r in sorted(rows, key=lambda r: r["doc_id"])]


@pytest.mark.parametrize("seed, percent", [(1, 80), (2, 60)])
def test_groups_of_edited_copies(spark, seed, percent):
    texts = corpus(np.random.default_rng(seed), 300)
    assert components(spark, texts, percent=percent) == brute(texts, percent)


def test_three_thousand_edited_copies(spark):
    texts = corpus(np.random.default_rng(3), 3000, words=60)
    want = brute(texts)
    assert components(spark, texts) == want and 300 < len(set(want)) < 4000


def test_long_lists_in_parts(spark, monkeypatch):
    """Lists of more than 64 sets are cut into parts, which must lose no pair."""
    monkeypatch.setattr(jaccard_join, "LISTED", 64)
    monkeypatch.setattr(jaccard_join, "ALIKE", 99)  # no leaders: the lists must find all
    texts = corpus(np.random.default_rng(4), 400, words=40)
    assert components(spark, texts) == brute(texts)


def test_hash_of_long_words(monkeypatch):
    raw = np.frombuffer(b"Ab cde " + b"xY" * 3000 + b" fg", np.uint8)
    starts, ends = _words.spans(raw, np.array([0, len(raw)]))
    whole = _words.word_hashes(raw, starts, ends)
    monkeypatch.setattr(_words, "HASHED", 256)
    assert (_words.word_hashes(raw, starts, ends) == whole).all() and len(set(whole.tolist())) == 4


def test_derived_overlaps():
    """Overlaps of sets given by a base and its changes equal those of the sets."""
    rng = np.random.default_rng(5)
    draw = lambda n: np.sort(rng.choice(200, n, replace=False)).astype(np.uint64)
    for _ in range(200):
        base, hub, da, db = draw(60), draw(60), draw(int(rng.integers(0, 40))), draw(int(rng.integers(0, 40)))
        state = jaccard_join._Answers(30)
        state.hub = hub
        state.meet(base)
        a, b = set(base.tolist()) ^ set(da.tolist()), set(hub.tolist()) ^ set(db.tolist())
        assert state.linked(da, db) == (100 * len(a & b) >= 30 * len(a | b))


def test_followers_that_lack_what_only_their_leader_has(spark):
    """Two texts are alike, and both are their leader's beginning: nothing but its own end makes them differ from it alike."""
    rng = np.random.default_rng(11)
    texts = []
    for _ in range(40):
        base = [f"w{rng.integers(1 << 40)}" for _ in range(200)]
        texts.append(base)
        for at in rng.choice(140, 2, replace=False):
            texts.append([*base[:at], f"e{rng.integers(1 << 40)}", *base[at + 1 : 150]])
    texts = [" ".join(x) for x in texts]
    want = brute(texts)
    assert len(set(want)) < len(texts)
    assert components(spark, texts) == want


def test_texts_are_chosen_by_many_ids_without_being_dealt(spark):
    docs = spark.range(0, 2_000_000, 1, 4).select("id", F.lit("a text").alias("text")).union(spark.sql("SELECT CAST(NULL AS BIGINT), 'none'"))
    ids = spark.range(0, 1_800_000, 3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    try:
        made = jaccard_join._of(docs, ids)
        assert "hashpartitioning(id" not in made._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert made.join(ids, "id", "left_semi").count() == 600_000 and made.count() < 800_000
    assert jaccard_join._of(docs, ids.where("id < 0")).count() == 0
