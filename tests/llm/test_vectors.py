"""Near-duplicate vectors whose neighbour lists are too short for their links."""

import numpy as np
import pytest

from gridloom.llm import embedding_dedup


def _unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def _clusters(rng, dim, centres, many, spread):
    """`many` distinct vectors around each centre, at about `spread` from it."""
    return np.concatenate([_unit(c + spread * _unit(rng.normal(size=(many, dim)))) for c in centres])


def test_links_beyond_the_lists(spark):
    """Two tight clusters of 20 at a cosine of about 0.93 to each other: all lists are full of their own cluster."""
    rng = np.random.default_rng(5)
    a, b = _unit(rng.normal(size=64)), rng.normal(size=64)
    b = _unit(b - (b @ a) * a)
    x = _clusters(rng, 64, [a, 0.94 * a + np.sqrt(1 - 0.94**2) * b], 20, 0.07)
    x = np.concatenate([x, _unit(rng.normal(size=(20, 64)))])
    near = x @ x.T >= 0.9
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = {r["vec_id"]: r for r in embedding_dedup.near_vectors(df).collect()}
    assert near[:20, 20:40].any()
    assert [rows[i]["n_links"] for i in range(60)] == (near.sum(1) - 1).tolist()
    assert {rows[i]["component_id"] for i in range(40)} == {0} and [i for i in range(60) if rows[i]["kept"]] == [0, *range(40, 60)]


def test_audit_of_skewed_links(spark):
    """All links of one large group are found and none of 30 pairs: most links, but not those of most vectors."""
    rng = np.random.default_rng(6)
    pairs = np.repeat(_unit(rng.normal(size=(30, 64))), 2, axis=0) + 0.03 * rng.normal(size=(60, 64))
    x = np.concatenate([_clusters(rng, 64, _unit(rng.normal(size=(1, 64))), 100, 0.05), _unit(pairs)])
    a, b = np.nonzero((x @ x.T >= 0.9) & ~np.eye(160, dtype=bool))
    vectors = spark.createDataFrame([(i, 1, v.tobytes()) for i, v in enumerate(x)], "id long, many long, v binary")
    every = [(int(i), int(j), 1.0) for i, j in zip(a, b)]
    found = [e for e in every if e[0] < 100]
    assert len(every) == 9960 and len(found) / len(every) > embedding_dedup.RECALL
    links = lambda rows: spark.createDataFrame(rows, "a long, b long, sim double")
    assert embedding_dedup.audit(links(found), vectors, 0.9, 160) < 0.1
    assert embedding_dedup.audit(links(every), vectors, 0.9, 160) == 1
    inside = spark.createDataFrame([(i, 0) for i in range(100)], "id long, component long")
    assert embedding_dedup.audit(links(every[:0]), vectors, 0.9, 160, inside) < 0.1
    assert embedding_dedup.audit(links([e for e in every if e[0] >= 100]), vectors, 0.9, 160, inside) == 1


def test_recall_that_stays_short(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TRIES", 1)
    monkeypatch.setattr(embedding_dedup, "audit", lambda *a: 0.5)
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1])], "vec_id long, embedding array<double>")
    with pytest.raises(embedding_dedup.RecallError):
        embedding_dedup.near_vectors(vectors)


def test_tables_grow_with_the_cells():
    side = 1 - np.arccos(0.9) / np.pi
    for count in (100, 10_000, 100_000, 1_000_000, 100_000_000):
        cell = side ** max(0, np.ceil(np.log2(count / embedding_dedup.CHUNK)))
        assert (1 - cell) ** embedding_dedup.tables_for(count) <= embedding_dedup.MISS


def test_saturated_lists_and_components(spark):
    """A group of 700 (two blocks), a chain, pairs and copies: links and components by brute force."""
    rng = np.random.default_rng(8)
    x = _clusters(rng, 32, _unit(rng.normal(size=(1, 32))), 700, 0.3)
    turn = np.linspace(0, 3, 40)
    a, b = np.linalg.qr(rng.normal(size=(32, 2)))[0].T
    x = np.concatenate([x, np.outer(np.cos(turn), a) + np.outer(np.sin(turn), b), _unit(rng.normal(size=(60, 32))), x[:30]])
    linked = (x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    least = np.arange(len(x))
    while True:
        lower = np.minimum(least, np.where(linked, least[None, :], least[:, None]).min(1))
        if (lower == least).all():
            break
        least = lower
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = {r["vec_id"]: r for r in embedding_dedup.near_vectors(df).collect()}
    assert [rows[i]["n_links"] for i in range(len(x))] == linked.sum(1).tolist() and linked.sum(1).max() > 100
    assert [rows[i]["component_id"] for i in range(len(x))] == least.tolist()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in rows.values())
