"""The stages of the corpus pipeline on cases and against plain Python; operators on clashing names."""

import hashlib
import re

import numpy as np
import pytest

import corpus_pipeline as pipe
from gridloom.llm import chat_format, packing, pii, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EN = "the cat and the dog were in the house with all of the others and it was the best of days for them number {} of many"
DE = "der hund und die katze waren in dem haus mit allen anderen und es war der beste aller tage nummer {} von ihnen"


def rows(spark, texts, extra=False):
    made = [(i, t, "en", "web", len(t or "")) for i, t in texts]
    df = spark.createDataFrame([(*r, 7) for r in made], SCHEMA + ", kept long") if extra else spark.createDataFrame(made, SCHEMA)
    return df


def out(df):
    assert df.columns == pipe.COLUMNS
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_language_stage(spark):
    labelled = [(i, (EN if i % 2 else DE).format(i), "en" if i % 2 else "de", "web", 1) for i in range(100)]
    odd = [(200, None, None, None, None), (201, "", None, None, None), (202, "123 456 !", "en", None, 9), (None, EN, None, None, 3), (203, EN * 500, None, None, 3), (203, EN, None, None, 3), (203, EN, None, None, 3)]
    docs = spark.createDataFrame(labelled + odd, SCHEMA).withColumn("row", pipe.F.lit(1))
    kept = out(pipe.language(spark, docs, ""))
    assert kept == sorted([(r[0], r[1]) for r in labelled + odd if r[1] and re.search("[a-z]", r[1])], key=str)
    assert pipe.language(spark, docs.limit(0), "").count() == 0


def test_exact_stage(spark):
    texts = [(1, "a b"), (2, "a  b"), (2, "a  b"), (3, "c"), (3, "c"), (3, "d"), (3, "ab"), (None, "e"), (None, "e"), (None, "f"), (4, "f"), (5, None), (6, ""), (7, "x" * 9000), (8, "x" * 9000 + " ")]
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    want = {}
    for i, t in texts:
        best = want.setdefault(norm(t), (i, t))
        order = lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)
        want[norm(t)] = min(best, (i, t), key=order)
    got = out(pipe.exact_copies(spark, rows(spark, texts, True), ""))
    assert got == sorted(want.values(), key=str)
    assert pipe.exact_copies(spark, rows(spark, texts).limit(0), "").count() == 0


def test_near_stage(spark):
    base = " ".join(f"w{i}" for i in range(100))
    texts = [(5, base), (3, base + " tail"), (9, base.replace("w50", "x")), (1, "something else entirely is said in here"), (None, base), (2, None), (4, "")]
    got = out(pipe.near_copies(spark, rows(spark, texts, True), ""))
    assert got == sorted([(3, base + " tail"), texts[3], texts[4], texts[5], texts[6]], key=str)
    assert pipe.near_copies(spark, rows(spark, texts).limit(0), "").count() == 0


def test_private_stage(spark):
    texts = [(1, "write to jo.doe@example.com now"), (2, "jo.doe@example.com"), (3, "nothing"), (4, None), (None, "")]
    got = dict(out(pipe.private(spark, rows(spark, texts, True), "")))
    mail = re.search(r"\S+@example\.com", got[1])[0]
    assert mail != "jo.doe@example.com" and got[2] == mail and (got[3], got[4], got[None]) == ("nothing", None, "")


def test_packed_stage(spark):
    texts = [(1, "one two"), (1, "one two"), (2, None), (None, "x " * 9000)]
    got = pipe.packed(spark, rows(spark, texts, True), "").collect()
    assert sum(r["length"] for r in got) == sum(r["doc_tokens"] for r in got if r["start"] == 0) and len(got) == 6
    assert pipe.packed(spark, rows(spark, texts).limit(0), "").count() == 0


def test_whole_run(spark, tmp_path):
    texts = [(i, (EN if i % 2 else DE).format(f"{i} z{hashlib.md5(str(i).encode()).hexdigest()} " * 20), "en" if i % 2 else "de", "web", 1) for i in range(60)]
    texts += [(100 + i, t[1] + " ", t[2], "web", 1) for i, t in enumerate(texts[:20])] + [(200, "12 34", "en", "web", 5)]
    spark.createDataFrame(texts, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = pipe.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} == {100 + i for i in range(20)} | set(range(20, 60))


@pytest.mark.parametrize("names", ["_found", "_made", "_between"])
def test_pii_keeps_columns(spark, names):
    df = spark.createDataFrame([("call 078-05-1120", 1)], f"text string, {names} int")
    got = pii.pseudonymise(df, "k").collect()[0].asDict()
    assert set(got) == {"text", names, "n_pii"} and got[names] == 1 and got["n_pii"] == 1 and got["text"] != "call 078-05-1120"


def test_dates_are_permuted(spark):
    """Every day of an era has another pseudonym, and it is a day of the same era; days of all centuries are covered."""
    days = np.arange(np.datetime64("1900-01-01"), np.datetime64("1900-01-01") + 73000).astype(str)
    eras = ["0102-03-04", "1066-10-14", "1699-12-31", "2350-01-01", "9500-06-07"]
    first = int((np.datetime64("1900-01-01") - np.datetime64("1700-01-01")).astype(int)) // 73000 * 73000
    df = spark.createDataFrame([(str(d),) for d in [*days, *eras]], "text string").repartition(4)
    got = [r["text"] for r in pii.pseudonymise(df, "k").collect()]
    start = np.datetime64("1700-01-01") + first
    own = {g for g in got if start <= np.datetime64(g) < start + 73000}
    inside = [d for d in days if start <= np.datetime64(d) < start + 73000]
    assert len(set(got)) == len(got) and len(own) == len(inside) and not set(got) & set(eras)


def test_cards_stay_apart(spark):
    df = spark.sql("SELECT concat('4', lpad(cast(id AS string), 14, '0')) AS p FROM range(0, 3000)")
    df = df.selectExpr(f"concat(p, {pii._check_digit('p')}) AS text")
    got = [r["text"] for r in pii.pseudonymise(df, "k").collect()]
    assert len(set(got)) == 3000


def test_shards_by_rank(spark, tmp_path):
    """Sources with a common beginning get cells of their own; clashing names, repeated and null ids, written files."""
    docs = [(i if i % 10 else None, "t" * (i % 7), "en", f"https://example.com/dump/{i % 40:03d}", 1, 2) for i in range(400)] + [(1, "t", "en", None, 1, 2)] * 3
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, rank int, curve int")
    got = sharding.hilbert_shards(df, 8).collect()
    counts = [sum(r["shard"] == s for r in got) for s in range(8)]
    assert max(counts) - min(counts) <= 1 and len({r["curve"] for r in got}) > 200
    sharding.write_shards(df, str(tmp_path / "out"), 8)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, back.select(*df.columns).collect())) == sorted(map(str, df.collect()))
    assert max(r["n"] for r in back.groupBy("shard").agg(pipe.F.countDistinct("source").alias("n")).collect()) < 30
    with pytest.raises(ValueError):
        sharding.hilbert_order(df, {"source": pipe.F.col("source")})


def test_pack_beside_rank(spark):
    df = spark.createDataFrame([(1, 0, 5, 1, "a"), (2, 0, 3, 2, "b")], "doc_id long, start long, length long, ids_crc32 long, rank string")
    got = packing.pack(df, 8).collect()
    assert {r["rank"] for r in got} == {"a", "b"} and {r["sequence_id"] for r in got} == {0}


def test_mined_preferences(spark):
    turns = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "more"), (1, 3, "assistant", "sure"),
        (2, 0, "user", "hi"), (2, 1, "assistant", "yes"), (2, 2, "user", "more"), (2, 3, "assistant", "no"), (2, 4, "user", "oh"),
        (3, 0, "user", "x"), (3, 1, "assistant", "long"), (3, 2, "user", "y"), (3, 3, "assistant", "answer"), (3, 4, "user", "thanks"),
        (4, 0, "user", "only a question"), (None, 0, "user", "no id"), (None, 1, "assistant", "still text"),
    ]
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, kind int")
    got = chat_format.preferences(df).collect()
    by = {r["chosen_id"]: r for r in got}
    assert sorted(r["pair_id"] for r in got) == [0, 1, 2, 3, 4] and len(by) == 5
    pair = by[1]
    assert pair["kind"] == "sibling" and pair["rejected_id"] == 2 and pair["prompt_turns"] == 3
    assert pair["chosen"] == "<|im_start|>assistant\nsure<|im_end|>\n" and pair["rejected"].startswith("<|im_start|>assistant\nno<|im_end|>\n<|im_start|>user")
    assert by[4]["kind"] == "alone" and by[4]["rejected"] == "" and by[4]["prompt_turns"] == 0
    if by[3]["kind"] == "swapped":
        assert by[3]["prompt_turns"] == 3 and "answer" in by[3]["chosen"] and "thanks" in by[3]["chosen"] and "thanks" not in by[3]["rejected"]
    assert "still text" in by[None]["chosen"] + by[None]["prompt"]
    given = spark.createDataFrame([(1, 1, 2), (2, 3, 99), (3, None, 1)], "pair_id long, chosen_id long, rejected_id long")
    rows = {r["pair_id"]: r for r in chat_format.preferences(df, given).collect()}
    assert rows[1]["prompt_turns"] == 3 and rows[2]["rejected"] == "" and rows[3]["chosen"] == "" and rows[3]["prompt"] == ""
