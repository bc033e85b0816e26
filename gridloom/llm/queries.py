"""The operators' queries over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

import secrets
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, chat_format, embedding_dedup, exact_dedup, jaccard_join, language_id, packing, pii, sharding, toxicity
from ._runtime import fold, table

#: The setting that names the secret key of the pseudonyms.
KEY_SETTING = "spark.gridloom.pii.key"


def pii_key(spark: SparkSession) -> str:
    """The session's key; where none is set, a random one for this session, whose pseudonyms no other run repeats."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key


def _held_out(buckets: int, held: int) -> Column:
    return F.coalesce(fold("doc_id", buckets) == held, F.lit(False)).alias("held_out")


def op1_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_ecoc_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs.select("doc_id", "text"), language_id.train(docs.select("doc_id", "text", "lang")))
    return found.select("row.doc_id", "lang_pred", "score", "ambiguous").select("doc_id", _held_out(4, 2), "lang_pred", "score", "ambiguous")


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.hilbert_shards(table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def op5_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tagged = toxicity.tag(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return tagged.select("doc_id", _held_out(5, 0), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))


def op6_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(spark))


def op7_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def op8_word_table_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chat_format.preferences(table(spark, sf_dir, "conversations"))
    flat = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["begin"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",").alias(c)
    return made.select("pair_id", "chosen_id", "rejected_id", "kind", "prompt_turns", "prompt", "chosen", "rejected", flat("chosen_mask"), flat("rejected_mask"))


def op10_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_block_naming, op2_ecoc_language, op3_hilbert_shards, op4_jaccard_join, op5_crf_toxicity,
        op6_feistel_pii, op7_bin_slack_packing, op8_word_table_bpe, op9_preference_format, op10_nn_descent,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_block_naming": r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS size, regexp_replace(coalesce(text, ''), '[\x09-\x0D\x20]', '', 'g') AS k
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY k ORDER BY size DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY k) AS group_size
  FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(k) AS text_sha256 FROM g
""",
    "op9_preference_format": """
WITH conv AS (
  SELECT conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations GROUP BY conv_id
), keyed AS (
  SELECT *, md5(turns[1].role || chr(10) || turns[1].text) AS first,
    coalesce(list_max(list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant')), 0) AS answer
  FROM conv
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY first, conv_id) - 1 AS rank FROM keyed
), met AS (
  SELECT a.rank AS pair_id, a.conv_id AS chosen_id, b.conv_id AS next_id, a.turns AS c, b.turns AS other, a.answer AS own, b.answer AS other_own,
    CASE WHEN a.first = b.first THEN 'sibling' WHEN a.answer > 0 AND b.answer > 0 THEN 'swapped' ELSE 'alone' END AS kind
  FROM ranked a LEFT JOIN ranked b ON b.rank = a.rank + 1
), pairs AS (
  SELECT pair_id, chosen_id, CASE WHEN kind <> 'alone' THEN next_id END AS rejected_id, kind, c,
    CASE kind WHEN 'sibling' THEN other WHEN 'swapped' THEN list_concat(c[:own - 1], other[other_own:other_own]) ELSE [] END AS r
  FROM met
), cut AS (
  SELECT *, CAST(coalesce(list_min(list_filter(range(1, greatest(len(c), len(r)) + 1), lambda i: i > len(c) OR i > len(r) OR c[i] IS DISTINCT FROM r[i])) - 1, len(c)) AS INTEGER) AS prompt_turns
  FROM pairs
), side AS (
  SELECT *, c[:prompt_turns] AS p, c[prompt_turns + 1:] AS cc, r[prompt_turns + 1:] AS rr FROM cut
), lens AS (
  SELECT *,
    list_transform(cc, lambda t: length(t.role) + length(t.text) + 24) AS cl,
    list_transform(rr, lambda t: length(t.role) + length(t.text) + 24) AS rl
  FROM side
)
SELECT pair_id, chosen_id, rejected_id, kind, prompt_turns,
  coalesce(array_to_string(list_transform(p, lambda t: '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10)), ''), '') AS prompt,
  coalesce(array_to_string(list_transform(cc, lambda t: '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10)), ''), '') AS chosen,
  coalesce(array_to_string(list_transform(rr, lambda t: '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10)), ''), '') AS rejected,
  coalesce(array_to_string(list_transform(list_filter(range(1, len(cc) + 1), lambda i: cc[i].role = 'assistant'),
    lambda i: CAST(CAST(coalesce(list_sum(cl[:i - 1]), 0) AS BIGINT) + 13 + length(cc[i].role) AS VARCHAR) || '-' || CAST(CAST(coalesce(list_sum(cl[:i]), 0) AS BIGINT) - 1 AS VARCHAR)), ','), '') AS chosen_mask,
  coalesce(array_to_string(list_transform(list_filter(range(1, len(rr) + 1), lambda i: rr[i].role = 'assistant'),
    lambda i: CAST(CAST(coalesce(list_sum(rl[:i - 1]), 0) AS BIGINT) + 13 + length(rr[i].role) AS VARCHAR) || '-' || CAST(CAST(coalesce(list_sum(rl[:i]), 0) AS BIGINT) - 1 AS VARCHAR)), ','), '') AS rejected_mask
FROM lens
""",
    "op4_jaccard_join": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x09-\x0D\x20]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words
), classes AS (
  SELECT min(doc_id) AS rep, list_sort(s) AS s FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)
), entries AS (
  SELECT rep, len(s) AS n, hash(unnest(s)) AS h FROM classes
), common AS (
  SELECT a.rep AS x, b.rep AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS k
  FROM entries a JOIN entries b ON a.h = b.h AND a.rep < b.rep GROUP BY a.rep, b.rep
), links AS (
  SELECT x, y FROM common WHERE 180 * k >= 80 * (nx + ny)
), undirected AS (
  SELECT x, y FROM links UNION SELECT y, x FROM links
), reach(rep, other) AS (
  SELECT rep, rep FROM classes UNION SELECT r.rep, b.y FROM reach r JOIN undirected b ON r.other = b.x
), least AS (
  SELECT rep, min(other) AS component_id FROM reach GROUP BY rep
)
SELECT t.doc_id, CAST(len(t.s) AS BIGINT) AS n_shingles, coalesce(l.component_id, t.doc_id) AS component_id
FROM sets t LEFT JOIN classes c ON c.s = list_sort(t.s) AND len(t.s) > 0 LEFT JOIN least l ON l.rep = c.rep
""",
}
