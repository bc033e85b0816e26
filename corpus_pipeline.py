"""A corpus from raw documents to packed training windows.

Stages, in order: language identification (documents in no language go), exact deduplication, near-duplicate removal
(one document of each group stays), pseudonyms for personal data, packing. Each stage is written as Parquet and read
again by the next.

Each stage takes the columns of documents; others are left out, and a missing one is an error. Null ids belong to no group
of near duplicates; null and empty texts are in no language, so none is left after the first stage. Rows of one id are
told apart by their texts in the second stage, and taken for one document by the third.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm import exact_dedup as exact
from gridloom.llm import jaccard_join, language_id, packing, pii
from gridloom.llm._runtime import durable, sieved, table
from gridloom.llm.queries import pii_key

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language; those without a letter go. Columns are those of documents."""
    found = language_id.identify(docs, language_id.train(docs), keep=COLUMNS)
    return found.where("lang_pred <> 'und'").select("row.*").select(*COLUMNS)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of equal texts, repeated rows included.

    Rows are told by their id. Ids of several rows (or null) tell no row; only those rows are told by their texts too.
    """
    told = durable(exact.exact_dedup(docs).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.when(F.col("kept"), F.col("text_sha256"))).alias("stays")))
    gone = told.where("n > 1 OR size(stays) = 0 OR doc_id IS NULL").select(F.col("doc_id").alias("_id"))
    single = docs.select(*COLUMNS).join(gone, docs["doc_id"].eqNullSafe(gone["_id"]), "left_anti")
    shared = told.where("(n > 1 OR doc_id IS NULL) AND size(stays) > 0").select(F.col("doc_id").alias("_id"), "stays")
    again = docs.select(*COLUMNS).join(shared, docs["doc_id"].eqNullSafe(shared["_id"]))
    again = again.withColumn("_key", F.sha2(F.encode(exact.normalised(F.col("text")), "UTF-8"), 256)).where(F.array_contains("stays", F.col("_key")))
    first = Window.partitionBy("_key", "doc_id").orderBy(F.desc(F.char_length("text")), "text")
    again = again.withColumn("_place", F.row_number().over(first)).where("_place = 1").select(*COLUMNS)
    return single.unionByName(again)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each group of near duplicates; documents without an id are in no group.

    Only documents whose id may be a duplicate's are dealt by it.
    """
    placed = jaccard_join.jaccard_components(docs)
    gone = durable(placed.where("doc_id <> component_id").select("doc_id").distinct())
    told = sieved(docs.select(*COLUMNS), "doc_id", gone.select(F.col("doc_id").alias("id")))
    rest = told.where("sieved").join(gone, "doc_id", "left_anti")
    return told.where("NOT sieved").select(*COLUMNS).unionByName(rest.select(*COLUMNS))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by pseudonyms of the same format."""
    return pii.pseudonymise(docs.select(*COLUMNS), pii_key(spark), count_col=None)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in training windows."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("exact_dedup", exact_copies),
    ("jaccard_join", near_copies),
    ("pii", private),
    ("packing", packed),
]

#: Learned predictions, pseudonyms and packing can't be written in SQL; tests/llm/test_pipeline.py runs each stage on
#: cases and against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`; each stage's rows go to the shared folder as Parquet."""
    docs = table(spark, sf_dir, "documents")
    durable(spark.range(1))  # sets a folder where the session names none
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
