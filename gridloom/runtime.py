"""Sessions, and steps that cut the lineage of iterations."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "gridloom", master: str | None = None, **settings: str) -> SparkSession:
    """A session with adaptive execution and UTC; the cluster's own settings come first."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for k, v in settings.items():
        builder = builder.config(k.replace("_", "."), v)
    return builder.getOrCreate()


def durable(df: DataFrame) -> DataFrame:
    """Write a frame to the folder in spark.checkpoint.dir (a temporary one where none is named) and go on from there."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="gridloom-"))
    return df.checkpoint(eager=True)
