"""An analysis schema as a Spark database: tables, names and the log of one study area."""

from __future__ import annotations

import logging
import os
import re
from logging.handlers import RotatingFileHandler

from pyspark.sql import DataFrame, SparkSession

from .operators.consolidate import assert_unique

FEATURE, NEIGHBOURHOOD, TARGET = "feat_", "feat_neigh_", "tgt_"


class TableExists(ValueError):
    """An output that is there already and is not to be overwritten."""


class Workspace:
    """Tables of one study area. Operators work on frames; this reads and writes them by name."""

    def __init__(self, spark: SparkSession, schema: str):
        if not re.fullmatch(r"\w+", schema):
            raise ValueError(f"not a schema name: {schema}")
        self.spark, self.schema = spark, schema

    def init(self) -> Workspace:
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{self.schema}`")
        return self

    def _name(self, table: str) -> str:
        return f"`{self.schema}`.`{table}`"

    def tables(self, prefix: str = "") -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables(self.schema) if t.name.startswith(prefix) and not t.isTemporary)

    def exists(self, table: str) -> bool:
        return self.spark.catalog.tableExists(f"{self.schema}.{table}")

    def read(self, table: str) -> DataFrame:
        return self.spark.table(self._name(table))

    def columns(self, table: str) -> list[str]:
        return self.read(table).columns

    def write(self, df: DataFrame, table: str, overwrite: bool = False, key: str | None = None, append: bool = False, buckets: int | None = None) -> str:
        """Store a frame; with a key, after a check that it is one. buckets: by the key, so that joins on it need no
        shuffle."""
        if self.exists(table) and not (overwrite or append):
            raise TableExists(f"{self.schema}.{table} exists")
        out = (assert_unique(df, key) if key else df).write.mode("append" if append else "overwrite")
        if buckets and key:
            out = out.bucketBy(buckets, key).sortBy(key)
        out.saveAsTable(self._name(table))
        return table

    def update(self, table: str, df: DataFrame) -> None:
        """Replace a table by a frame that may be made from it: written beside it, then exchanged."""
        fresh = f"{table}__new"
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name(fresh)}")
        df.write.saveAsTable(self._name(fresh))
        self.spark.sql(f"DROP TABLE {self._name(table)}")
        self.spark.sql(f"ALTER TABLE {self._name(fresh)} RENAME TO {self._name(table)}")

    def drop(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name(table)}")

    def unique_name(self, stem: str, banned: tuple[str, ...] = ()) -> str:
        """The stem, or the stem with the first free number: only the stem itself and its numbered names count."""
        taken = set(self.tables(stem)) | set(banned)
        if stem not in taken:
            return stem
        n = 1
        while f"{stem}_{n}" in taken:
            n += 1
        return f"{stem}_{n}"

    def features(self, neighbourhood: bool | None = None) -> dict[str, DataFrame]:
        """Feature tables by name; neighbourhood: only those, or only the others."""
        names = [t for t in self.tables(FEATURE) if neighbourhood is None or t.startswith(NEIGHBOURHOOD) == neighbourhood]
        return {t: self.read(t) for t in names}

    def clear_features(self) -> list[str]:
        """Drop all feature tables."""
        names = self.tables(FEATURE)
        for t in names:
            self.drop(t)
        return names

    def srid(self, table: str) -> int | None:
        row = self.read(table).select("geometry.srid").first()
        return row["srid"] if row else None

    def log_to(self, folder: str, task: str) -> logging.Logger:
        """A rotating log file for a task, and the console."""
        os.makedirs(folder, exist_ok=True)
        log = logging.getLogger(f"gridloom.{self.schema}.{task}")
        log.setLevel(logging.DEBUG)
        if not log.handlers:
            file = RotatingFileHandler(os.path.join(folder, f"{self.schema}_{task}.log"), maxBytes=10 << 20, backupCount=3)
            file.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
            screen = logging.StreamHandler()
            screen.setLevel(logging.INFO)
            log.addHandler(file)
            log.addHandler(screen)
        return log
