"""Tables from delimited text whose separator and types are found out."""

from __future__ import annotations

import csv
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEPARATORS = (";", ",", "|")
HEADER_CHARS = 20_000
WHOLE, NUMBER, DAY = r"^[+-]?\d+$", r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$", r"^\d{4}-\d{1,2}-\d{1,2}$"
#: Types that a sidecar file can declare (fixed values of the format).
DECLARED = {"String": "string", "Integer": "bigint", "Real": "double", "DateTime": "timestamp_ntz", "Date": "date", "Time": "string"}


class TableError(ValueError):
    """A file that can't be read as a table."""


def separator(header: str) -> str:
    """The first of ; , | that the header has."""
    for s in SEPARATORS:
        if s in header:
            return s
    raise TableError("no separator is found in the header")


def guess_all(text: DataFrame) -> list[str]:
    """Types of the columns from all their texts, empty ones aside, in one aggregation."""
    tests = []
    for i, n in enumerate(text.columns):
        c = F.col(f"`{n}`")
        number = F.when(c.rlike(NUMBER), c.try_cast("double"))
        day = F.when(c.rlike(DAY), c.try_cast("date"))
        whole = c.rlike(WHOLE) & c.try_cast("bigint").isNotNull()
        rounded = (number == F.floor(number)) & number.try_cast("decimal(38,0)").try_cast("bigint").isNotNull()
        flags = {"flag": c.isin("0", "1"), "integer": whole | rounded, "digits": c.rlike(WHOLE), "number": number.isNotNull(), "day": day.isNotNull()}
        tests += [F.count(c).alias(f"seen{i}"), *[F.bool_and(F.when(c.isNotNull(), F.coalesce(f, F.lit(False)))).alias(f"{k}{i}") for k, f in flags.items()]]
    row = text.agg(*tests).first()
    kinds = (("flag", "boolean"), ("integer", "bigint"), ("digits", "string"), ("number", "double"), ("day", "timestamp_ntz"))
    return [next((kind for k, kind in kinds if row[f"seen{i}"] and row[f"{k}{i}"]), "string") for i in range(len(text.columns))]


def declared(line: str) -> list[str]:
    """Types of a sidecar file's line such as "String","Real(10.2)"."""
    out = []
    for item in next(csv.reader([line])):
        name = re.sub(r"\(.*\)", "", item).strip()
        if name not in DECLARED:
            raise TableError(f"unknown declared type: {item}")
        out.append(DECLARED[name])
    return out


def read_table(spark: SparkSession, path: str, encoding: str = "utf-8", types: str | None = None) -> DataFrame:
    """A table with the types of its columns, guessed from all rows or declared in the file `types`.

    A whole number with a decimal point counts as whole, and whole numbers too long for a bigint are text; empty texts
    are null. A value that does not fit a declared type is an error when it is read.
    """
    head = spark.read.text(path).first()
    if head is None:
        raise TableError(f"{path} is empty")
    header = head["value"].lstrip("\ufeff")[:HEADER_CHARS]
    sep = separator(header)
    names = [n.strip().strip('"') for n in next(csv.reader([header], delimiter=sep))]
    if types:
        kinds = declared(spark.read.text(types).first()["value"])
        if len(kinds) != len(names):
            raise TableError("as many types as columns must be declared")
    text = spark.read.csv(path, sep=sep, header=True, encoding=encoding, nullValue="", schema=", ".join(f"`{n}` string" for n in names))
    if not types:
        kinds = guess_all(text)

    def typed(n: str, k: str):
        c = F.col(f"`{n}`")
        if k == "string":
            return c
        if k == "bigint":
            number = c.try_cast("double")
            made = F.coalesce(c.try_cast("bigint"), F.when(number == F.floor(number), number.try_cast("decimal(38,0)").try_cast("bigint")))
        elif k == "boolean":
            made = F.when(c == "1", True).when(c == "0", False)
        else:
            made = c.try_cast(k)
        wrong = F.raise_error(F.concat(F.lit(f"column {n}: not a {k}: "), c))
        return F.when(c.isNull() | made.isNotNull(), made).otherwise(wrong.cast(k))

    return text.select(*[typed(n, k).alias(n) for n, k in zip(names, kinds, strict=True)])
