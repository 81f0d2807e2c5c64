"""Readers that take every cell as a string, and tell what they cannot read."""

from __future__ import annotations

import re

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

UNIT = re.compile(r"\(?\s*(?:[a-zA-Zµμ°℃%‰]{1,6}[0-9³²]{0,2}(?:\s*/\s*[a-zA-Z]{1,3}[0-9³²]{0,2})?|-)\s*\)?")
#: A first row is one of units if so many of its filled cells look like a unit.
UNIT_SHARE = 0.6


class SourceError(ValueError):
    """A source that is missing, of an unknown kind or not readable."""


def as_strings(df: DataFrame) -> DataFrame:
    """Scalars cast, nested values as JSON, names as they are."""
    nested = ("array", "struct", "map")
    return df.select(*((F.to_json(f"`{n}`") if t.startswith(nested) else F.col(f"`{n}`").cast("string")).alias(n) for n, t in df.dtypes))


def _records(df: DataFrame) -> DataFrame:
    """Rows of a JSON list, or of the list that an object holds as ``records`` or ``data``."""
    for name in ("records", "data"):
        if name in df.columns and isinstance(df.schema[name].dataType, ArrayType) and isinstance(df.schema[name].dataType.elementType, StructType):
            return df.select(F.inline(name))
    return df


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """A csv, parquet or json path as strings; blanks stay blanks and a byte order mark goes."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    try:
        if suffix == "csv":
            df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
        elif suffix == "parquet":
            df = spark.read.parquet(path)
        elif suffix == "json":
            df = _records(spark.read.json(path, multiLine=True))
        else:
            raise SourceError(f"no reader for .{suffix}")
    except PySparkException as e:
        raise SourceError(f"cannot read {path}: {e.getCondition()}") from e
    return as_strings(df.toDF(*(c.removeprefix("﻿") for c in df.columns)))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of a file with one in each line; blank, broken and other lines are left out."""
    rows = spark.read.schema(f"{schema}, __bad string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="__bad")
    return rows.where("__bad is null").drop("__bad")


def split_units(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows without those of units, and the unit of each column.

    The first row is looked at.  If it holds units, all rows equal to it go, so that a
    folder of files with a row of units each is read as one table.
    """
    first = df.first()
    filled = {c: v.strip() for c, v in (first.asDict() if first else {}).items() if v and v.strip()}
    if not filled or sum(bool(UNIT.fullmatch(v)) for v in filled.values()) < UNIT_SHARE * len(filled):
        return df, {}
    same = F.lit(True)
    for c in df.columns:
        same = same & F.col(f"`{c}`").eqNullSafe(F.lit(first[c]))
    return df.where(~same), filled
