"""Readers of plain tables with a contract of their own, and the choice between places."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillspark.operators.ranking import keep_first
from rillspark.operators.texts import paragraph_chunks
from rillspark.sources.tolerant import SourceError, read_json_lines, read_raw

TABULAR = ("csv", "parquet", "json")


def matching_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that a glob pattern meets, by the file system that Spark reads from."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(s.getPath().toString() for s in found or [])


def only_path(spark: SparkSession, pattern: str) -> str:
    found = matching_paths(spark, pattern)
    if len(found) != 1:
        raise SourceError(f"{len(found)} paths for {pattern}, not one")
    return found[0]


def first_path(spark: SparkSession, *places: str) -> str | None:
    """The first place that exists: places are never merged."""
    return next((p for p in places if matching_paths(spark, p)), None)


def read_tabular(spark: SparkSession, path: str) -> DataFrame | None:
    """A table of strings, or none for files of other kinds."""
    return read_raw(spark, path) if path.rstrip("/").rsplit(".", 1)[-1].lower() in TABULAR else None


def cells(df: DataFrame) -> DataFrame:
    """Every cell a string, the empty one for null."""
    return df.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns))


def read_object(spark: SparkSession, path: str) -> DataFrame:
    """One row: the JSON object of a file; an error for anything else."""
    df = spark.read.json(path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="__bad")
    if "__bad" in df.columns or not df.columns or len(df.take(2)) != 1:
        raise SourceError(f"no JSON object in {path}")
    return df


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    """What a table lacks, by its schema: no row is read."""
    return [c for c in required if c not in df.columns]


def weather(df: DataFrame, numbers: Sequence[str]) -> DataFrame:
    """day and numbers of rows with Year, Mon and Day; no row for days that do not exist."""
    part = lambda c, n: F.lpad(F.trim(F.col(c).cast("string")), n, "0")
    day = F.concat_ws("-", part("Year", 4), part("Mon", 2), part("Day", 2)).try_cast("date")
    return df.select(day.alias("day"), *(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).try_cast("double").alias(c) for c in numbers)).where("day is not null")


def month_sheet(df: DataFrame, year: int, day_column: str, month_columns: Sequence[str], **about: str) -> DataFrame:
    """day and value of a sheet with a row for each day of the month and a column for each month; impossible days and blanks are left out.

    ``about`` become constant columns (station, variable, unit).
    """
    pairs = F.array(*(F.struct(F.lit(i + 1).alias("month"), F.col(c).cast("string").alias("text")) for i, c in enumerate(month_columns)))
    long = df.select(F.col(day_column).cast("string").try_cast("int").alias("d"), F.inline(pairs))
    day = F.format_string("%04d-%02d-%02d", F.lit(year), "month", "d").try_cast("date")
    out = long.where("d is not null").select(day.alias("day"), F.nullif(F.trim("text"), F.lit("")).try_cast("double").alias("value"))
    return out.where("day is not null and value is not null").select("day", *(F.lit(v).alias(k) for k, v in about.items()), "value")


def level_sheet(df: DataFrame, day_column: str, value_column: str, **about: str) -> DataFrame:
    """day and value of a sheet with a row for each day."""
    out = df.select(F.trim(F.col(day_column).cast("string")).try_cast("date").alias("day"), *(F.lit(v).alias(k) for k, v in about.items()), F.col(value_column).cast("string").try_cast("double").alias("value"))
    return out.dropna(subset=["day", "value"])


def wide_gauges(long: DataFrame, stations: Sequence[str]) -> DataFrame:
    """A row for each day with <station>_flow and <station>_level: the first reading of each that is not null."""
    names = [f"{s}_{v}" for s in stations for v in ("flow", "level")]
    out = long.withColumn("__c", F.concat_ws("_", "station", "variable")).groupBy("day").pivot("__c", names).agg(F.min("value"))
    return out.select("day", *names)


def field_rows(blocks: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """All blocks one after the other; of rows with equal keys that of the first block, and in it the smallest."""
    both = None
    for i, b in enumerate(blocks):
        part = b.withColumn("__block", F.lit(i))
        both = part if both is None else both.unionByName(part, allowMissingColumns=True)
    rest = [F.col(c) for c in both.columns if c not in keys and c != "__block"]
    return keep_first(both, list(keys), [F.col("__block"), *rest]).drop("__block").orderBy(*keys)


def occurrences(spark: SparkSession, path: str, keys: Sequence[str], schema: str) -> DataFrame:
    """Each relation with its distinct (ordinal, chunk_id), in order."""
    rows = read_json_lines(spark, path, schema)
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_set(F.struct("ordinal", "chunk_id"))).alias("chunks"))


def relations(spark: SparkSession, *places: str) -> DataFrame:
    """Relations of the first place that exists; descriptions are evidence, and what a place lacks is null."""
    path = first_path(spark, *places)
    if path is None:
        raise SourceError(f"none of {', '.join(places)}")
    df = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else read_raw(spark, path)
    names = {"source": "source", "relation": "relation", "target": "target", "evidence": "evidence" if "evidence" in df.columns else "description"}
    return df.select(*((F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(k) for k, c in names.items()))


def text_chunks(spark: SparkSession, path: str, most: int = 1200, overlap: int = 0) -> DataFrame:
    """chunk_id (``stem#0001``), source_file, ordinal, char_start, char_end, chunk of whole text files."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("source_file"), "value")
    c = paragraph_chunks(files, "source_file", "value", most, overlap)
    stem = F.regexp_replace("source_file", r"\.[^.]*$", "")
    return c.select(F.format_string("%s#%04d", stem, F.col("ordinal") + 1).alias("chunk_id"), "source_file", "ordinal", "char_start", "char_end", "chunk")
