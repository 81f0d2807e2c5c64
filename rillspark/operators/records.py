"""Records and their lists: pages, summaries, upserts, histories, versions, life cycles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matching(df: DataFrame, equal: Mapping[str, object] | None = None, day: str | None = None, first: str | None = None, last: str | None = None, keyword: str | None = None, searched: Sequence[str] = ()) -> DataFrame:
    """Rows by equality or membership, day bounds and a keyword.

    A list means membership.  A row without a day passes the bounds.  The keyword is sought as it is, without
    wildcards and case, in the searched columns joined by blanks.
    """
    for c, v in (equal or {}).items():
        df = df.where(F.col(c).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(c) == F.lit(v))
    if first:
        df = df.where(F.col(day).isNull() | (F.to_date(day) >= F.lit(first).cast("date")))
    if last:
        df = df.where(F.col(day).isNull() | (F.to_date(day) <= F.lit(last).cast("date")))
    if keyword:
        df = df.where(F.lower(F.concat_ws(" ", *(F.col(c).cast("string") for c in searched))).contains(keyword.lower()))
    return df


def page(df: DataFrame, order: Sequence[Column | str], offset: int, limit: int) -> DataFrame:
    """``limit`` rows from ``offset`` on, and has_next: one row more is taken to know that, and no row is counted."""
    numbered = df.orderBy(*order).limit(offset + limit + 1)
    i = F.row_number().over(Window.orderBy(*order))  # of at most offset + limit + 1 rows
    return numbered.withColumn("__i", i).withColumn("has_next", F.max("__i").over(Window.partitionBy(F.lit(0))) > offset + limit).where((F.col("__i") > offset) & (F.col("__i") <= offset + limit)).drop("__i")


def summary(df: DataFrame, station: str, day: str, measures: Sequence[str]) -> DataFrame:
    """One row over all matches: count, distinct stations, first and last day, mean of each measure."""
    return df.agg(F.count("*").alias("n"), F.countDistinct(station).alias("stations"), F.min(F.to_date(day)).alias("first_day"), F.max(F.to_date(day)).alias("last_day"), *(F.avg(m).alias(f"mean_{m}") for m in measures))


def values_of(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct texts of a column; none where the table has no such column."""
    if column not in df.columns:
        return df.sparkSession.createDataFrame([], "value string")
    return df.select(F.col(column).cast("string").alias("value")).dropna().distinct().orderBy("value")


def upserted(base: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """All keys of both, each with its record of the highest version; of equal ones that of ``new``."""
    both = base.withColumn("__side", F.lit(0)).unionByName(new.withColumn("__side", F.lit(1)))
    rest = [c for c in base.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.max(F.struct(version, "__side", F.struct(*rest).alias("r"))).alias("b"))
    return best.select(*keys, "b.r.*").select(*base.columns)


def inserted(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` and the records of ``new`` whose keys it lacks."""
    return base.unionByName(new.join(base.select(*keys).distinct(), keys, "left_anti").select(*base.columns))


def merged(old: Column, new: Column) -> Column:
    """Entries of both maps; those of the new one win."""
    kept = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k))
    return F.when(new.isNull(), old).when(old.isNull(), new).otherwise(F.map_concat(kept, new))


def guarded(changes: DataFrame, key: str, order: list[str], state: str, allowed: Sequence[tuple[str, str]]) -> DataFrame:
    """Each change with ``before`` and ``ok``: whether the step from the state before it is an allowed one. A first state is."""
    before = F.lag(state).over(Window.partitionBy(key).orderBy(*order))
    steps = F.array(*(F.lit(f"{a}>{b}") for a, b in allowed))
    return changes.withColumn("before", before).withColumn("ok", F.col("before").isNull() | F.array_contains(steps, F.concat("before", F.lit(">"), F.col(state))))


def histories(changes: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """The states of each key in their order, as an array."""
    return changes.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(*order, state))), lambda x: x[state]).alias("history"))


def versioned(known: DataFrame, new: DataFrame, key: str, digest: str, order: list[str]) -> DataFrame:
    """Records of ``new`` whose content a key does not have yet, each content once, numbered on from the key's last version."""
    unseen = new.join(known.select(key, digest).distinct(), [key, digest], "left_anti")
    once = unseen.withColumn("__k", F.row_number().over(Window.partitionBy(key, digest).orderBy(*order))).where("__k = 1").drop("__k")
    last = known.groupBy(key).agg(F.max("version").alias("__last"))
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return once.join(last, key, "left").withColumn("version", (F.coalesce("__last", F.lit(0)) + n).cast("long")).drop("__last")


def published(models: DataFrame, key: str, when: str, tie: str) -> DataFrame:
    """is_default: the newest published record of each key; the others are superseded."""
    newest = models.groupBy(key).agg(F.max(F.struct(when, tie)).alias("__n"))
    return models.join(newest, key).withColumn("is_default", F.struct(when, tie) == F.col("__n")).drop("__n")


def usable(versions: DataFrame, coverage: str, station: Column | str) -> DataFrame:
    """Versions whose coverage holds the station, or is empty."""
    s = F.lit(station) if isinstance(station, str) else station
    return versions.where((F.size(F.coalesce(F.col(coverage), F.array().cast("array<string>"))) == 0) | F.array_contains(coverage, s))


def common_window(versions: DataFrame, first: str, last: str) -> DataFrame:
    """The days that all versions cover: none where they do not meet."""
    w = versions.agg(F.max(first).alias("first_day"), F.min(last).alias("last_day"))
    return w.where("first_day <= last_day")


def expired(df: DataFrame, dates: Sequence[str], cutoff: Column, unused: Column) -> DataFrame:
    """Records whose first known date is at or before the cutoff, and which nothing uses."""
    return df.where((F.coalesce(*(F.col(c) for c in dates)) <= cutoff) & unused)


def listed(text: Column, mark: str = ";") -> Column:
    """Trimmed pieces of a text between marks, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), mark), lambda x: F.trim(x)), lambda x: x != "")


def progress(stages: Mapping[str, float], stage: Column, share: Column) -> Column:
    """Percent done: the weights of the stages before this one and its own share, of all weights."""
    total, done, out = sum(stages.values()), 0.0, F.lit(None).cast("double")
    for name, weight in stages.items():
        out = F.when(stage == name, (F.lit(done) + weight * F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))) * 100 / total).otherwise(out)
        done += weight
    return out


def timed_out(df: DataFrame, started: str, now: Column, limit_seconds: int) -> DataFrame:
    """state: ``timeout`` for what runs longer than the limit."""
    return df.withColumn("elapsed", (F.unix_timestamp(now) - F.unix_timestamp(started)).cast("long")).withColumn("state", F.when(F.col("elapsed") > limit_seconds, "timeout").otherwise("running"))
