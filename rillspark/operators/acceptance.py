"""Acceptance of raw tables of strings: stages that end at the first failure, and a grade.

The rules of a table are a Spark schema.  :func:`rule` makes a field of it; its metadata say what a source
may be called, its unit and range, and how several readings of a day become one.  Units are
the caller's too: factors between two of them, header endings that name one, and words for none.

Names and units are looked at on the driver, as they are no data.  Rows pass through one
projection, one ``distinct`` and one aggregation; figures come from two jobs.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, StringType, StructField, StructType

# Grades with the highest rates of missing, out-of-range and repeated readings, and the rows that a model needs.
GRADES = (("A", 0.05, 0.01, 0.01), ("B", 0.20, 0.05, 0.05), ("C", 0.40, 0.15, 0.15))
LEAST_ROWS = 30
KINDS = {"double": DoubleType(), "date": DateType(), "string": StringType()}
# Headers of the parts of a date.
DATE_PARTS = (("year", "年", "年份"), ("mon", "month", "月", "月份"), ("day", "日", "日期号"))


class NotAccepted(ValueError):
    """A table that cannot be accepted, with the reasons."""


@dataclass(frozen=True)
class Units:
    factors: Mapping[tuple[str, str], float] = field(default_factory=dict)
    endings: tuple[str, ...] = ()
    none: frozenset[str] = frozenset(("", "-"))

    def factor(self, given: str | None, wanted: str | None) -> float | None:
        """What a value is multiplied with; null if the units do not go together."""
        if given is None:
            return 1.0
        a, b = folded(given), folded(wanted or "")
        if a == b or a in self.none:
            return 1.0
        return self.factors.get((a, b))


def rule(name: str, kind: str = "double", required: bool = False, **about) -> StructField:
    """A field; ``about``: also (other names), unit, low, high, how (avg, sum, max, min), key (of text)."""
    return StructField(name, KINDS[kind], not required, {k: v for k, v in about.items() if v is not None})


def folded(text: str) -> str:
    return re.sub("[\\s﻿]+", "", unicodedata.normalize("NFKC", text)).replace("μ", "u").lower()


def parted(header: str, units: Units) -> tuple[str, str | None]:
    """A header folded for lookup, without a unit in brackets at its end, and its unit."""
    flat = folded(header)
    if flat.endswith(")") and "(" in flat:
        name, _, unit = flat[:-1].rpartition("(")
        return name, unit
    return flat, next((e for e in units.endings if flat.endswith(f"_{e}")), None)


@dataclass
class Sources:
    """Where the fields come from: a column of text and one of its value for each, and what did not go well."""

    text: dict[str, Column] = field(default_factory=dict)
    value: dict[str, Column] = field(default_factory=dict)
    conversions: dict[str, float] = field(default_factory=dict)
    unmapped: list[str] = field(default_factory=list)
    wrong_units: list[str] = field(default_factory=list)


def _is(f: StructField, kind: str) -> bool:
    return f.dataType.simpleString() == kind


def numbers(rules: StructType, names) -> list[StructField]:
    return [f for f in rules if _is(f, "double") and f.name in names]


def matched(raw: DataFrame, rules: StructType, units: Units, hints: Mapping[str, str] | None = None) -> Sources:
    """The sources of the rules' fields; of two sources the first. ``hints`` (a row of units) go before headers' units."""
    names = {parted(n, units)[0]: f for f in rules for n in (f.name, *f.metadata.get("also", ()))}
    out, heads = Sources(), {}
    for c in raw.columns:
        head, unit = parted(c, units)
        heads.setdefault(head, c)
        f = names.get(head)
        if f is None or f.name in out.value:
            out.unmapped.append(c)
            continue
        text = F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit(""))
        out.text[f.name] = text
        if _is(f, "double"):
            times = units.factor((hints or {}).get(c, unit), f.metadata.get("unit"))
            if times is None:
                out.wrong_units.append(c)
            elif times != 1.0:
                out.conversions[f.name] = times
            number = text.try_cast("double")
            out.value[f.name] = F.when(~F.isnan(number), number) * F.lit(times or 1.0)
        else:
            out.value[f.name] = text.try_cast("timestamp_ntz").cast("date") if _is(f, "date") else text
    parts = [next((heads[n] for n in group if n in heads), None) for group in DATE_PARTS]
    for f in rules:
        if _is(f, "date") and f.name not in out.value and None not in parts:
            out.text[f.name] = F.concat_ws("-", *(F.format_string("%02d", F.trim(F.col(f"`{p}`").cast("string")).try_cast("int")) for p in parts))
            out.value[f.name] = out.text[f.name].try_cast("date")
    return out


def in_range(f: StructField, value: Column) -> Column:
    low, high = f.metadata.get("low"), f.metadata.get("high")
    ok = F.lit(True)
    if low is not None:
        ok = ok & (value >= low)
    if high is not None:
        ok = ok & (value <= high)
    return ok


def mapped(raw: DataFrame, rules: StructType, units: Units, hints: Mapping[str, str] | None = None) -> DataFrame:
    """The fields found, typed and in their own units; raises for required fields without a source and for units that do not go together."""
    m = matched(raw, rules, units, hints)
    wrong = [f"unit of {c}" for c in m.wrong_units] + [f"no {f.name}" for f in rules if not f.nullable and f.name not in m.value]
    if wrong:
        raise NotAccepted("; ".join(wrong))
    return raw.select(*(m.value[f.name].alias(f.name) for f in rules if f.name in m.value))


def cleaned(df: DataFrame, rules: StructType) -> DataFrame:
    """Rows with a day and a measure, each once; measures out of their range are null, never clipped."""
    found = numbers(rules, df.columns)
    days = [f.name for f in rules if _is(f, "date") and f.name in df.columns]
    rows = df.where(F.coalesce(*(F.col(f.name) for f in found)).isNotNull()).dropna(subset=days)
    return rows.withColumns({f.name: F.when(in_range(f, F.col(f.name)), F.col(f.name)) for f in found})


def aligned(df: DataFrame, rules: StructType) -> DataFrame:
    """One row for each day and key (a null key is one), each measure by its own aggregate; other texts by the smallest.

    A sum over no reading is 0, as a day without rain.
    """
    here = [f for f in rules if f.name in df.columns]
    keys = [f.name for f in here if _is(f, "date") or f.metadata.get("key")]

    def of(f: StructField) -> Column:
        if not _is(f, "double"):
            return F.min(f.name)
        how = f.metadata.get("how", "avg")
        value = F.expr(f"{how}(`{f.name}`)")
        return F.coalesce(value, F.lit(0.0)) if how == "sum" else value

    return df.groupBy(*keys).agg(*(of(f).alias(f.name) for f in here if f.name not in keys))


def profile(raw: DataFrame, rules: StructType, units: Units, hints: Mapping[str, str] | None = None) -> DataFrame:
    """One row: n_rows, n_padding, n_no_day and, for each measure, missing, unparseable, out_of_range, min, max and mean (of those in range)."""
    m = matched(raw, rules, units, hints)
    found = numbers(rules, m.value)
    filled = F.coalesce(*(m.value[f.name] for f in found)).isNotNull()
    days = [m.value[f.name] for f in rules if _is(f, "date") and f.name in m.value]
    out = [F.count("*").alias("n_rows"), F.count_if(~filled).alias("n_padding"), *(F.count_if(filled & d.isNull()).alias("n_no_day") for d in days[:1])]
    for f in found:
        v, good = m.value[f.name], F.when(in_range(f, m.value[f.name]), m.value[f.name])
        out += [
            F.count_if(filled & v.isNull()).alias(f"{f.name}_missing"),
            F.count_if(m.text[f.name].isNotNull() & v.isNull()).alias(f"{f.name}_unparseable"),
            F.count_if(filled & ~in_range(f, v)).alias(f"{f.name}_out_of_range"),
            F.min(good).alias(f"{f.name}_min"),
            F.max(good).alias(f"{f.name}_max"),
            F.avg(good).alias(f"{f.name}_mean"),
        ]
    return raw.agg(*out)


PROFILE = ("missing", "unparseable", "out_of_range", "min", "max", "mean")


def by_field(wide: DataFrame, rules: StructType) -> DataFrame:
    """:func:`profile` with a row for each measure."""
    here = [f.name for f in rules if f"{f.name}_missing" in wide.columns]
    return wide.select(F.inline(F.array(*(F.struct(F.lit(n).alias("field"), *(F.col(f"{n}_{p}").alias(p) for p in PROFILE)) for n in here))))


def daily_figures(df: DataFrame, rules: StructType) -> DataFrame:
    """One row about aligned rows: n_rows, first_day, last_day, n_days, gap_days, n_keys, n_modelable (all required fields there), missing_rate."""
    here = [f for f in rules if f.name in df.columns]
    day = next(f.name for f in here if _is(f, "date"))
    found = numbers(rules, df.columns)
    required = F.lit(True)
    for f in here:
        if not f.nullable:
            required = required & F.col(f.name).isNotNull()
    keys = [f.name for f in here if f.metadata.get("key")]
    span = F.coalesce(F.datediff(F.max(day), F.min(day)) + 1, F.lit(0))
    blanks = sum((F.sum(F.col(f.name).isNull().cast("long")) for f in found), F.lit(0))
    return df.agg(
        F.count("*").alias("n_rows"),
        F.min(day).alias("first_day"),
        F.max(day).alias("last_day"),
        F.countDistinct(day).alias("n_days"),
        (span - F.countDistinct(day)).cast("long").alias("gap_days"),
        (F.countDistinct(F.struct(*keys)) if keys else F.lit(0)).cast("long").alias("n_keys"),
        F.count_if(required).alias("n_modelable"),
        F.coalesce(F.try_divide(blanks, F.count("*") * len(found)), F.lit(0.0)).alias("missing_rate"),
    )


def grade(missing: float, out_of_range: float, repeated: float) -> str:
    return next((name for name, a, b, c in GRADES if missing <= a and out_of_range <= b and repeated <= c), "D")


@dataclass
class Stage:
    name: str
    ok: bool
    errors: list[str]
    facts: dict[str, object]


@dataclass
class Outcome:
    """What the chain came to; ``rows`` only where the table is accepted."""

    stages: list[Stage]
    accepted: bool
    grade: str
    rows: DataFrame | None = None

    def report(self, spark: SparkSession) -> DataFrame:
        """A row for each stage that was reached."""
        rows = [(i, s.name, s.ok, s.errors, {k: str(v) for k, v in s.facts.items()}) for i, s in enumerate(self.stages)]
        return spark.createDataFrame(rows, "ordinal int, stage string, ok boolean, errors array<string>, facts map<string,string>")


def chain(raw: DataFrame, rules: StructType, units: Units, hints: Mapping[str, str] | None = None, markers: Sequence[str] = ()) -> Outcome:
    """Uploaded, validated, mapped, cleaned, aligned, graded: ends at the first stage that fails.

    ``markers``: pieces of headers of tables that another reader has to turn into rows first.
    """
    stages = [Stage("uploaded", True, [], {"columns": len(raw.columns), "units_row": bool(hints)})]

    def step(name: str, errors: list[str], **facts) -> bool:
        stages.append(Stage(name, not errors, errors, facts))
        return not errors

    m = matched(raw, rules, units, hints)
    absent = [f.name for f in rules if not f.nullable and f.name not in m.value]
    errors = ["file_is_empty"] * raw.isEmpty() + ["requires_dedicated_preprocessor"] * any(x in c for x in markers for c in raw.columns) + ["missing_required_fields"] * bool(absent)
    if not step("validated", errors, missing=absent):
        return Outcome(stages, False, "D")
    if not step("mapped", ["unconvertible_unit"] * bool(m.wrong_units), conversions=m.conversions, unmapped=m.unmapped):
        return Outcome(stages, False, "D")
    clean = cleaned(mapped(raw, rules, units, hints), rules)
    once = clean.distinct()
    counts = profile(raw, rules, units, hints).first().asDict()
    n_clean, n_once = clean.count(), once.count()
    names = [f.name for f in numbers(rules, m.value)]
    out_of_range, unparseable = (sum(counts[f"{n}_{k}"] for n in names) for k in ("out_of_range", "unparseable"))
    step("cleaned", [], rows=n_once, padding=counts["n_padding"], repeated=n_clean - n_once, out_of_range=out_of_range, unparseable=unparseable)
    rows = aligned(once, rules)
    d = daily_figures(rows, rules).first().asDict()
    if not step("aligned", ["no_aligned_rows"] * (not d["n_rows"]), **d):
        return Outcome(stages, False, "D")
    short = d["n_modelable"] < LEAST_ROWS
    mark = "D" if short else grade(d["missing_rate"], out_of_range / d["n_rows"], (n_clean - n_once) / counts["n_rows"])
    reasons = ["insufficient_modelable_rows"] * short or ["quality_grade_below_threshold"] * (mark == "D")
    step("graded", reasons, grade=mark)
    return Outcome(stages, not reasons, mark, None if reasons else rows)
