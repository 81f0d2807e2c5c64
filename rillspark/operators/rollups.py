"""Rollups of predictions, assets, attributions and labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillspark.operators.ranking import top_of_each


def first_known(df: DataFrame, columns: Sequence[str], order: str) -> DataFrame:
    """One row: the first value of each column that is not null, by an order of rows."""
    return df.agg(*(F.min(F.when(F.col(c).isNotNull(), F.struct(order, c)))[c].alias(c) for c in columns))


def assets(df: DataFrame, key: str, role: str, kind: str, kinds: Sequence[str], size: str, name: str, numeric: Sequence[str], most: int = 6) -> DataFrame:
    """Per key: the most frequent role (the smallest of equals), counts by kind, bytes, the first names, mean, low and high of every measure.

    Only the ``most`` smallest names of a key are brought together.
    """
    roles = df.groupBy(key, role).agg(F.count("*").alias("n")).groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("n"), role))[role].alias("role"))
    sums = df.groupBy(key).agg(
        *(F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in kinds),
        F.sum(size).alias("bytes"),
        *(x for m in numeric for x in (F.avg(m).alias(f"{m}_mean"), F.max(m).alias(f"{m}_max"), F.min(m).alias(f"{m}_min"))),
    )
    names = top_of_each(df.select(key, name).distinct(), [key], [F.col(name)], most).groupBy(key).agg(F.array_join(F.sort_array(F.collect_list(F.col(name).cast("string"))), ";").alias("names"))
    return sums.join(roles, key).join(names, key)


def policies(df: DataFrame, keys: list[str], means: Sequence[str], label: str, flag: Column, identity: str) -> DataFrame:
    """Per keys: means, the sorted distinct labels as a text, whether any row has the flag, the smallest id."""
    return df.groupBy(*keys).agg(*(F.avg(m).alias(m) for m in means), F.array_join(F.array_sort(F.collect_set(label)), ",").alias("labels"), F.max(flag).alias("any_flag"), F.min(identity).alias("first_id"))


def importance(df: DataFrame, model: str, values: str, names: Sequence[str], top: int) -> DataFrame:
    """model, feature, saliency (mean absolute value at the feature's place of an array), best first, ``top`` of each model."""
    each = df.select(model, F.posexplode(values).alias("i", "v")).groupBy(model, "i").agg(F.avg(F.abs("v")).alias("saliency"))
    named = each.withColumn("feature", F.element_at(F.array(*map(F.lit, names)), F.col("i") + 1)).where("feature is not null")
    return top_of_each(named.select(model, "feature", "saliency"), [model], [F.desc("saliency"), F.col("feature")], top)


def contributions(df: DataFrame, keys: list[str], effects: Mapping[str, Column], k: int = 3) -> DataFrame:
    """For each row the ``k`` strongest drivers (positive) and inhibitors (negative) with their effects, as texts. A row's own arrays, no window."""
    parts = F.array(*(F.struct(F.lit(n).alias("n"), c.alias("v")) for n, c in effects.items()))

    def top(sign: int) -> Column:
        mine = F.filter(F.transform(parts, lambda x: F.struct((-F.abs(x["v"])).alias("s"), x["n"].alias("n"), x["v"].alias("v"))), lambda x: (x["v"] * sign) > 0)
        return F.array_join(F.transform(F.slice(F.array_sort(mine), 1, k), lambda x: x["n"]), "|")

    return df.select(*keys, top(1).alias("drivers"), top(-1).alias("inhibitors"))


def zeroed(df: DataFrame, features: Sequence[str], predict) -> dict[str, Column]:
    """For each feature what a prediction loses where the feature is zero: ``predict`` makes a column of a mapping of columns."""
    whole = predict({f: F.col(f) for f in features})
    return {f: whole - predict({g: F.lit(0.0) if g == f else F.col(g) for g in features}) for f in features}


def tensor_cells(df: DataFrame, axes: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*axes).agg(F.sum(value).alias("total"), F.count(value).alias("n"))


def differences(df: DataFrame, keys: list[str], model: str, a: str, b: str, measures: Sequence[str]) -> DataFrame:
    """What each measure of model ``a`` is above that of ``b``."""
    of = lambda m, c: F.max(F.when(F.col(model) == m, F.col(c)))
    return df.groupBy(*keys).agg(*((of(a, c) - of(b, c)).alias(f"{c}_delta") for c in measures))


def spread(df: DataFrame, value: str, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(value).alias("low"), F.median(value).alias("middle"), F.max(value).alias("high"))


def success(y: Column, p: Column, absolute: float, relative: float) -> Column:
    """Share of predictions within the larger of an absolute and a relative bound."""
    return F.avg((F.abs(p - y) <= F.greatest(F.lit(absolute), F.abs(y) * relative)).cast("double"))


def label_confidence(ratio: Column, threshold: Column) -> Column:
    """How far a ratio is from its threshold, in thresholds, from 0.15 to 1."""
    return F.least(F.greatest(F.abs(ratio - threshold) / F.greatest(threshold, F.lit(1e-6)), F.lit(0.15)), F.lit(1.0))


def readiness(has_label: Column, images: Column, videos: Column) -> Column:
    """The first that holds: all sources, label and images, visual alone, label alone, nothing."""
    return F.when(has_label & (images > 0) & (videos > 0), "full_fusion").when(has_label & (images > 0), "image_fusion").when((images > 0) | (videos > 0), "visual_only").when(has_label, "label_only").otherwise("not_ready")


def breaches(df: DataFrame, keys: list[str], limits: Mapping[str, float]) -> DataFrame:
    """A row for each measure strictly over its limit: keys, feature, value, threshold, ratio."""
    cases = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"), F.lit(v).alias("threshold")) for f, v in limits.items()))
    return df.select(*keys, F.inline(cases)).where("value > threshold").withColumn("ratio", F.col("value") / F.col("threshold"))


def piecewise(c: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Linear between knots (x, y), constant outside."""
    out = F.lit(float(knots[-1][1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(knots[:-1], knots[1:], strict=True))):
        out = F.when(c < x1, y0 + (c - x0) * ((y1 - y0) / (x1 - x0))).otherwise(out)
    return F.when(c.isNotNull(), F.when(c < knots[0][0], F.lit(float(knots[0][1]))).otherwise(out))


def effect_scores(text: Column, effects: Mapping[str, Sequence[tuple[str, float]]]) -> dict[str, Column]:
    """For each effect the highest score of a phrase that stands in the text; 0 where none does."""
    low = F.lower(text)
    return {name: F.greatest(F.lit(0.0), F.lit(0.0), *(F.when(F.contains(low, F.lit(w)), F.lit(v)).otherwise(0.0) for w, v in phrases)) for name, phrases in effects.items()}


def balanced(df: DataFrame, weights: Mapping[str, float], down: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``balanced``: weighted measures, each scaled to 0..1 over the table (turned round for those to be low)."""
    bounds = df.agg(*(x for c in weights for x in (F.min(c).alias(f"__lo_{c}"), F.max(c).alias(f"__hi_{c}"))))  # one row
    unit = lambda c: (F.col(c) - F.col(f"__lo_{c}")) / F.greatest(F.col(f"__hi_{c}") - F.col(f"__lo_{c}"), F.lit(1e-12))
    score = sum(((1 - unit(c) if c in down else unit(c)) * w for c, w in weights.items()), F.lit(0.0))
    return df.crossJoin(F.broadcast(bounds)).withColumn("balanced", score).drop(*(f"__{s}_{c}" for s in ("lo", "hi") for c in weights))
