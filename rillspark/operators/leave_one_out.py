"""Leave-one-out models for tables of any length: every fold's model from one set of sums, less its own row.

A fold fills gaps with the medians of its other rows, standardizes, keeps the features of most F where there are more
features than rows, takes their principal components and fits a ridge model.  All of that follows from sums of
products, and those of a fold are the table's sums less one row.  The sums are made in one pass; a second one
gives each row its model, a small matrix at a time.  No row meets another one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillspark.operators.quantiles import running

#: Fixed values of the model: strength of the ridge, features kept and components where features outnumber rows, least rows for that count.
ALPHA, KEPT, COMPONENTS, LEAST = 5.0, 3, 2, 6


class Medians:
    """Medians of each feature without any one of its values, from the values around the middle."""

    def __init__(self, counts: Sequence[int], around: Sequence[dict[int, float]]):
        self.counts, self.around = counts, around
        self.whole = np.array([(a[(c - 1) // 2] + a[c // 2]) / 2 if c else 0.0 for c, a in zip(counts, around, strict=True)])

    def without(self, x: np.ndarray) -> np.ndarray:
        """rows x features: the median of the other rows' known values; 0 where no other row has one."""
        out = np.tile(self.whole, (len(x), 1))
        for j, (c, a) in enumerate(zip(self.counts, self.around, strict=True)):
            known = ~np.isnan(x[:, j])
            if c == 1:
                out[known, j] = 0.0
            elif c > 1:
                v = x[known, j]
                # the value at a place of the list without v
                at = lambda t: np.where(v > a[t], a[t], a[t + 1])  # noqa: E731, B023
                out[known, j] = (at((c - 2) // 2) + at((c - 1) // 2)) / 2
        return out


def _medians(df: DataFrame, features: Sequence[str]) -> Medians:
    long = df.select(F.posexplode(F.array(*(F.col(f"`{f}`") for f in features))).alias("j", "v")).where("v is not null")
    counts = long.groupBy("j", "v").agg(F.count("*").alias("n"))
    sizes = {r["j"]: r["n"] for r in counts.groupBy("j").agg(F.sum("n").alias("n")).collect()}  # one row a feature
    around: list[dict[int, float]] = [{} for _ in features]
    if sizes:
        total = F.element_at(F.create_map(*(F.lit(x) for kv in sizes.items() for x in kv)), F.col("j"))
        placed = running(counts, "v", ["n"], "j").withColumn("place", F.explode(F.sequence(F.greatest(F.floor(total / 2) - 2, F.lit(0)), F.floor(total / 2) + 1)))
        for r in placed.where("before_n <= place and place < before_n + n").select("j", "place", "v").collect():  # four rows a feature
            around[r["j"]][r["place"]] = r["v"]
    return Medians([sizes.get(j, 0) for j in range(len(features))], around)


class Sums:
    """Sums of products of features (gaps as 0, and told apart) and of the target, of all rows or of one."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        gap = np.isnan(x).astype(float)
        known = np.where(gap > 0, 0.0, x)
        self.parts = {"a": known.T @ known, "b": gap.T @ known, "c": gap.T @ gap, "s": known.sum(0), "g": gap.sum(0), "sy": known.T @ y, "gy": gap.T @ y, "y": np.array([len(y), y.sum(), (y * y).sum()])}

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.parts.values()])

    def less(self, other: Sums) -> dict[str, np.ndarray]:
        return {k: v - other.parts[k] for k, v in self.parts.items()}

    @classmethod
    def of(cls, flat: np.ndarray, p: int) -> Sums:
        out = cls(np.zeros((0, p)), np.zeros(0))
        at = 0
        for k, v in out.parts.items():
            out.parts[k] = flat[at : at + v.size].reshape(v.shape)
            at += v.size
        return out


def fold(sums: dict[str, np.ndarray], fill: np.ndarray, x: np.ndarray, alpha: float) -> float:
    """The prediction for a row from the sums of the others; ``fill`` stands in gaps."""
    n, total, squares = sums["y"]
    n = round(n)
    if n < 1:
        return np.nan
    second = sums["a"] + fill[:, None] * sums["b"] + (fill[:, None] * sums["b"]).T + np.outer(fill, fill) * sums["c"]
    mean, y = (sums["s"] + fill * sums["g"]) / n, total / n
    cov = second / n - np.outer(mean, mean)
    var = np.diag(cov).copy()
    constant = var <= 1e-12 * np.maximum(np.diag(second) / n, 1e-300)
    scale = np.where(constant, 1.0, np.sqrt(np.where(constant, 1.0, var)))
    cov = np.where(constant[:, None] | constant[None], 0.0, cov) / np.outer(scale, scale)
    with_y = np.where(constant, 0.0, (sums["sy"] + fill * sums["gy"]) / n - mean * y) / scale
    z = np.where(constant, 0.0, (np.where(np.isnan(x), fill, x) - mean) / scale)
    p = len(z)
    if p > max(n, LEAST):
        k = min(KEPT, max(1, n - 1), p)
        # F grows with the squared correlation; constant features come last, of equals (to nine digits) the later ones first
        spread = max(squares / n - y * y, 1e-300)
        order = np.argsort(np.where(constant, -1.0, np.round(with_y * with_y / spread, 9)), kind="stable")[-k:]
        chosen = np.sort(order)
        cov, with_y, z = cov[np.ix_(chosen, chosen)], with_y[chosen], z[chosen]
        parts = min(COMPONENTS, n - 1, k)
        if 1 <= parts < k:
            _, axes = np.linalg.eigh(cov)
            axes = axes[:, ::-1][:, :parts]
            cov, with_y, z = axes.T @ cov @ axes, axes.T @ with_y, z @ axes
    w = np.linalg.solve(n * cov + alpha * np.eye(len(z)), n * with_y)
    return float(y + z @ w)


def predicted(df: DataFrame, row: str, features: Sequence[str], target: str, alpha: float = ALPHA) -> DataFrame:
    """row, actual, predicted, absolute_error of every row, each by a model of all others.

    Rows without a finite target are left out; NaN and infinite features are gaps.  Equal rows are separate folds.  A feature that no
    other row knows says nothing; a single row has a null prediction.
    """
    clean = lambda c: F.when(F.abs(F.col(f"`{c}`").cast("double")) < float("inf"), F.col(f"`{c}`").cast("double"))
    names = [f"__f{i}" for i in range(len(features))]
    p = len(features)
    rows = df.select(F.col(f"`{row}`").alias("__row"), *(clean(f).alias(n) for f, n in zip(features, names, strict=True)), clean(target).alias("__y")).where("__y is not null and not isnan(__y)")
    rows = rows.select("__row", *(F.nanvl(n, F.lit(None).cast("double")).alias(n) for n in names), "__y")
    medians = _medians(rows, names)
    level = rows.agg(F.avg("__y")).first()[0] or 0.0
    shift = medians.whole

    def matrix(b: pa.RecordBatch, first: int) -> np.ndarray:
        # nulls become NaN
        return np.stack([b.column(first + i).cast(pa.float64()).to_numpy(zero_copy_only=False) for i in range(p)], 1) if p else np.zeros((b.num_rows, 0))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Sums(np.zeros((0, p)), np.zeros(0)).flat()
        for b in batches:
            total = total + Sums(matrix(b, 0) - shift, b.column(p).to_numpy() - level).flat()
        yield pa.RecordBatch.from_pydict({"k": pa.array(np.arange(len(total)), pa.int32()), "value": pa.array(total)})

    parts = rows.select(*names, "__y").mapInArrow(added, "k int, value double").groupBy("k").agg(F.sum("value").alias("value")).collect()  # about 3 p^2 rows
    whole = Sums.of(np.array([r["value"] for r in sorted(parts, key=lambda r: r["k"])]), p) if parts else None
    kind = df.schema[row].dataType.simpleString()

    def folds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, y = matrix(b, 1), b.column(p + 1).to_numpy()
            x, fill = raw - shift, medians.without(raw) - shift
            got = np.array([fold(whole.less(Sums(x[i : i + 1], y[i : i + 1] - level)), fill[i], x[i], alpha) for i in range(len(y))]) + level
            guess = pa.array(got, from_pandas=True)  # NaN as null
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(y), guess, pa.array(np.abs(got - y), from_pandas=True)], names=[row, "actual", "predicted", "absolute_error"])

    return rows.mapInArrow(folds, f"`{row}` {kind}, actual double, predicted double, absolute_error double")
