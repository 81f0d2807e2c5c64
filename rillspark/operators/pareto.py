"""Rows that no other row beats in any number of objectives, with a slack, without comparing all pairs.

A row beats another one if it is nowhere worse by more than the slack and somewhere better by more.  With a slack that
is not transitive: a beaten row may itself beat a third.  But a row that is nowhere worse *at all* than another one beats
whatever that one beats.  So a row that is beaten by such a row (below: clearly beaten) is neither a result nor
needed to rule out others, and may go as soon as it is met: first whole cells of a grid, then rows
inside a chunk.  What is left is compared block against block, and only where the corners of two cells allow it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillspark.session import written

SLACK = 1e-9
#: Most cells of the grid, rows of a chunk that are compared at once, and rows of a block.
CELLS, CHUNK, BLOCK = 256, 20_000, 1024


def clearly_beaten(x: np.ndarray, by: np.ndarray, slack: float) -> np.ndarray:
    """Whether each row of ``x`` is beaten by a row of ``by`` that is nowhere worse."""
    out = np.zeros(len(x), bool)
    for row in by:
        out |= (row <= x).all(1) & (row < x - slack).any(1)
    return out


def beaten(x: np.ndarray, by: np.ndarray, slack: float) -> np.ndarray:
    out = np.zeros(len(x), bool)
    for row in by:
        out |= (row <= x + slack).all(1) & (row < x - slack).any(1)
    return out


def thinned(x: np.ndarray, slack: float) -> np.ndarray:
    """Places of the rows that no other row clearly beats: rows come by their sums, and each meets those that stayed before it."""
    kept = np.empty((0, x.shape[1]))
    places: list[int] = []
    order = np.argsort(x.sum(1), kind="stable")
    for at in range(0, len(order), BLOCK):
        part = order[at : at + BLOCK]
        part = part[~clearly_beaten(x[part], kept, slack)]
        part = part[~clearly_beaten(x[part], x[part], slack)]
        places += part.tolist()
        kept = np.concatenate([kept, x[part]])
    return np.array(sorted(places), np.int64)


def front(df: DataFrame, objectives: dict[str, str], slack: float = SLACK, cells: int = CELLS, chunk: int = CHUNK) -> DataFrame:
    """The rows of ``df`` that no other row beats; ``objectives`` maps columns to ``min`` or ``max``.

    Rows with an objective that is null, NaN or infinite are left out.  Equal rows stay together.  Objectives may be any
    numbers; they are compared as doubles.
    """
    if not objectives or set(objectives.values()) - {"min", "max"}:
        raise ValueError("objectives map columns to min or max")
    names = [f"__v{i}" for i in range(len(objectives))]
    d = len(names)
    # adding zero makes a negative zero a plain one
    as_low = {n: (F.col(f"`{c}`").cast("double") if way == "min" else -F.col(f"`{c}`").cast("double")) + F.lit(0.0) for n, (c, way) in zip(names, objectives.items(), strict=True)}
    finite = F.lit(True)
    for n in names:
        finite = finite & F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(F.col(n)) < float("inf"))
    valued = df.withColumns(as_low).where(finite)
    points = written(valued.select(*names).distinct(), "points")

    # a grid by quantiles: every cell has the corners of its own points
    each = max(1, int(round(cells ** (1 / d) - 0.5)))
    edges = points.approxQuantile(names, [k / each for k in range(1, each)], 0.01) if each > 1 else [[]] * d
    cell = F.lit(0)
    for n, bounds in zip(names, edges, strict=True):
        place = F.lit(0)
        for b in sorted(set(bounds or [])):
            place = place + (F.col(n) > b).cast("int")
        cell = cell * each + place
    placed = points.withColumn("cell", cell)
    corners = placed.groupBy("cell").agg(*(F.min(n).alias(f"low{i}") for i, n in enumerate(names)), *(F.max(n).alias(f"high{i}") for i, n in enumerate(names))).orderBy("cell").collect()  # ``cells`` rows at most
    low = np.array([[r[f"low{i}"] for i in range(d)] for r in corners]).reshape(-1, d)
    high = np.array([[r[f"high{i}"] for i in range(d)] for r in corners]).reshape(-1, d)
    # all points of a cell are clearly beaten by all of another one
    alive = [k for k in range(len(corners)) if not ((high <= low[k]).all(1) & (high < low[k] - slack).any(1)).any()]
    ids = [int(corners[k]["cell"]) for k in alive]
    # (cell, other): a point of the other cell may beat one of the cell
    pairs = [(ids[a], ids[b]) for a, k in enumerate(alive) for b, o in enumerate(alive) if (low[o] <= high[k] + slack).all()]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flushed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            x = np.stack([t.column(i).to_numpy() for i in range(d)], 1)
            of = t.column(d).to_numpy()
            for c in np.unique(of):
                mine = x[of == c]
                mine = mine[thinned(mine, slack)]
                for at in range(0, len(mine), BLOCK):
                    yield pa.RecordBatch.from_pydict({"cell": pa.array([int(c)], pa.int32()), "matrix": pa.array([np.ascontiguousarray(mine[at : at + BLOCK]).tobytes()], pa.binary())})

        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= chunk:
                yield from flushed(held)
                held = []
        if held:
            yield from flushed(held)

    living = placed.where(F.col("cell").isin(ids)) if ids else placed.limit(0)
    # first what each task holds, then what each cell has left
    thin = living.select(*names, "cell").mapInArrow(blocks, "cell int, matrix binary")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(m).reshape(-1, d)
                yield pa.RecordBatch.from_arrays([*(pa.array(x[:, i]) for i in range(d)), pa.array(np.full(len(x), c, np.int32))], names=[*names, "cell"])

    again = thin.mapInArrow(rows, ", ".join(f"{n} double" for n in names) + ", cell int").repartitionByRange("cell", names[0]).mapInArrow(blocks, "cell int, matrix binary")
    left = written(again.withColumn("block", F.monotonically_increasing_id()), "blocks")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for one, two in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x, by = np.frombuffer(one).reshape(-1, d), np.frombuffer(two).reshape(-1, d)
                near = (x.min(0) - slack > by.min(0)).any() and (by.min(0) <= x.max(0) + slack).all()
                lost = x[beaten(x, by, slack)] if near else x[:0]
                if len(lost):
                    yield pa.RecordBatch.from_arrays([pa.array(lost[:, i]) for i in range(d)], names=names)

    spark = df.sparkSession
    links = spark.createDataFrame(pairs, "cell int, other int")
    met = left.select("cell", F.col("matrix").alias("one")).join(links, "cell").join(left.select(F.col("cell").alias("other"), F.col("matrix").alias("two")), "other")
    lost = met.select("one", "two").mapInArrow(compared, ", ".join(f"{n} double" for n in names)).distinct()
    best = left.select("matrix", F.lit(0).alias("zero")).select(F.lit(0).cast("int").alias("cell"), "matrix").mapInArrow(rows, ", ".join(f"{n} double" for n in names) + ", cell int").select(*names)
    winners = written(best.join(lost, names, "left_anti"), "front")
    return valued.join(winners, names, "left_semi").drop(*names)
