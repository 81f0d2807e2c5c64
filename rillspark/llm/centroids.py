"""Exact k-means over integer vectors, screened in float32.

A component ``x`` becomes the integer ``floor(256 * x)``.  A block of vectors meets all centroids
in one float32 matrix product.  The rounding error of that product has a bound (the usual one
for inner products of any summation order, with the conversion to float32), so each squared
distance lies in a known interval.  Centroids whose intervals overlap the lowest one are the
shortlist; where it has more than one, their distances are computed again in exact integers, and
the smallest wins, the smaller number on ties.  Which centroid a vector gets therefore depends
on no machine, library or order.

Sums of components are exact integers: each task adds up its vectors, Spark adds up the
tasks' rows (clusters x dimensions for each task), and the driver holds the centroids alone.

Kept are vectors with exactly ``dimensions`` components, none null, NaN or infinite; null, shorter
and longer ones are left out, and so are vectors with a component beyond 2**90 after scaling, whose
sums no Spark number could hold.  Distances and inertias that pass the largest long are given as that
number; the choice of centroids stays exact.  A null id is written as the empty text.  Repeated rows
are separate vectors; equal ids are started from in the order of their components.  Fewer vectors than
centroids make fewer centroids; no vectors give no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillspark.session import removed, tables_so_far, written

SCALE, LARGEST, LONG = 256, 2.0**90, 2**63 - 1
#: Below it squared distances of up to 128 components fit into 64 bits.
NARROW = 1 << 27
UNIT = 2.0**-24
#: Pairs of vectors and centroids whose exact distances are computed together.
PAIRS = 20_000


# -- distances ----------------------------------------------------------------------------


class Centroids:
    """Integer centroids with what screening needs of them."""

    def __init__(self, rows: list[list[int]]):
        exact = np.array(rows, object).reshape(len(rows), -1)
        self.narrow = exact.shape[1] <= 128 and all(abs(v) < NARROW for v in exact.ravel())
        self.exact = exact.astype(np.int64) if self.narrow else exact
        with np.errstate(over="ignore"):
            self.float32 = exact.astype(np.float64).astype(np.float32)
        self.square = np.array([float(sum(v * v for v in row)) for row in exact])
        self.norm = np.sqrt(self.square)

    def intervals(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper ends of ``|c|^2 - 2 x.c`` (the squared distance without ``|x|^2``) of whole numbers ``x`` in float64.

        With ``u`` the unit of float32, a product of n terms errs by at most ``g |x||c|``, ``g = (n+2)u / (1-(n+2)u)``,
        conversions included; whole numbers cannot underflow.  What overflows gets an unbounded interval.
        The float64 steps err by less than 2**-50 of their operands.
        """
        n = x.shape[1] + 2
        g = n * UNIT / (1 - n * UNIT)
        with np.errstate(over="ignore", invalid="ignore"):
            dot = (x.astype(np.float32) @ self.float32.T).astype(np.float64)
            middle = self.square - 2 * dot
            lengths = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None] * self.norm
            width = 2.001 * g * lengths + 2.0**-49 * (self.square + 2 * np.abs(dot))
            low, high = middle - width, middle + width
        unsure = ~(np.isfinite(low) & np.isfinite(high))
        low[unsure], high[unsure] = -np.inf, np.inf
        return low, high

    def distances(self, x: np.ndarray, rows: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Exact squared distances of ``x[rows]`` and the centroids ``which``."""
        if self.narrow and x.dtype != np.float64:
            d = x[rows].astype(np.int64) - self.exact[which]
        else:
            whole = np.array([int(v) for v in x[rows].ravel()], object).reshape(len(rows), x.shape[1])
            d = whole - self.exact[which].astype(object)
        return (d * d).sum(1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid of each vector, and how many centroids were computed exactly for it (0: the screening was enough)."""
        low, high = self.intervals(x.astype(np.float64))
        close = low <= high.min(1, keepdims=True)
        number, n = close.argmax(1), close.sum(1)
        open_rows = np.nonzero(n > 1)[0]
        step = max(1, PAIRS // len(self.exact))
        for at in range(0, len(open_rows), step):
            some = open_rows[at : at + step]
            row, which = np.nonzero(close[some])  # row by row, numbers ascending
            d = self.distances(x, some[row], which)
            starts = np.searchsorted(row, np.arange(len(some)))
            least = np.minimum.reduceat(d, starts)
            hit = np.nonzero(d == least[row])[0]
            number[some] = which[hit[np.unique(row[hit], return_index=True)[1]]]
        return number, np.where(n > 1, n, 0)


# -- vectors ------------------------------------------------------------------------------


def blocks(vectors: DataFrame, id_col: str, vector_col: str, dimensions: int) -> DataFrame:
    """Kept vectors as rows of ids and one matrix of whole numbers: 32-bit integers, or doubles where ``wide``."""
    kind = vectors.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sized = pc.fill_null(pc.equal(pc.list_value_length(b.column(1)), dimensions), False)
            ids, col = b.column(0).filter(sized), b.column(1).filter(sized)
            # nulls become NaN
            x = col.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dimensions)
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(SCALE * x)
                good = (np.abs(x) <= LARGEST).all(1)
            if not good.any():
                continue
            x, wide = x[good], bool(np.abs(x[good]).max() >= NARROW)
            matrix = np.ascontiguousarray(x, "<f8" if wide else "<i4").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([ids.filter(pa.array(good)).to_pylist()], pa.list_(ids.type)), pa.array([wide]), pa.array([matrix], pa.binary())], names=["ids", "wide", "matrix"])

    return vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v")).mapInArrow(run, f"ids array<{kind}>, wide boolean, matrix binary")


def _matrices(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[tuple[list, np.ndarray]]:
    for b in batches:
        for k in range(b.num_rows):
            kind = "<f8" if b.column(1)[k].as_py() else "<i4"
            yield b.column(0)[k].as_py(), np.frombuffer(b.column(2)[k].as_buffer(), kind).reshape(-1, dimensions)


def first_centroids(table: DataFrame, dimensions: int, clusters: int, seed: int) -> list[list[int]]:
    """Vectors with the smallest SHA-256 of ``seed:id``, in that order; each task gives at most ``clusters`` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[str, list[float]]] = []
        for ids, x in _matrices(batches, dimensions):
            hashes = [hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest() for i in ids]
            bar = best[-1][0] if len(best) == clusters else "g"  # above every hex text
            best = heapq.nsmallest(clusters, best + [(h, x[k].astype(float).tolist()) for k, h in enumerate(hashes) if h <= bar])
        if best:
            yield pa.RecordBatch.from_pydict({"hash": [h for h, _ in best], "v": pa.array([v for _, v in best], pa.list_(pa.float64()))})

    rows = table.mapInArrow(run, "hash string, v array<double>").orderBy("hash", "v").limit(clusters).collect()
    return [[int(v) for v in r["v"]] for r in rows]


def moved(table: DataFrame, dimensions: int, now: list[list[int]]) -> list[list[int]]:
    """The centroids after one round: floors of exact means, empty ones as they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, k = Centroids(now), len(now)
        sums, counts = np.zeros((k, dimensions), object), np.zeros(k, np.int64)
        for _, x in _matrices(batches, dimensions):
            number, _ = centroids.nearest(x)
            order = np.argsort(number, kind="stable")
            there, starts = np.unique(number[order], return_index=True)
            whole = x[order].astype(np.int64) if x.dtype != np.float64 else np.array([int(v) for v in x[order].ravel()], object).reshape(x.shape)
            sums[there] += np.add.reduceat(whole, starts).astype(object)
            counts += np.bincount(number, minlength=k)
        full = np.nonzero(counts)[0]
        if len(full):
            at = np.repeat(full, dimensions)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(at, pa.int32()),
                    pa.array(np.tile(np.arange(dimensions), len(full)), pa.int32()),
                    pa.array([Decimal(int(v)) for v in sums[full].ravel()], pa.decimal128(38, 0)),
                    pa.array(counts[at], pa.int64()),
                ],
                names=["cluster", "place", "total", "n"],
            )

    parts = table.mapInArrow(run, "cluster int, place int, total decimal(38,0), n long")
    out = [list(c) for c in now]
    for r in parts.groupBy("cluster", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # clusters x dimensions rows
        out[r["cluster"]][r["place"]] = int(r["total"]) // r["n"]
    return out


def assigned(table: DataFrame, dimensions: int, now: list[list[int]], id_col: str) -> DataFrame:
    """``id_col``, cluster, distance of every vector."""
    kind = table.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = Centroids(now)
        for b in batches:
            of_type = b.column(0).type.value_type
            for ids, x in _matrices(iter([b]), dimensions):
                number, _ = centroids.nearest(x)
                d = centroids.distances(x, np.arange(len(x)), number)
                if d.dtype == object:
                    d = np.array([min(int(v), LONG) for v in d], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids, of_type), pa.array(number, pa.int32()), pa.array(d, pa.int64())], names=[id_col, "cluster", "distance"])

    return table.mapInArrow(run, f"`{id_col}` {kind}, cluster int, distance long")


def clustered(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = 64, clusters: int = 40, rounds: int = 5, seed: int = 2) -> DataFrame:
    """``id_col``, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector.

    The vectors are read once and written as blocks of whole numbers; every round reads the blocks.
    """
    spark = vectors.sparkSession
    mark = tables_so_far()
    table = written(blocks(vectors, id_col, vector_col, dimensions), "vectors")
    now = first_centroids(table, dimensions, clusters, seed)
    for _ in range(rounds if now else 0):
        now = moved(table, dimensions, now)
    if not now:  # no vector is kept: the empty table has the columns of the result
        now = [[0] * dimensions]
    out = written(assigned(table, dimensions, now, id_col), "assigned")
    removed(spark, mark, keep=[out])
    total = {r["cluster"]: int(r["total"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    whole = min(sum(total.values()), LONG)
    facts = [(k, min(v, LONG), whole, hashlib.sha256(",".join(map(str, now[k])).encode()).hexdigest()) for k, v in sorted(total.items())]
    # one row for each cluster, a parameter's number of them
    small = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(small), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
