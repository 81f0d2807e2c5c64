"""Exact searches of many queries over many rows, block against block.

Queries and rows are packed into Arrow blocks of bounded size, one block a row.  Every block of
queries meets every block of rows; a pair of blocks gives the best ``k`` of each query in it, and
those are merged per query.  No row stands for a pair of a query and a row, no word is a
shuffle key, and no table is collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillspark.operators import ranking

QUERIES, ROWS, MOST_BYTES = 256, 1024, 1 << 20


def _pieces(b: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    if b.num_rows > 1 and (b.num_rows > rows or b.nbytes > MOST_BYTES):
        half = b.num_rows // 2
        yield from _pieces(b.slice(0, half), rows)
        yield from _pieces(b.slice(half), rows)
    elif b.num_rows:
        yield b


def packed(df: DataFrame, rows: int, name: str) -> DataFrame:
    """One binary column ``name``: up to ``rows`` rows of ``df`` as an Arrow stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in _pieces(b, rows):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, piece.schema) as out:
                    out.write_batch(piece)
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=[name])

    return df.mapInArrow(run, f"{name} binary")


def _unpacked(data: bytes) -> tuple[np.ndarray, pa.ListArray]:
    t = pa.ipc.open_stream(data).read_all().combine_chunks()
    values = t.column(1).combine_chunks()
    return t.column(0).to_numpy(), values


def _searched(queries: DataFrame, rows: DataFrame, read: Callable, best: Callable, score: str, order: list[Column], k: int) -> DataFrame:
    """(query, row, score) of the best ``k`` rows of each query; both tables are (id long, list).

    ``read`` prepares a block of queries; ``best`` gives the places of queries and rows and the
    scores of the best ``k`` of each query of one pair of blocks.
    """
    n_blocks = max(1, -(-queries.count() // QUERIES))
    pairs = packed(rows, ROWS, "rows").crossJoin(packed(queries.repartition(n_blocks), QUERIES, "queries"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, block = None, None
        for b in batches:
            for data, asked in zip(b.column("rows"), b.column("queries"), strict=True):
                if (asked := asked.as_py()) != last:
                    last, block = asked, read(*_unpacked(asked))
                ids, values = _unpacked(data.as_py())
                q, r, s = best(block, ids, values, k)
                yield pa.RecordBatch.from_arrays([pa.array(block[0][q], pa.int64()), pa.array(ids[r], pa.int64()), pa.array(s)], names=["query", "row", "score"])

    found = pairs.select("rows", "queries").mapInArrow(run, f"query long, row long, score {score}")
    return ranking.top_of_each(found, ["query"], order, k).select("query", "row", "score")


def _flat(values: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """All elements, and where each list begins and ends in them."""
    return values.flatten(), np.r_[0, np.cumsum(pc.list_value_length(values).to_numpy(zero_copy_only=False))].astype(np.int64)


# -- shared words ---------------------------------------------------------------------------


def _read_words(ids: np.ndarray, values: pa.ListArray):
    flat, ends = _flat(values)
    vocabulary = pc.unique(flat)
    has = np.zeros((len(vocabulary), len(ids)), np.uint16 if len(vocabulary) < 1 << 16 else np.int64)
    has[pc.index_in(flat, value_set=vocabulary).to_numpy(zero_copy_only=False), np.repeat(np.arange(len(ids)), np.diff(ends))] = 1
    return ids, vocabulary, has


def _best_words(block, ids: np.ndarray, values: pa.ListArray, k: int):
    _, vocabulary, has = block
    flat, ends = _flat(values)
    at = pc.fill_null(pc.index_in(flat, value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
    hits = np.empty((len(ids), has.shape[1]), np.int64)
    for d in range(len(ids)):
        own = at[ends[d] : ends[d + 1]]
        hits[d] = has[own[own >= 0]].sum(0, dtype=has.dtype)
    place = np.empty(len(ids), np.int64)
    place[np.argsort(ids, kind="stable")] = np.arange(len(ids) - 1, -1, -1)
    key = hits * len(ids) + place[:, None]  # more hits first, then the smaller id
    top = np.argpartition(-key, k - 1, axis=0)[:k] if len(ids) > k else np.argsort(-key, axis=0)
    r, q = top.ravel(), np.tile(np.arange(has.shape[1]), len(top))
    keep = hits[r, q] > 0
    return q[keep], r[keep], hits[r, q][keep]


def most_shared_words(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """query, row, score: the ``k`` rows that share most words with each query, the smaller id first.

    Both tables are (id long, distinct words); null ids and null lists have no words.
    """
    return _searched(queries.dropna(), rows.dropna(), _read_words, _best_words, "long", [F.desc("score"), F.col("row")], k)


# -- cosine ---------------------------------------------------------------------------------


def _read_vectors(ids: np.ndarray, values: pa.ListArray):
    v = _flat(values)[0].to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
    return ids, v, np.sqrt(_dots(v, v))


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products summed in the order of the dimensions: equal vectors give equal scores in any block."""
    total = np.zeros(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]))
    for d in range(a.shape[-1]):
        total += a[..., d] * b[..., d]
    return total


def _best_vectors(block, ids: np.ndarray, values: pa.ListArray, k: int):
    asked, q, q_len = block
    order = np.argsort(ids, kind="stable")
    _, v, v_len = _read_vectors(ids, values)
    v_columns, q_columns = np.ascontiguousarray(v[order].T), np.ascontiguousarray(q.T)
    s = _dots(q_columns.T[:, None, :], v_columns.T[None, :, :])
    with np.errstate(divide="ignore", invalid="ignore"):
        s = s / v_len[order][None, :] / q_len[:, None]
    s[np.isnan(s) | (asked[:, None] == ids[order][None, :])] = -np.inf
    top = np.argsort(-s, axis=1, kind="stable")[:, :k]  # equal scores stay by id
    at, place = np.repeat(np.arange(len(asked)), top.shape[1]), top.ravel()
    keep = s[at, place] > -np.inf
    return at[keep], order[place][keep], s[at, place][keep]


def nearest_by_cosine(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """query, row, score: the ``k`` other rows of the highest cosine, the smaller id first.

    Both tables are (id long, vector), all of one length.  Null vectors and vectors of zeros
    have no direction and are neither asked nor found.
    """
    return _searched(queries.dropna(), rows.dropna(), _read_vectors, _best_vectors, "double", [F.desc("score"), F.col("row")], k)
