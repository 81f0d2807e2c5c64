"""Packing by powers of two: each document becomes pieces of binary length.

A document of n ids is cut into as many pieces of the longest allowed length as fit and
one piece for each bit of the rest, longest first.  A piece is a sequence by itself:
nothing is padded and no sequence crosses documents.  Sequences of one length form a
bucket and have consecutive numbers, so a trainer reads batches of one shape.

Numbers need a global order.  It is found without a global sort: pieces are dealt to
chunks by a hash of their document, each chunk counts its pieces by length, the small
table of counts gives each (length, chunk) its first number, and pieces are numbered
inside their (length, chunk) only.

Null and empty texts hold the end id alone.  Repeated rows are separate documents; ties in
the order are between equal rows, so either order gives the same table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillspark.llm.bpe import encoder
from rillspark.llm.common import sliced
from rillspark.session import written

END = 1
MOST = 2048


def piece_lengths(n: int, most: int = MOST) -> list[int]:
    """``n`` as pieces of ``most`` and then one piece for each bit of the rest."""
    whole, rest = divmod(n, most)
    return [most] * whole + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", most: int = MOST, end: int = END, with_ids: bool = False) -> DataFrame:
    """A row for each piece: id, start, length, ids_crc32, doc_tokens and, if asked for, the ids themselves."""
    if most & (most - 1) or most < 1:
        raise ValueError("the longest piece must be a power of two")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in sliced(batches, text_col, 6_000_000):
            where, start, length, crc, total, ids = [], [], [], [], [], []
            flat, sizes = enc.encode(b.column(text_col), end)
            until = np.cumsum(sizes)
            whole = memoryview(flat.tobytes())
            for i, (n, first) in enumerate(zip(sizes.tolist(), (until - sizes).tolist(), strict=True)):
                raw, at = whole[4 * first : 4 * (first + n)], 0
                for size in piece_lengths(n, most):
                    one = raw[4 * at : 4 * (at + size)]
                    where.append(i)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(one))
                    total.append(n)
                    if with_ids:
                        ids.append(bytes(one))
                    at += size
            cols = [b.column(id_col).take(pa.array(where, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(total, pa.int64())]
            names = [id_col, "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                cols.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def packed(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", most: int = MOST, end: int = END, with_ids: bool = False) -> DataFrame:
    """:func:`pieces` with sequence_id (gapless from 0, one bucket after the other) and offset.

    The pieces are written once to the shared folder, so texts are encoded once.
    """
    spark = docs.sparkSession
    chunks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = written(
        pieces(docs, path, id_col, text_col, most, end, with_ids).withColumn("chunk", F.pmod(F.xxhash64(id_col, "doc_tokens"), F.lit(chunks)).cast("int")), "pieces"
    )
    sizes = found.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    # at most 12 lengths times the chunks: a table that does not grow with the documents
    firsts = sizes.select(
        F.col("length").alias("of_length"),
        F.col("chunk").alias("of_chunk"),
        (F.sum("n").over(Window.orderBy(F.desc("length"), "chunk")) - F.col("n")).alias("first"),
    )
    number = F.row_number().over(Window.partitionBy("length", "chunk").orderBy(id_col, "start", "ids_crc32"))
    return (
        found.withColumn("number", number)
        .join(F.broadcast(firsts), (F.col("length") == F.col("of_length")) & (F.col("chunk") == F.col("of_chunk")))
        .withColumn("sequence_id", F.col("first") + F.col("number") - 1)
        .withColumn("offset", F.lit(0).cast("long"))
        .select(id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids)
    )
