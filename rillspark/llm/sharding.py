"""Shards by vector bin packing: bytes, tokens and rows are balanced jointly.

Groups of equal texts are placed whole, each where the dot product of its size vector with a
shard's residual capacity is highest, largest first.  The law that holds is ``bytes``: sizes
of shards are near equal (bytes weigh more than tokens and rows).

Placing each group one by one would need all of them in one place.  So a group that holds
less than ``HEAVY`` of a shard in all three sizes goes to one of ``CELLS`` cells by the hash
of its text, and cells are placed as units.  At most 3 * shards / ``HEAVY`` groups can be heavy; they
are placed by themselves.  A group that is larger than a shard is split into pieces by row first; where sizes
come out further than ``UNEVEN`` from each other, those over a quarter of a shard are too.  What the driver packs
is the sizes of cells, heavy groups and pieces: a bounded number, whatever the input.

Tokens are words ``[^\\x20\\x09-\\x0D]+``.  Null texts have size 1 and no tokens, and are one
group.  Repeated rows are separate rows of a group.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillspark.session import removed, tables_so_far, written

CELLS, HEAVY, WEIGHTS = 8192, 1 / 64, np.array([4.0, 1.0, 1.0])
#: A heavy group over this part of a shard is split into pieces of about a sixteenth of it; the second where the first leaves shards uneven.
SPLIT_OVER, UNEVEN = (1, 1 / 4), 0.03
#: Part of a shard by which bytes may go over, which leaves room to balance tokens and rows.
ROOM = 0.004


def place(sizes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each size vector (items x dimensions): of those with bytes left for it the one with the largest dot product with
    what is left, or else the one with most bytes left."""
    total = np.maximum(sizes.sum(0), 1)
    share = sizes / total * shards  # of one shard's capacity
    order = np.lexsort((np.arange(len(share)), -(share * WEIGHTS).sum(1)))
    left = np.ones((shards, share.shape[1]))
    out = np.zeros(len(share), np.int64)
    for i in order.tolist():
        fits = left[:, 0] >= share[i, 0] - ROOM
        k = int(np.argmax(np.where(fits, left @ (share[i] * WEIGHTS), -np.inf) if fits.any() else left[:, 0]))
        out[i] = k
        left[k] -= share[i]
    return out


def sharded(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, size, text_crc32, law, shard, slot and grown_shard (null under this law) of every row."""
    spark = docs.sparkSession
    mark = tables_so_far()
    text = F.col(text_col)
    rows = written(
        docs.select(
            F.col(id_col),
            F.xxhash64(text).alias("key"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long").alias("tokens"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        ),
        "sizes",
    )
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")]
    groups = rows.groupBy("key").agg(*sums)
    total = rows.agg(*sums).first()
    if not total["n"]:
        return rows.select(id_col, "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    part = F.greatest(*(F.col(c) * (shards / max(total[c], 1)) for c in ("size", "tokens", "n")))
    heavy = written(groups.select(F.col("key").alias("heavy_key"), part.alias("part")).where(F.col("part") >= HEAVY), "heavy")  # at most 3 * shards / HEAVY rows
    cell = F.pmod("key", F.lit(CELLS))
    for over in SPLIT_OVER:
        pieces = F.when(F.col("part") > over, F.ceil(F.col("part") * 16)).otherwise(1).cast("int")
        piece = F.pmod(F.xxhash64(id_col, "key"), pieces).cast("int")
        itemed = rows.join(F.broadcast(heavy), F.col("key") == F.col("heavy_key"), "left").select(
            id_col, "size", "tokens", "text_crc32", F.coalesce("heavy_key", cell).alias("item"), F.when(F.col("heavy_key").isNull(), -1).otherwise(piece).alias("piece")
        )
        items = itemed.groupBy("item", "piece").agg(*sums).orderBy("item", "piece").collect()
        where = place(np.array([[r["size"], r["tokens"], r["n"]] for r in items], float), shards)
        filled = np.bincount(where, [float(r["size"]) for r in items], shards)
        if filled.max() - filled.min() <= UNEVEN * filled.mean() or not (heavy.agg(F.max("part")).first()[0] or 0) > SPLIT_OVER[-1]:
            break
    chosen = spark.createDataFrame([(r["item"], r["piece"], int(k)) for r, k in zip(items, where, strict=True)], "to_item long, to_piece int, shard int")
    placed = written(
        itemed.join(F.broadcast(chosen), (F.col("item") == F.col("to_item")) & (F.col("piece") == F.col("to_piece")))
        .select(id_col, "size", "text_crc32", "shard", F.pmod(F.xxhash64(id_col, "size", "text_crc32"), F.lit(4 * int(spark.conf.get("spark.sql.shuffle.partitions")))).alias("chunk")),
        "placed",
    )
    removed(spark, mark, keep=[placed])
    # slots without a sort of a whole shard: chunks first, then rows inside their chunk
    counts = placed.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    firsts = counts.select(F.col("shard").alias("of_shard"), F.col("chunk").alias("of_chunk"), (F.sum("n").over(Window.partitionBy("shard").orderBy("chunk")) - F.col("n")).alias("first"))
    number = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy(id_col, "size", "text_crc32"))
    return (
        placed.withColumn("number", number)
        .join(F.broadcast(firsts), (F.col("shard") == F.col("of_shard")) & (F.col("chunk") == F.col("of_chunk")))
        .select(id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("number") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
