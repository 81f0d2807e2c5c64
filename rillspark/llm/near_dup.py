"""Near-duplicate groups by min-max hashing, bands of the signatures and exact checks.

Each permutation gives two values of a document's shingle set, its smallest and its largest
hash; either agrees for two sets with a chance equal to their Jaccard similarity.  So
``PERMUTATIONS`` evaluations give twice as many unbiased values, of lower variance than
those of independent permutations.  ``BANDS`` bands of ``ROWS`` values put documents into
buckets: two sets at a similarity of 0.8 share no bucket with a chance of 3e-7.

1. One scan makes for each document the key of its shingle set, the set's size, the bands
   and four bits of each value.  Documents with one set are one class from here on, however
   many they are; its smallest doc_id stands for it.
2. Of buckets with the same members one is kept.  In each bucket every member is paired with one hub, never with all others.  The pairs
   are checked on full shingle sets, and links make components.
3. Buckets that still span several components get two more rounds with other hubs.
4. What is left in such buckets is checked across components only: members outside a bucket's
   largest component meet all members, chunk by chunk, so that a hot bucket is many tasks.
   Inside the join come sizes, then four bits of each value (a pair at 0.8 fails that with a
   chance under 1e-7), then the full sets.  The join makes rows of links alone; no bucket is left
   unexamined or capped.

Shingle sets are made anew for members of shared buckets alone, found by a bit filter of
fixed size.  All intermediate tables are written to the shared folder.

Null and empty texts and texts of white space have the empty set and are linked with
nothing.  With fewer words than a shingle has, the whole sequence is the one shingle.  Rows
with one doc_id stand for one document.  A null doc_id is linked with nothing; its
component is null, and it is kept.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillspark.llm.common import sliced, words
from rillspark.llm.components import components
from rillspark.llm.hashing import P, WordHashes, bit_filter, in_filter, mixed, runs
from rillspark.session import removed, tables_so_far, written

PERMUTATIONS, ROWS, BANDS = 96, 5, 38
SEED = 20240229
#: Values, of 192, that must agree in four bits: 5.5 standard deviations under what 0.8 leads to.
AGREE_AT_80 = 126
#: Members of a bucket that one task compares with those outside its largest component.
CHUNK = 2000


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(SEED)
    return r.integers(0, 1 << 31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1), r.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)


def min_max_values(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest and the largest hash under each permutation, interleaved."""
    low, high = np.full(len(a), 0xFFFFFFFF, np.uint32), np.zeros(len(a), np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 2048):
        h = a[:, None] * x[at : at + 2048] + b[:, None]
        np.minimum(low, h.min(1), out=low)
        np.maximum(high, h.max(1), out=high)
    return np.stack([low, high], 1).ravel()


def band_keys(values: np.ndarray) -> np.ndarray:
    """documents x values -> documents x bands, as signed 64-bit keys."""
    used = values[:, : BANDS * ROWS].reshape(len(values), BANDS, ROWS).astype(np.uint64)
    acc = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), used.shape[:2]).copy()
    for i in range(ROWS):
        acc = mixed(acc * P + used[:, :, i])
    return acc.view(np.int64)


def four_bits(values: np.ndarray) -> np.ndarray:
    """documents x values -> documents x (values / 16): four bits of each value, 16 to a long."""
    nibbles = ((values * np.uint32(0x9E3779B1)) >> np.uint32(28)).astype(np.uint64).reshape(len(values), -1, 16)
    return np.bitwise_or.reduce(nibbles << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=2).view(np.int64)


def _listed(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """id, key (of the shingle set; null if empty), n_shingles, bits and bands of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _permutations()
        hashes = WordHashes()
        for batch in sliced(batches, text_col):
            keys, counts, values = [], [], []
            for t in batch.column(text_col).to_pylist():
                s = np.unique(runs(hashes.of(words(t)), size))
                counts.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                values.append(min_max_values(s, a, b))
            v = np.stack(values)
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), _listed(four_bits(v)), _listed(band_keys(v))],
                names=["id", "key", "n_shingles", "bits", "bands"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, key binary, n_shingles long, bits array<long>, bands array<long>")


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, size: int, bits: np.ndarray) -> DataFrame:
    """id and sorted shingle hashes of the rows whose hashed id may be in the filter."""
    kept = docs.select(id_col, text_col, F.xxhash64(id_col).alias("__h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            mask = in_filter(bits, batch.column("__h").to_numpy())
            if not mask.any():
                continue
            for b in sliced(iter([batch.filter(pa.array(mask))]), text_col):
                sets = [np.unique(runs(hashes.of(words(t)), size)).view(np.int64) for t in b.column(text_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(id_col), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32)), pa.array(np.concatenate(sets)))], names=["id", "shingles"])

    kind = docs.schema[id_col].dataType.simpleString()
    return kept.mapInArrow(run, f"id {kind}, shingles array<long>")


def _agreeing(x: str, y: str, longs: int) -> str:
    """SQL for the number of equal four-bit values of two rows of columns of longs."""
    parts = []
    for i in range(longs):
        d = f"({x}{i} ^ {y}{i})"
        two = f"({d} | shiftrightunsigned({d}, 1))"
        parts.append(f"bit_count(({two} | shiftrightunsigned({two}, 2)) & 1229782938247303441L)")
    return f"({16 * longs} - ({' + '.join(parts)}))"


def near_components(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """``id_col``, n_shingles, component_id and kept of every row."""
    mark = tables_so_far()
    table = written(signatures(docs, id_col, text_col, size), "signatures")
    first = F.min(F.struct("id", "n_shingles", "bits", "bands")).alias("r")
    reps = written(table.where("key is not null and id is not null").groupBy("key").agg(first).select("key", "r.*"), "classes")

    bucket = reps.select("id", F.explode("bands").alias("bucket"))
    same = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"same{k}") for k in (0, 1)]
    hubs = bucket.groupBy("bucket").agg(F.min("id").alias("hub"), F.max("id").alias("last"), F.count("*").alias("n"), *same).where("hub < last")
    # near copies share many bands: of buckets with the same members (by 128 bits) one is enough
    once = hubs.groupBy("hub", "last", "n", "same0", "same1").agg(F.min("bucket").alias("bucket")).select("bucket", "hub")
    members = written(bucket.join(once, "bucket"), "members")
    sets = written(
        shingle_sets(docs, id_col, text_col, size, bit_filter(members.select(F.xxhash64("id").alias("h")), "h")), "sets"
    )

    def links(pairs: DataFrame) -> DataFrame:
        """Of pairs a, b those whose full sets are similar enough."""
        wide = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
        found = wide.select("a", "b", (F.size("sa") + F.size("sb")).alias("total"), F.size(F.array_intersect("sa", "sb")).alias("both"))
        return found.where(F.expr(f"100 * both >= {percent} * (total - both)")).select("a", "b")

    done = written(links(members.where("id > hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()), "links")
    labels = written(components(done), "labels")

    def labelled() -> DataFrame:
        """Members of shared buckets with their components so far."""
        return members.select("bucket", "id").join(labels, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))

    def merged(new: DataFrame) -> DataFrame:
        """Labels after new links, found on the components alone."""
        names = labels.select(F.col("id").alias("a"), F.col("component").alias("ca"))
        of = new.join(names, "a", "left").join(names.select(F.col("a").alias("b"), F.col("ca").alias("cb")), "b", "left")
        ends = of.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        joined = written(components(ends), "labels").select(F.col("id").alias("component"), F.col("component").alias("low"))
        old = labels.join(joined, "component", "left").select("id", F.coalesce("low", "component").alias("component"))
        fresh = joined.join(labels.select(F.col("id").alias("component")), "component", "left_anti").select(F.col("component").alias("id"), F.col("low").alias("component"))
        return written(old.union(fresh), "labels")

    for turn in (1, 2):
        now = written(labelled(), "open")
        top = F.max_by(F.struct("id", "component"), F.xxhash64("id", "bucket", F.lit(turn))).alias("hub")
        mixed_buckets = now.groupBy("bucket").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), top).where("c0 < c1")
        pairs = now.join(mixed_buckets.select("bucket", "hub"), "bucket").where("component != hub.component")
        new = written(links(pairs.select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b")).distinct()), "links")
        if new.isEmpty():
            break
        labels = merged(new)

    now = written(labelled(), "open")
    parts = now.groupBy("bucket", "component").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("n_parts"), F.sum("n").alias("n"))
    spanning = written(parts.where("n_parts > 1").select("bucket", "main", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")), "spanning")
    longs = 2 * PERMUTATIONS // 16
    flat = reps.select("id", "n_shingles", *(F.col("bits")[i].alias(f"b{i}") for i in range(longs)))
    left = now.join(spanning, "bucket").join(flat, "id").join(sets, "id")
    # members outside a bucket's largest component meet all of it, chunk by chunk
    x = left.where("component != main").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).alias("x")
    y = left.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).alias("y")
    # a chance agreement of four bits is one in sixteen
    need = round(192 * (1 / 16 + 15 / 16 * percent / 100) - 192 * (1 / 16 + 15 / 16 * 0.8) + AGREE_AT_80)
    # cheap tests first; the full sets are compared inside the join, so that it makes rows of links alone
    alike = F.expr(
        f"x.bucket = y.bucket and x.chunk = y.chunk and x.component != y.component and (y.component = y.main or x.id < y.id) and 100 * least(x.n_shingles, y.n_shingles) >= {percent} * greatest(x.n_shingles, y.n_shingles)"
        f" and {_agreeing('x.b', 'y.b', longs)} >= {need} and {100 + percent} * size(array_intersect(x.shingles, y.shingles)) >= {percent} * (x.n_shingles + y.n_shingles)"
    )
    new = written(x.join(y, alike).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct(), "links")
    if not new.isEmpty():
        labels = merged(new)

    # the result needs no more than these three
    removed(docs.sparkSession, mark, keep=[table, reps, labels])
    classes = reps.select("key", "id").join(labels, "id", "left").select("key", F.coalesce("component", "id").alias("component_id"))
    out = table.select("id", "key", "n_shingles").join(classes, "key", "left").select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
    out = out.withColumn("component_id", F.when(F.col(id_col).isNotNull(), F.col("component_id")))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
