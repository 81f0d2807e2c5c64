"""Id files in which frequent pairs are replaced by nonterminals (Re-Pair), shard by shard.

A shard is a range of doc_id.  Its ids are kept in blocks of about ``BLOCK`` ids, each a
row of a Parquet table in the shared folder and readable by itself:

=============  ==========================================================================
shard, block   place in the order of doc_id
shard_start    ids of the shard before this block
doc_ids        documents of the block, ascending
rules          little-endian int32 pairs: nonterminal ``BASE + k`` stands for pair ``k``
lengths        little-endian int32: ids that nonterminal ``BASE + k`` expands to
symbols        little-endian int32: the compressed ids
symbol_ends    for each document, where its symbols end: documents never share a symbol
n_ids          for each document, its ids with the end id
=============  ==========================================================================

first_id and last_id, the smallest and largest id of a block, stand beside them.  Random access
(:func:`read_documents`) is a filter on those two, which the statistics of Parquet answer, and expands
only the symbols of the documents asked for; ``lengths`` gives their size before expanding.

Each round counts adjacent pairs inside documents, makes a rule of every pair that occurs ``LEAST``
times or more and replaces occurrences from left to right.  Rules may use earlier
nonterminals.  Rounds go on until no pair occurs ``LEAST`` times.

Null and empty texts hold the end id alone; repeated doc_ids stay separate, in the order of a hash
of their texts (equal texts have equal ids), and may lie in several shards.  A null doc_id
comes first.  Other columns are not read.  No documents give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillspark.llm.bpe import encoder, spans
from rillspark.llm.common import sliced
from rillspark.session import written

END = 0
#: First nonterminal: above every id of the vocabularies in use.
BASE = 1 << 20
BLOCK = 1_000_000
#: Occurrences in a block that make a pair frequent.
LEAST = 24
#: Pairs are first counted in this many hash buckets, exactly after that.
BUCKETS = 1 << 18


def compress(ids: np.ndarray, ends: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rules, lengths, symbols, symbol ends) of ids whose documents end before ``ends``."""
    seq = ids.astype(np.int32)
    cut = np.zeros(len(seq), bool)
    cut[np.asarray(ends) - 1] = True  # a last symbol of a document begins no pair
    rules, lengths = np.empty((0, 2), np.int32), np.empty(0, np.int32)
    # places whose pair may be frequent: the count of a pair of old symbols never grows
    live, salt = ~cut, 0
    while len(at := np.flatnonzero(live)):
        salt += 1
        first_of, second_of = seq[at], seq[at + 1]
        mixed = ((first_of.view(np.uint32) * np.uint32(0x9E3779B1)) ^ (second_of.view(np.uint32) + np.uint32(salt))) * np.uint32(0x85EBCA77)
        bucket = (((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - 18)).astype(np.int64)
        # pairs whose bucket is not full cannot be frequent
        some = (np.bincount(bucket, minlength=BUCKETS) >= least)[bucket]
        live[at[~some]] = False
        at, bucket, pair = at[some], bucket[some], first_of[some].astype(np.int64) << 32 | second_of[some]
        # of each full bucket one pair is counted, without a sort; another round has other buckets
        one = np.zeros(BUCKETS, np.int64)
        one[bucket] = pair
        its = one[bucket] == pair
        often = np.bincount(bucket[its], minlength=BUCKETS) >= least
        if often.any():
            chosen = np.flatnonzero(often)
            rank = np.zeros(BUCKETS, np.int32)
            rank[chosen] = np.arange(len(chosen), dtype=np.int32)
            frequent = often[bucket]
            live[at[its & ~frequent]] = False
            its &= frequent
            kinds, at, which = one[chosen], at[its], rank[bucket[its]]
        else:  # what shares its bucket with other pairs is counted exactly
            kinds, which, counts = np.unique(pair, return_inverse=True, return_counts=True)
            its = (counts >= least)[which]
            live[at[~its]] = False
            at, which = at[its], which[its]
            if not len(at):
                break
        # of neighbouring occurrences every second one, from the left
        run_start = np.flatnonzero(np.r_[True, np.diff(at) != 1])
        place = np.arange(len(at)) - np.repeat(run_start, np.diff(np.r_[run_start, len(at)]))
        at, which = at[place % 2 == 0], which[place % 2 == 0]
        used = np.flatnonzero(np.bincount(which, minlength=len(kinds)))  # a pair whose occurrences all overlap others makes no rule
        number = np.zeros(len(kinds), np.int32)
        number[used] = np.arange(len(used), dtype=np.int32)
        made = kinds[used]
        made = np.stack([made >> 32, made & 0xFFFFFFFF], 1).astype(np.int32)
        first = BASE + len(rules)
        known = np.r_[lengths, np.zeros(1, np.int32)]
        size = lambda s: np.where(s >= BASE, known[np.maximum(s - BASE, 0)], 1)  # noqa: B023, E731
        rules, lengths = np.r_[rules, made], np.r_[lengths, (size(made[:, 0]) + size(made[:, 1])).astype(np.int32)]
        seq[at] = first + number[which]
        cut[at] = cut[at + 1]
        live[at] = True
        live[at[at > 0] - 1] = True
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, cut, live = seq[keep], cut[keep], live[keep]
        live &= ~cut
    return rules, lengths, seq, np.flatnonzero(cut) + 1


def expansions(rules: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nonterminals expanded, one after the other, and where each starts."""
    starts = np.r_[0, np.cumsum(lengths)].astype(np.int64)
    flat = np.empty(int(starts[-1]), np.int32)
    for k, (a, b) in enumerate(rules.tolist()):
        at = int(starts[k])
        for s in (a, b):
            if s >= BASE:
                i = int(starts[s - BASE])
                n = int(lengths[s - BASE])
                flat[at : at + n] = flat[i : i + n]
            else:
                n = 1
                flat[at] = s
            at += n
    return flat, starts


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ids that symbols stand for: any slice of a block's symbols can be given."""
    flat, starts = expansions(rules, lengths)
    is_rule = symbols >= BASE
    k = np.where(is_rule, symbols - BASE, 0)
    sizes = np.where(is_rule, lengths[k] if len(lengths) else 1, 1)
    out = np.repeat(symbols, sizes)
    out[np.repeat(is_rule, sizes)] = flat[spans(starts[k[is_rule]], sizes[is_rule])]
    return out


def expand_some(symbols: np.ndarray, rules: np.ndarray) -> np.ndarray:
    """The ids that a few symbols stand for, by no other rules than those they need."""
    while (is_rule := symbols >= BASE).any():
        at = np.cumsum(1 + is_rule) - (1 + is_rule)
        out = np.repeat(symbols, 1 + is_rule)
        pairs = rules[symbols[is_rule] - BASE]
        out[at[is_rule]], out[at[is_rule] + 1] = pairs[:, 0], pairs[:, 1]
        symbols = out
    return symbols


def write_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> DataFrame:
    """The file table of all documents, written in the shared folder and read again."""
    kind = docs.schema[id_col].dataType.simpleString()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def block(shard: int, k: int, before: int, keys: pa.Array, ids: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        rules, lengths, seq, ends = compress(ids, np.cumsum(n))
        low = pc.min_max(keys)
        listed = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        row = {
            "shard": pa.array([shard], pa.int32()),
            "block": pa.array([k], pa.int32()),
            "shard_start": pa.array([before], pa.int64()),
            "first_id": pa.array([low["min"].as_py()], keys.type),
            "last_id": pa.array([low["max"].as_py()], keys.type),
            "doc_ids": listed(keys),
            "rules": pa.array([rules.astype("<i4").tobytes()]),
            "lengths": pa.array([lengths.astype("<i4").tobytes()]),
            "symbols": pa.array([seq.astype("<i4").tobytes()]),
            "symbol_ends": listed(pa.array(ends.astype(np.int64))),
            "n_ids": listed(pa.array(n.astype(np.int64))),
        }
        return pa.RecordBatch.from_pydict(row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        if enc.tok.get_vocab_size() > BASE or end >= BASE:
            raise ValueError("the vocabulary reaches into the nonterminals")
        keys, ids, sizes, size, k, before, shard = [], [], [], 0, 0, 0, 0
        for b in sliced(batches, text_col, 4_000_000):
            shard = b.column("shard")[0].as_py()
            flat, n = enc.encode(b.column(text_col), end)
            keys.append(b.column(id_col))
            ids.append(flat)
            sizes.append(n)
            size += len(flat)
            if size >= BLOCK:
                yield block(shard, k, before, pa.concat_arrays(keys), np.concatenate(ids), np.concatenate(sizes))
                keys, ids, sizes, size, k, before = [], [], [], 0, k + 1, before + size
        if keys:
            yield block(shard, k, before, pa.concat_arrays(keys), np.concatenate(ids), np.concatenate(sizes))

    schema = f"shard int, block int, shard_start long, first_id {kind}, last_id {kind}, doc_ids array<{kind}>, rules binary, lengths binary, symbols binary, symbol_ends array<long>, n_ids array<long>"
    # by the hash too, so that a doc_id with very many rows is spread over shards
    some = docs.select(F.col(id_col), F.col(text_col), F.xxhash64(text_col).alias("__h"))
    ordered = some.repartitionByRange(parts, id_col, "__h").sortWithinPartitions(id_col, "__h").drop("__h")
    return written(ordered.withColumn("shard", F.spark_partition_id()).mapInArrow(run, schema), "ids")


def read_ids(files: DataFrame, id_type: str = "long", id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Documents decoded from the file table: id, start (ids before it in all documents), n_tokens, ids_crc32."""
    totals = files.select("shard", F.expr("shard_start + aggregate(n_ids, 0L, (a, x) -> a + x)").alias("until")).groupBy("shard").agg(F.max("until").alias("n"))
    # a row for each shard: as many as the files were written in partitions
    firsts = totals.select(F.col("shard").alias("of_shard"), (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                get = lambda c: row.column(c)[0]  # noqa: B023, E731
                ids = expand(np.frombuffer(get("symbols").as_buffer(), "<i4"), np.frombuffer(get("rules").as_buffer(), "<i4").reshape(-1, 2), np.frombuffer(get("lengths").as_buffer(), "<i4"))
                n = get("n_ids").values.to_numpy()
                ends = np.cumsum(n)
                start = ends - n
                raw = ids.astype("<u4").tobytes()
                cols = [get("doc_ids").values, pa.array(get("before").as_py() + get("shard_start").as_py() + start), pa.array(n), pa.array([zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(start.tolist(), ends.tolist(), strict=True)], pa.int64())]
                names = [id_col, "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array([raw[4 * x : 4 * y] for x, y in zip(start.tolist(), ends.tolist(), strict=True)], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"`{id_col}` {id_type}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    wide = files.join(F.broadcast(firsts), F.col("shard") == F.col("of_shard"))
    return wide.select("doc_ids", "n_ids", "rules", "lengths", "symbols", "shard_start", "before").mapInArrow(run, schema)


def read_documents(files: DataFrame, keys: list, id_col: str = "doc_id") -> DataFrame:
    """``id_col`` and ids (little-endian unsigned 32-bit) of the documents asked for, by random access.

    Only blocks that may hold one of the keys (a short list) are read, and only the symbols of the
    documents asked for are expanded.
    """
    kind = files.schema["first_id"].dataType.simpleString()
    wanted = pa.array(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                get = lambda c: b.slice(i, 1).column(c)[0]  # noqa: B023, E731
                names = get("doc_ids").values
                at = np.flatnonzero(pc.is_in(names, wanted.cast(names.type)).to_numpy(zero_copy_only=False))
                ends = get("symbol_ends").values.to_numpy()
                rules, symbols = np.frombuffer(get("rules").as_buffer(), "<i4").reshape(-1, 2), np.frombuffer(get("symbols").as_buffer(), "<i4")
                ids = [expand_some(symbols[ends[k - 1] if k else 0 : ends[k]], rules).astype("<u4").tobytes() for k in at.tolist()]
                if ids:
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(at)), pa.array(ids, pa.binary())], names=[id_col, "ids"])

    some = F.lit(False)
    for key in keys:
        some = some | ((F.col("first_id") <= key) & (F.col("last_id") >= key))
    return files.where(some).select("doc_ids", "rules", "symbols", "symbol_ends").mapInArrow(run, f"`{id_col}` {kind}, ids binary")
