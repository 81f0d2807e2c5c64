"""Benchmark passages in documents, found by spaced seeds and checked word by word.

Words are lower-cased and lose all but letters and digits; words without any are skipped.
An item of ``SPAN`` words or more is looked for window by window, each of ``SPAN`` words; a shorter
one is a single window of all its words.  One rule holds for all sizes: of ``SPAN`` words
``SUBSTITUTIONS`` may be replaced, of fewer words in proportion, rounded down (one of 7 to 12, none of
1 to 6).  Inserted and dropped words are not tolerated beyond that.

A window that tolerates k replaced words is cut into k + 2 blocks, and each mask looks at two of
them and ignores the others.  Whichever words are replaced, some mask ignores them all, so such a
window always shares a masked hash with its source.

The hashes of the benchmark fill a bit filter of bounded size.  One scan of the documents keeps
the windows whose hash may be in it; those are joined with the benchmark's windows on the
hash and compared word by word.  A seed that very many documents share is dealt over ``SALTS`` keys.

An item of very few words is found wherever these stand in a row, which says little of a
document: ``shortest`` leaves out items of fewer words where a user wants that; by default none is.
Null and empty texts, and an empty benchmark, give no hits.  Repeated rows give repeated rows,
repeated items count once (the smallest id stands for them).  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillspark.llm.common import sliced
from rillspark.llm.hashing import KEPT_WORDS, P, bit_filter, in_filter, mixed
from rillspark.session import written

SPAN, SUBSTITUTIONS, SALTS = 13, 2, 16


def tolerated(size: int) -> int:
    """Replaced words that a window of so many words tolerates."""
    return size * SUBSTITUTIONS // SPAN


@lru_cache(maxsize=None)
def layout(size: int) -> tuple[list[tuple[int, int]], list[tuple[int, ...]]]:
    """(first word, words) of the blocks of a window, and the blocks that each mask looks at."""
    k = tolerated(size)
    if not k:
        return [(0, size)], [(0,)]
    edges = [-(-size * i // (k + 2)) for i in range(k + 3)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)], list(combinations(range(k + 2), 2))


class PlainHashes(dict):
    """Raw word -> hash of its lower-cased letters and digits; 0 where it has none."""

    def __missing__(self, word: str) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        plain = "".join(filter(str.isalnum, word.lower()))
        h = self[word] = (xxhash.xxh3_64_intdigest(plain.encode("utf-8", "replace")) | 1) if plain else 0
        return h

    def of(self, text: str | None) -> np.ndarray:
        parts = text.split() if text else []
        h = np.fromiter(map(self.__getitem__, parts), np.uint64, len(parts))
        return h[h != 0]


#: An odd base of sums of hashes and its inverse modulo 2**64.
INVERSE = np.uint64(pow(int(P), -1, 1 << 64))


class Powers:
    """Powers of an odd number modulo 2**64, as many as the longest text so far needs."""

    def __init__(self, base: np.uint64):
        self.base, self.known = base, np.ones(1, np.uint64)

    def first(self, n: int) -> np.ndarray:
        if n > len(self.known):
            self.known = np.full(2 * n, self.base, np.uint64)
            self.known[0] = 1
            np.multiply.accumulate(self.known, out=self.known)
        return self.known[:n]


UP, DOWN = Powers(P), Powers(INVERSE)


def masked(h: np.ndarray, size: int) -> np.ndarray:
    """masks x windows: the hash of each window of ``size`` words under each mask, apart from other sizes and masks.

    A block's words are summed with rising powers, as the difference of two running sums of the text, brought
    back to the block's start.
    """
    n = len(h) - size + 1
    where, masks = layout(size)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * UP.first(len(h)), out=sums[1:])
    down = DOWN.first(len(h))
    blocks = [(sums[first + words : first + words + n] - sums[first : first + n]) * down[first : first + n] for first, words in where]
    out = np.empty((len(masks), n), np.uint64)
    for m, mask in enumerate(masks):
        acc = blocks[mask[0]] + np.uint64((64 * size + m + 1) * int(P) % (1 << 64))
        for b in mask[1:]:
            acc = acc * P + blocks[b]
        out[m] = mixed(acc)
    return out.view(np.int64)


def _windows(docs: DataFrame, id_col: str, text_col: str, bits: np.ndarray | None, sizes: list[int], shortest: int) -> DataFrame:
    """id, place, seed and words of the windows of each text whose seed may be in ``bits``.

    Without ``bits``: of each benchmark item.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = PlainHashes()
        for b in sliced(batches, text_col):
            rows, place, seed, words, ends = [], [], [], [], [0]
            for i, t in enumerate(b.column(text_col).to_pylist()):
                h = hashes.of(t)
                short = h.astype(np.uint32).view(np.int32)
                for size in sizes if bits is not None else [min(len(h), SPAN)] if len(h) >= max(shortest, 1) else []:
                    if len(h) >= size:
                        m = masked(h, size)
                        at = np.nonzero(in_filter(bits, m) if bits is not None else np.ones(m.shape, bool))
                        if len(at[1]):
                            rows.append(np.full(len(at[1]), i))
                            place.append(at[1])
                            seed.append(m[at])
                            words.append(short[at[1][:, None] + np.arange(size)].ravel())
                            ends.extend([size] * len(at[1]))
            if rows:
                listed = pa.ListArray.from_arrays(pa.array(np.cumsum(ends).astype(np.int32)), pa.array(np.concatenate(words)))
                yield pa.RecordBatch.from_arrays([b.column(id_col).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(place)), pa.array(np.concatenate(seed)), listed], names=["id", "place", "seed", "words"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, place long, seed long, words array<int>")


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", shortest: int = 1) -> DataFrame:
    """``id_col``, place, ``item_col``, item_place and substitutions of every window that a document shares."""
    items = _windows(benchmark, item_col, item_text, None, [], shortest)
    # one row for each different window, so repeated items multiply nothing
    items = written(
        items.groupBy("seed", "words").agg(F.min(F.struct("id", "place")).alias("i")).select("seed", F.col("words").alias("theirs"), F.col("i.id").alias(item_col), F.col("i.place").alias("item_place")), "benchmark"
    )
    sizes = sorted(r[0] for r in items.select(F.size("theirs").alias("n")).distinct().collect())  # SPAN at most
    found = written(_windows(docs, id_col, text_col, bit_filter(items.select("seed"), "seed"), sizes, shortest), "windows")
    salted = items.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pairs = found.withColumn("salt", F.pmod(F.xxhash64("id", "place"), F.lit(SALTS)).cast("int")).join(salted, ["seed", "salt"]).where(F.size("words") == F.size("theirs"))
    wrong = F.size(F.filter(F.zip_with("words", "theirs", lambda a, b: a != b), lambda x: x))
    checked = pairs.select(F.col("id").alias(id_col), "place", item_col, "item_place", wrong.alias("substitutions"), F.size("words").alias("n"))
    return checked.where(F.expr(f"substitutions <= n * {SUBSTITUTIONS} div {SPAN}")).drop("n")


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """What tells rows apart for the search: the id, which may be null or repeated, and a hash of the text, which decides alone."""
    return F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("text"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", shortest: int = 1) -> DataFrame:
    """``id_col``, contaminated, n_windows, ``item_col`` (the smallest of those found) and substitutions (fewest) of every row.

    Rows with a null id, and rows that share an id, are judged by their own texts.
    """
    keyed = docs.select(F.col(f"`{id_col}`").alias(id_col), row_key(id_col, text_col).alias("__row"), F.col(f"`{text_col}`").alias(text_col))
    found = hits(keyed, benchmark, "__row", text_col, item_col, item_text, shortest)
    # a document's windows are merged place by place first: the same place comes up for each mask and item
    by_place = found.groupBy("__row", "place").agg(F.min(item_col).alias(item_col), F.min("substitutions").alias("substitutions"))
    per_doc = by_place.groupBy("__row").agg(F.count("*").alias("n_windows"), F.min(item_col).alias(item_col), F.min("substitutions").alias("substitutions"))
    out = keyed.select(id_col, "__row").join(per_doc, "__row", "left")
    return out.select(id_col, F.col("n_windows").isNotNull().alias("contaminated"), F.coalesce("n_windows", F.lit(0)).alias("n_windows"), item_col, "substitutions")
