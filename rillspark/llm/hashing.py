"""Stable 64-bit hashes of words and of runs of words, and bounded bit filters of keys."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct words that a Python worker remembers; then it starts afresh.
KEPT_WORDS = 1_000_000
P, C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class WordHashes(dict):
    """A word's hash, computed once for each distinct word that is remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * C
    return x ^ (x >> np.uint64(29))


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` words; of the whole where there are fewer; none of nothing."""
    n = len(hashes)
    if not n:
        return hashes
    size = min(size, n)
    acc = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        acc = mixed(acc * P + hashes[i : n - size + 1 + i])
    return acc


#: Fewest and most bits of a filter: 4 MB to 32 MB of them in all, whatever the number of keys.
FILTER_BITS, MOST_BITS = 1 << 25, 1 << 28


def _places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return keys & np.int64(bits - 1), (keys >> np.int64(29)) & np.int64(bits - 1)


def bit_filter(keys: DataFrame, key: str) -> np.ndarray:
    """Two bits for each of the keys (signed 64-bit hashes), for :func:`in_filter`.

    About 16 bits a key between the two sizes above; more keys than that let more through, which
    costs work and never a result.  At most ``MOST_BITS`` / 32768 rows of 4 KB come to the driver.
    """
    n = keys.count()
    size = FILTER_BITS
    while size < MOST_BITS and size < 16 * n:
        size *= 2
    both = F.array(F.col(key), F.expr(f"shiftright(`{key}`, 29)"))
    place = keys.select(F.explode(both).alias("k")).select((F.pmod("k", F.lit(size)) + 1).alias("p"))
    rows = place.groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()
    out = np.zeros(size // 8, np.uint8)
    for r in rows:  # bucket k holds the values 32768 (k - 1) + 1 .. 32768 k
        p0 = 4096 * (r["bucket"] - 1)
        out[p0 : p0 + 4096] = np.frombuffer(bytes(r["bits"]).ljust(4096, b"\0"), np.uint8)
    return out


def in_filter(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each signed 64-bit key may be among the keys of the filter; never false for one that is."""
    get = lambda p: (bits[p >> np.int64(3)] >> (p & np.int64(7)).astype(np.uint8)) & np.uint8(1) == 1
    one, two = _places(keys, 8 * len(bits))
    out = get(one)
    at = np.nonzero(out)
    out[at] = get(two[at])
    return out
