"""Spelling variants of words: full neighbourhood generation and a hash join with the vocabulary.

Every word emits all distinct texts that one deletion, replacement or insertion over the observed alphabet
makes of it.  A candidate is a key (64 bits), made from two running sums of the word in a few operations whatever
the word's length, with the edit that makes it.  Keys that a bounded bit filter of the vocabulary rules out are dropped
where they are made; the others are joined with the vocabulary by key, and a hit holds if the edited word
*is* the vocabulary's word.  No distance is computed.

Words are maximal runs ``[A-Za-z\\u00C0-\\u00FF]+``, A-Z lowered, of at least ``shortest`` code points and
``fewest`` occurrences.  Noise can be planted first: a run whose crc32 with its document's id is a multiple of
``noise`` loses one code point.  Null and empty texts have no words; a null id is the empty text in that hash.
Repeated rows count again.  A word that occurs in every document is one row for each task before the shuffle.
Other columns are not read.  No words give no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillspark.llm.common import sliced
from rillspark.llm.hashing import bit_filter, in_filter, mixed
from rillspark.session import removed, tables_so_far, written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
FORM_TIMES = 5
#: Distinct words that a task counts before it passes the counts on.
COUNTED = 200_000
#: Candidates that are made together.
TOGETHER = 1_000_000
MOST_STEPS = 40
#: An odd base of the keys and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
DELETED, REPLACED, INSERTED = 0, 1, 2


# -- vocabulary ---------------------------------------------------------------------------


def counted_words(docs: DataFrame, id_col: str, text_col: str, noise: int | None, shortest: int) -> DataFrame:
    """word, n: partial counts of the tasks."""

    def flushed(counts: Counter) -> pa.RecordBatch:
        out = pa.RecordBatch.from_pydict({"word": pa.array(counts.keys(), pa.string()), "n": pa.array(counts.values(), pa.int64())})
        counts.clear()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                # bytes.lower touches A-Z only
                own = Counter(RUN.findall((text or "").encode("utf-8", "replace").lower().decode()))
                if noise:
                    head = zlib.crc32(f"{'' if key is None else key}:".encode())
                    for word, n in own.items():
                        h = zlib.crc32(word.encode(), head)
                        if h % noise == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                        if len(word) >= shortest:
                            counts[word] += n
                else:
                    counts.update({w: n for w, n in own.items() if len(w) >= shortest})
                if len(counts) > COUNTED:
                    yield flushed(counts)
        if counts:
            yield flushed(counts)

    table = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return table.mapInArrow(lambda batches: run(sliced(batches, "text")), "word string, n long")


def _codes(word: str) -> np.ndarray:
    return np.frombuffer(word.encode("utf-32-le"), "<u4").astype(np.uint64)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_keys(words: list[str]) -> np.ndarray:
    """The key of each word: the mixed sum of code points times powers of the base, modulo 2**64."""
    if not words:
        return np.empty(0, np.int64)
    codes = _codes("".join(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(codes)) - np.repeat(starts, lengths)
    return mixed(np.add.reduceat(codes * _powers(int(lengths.max()))[place], starts)).view(np.int64)


def keyed(words: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(word_keys(b.column(0).to_pylist()))], names=["word", "n", "key"])

    return words.mapInArrow(run, "word string, n long, key long")


# -- neighbourhoods -----------------------------------------------------------------------


def neighbourhood(codes: np.ndarray, alphabet: np.ndarray, places: slice) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(edit, places, letters, keys, distinct) for words of one length (rows of ``codes``): keys by word, place and letter.

    With ``before`` and ``after`` the sums of what lies left of a place and from it on, a deletion is ``before + (after - own) / base``,
    a replacement ``before + new + (after - own)`` and an insertion ``before + new + after * base``.  ``distinct`` leaves out
    what is the word itself or made elsewhere: of equal deletions in a run of one letter only the last stays,
    of equal insertions only the one behind the run.
    """
    n, length = codes.shape
    power = _powers(length + 1)
    terms = codes * power[:length]
    after = np.zeros((n, length + 1), np.uint64)
    after[:, :length] = np.cumsum(terms[:, ::-1], 1)[:, ::-1]
    before = after[:, :1] - after
    # a zero, which is no letter, behind each word
    padded = np.concatenate([codes, np.zeros((n, 2), np.uint64)], 1)
    at = np.arange(length + 1)[places]
    inner = at[at < length]
    own, rest = codes[:, inner], after[:, inner] - terms[:, inner]
    yield DELETED, inner, alphabet[:1], (before[:, inner] + rest * np.uint64(INVERSE))[:, :, None], (own != padded[:, inner + 1])[:, :, None]
    yield REPLACED, inner, alphabet, (before[:, inner] + rest)[:, :, None] + power[inner][:, None] * alphabet, own[:, :, None] != alphabet
    yield INSERTED, at, alphabet, (before[:, at] + after[:, at] * np.uint64(BASE))[:, :, None] + power[at][:, None] * alphabet, padded[:, at][:, :, None] != alphabet


def candidates(words: DataFrame, alphabet: np.ndarray, bits: np.ndarray) -> DataFrame:
    """word_key, edit, place, code, key of the candidates that the filter lets pass."""
    shared = words.sparkSession.sparkContext.broadcast(bits)  # 32 MB at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by_length: dict[int, list[int]] = {}
            texts, own = b.column(0).to_pylist(), b.column(1).to_numpy()
            for k, w in enumerate(texts):
                by_length.setdefault(len(w), []).append(k)
            for length, rows in by_length.items():
                # so many words, or else so many places of one word, that few candidates lie in memory
                some = max(1, TOGETHER // (2 * (length + 1) * len(alphabet)))
                span = max(1, TOGETHER // (2 * len(alphabet)))
                for first in range(0, len(rows), some):
                    part = rows[first : first + some]
                    codes = _codes("".join(texts[k] for k in part)).reshape(len(part), length)
                    for at in range(0, length + 1, span):
                        for edit, places, letters, keys, distinct in neighbourhood(codes, alphabet, slice(at, at + span)):
                            keys = mixed(keys).view(np.int64)
                            row, k, a = np.nonzero(in_filter(shared.value, keys.ravel()).reshape(keys.shape) & distinct)
                            if len(row):
                                columns = [own[np.array(part)[row]], np.full(len(row), edit, np.int8), places[k].astype(np.int32), letters[a].astype(np.int32), keys[row, k, a]]
                                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["word_key", "edit", "place", "code", "key"])

    return words.select("word", "key").mapInArrow(run, "word_key long, edit tinyint, place int, code int, key long")


def edited(word: Column, edit: Column, place: Column, code: Column) -> Column:
    """The candidate's text."""
    left = F.substr(word, F.lit(1), place)
    # letters end at U+00FF, as the codes of char() do
    new = F.when(edit == DELETED, "").otherwise(F.char(code.cast("long")))
    return F.concat(left, new, F.substr(word, place + F.when(edit == INSERTED, 1).otherwise(2)))


def near_words(vocabulary: DataFrame) -> DataFrame:
    """word, n, near, near_n: every word with each vocabulary word one edit away."""
    letters = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct()
    # at most the letters that a run can hold: 26 and 64
    alphabet = np.array(sorted(ord(r["c"]) for r in letters.collect() if r["c"]), np.uint64)
    bits = bit_filter(vocabulary, "key")
    # candidates are the work: words are dealt out evenly before they are made
    made = candidates(vocabulary.repartition("key"), alphabet, bits)
    theirs = vocabulary.select("key", F.col("word").alias("near"), F.col("n").alias("near_n"))
    hits = made.join(theirs, "key").drop("key")
    own = vocabulary.withColumnRenamed("key", "word_key")
    return hits.join(own, "word_key").where(edited(F.col("word"), F.col("edit"), F.col("place"), F.col("code")) == F.col("near")).select("word", "n", "near", "near_n")


# -- forms and roots ----------------------------------------------------------------------


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of each chain word -> form, in as many steps as the logarithm of the longest chain.

    A form occurs ``FORM_TIMES`` as often as its word, so there are no rings and chains are short.
    """
    mark = tables_so_far()
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(MOST_STEPS):
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = written(now.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("open")), "roots")
        if not step.where("open").head(1):
            removed(forms.sparkSession, mark, keep=[step])
            return step.select("word", "root")
        now = step.select("word", "root")
    raise RuntimeError("the chains of forms did not end")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 6, fewest: int = 5, noise: int | None = None) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word.

    ``form`` is the near word of largest n (ties: the smallest in code-point order), if it occurs at least
    ``FORM_TIMES`` as often as the word; ``root`` is where the forms end.
    """
    mark = tables_so_far()
    counts = counted_words(docs, id_col, text_col, noise, shortest).groupBy("word").agg(F.sum("n").alias("n"))
    vocabulary = written(keyed(counts.where(F.col("n") >= fewest)), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = near_words(vocabulary).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    holds = F.col("n_near").isNotNull() & (-F.col("best.less") >= FORM_TIMES * F.col("n"))
    table = written(
        vocabulary.join(near, "word", "left").select(
            "word",
            F.when(holds, F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(holds, -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    ends = roots(table.where("form is not null"))
    out = written(table.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "variants")
    removed(docs.sparkSession, mark, keep=[out])
    return out
