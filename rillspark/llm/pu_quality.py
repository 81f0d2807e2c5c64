"""Quality of documents by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives P are the training documents whose labels are all 1; the unlabelled texts U are
all training documents.  Labels of 0 are never used.  With ``l`` the logistic loss, ``g`` a linear
score of features of the whole text and ``prior`` the share of positives in U, the risk is

    prior * mean_P l(g) + max(0, mean_U l(-g) - prior * mean_P l(-g)) + ridge

which is unbiased while the second term (the risk on the unseen negatives) is positive, and is kept
from falling below zero by the ``max``.  A minimiser with a negative second term is overfitted, so the ridge is
weakened step by step (``RIDGES``) only as long as that term stays non-negative; there the risk is convex and
Newton steps minimise it.  Each step is one pass over the features, in which every task adds up its documents and
Spark adds up the tasks' sums.

The prior is estimated, not given: any set S of scores holds at least the share
``prior * P(S)`` of U, so ``U(S) / P(S)`` bounds it from above.  S runs over the upper tails, with at least
half of P, of a score that tells P from U.  That score is fitted on one half of the training documents
(by hash) and the tails are counted, in fixed bins, on the other, or it would favour the very positives
that it was fitted on.  The bound is read where its upper confidence end is lowest.

Features come from the text alone: shares of pairs of neighbouring kinds of characters, and repetition,
variety and length of words and lines.  They are written once (a few hundred bytes a document).

Training leaves out documents whose crc32(id as text) is 2 modulo 4; a null id is the empty text
there and meets no label.  Null and empty texts have features of no characters and get a score like any
other.  Repeated rows are separate documents, repeated labels of an id count once.  Without a
trusted positive every score is 0.5.  Other columns are not read.  No documents give no rows.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillspark.llm.common import sliced
from rillspark.session import removed, tables_so_far, written

KINDS = 8
N_FEATURES = KINDS * KINDS + 9
STRETCH = 1_000_000
PASSES, BINS, REACH = 25, 4000, 20.0
RIDGES = (10.0, 3.0, 1.0, 0.3, 0.1, 0.03, 0.01, 0.003)
#: Ridge of the score that the prior is read from.
APART_RIDGE = 0.003
#: A positive document counts as kept from this score on.
THRESHOLD = 0.7


def _hash(key) -> int:
    return zlib.crc32(("" if key is None else str(key)).encode())


def held_out(key) -> bool:
    return _hash(key) % 4 == 2


# -- features -----------------------------------------------------------------------------


@cache
def _kinds() -> np.ndarray:
    """0 small letter, 1 capital, 2 digit, 3 blank, 4 line end, 5 full stop or comma, 6 other punctuation, 7 anything else."""

    def kind(c: str) -> int:
        if c == "\n":
            return 4
        if c.isspace():
            return 3
        if c in ".,":
            return 5
        group = unicodedata.category(c)[0]
        return (1 if c.isupper() else 0) if group in "LM" else {"N": 2, "P": 6}.get(group, 7) if c not in "#%&*" else 7

    return np.array([kind(chr(c)) for c in range(65536)] + [7], np.uint8)


def features(text: str | None) -> np.ndarray:
    """``N_FEATURES`` numbers, each of about 0 to 1, of a whole text."""
    text = text or ""
    pairs, last = np.zeros(KINDS * KINDS, np.int64), np.empty(0, np.uint8)
    for at in range(0, len(text), STRETCH):
        codes = np.frombuffer(text[at : at + STRETCH].encode("utf-32-le", "replace"), "<u4")
        kinds = np.concatenate([last, _kinds()[np.minimum(codes, 65536)]])
        pairs += np.bincount(KINDS * kinds[:-1].astype(np.int64) + kinds[1:], minlength=len(pairs))
        last = kinds[-1:]
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, counts = max(len(words), 1), Counter(words)
    tops = [c for _, c in counts.most_common(5)]
    of_words = [
        sum(map(eq, words, words[1:])) / n,
        sum(map(eq, words, words[2:])) / n,
        len(counts) / n,
        max(tops, default=0) / n,
        sum(tops) / n,
        len(text) / n / 20,
        np.log1p(len(words)) / 10,
        1 - len(set(lines)) / max(len(lines), 1),
        np.log1p(len(words) / max(len(lines), 1)) / 10,
    ]
    return np.concatenate([np.sqrt(pairs / max(pairs.sum(), 1)), of_words]).astype(np.float32)


def featured(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """id, train, half (0 or 1), positive and x (features as little-endian float32) of every document."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            ids = b.column(0).to_pylist()
            x = [features(t).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([not held_out(i) for i in ids]), pa.array([_hash(i) // 4 % 2 for i in ids], pa.int32()), pa.array(x, pa.binary())], names=["id", "train", "half", "x"])

    made = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"id {kind}, train boolean, half int, x binary")
    good = labels.groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.min(F.col(f"`{label_col}`") == 1).alias("positive"))
    return made.join(good, "id", "left").select("id", "train", "half", (F.col("train") & F.coalesce("positive", F.lit(False))).alias("positive"), "x")


# -- sums over all documents --------------------------------------------------------------


def summed(table: DataFrame, size: int, add: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``add(x, positive)`` (``size`` numbers) over batches of training documents; one set of sums a task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                x = np.frombuffer(b"".join(b.column(1).to_pylist()), "<f4").reshape(b.num_rows, -1).astype(np.float64)
                total += add(x, b.column(0).to_numpy(zero_copy_only=False))
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_pydict({"k": pa.array(at, pa.int32()), "value": pa.array(total[at])})

    out = np.zeros(size)
    parts = table.where("train").select("positive", "x").mapInArrow(run, "k int, value double")
    for r in parts.groupBy("k").agg(F.sum("value").alias("value")).collect():  # ``size`` rows at most
        out[r["k"]] = r["value"]
    return out


class Sums:
    """What a pass at weights ``w`` gives: means over P and U of losses, gradients and curvatures."""

    def __init__(self, table: DataFrame, w: np.ndarray, shift: np.ndarray, scale: np.ndarray):
        d = len(w)
        upper = np.triu_indices(d)
        each = 3 + 2 * d + len(upper[0])

        def one(z: np.ndarray) -> np.ndarray:
            g = z @ w
            s = 1 / (1 + np.exp(-np.clip(g, -500, 500)))
            curve = (z * (s * (1 - s))[:, None]).T @ z
            return np.concatenate([[len(z), np.logaddexp(0, -g).sum(), np.logaddexp(0, g).sum()], s @ z, z.sum(0), curve[upper]])

        def add(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
            z = standard(x, shift, scale)
            return np.concatenate([one(z[positive]), one(z)])

        both = summed(table, 2 * each, add)
        for name, part in (("p", both[:each]), ("u", both[each:])):
            n = max(part[0], 1)
            curve = np.zeros((d, d))
            curve[upper] = part[3 + 2 * d :]
            curve = curve + np.triu(curve, 1).T
            # mean losses of l(g) and l(-g), mean of s x, mean of x, mean curvature
            setattr(self, name, (part[1] / n, part[2] / n, part[3 : 3 + d] / n, part[3 + d : 3 + 2 * d] / n, curve / n))


Risk = Callable[[Sums], tuple[float, np.ndarray, np.ndarray]]


def telling_apart(s: Sums) -> tuple[float, np.ndarray, np.ndarray]:
    """Logistic risk of P against U, in equal parts."""
    return s.p[0] + s.u[1], s.p[2] - s.p[3] + s.u[2], s.p[4] + s.u[4]


def second_term(s: Sums, prior: float) -> float:
    """The estimated risk on negatives."""
    return s.u[1] - prior * s.p[1]


def unbiased(prior: float) -> Risk:
    """The unbiased risk; convex, since ``l(g) - l(-g) = -g``."""
    return lambda s: (prior * s.p[0] + second_term(s, prior), s.u[2] - prior * s.p[3], s.u[4])


def non_negative(prior: float) -> Risk:
    """The same with the ``max``."""

    def risk(s: Sums) -> tuple[float, np.ndarray, np.ndarray]:
        if second_term(s, prior) >= 0:
            return unbiased(prior)(s)
        return prior * s.p[0], prior * (s.p[2] - s.p[3]), prior * s.p[4]

    return risk


def standard(x: np.ndarray, shift: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardized features within five deviations, then a one for the constant."""
    return np.concatenate([np.clip((x - shift) * scale, -5, 5), np.ones((len(x), 1))], 1)


def minimised(at: Callable[[np.ndarray], Sums], risk: Risk, start: np.ndarray, strength: float) -> tuple[np.ndarray, Sums]:
    """Weights of least risk by damped Newton steps, and their sums; a step that raises the risk is halved."""
    ridge = np.full(len(start), strength)
    ridge[-1] = 1e-6  # the constant is all but free
    w, step, best = start, np.zeros(len(start)), None
    for _ in range(PASSES):
        trial = w + step
        sums = at(trial)
        value, slope, curve = risk(sums)
        value, slope, curve = value + ridge @ (trial * trial) / 2, slope + ridge * trial, curve + np.diag(ridge)
        if best is not None and value > best[0]:
            step = step / 2
            if np.abs(step).max() < 1e-4:
                break
            continue
        done = best is not None and best[0] - value < 1e-6 * max(1.0, abs(best[0]))
        w, best = trial, (value, sums)
        if done:
            break
        step = -np.linalg.solve(curve, slope)
        step *= min(1, 5 / max(np.abs(step).max(), 1e-12))
    return w, best[1]


def weakest_ridge(at: Callable[[np.ndarray], Sums], prior: float, start: np.ndarray) -> np.ndarray:
    """Weights of least non-negative risk under the weakest ridge whose minimiser leaves the second term at zero or above."""
    w = None
    for strength in RIDGES:
        found, sums = minimised(at, unbiased(prior), start if w is None else w, strength)
        if second_term(sums, prior) < 0:
            break
        w = found
    return minimised(at, non_negative(prior), start, RIDGES[0])[0] if w is None else w


def estimated_prior(table: DataFrame, w: np.ndarray, shift: np.ndarray, scale: np.ndarray) -> float:
    """The share of positives among the unlabelled, by the lowest confident ratio of tails."""

    def add(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
        g = standard(x, shift, scale) @ w
        place = np.clip(((g + REACH) * BINS / (2 * REACH)).astype(np.int64), 0, BINS - 1)
        return np.concatenate([np.bincount(place[positive], minlength=BINS), np.bincount(place, minlength=BINS)]).astype(float)

    counts = summed(table, 2 * BINS, add)
    p, u = (np.cumsum(c[::-1]) for c in (counts[:BINS], counts[BINS:]))
    n_p, n_u = max(p[-1], 1), max(u[-1], 1)
    p, u = p / n_p, u / n_u
    error = lambda share, n: np.sqrt(share * (1 - share) / n) + 1 / n
    floor = np.maximum(p - error(p, n_p), 1e-9)
    wide = p >= 0.5
    at = np.argmin(np.where(wide, (u + error(u, n_u)) / floor, np.inf))
    return float(np.clip(u[at] / max(p[at], 1e-9), 0.01, 0.99))


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``id_col``, held_out, score (0 to 1) and predicted (1 from ``THRESHOLD`` on) of every document."""
    mark = tables_so_far()
    table = written(featured(docs, labels, id_col, text_col, label_col), "features")

    def moments(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
        return np.concatenate([[len(x), positive.sum()], x.sum(0), (x * x).sum(0)])

    m = summed(table, 2 + 2 * N_FEATURES, moments)
    n = max(m[0], 1)
    shift = m[2 : 2 + N_FEATURES] / n
    spread = np.sqrt(np.maximum(m[2 + N_FEATURES :] / n - shift * shift, 0))
    scale = np.where(spread > 1e-4, 1 / np.maximum(spread, 1e-4), 0)
    w, prior = np.zeros(N_FEATURES + 1), 0.5
    if m[1]:
        apart, _ = minimised(lambda v: Sums(table.where("half = 0"), v, shift, scale), telling_apart, w, APART_RIDGE)
        prior = estimated_prior(table.where("half = 1"), apart, shift, scale)
        w = weakest_ridge(lambda v: Sums(table, v, shift, scale), prior, w)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.frombuffer(b"".join(b.column(2).to_pylist()), "<f4").reshape(b.num_rows, N_FEATURES).astype(np.float64)
            s = 1 / (1 + np.exp(-np.clip(standard(x, shift, scale) @ w, -500, 500)))
            out = [b.column(0), pa.array(~b.column(1).to_numpy(zero_copy_only=False)), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32)), pa.array(np.full(len(s), prior))]
            yield pa.RecordBatch.from_arrays(out, names=[id_col, "held_out", "score", "predicted", "prior"])

    out = written(table.select("id", "train", "x").mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int, prior double"), "scores")
    removed(docs.sparkSession, mark, keep=[out])
    return out
