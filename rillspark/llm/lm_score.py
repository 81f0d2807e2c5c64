"""Scores of texts under a hidden Markov model over word endings and words.

A latent state emits the class of a word, the hash of its last characters among ``CLASSES``;
the class emits the word by its smoothed count.  The document's end is a token with a class
of its own.  Transitions and emissions of classes are trained by Baum-Welch: each task adds
up the expected counts of its documents, and Spark sums them over all tasks; ``ROUNDS`` rounds
go over every training document.  They start from a model of pairs: how often each class, and each
pair of neighbouring groups of classes (``GROUPS`` of them), stands in all training documents is
counted in Spark, and the states are fitted to that table of fixed size.  No document is left out.

Both recursions are exact over whole documents.  A document is read in stretches of ``STRETCH``
tokens that advance together; what a stretch makes of each state before it is a small matrix,
and these matrices carry the forward and the backward message over every boundary.

One scan turns documents into blocks of bounded size: a block's distinct words and its
documents as numbers of those words.  Counts are summed by word over all blocks, one row for each
word and block, and sent back to the blocks that hold the word; no row is made for a token, and no
vocabulary is ever held in one place.

Tokens are words ``[^\\x20\\x09-\\x0D]+``, A-Z lowered, then one end.  Null and empty texts have
the end alone.  Training leaves out documents whose crc32(id as text) is 0 modulo 10 (a null
id is taken as the empty text).  Repeated rows are separate documents.  Other columns are not read.
No documents give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillspark.llm.common import sliced, words
from rillspark.session import written

STATES, CLASSES, ROUNDS, STRETCH = 5, 2048, 2, 1024
GROUPS, PAIR_ROUNDS = 512, 100
END = b"\n"  # no word holds white space
BLOCK_BYTES = 6_000_000
#: Tokens whose expected counts are made together, which bounds the memory of a step.
TOGETHER = 200_000
DELTA, SEED = 0.1, 20240807


def held_out(key) -> bool:
    return zlib.crc32(("" if key is None else str(key)).encode()) % 10 == 0


def word_class(word: bytes) -> int:
    """0 for the end; else by the last three characters."""
    return 0 if word == END else 1 + zlib.crc32(word.decode("utf-8", "replace")[-3:].encode()) % (CLASSES - 1)


# -- blocks -------------------------------------------------------------------------------


def blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of about ``BLOCK_BYTES`` of text: block, ids, lengths, tokens (numbers of words), words and their training counts."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32  # the table is written, so a number need only be unique
        for k, b in enumerate(sliced(batches, text_col, BLOCK_BYTES)):
            known: dict[bytes, int] = {END: 0}
            ids, tokens, lengths = b.column(id_col).to_pylist(), [], []
            for t in b.column(text_col).to_pylist():
                w = words(t)
                w.append(END)
                for x in w:
                    if x not in known:
                        known[x] = len(known)
                tokens.append(np.fromiter(map(known.__getitem__, w), np.int32, len(w)))
                lengths.append(len(w))
            train = np.repeat(np.array([not held_out(i) for i in ids]), lengths)
            flat = np.concatenate(tokens)
            counts = np.bincount(flat[train], minlength=len(known))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part + k], pa.int64()),
                    pa.array([ids], pa.list_(b.column(id_col).type)),
                    pa.array([lengths], pa.list_(pa.int32())),
                    pa.array([flat.tobytes()], pa.binary()),
                    pa.array([list(known)], pa.list_(pa.binary())),
                    pa.array([counts.tolist()], pa.list_(pa.int64())),
                    pa.array([[word_class(x) for x in known]], pa.list_(pa.int32())),
                ],
                names=["block", "ids", "lengths", "tokens", "words", "counts", "classes"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, f"block long, ids array<{kind}>, lengths array<int>, tokens binary, words array<binary>, counts array<long>, classes array<int>")


def _sequences(row: pa.RecordBatch) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """ids, lengths, tokens and the class of each word, of a one-row batch."""
    get = lambda c: row.column(c)[0]
    return get("ids").as_py(), get("lengths").values.to_numpy(), np.frombuffer(get("tokens").as_buffer(), np.int32), get("classes").values.to_numpy()


def stretches(lengths: np.ndarray, size: int = STRETCH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first token, tokens) of the stretches of sequences that lie one after the other."""
    n = -(-lengths // size)
    doc = np.repeat(np.arange(len(lengths)), n)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    start = (np.cumsum(lengths) - lengths)[doc] + k * size
    return doc, start, np.minimum(lengths[doc] - k * size, size)


# -- the model ----------------------------------------------------------------------------


def first_model(states: int = STATES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r = np.random.default_rng(SEED)
    a = np.full((states, states), 0.3 / states) + np.eye(states) * 0.7
    e = r.random((CLASSES, states)) + 0.5
    return np.full(states, 1 / states), a / a.sum(1, keepdims=True), e / e.sum(0)


def _active(size: np.ndarray) -> np.ndarray:
    """How many of stretches, longest first, are still running at each step."""
    return np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), side="right")


def _carried(seq: np.ndarray, start: np.ndarray, size: np.ndarray, before: np.ndarray, model, opens: bool) -> tuple[np.ndarray, np.ndarray]:
    """What stretches make of row vectors (stretches x vectors x states), scaled, and the logs of the scales.

    With ``opens`` a vector is the distribution of the first state itself.
    """
    _, a, e = model
    order = np.argsort(-size, kind="stable")
    m, logs = before[order], np.zeros(len(order))
    for t, n in enumerate(_active(size[order])):
        b = e[seq[start[order[:n]] + t]][:, None, :]
        now = (m[:n] if opens and t == 0 else m[:n] @ a) * b
        scale = now.max((1, 2))
        m[:n] = now / scale[:, None, None]
        logs[:n] += np.log(scale)
    back = np.argsort(order)
    return m[back], logs[back]


def _messages(seq: np.ndarray, lengths: np.ndarray, model, size_of: int):
    """The stretches, the state distribution before each (of its first token, or of the token before
    it), the backward message at its end, and the log-probability of each sequence."""
    pi, _, _ = model
    k = len(pi)
    doc, start, size = stretches(lengths, size_of)
    first = np.r_[True, doc[1:] != doc[:-1]]
    nth = np.arange(len(doc)) - np.maximum.accumulate(np.where(first, np.arange(len(doc)), 0))
    before, after = np.tile(pi, (len(doc), 1)), np.ones((len(doc), k))
    heads, later = np.flatnonzero(first), np.flatnonzero(~first)
    m, logs = _carried(seq, start[heads], size[heads], np.broadcast_to(pi, (len(heads), 1, k)).copy(), model, True)
    ends, total = m[:, 0] / m[:, 0].sum(1, keepdims=True), logs + np.log(m[:, 0].sum(1))
    if len(later):
        m, logs = _carried(seq, start[later], size[later], np.broadcast_to(np.eye(k), (len(later), k, k)).copy(), model, False)
        depth = nth[later]
        by_depth = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[by_depth], np.arange(1, int(depth.max()) + 2))
        groups = [by_depth[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        for at in groups:
            d = doc[later[at]]
            before[later[at]] = ends[d]
            v = np.einsum("nk,nkj->nj", ends[d], m[at])
            scale = v.sum(1)
            ends[d] = v / scale[:, None]
            total[d] += logs[at] + np.log(scale)
        for at in reversed(groups):
            v = np.einsum("nkj,nj->nk", m[at], after[later[at]])
            after[later[at] - 1] = v / v.max(1, keepdims=True)
    return start, size, first, before, after, total


def expected(seq: np.ndarray, lengths: np.ndarray, model, size_of: int = STRETCH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of first states, transitions and emissions over whole class sequences.

    Stretches advance together, longest first, so that those still running are a prefix; about
    ``TOGETHER`` tokens of them are worked on at a time, whatever the length of a sequence.
    """
    pi, a, e = model
    start, size, first, before, after, _ = _messages(seq, lengths, model, size_of)
    firsts, trans, out = np.zeros_like(pi), np.zeros_like(a), np.zeros_like(e)
    group = np.cumsum(size) // TOGETHER
    for some in np.split(np.arange(len(size)), np.flatnonzero(np.diff(group)) + 1):
        some = some[np.argsort(-size[some], kind="stable")]
        s, is_first, active = start[some], first[some], _active(size[some])
        alphas, scales, emits = [], [], []
        now = None
        for t, n in enumerate(active):
            b = e[seq[s[:n] + t]]
            now = (np.where(is_first[:, None], before[some], before[some] @ a) if t == 0 else now[:n] @ a) * b
            scale = now.sum(1, keepdims=True)
            now = now / scale
            alphas.append(now)
            scales.append(scale)
            emits.append(b)
        gammas, beta = [None] * len(active), np.empty((0, len(pi)))
        for t in range(len(active) - 1, -1, -1):
            n = active[t]
            if len(beta) < n:  # stretches that end here
                ending = slice(len(beta), n)
                last = after[some[ending]]
                beta = np.vstack([beta, last / (alphas[t][ending] * last).sum(1, keepdims=True)])
            gammas[t] = alphas[t] * beta
            back = beta * emits[t] / scales[t]
            if t:
                trans += alphas[t - 1][:n].T @ back
                beta = back @ a.T
            else:
                trans += before[some[~is_first]].T @ back[~is_first]
        firsts += gammas[0][is_first].sum(0)
        where = np.concatenate([seq[s[:n] + t] for t, n in enumerate(active)])
        g = np.concatenate(gammas)
        for k in range(len(pi)):
            out[:, k] += np.bincount(where, g[:, k], minlength=CLASSES)
    return firsts, trans * a, out


def from_counts(firsts: np.ndarray, trans: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pi, a, e = firsts + DELTA, trans + DELTA, out + DELTA
    return pi / pi.sum(), a / a.sum(1, keepdims=True), e / e.sum(0)


def log_likelihoods(seq: np.ndarray, lengths: np.ndarray, model, size_of: int = STRETCH) -> np.ndarray:
    """Natural log-probability of each whole class sequence: exact, by scaled forward recursion."""
    return _messages(seq, lengths, model, size_of)[-1]


def pair_counts(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How often each class, and each pair of groups of neighbouring tokens, stands in the training documents of a block table."""
    cells = GROUPS * GROUPS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(cells + CLASSES, np.int64)
        for b in batches:
            for i in range(b.num_rows):
                ids, lengths, tokens, classes = _sequences(b.slice(i, 1))
                seq = classes[tokens]
                train = np.repeat(np.array([not held_out(x) for x in ids]), lengths)
                follows = train.copy()
                follows[np.cumsum(lengths) - lengths] = False
                at = np.flatnonzero(follows)
                sums[:cells] += np.bincount((seq[at - 1] % GROUPS) * GROUPS + seq[at] % GROUPS, minlength=cells)
                sums[cells:] += np.bincount(seq[train], minlength=CLASSES)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["at", "n"])

    # at most groups^2 + classes sums, whatever the corpus
    got = table.select("ids", "lengths", "tokens", "classes").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    flat = np.zeros(cells + CLASSES)
    flat[got["at"].to_numpy(np.int64)] = got["n"].to_numpy()
    return flat[cells:], flat[:cells].reshape(GROUPS, GROUPS)


def paired_model(singles: np.ndarray, pairs: np.ndarray, states: int = STATES, rounds: int = PAIR_ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The model whose states best explain a table of neighbouring groups, by expectation and maximisation over the table.

    A class is dealt to the states as its group is, in proportion to its own count.
    """
    _, a, _ = first_model(states)
    e = (np.random.default_rng(SEED).random((len(pairs), states)) + 0.5) * (pairs.sum(0) + pairs.sum(1) + DELTA)[:, None]
    e, both = e / e.sum(0), a / states
    for _ in range(rounds):
        share = pairs / (e @ both @ e.T)
        new = both * (e.T @ share @ e) + DELTA
        e = e * (share @ e @ both.T + share.T @ e @ both) + DELTA
        e, both = e / e.sum(0), new / new.sum()
    pi = both.sum(1)
    of_group = e * pi
    of_group /= of_group.sum(1, keepdims=True)
    n = singles.sum()
    return from_counts(n * pi, n * both, singles[:, None] * of_group[np.arange(CLASSES) % len(pairs)])


def trained(docs: DataFrame, table: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS):
    """The model after Baum-Welch over the training documents of a block table."""
    model = paired_model(*pair_counts(table))
    k = len(model[0])
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            sums = None
            for b in batches:
                for i in range(b.num_rows):
                    ids, lengths, tokens, classes = _sequences(b.slice(i, 1))
                    train = np.array([not held_out(x) for x in ids])
                    if not train.any():
                        continue
                    part = expected(classes[tokens][np.repeat(train, lengths)], lengths[train], model)
                    sums = part if sums is None else tuple(x + y for x, y in zip(sums, part, strict=True))
            if sums is not None:
                flat = np.concatenate([x.ravel() for x in sums])
                at = np.flatnonzero(flat > 1e-9)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], names=["at", "n"])

        # at most states + states^2 + states * classes sums, whatever the corpus
        got = table.select("ids", "lengths", "tokens", "classes").mapInArrow(run, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
        flat = np.zeros(k + k * k + k * CLASSES)
        flat[got["at"].to_numpy(np.int64)] = got["n"].to_numpy()
        model = from_counts(flat[:k], flat[k : k + k * k].reshape(k, k), flat[k + k * k :].reshape(CLASSES, k))
    return model


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    table = written(blocks(docs, id_col, text_col), "blocks")
    model = trained(docs, table, id_col, text_col)
    # a block has one row for each of its words, so a frequent word has no more rows than there are blocks
    pairs = table.select("block", F.posexplode(F.arrays_zip("words", "counts", "classes")).alias("place", "w")).select("block", "place", F.col("w.words").alias("word"), F.col("w.counts").alias("n"), F.col("w.classes").alias("class"))
    of_word = Window.partitionBy("word")
    summed = pairs.select("block", "place", F.sum("n").over(of_word).alias("c"), F.when(F.col("block") == F.min("block").over(of_word), F.col("class")).alias("class")).where("c > 0")
    # the class stands at one row of each word, for the statistics of classes
    back = written(summed.groupBy("block").agg(F.collect_list(F.struct("place", "c", "class")).alias("known")), "counts", drop_shuffles=True)
    by_class = np.zeros((2, CLASSES))
    for r in back.select(F.inline("known")).where("class is not null").groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():  # one row for each class
        by_class[:, r["class"]] = r["c"], r["v"]
    n_all, v_all = int(by_class[0].sum()), int(by_class[1].sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                ids, lengths, tokens, classes = _sequences(row)
                c = np.zeros(len(classes))
                got = row.column("known")[0]
                if got.is_valid and len(got):
                    c[got.values.field("place").to_numpy()] = got.values.field("c").to_numpy()
                base = np.log10((c + DELTA) / (n_all + DELTA * (v_all + 1)))
                inside = np.log10((c + DELTA) / (by_class[0][classes] + DELTA * (by_class[1][classes] + 1)))
                first = np.cumsum(lengths) - lengths
                over = lambda x: np.add.reduceat(x[tokens], first)  # noqa: B023, E731
                score = log_likelihoods(classes[tokens], lengths, model) / np.log(10) + over(inside)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, row.column("ids").type.value_type),
                        pa.array([held_out(x) for x in ids]),
                        pa.array(lengths.astype(np.int64)),
                        pa.array(over((c > 0).astype(np.int64))),
                        pa.array(np.full(len(ids), n_all)),
                        pa.array(over(base)),
                        pa.array(score),
                    ],
                    names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    schema = f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    both = table.select("block", "ids", "lengths", "tokens", "classes").join(back, "block", "left")
    return both.select("ids", "lengths", "tokens", "classes", F.expr("transform(known, x -> struct(x.place, x.c))").alias("known")).mapInArrow(run, schema)
