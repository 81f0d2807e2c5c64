"""op5 starts from counts of all training documents, long ones too."""

import random

import numpy as np

from rillspark.llm import lm_score


def test_every_training_document_counts(spark):
    r = random.Random(8)
    # 400 documents, some far longer than others; only those of one kind hold "zyx"
    texts = [" ".join(r.choices(["alpha", "beta", "gammas", "Deltas", "zyx" if i % 40 == 3 else "mu"], k=3000 if i % 40 == 3 else r.randint(0, 12))) for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    singles, pairs = lm_score.pair_counts(lm_score.blocks(docs, "doc_id", "text"))
    want, both = np.zeros(lm_score.CLASSES), np.zeros((lm_score.GROUPS, lm_score.GROUPS))
    for i, t in enumerate(texts):
        if not lm_score.held_out(i):
            seq = [lm_score.word_class(w) for w in [*t.lower().encode().split(), lm_score.END]]
            np.add.at(want, seq, 1)
            np.add.at(both, (np.array(seq[:-1], int) % lm_score.GROUPS, np.array(seq[1:], int) % lm_score.GROUPS), 1)
    assert (singles == want).all() and (pairs == both).all()
    assert singles[lm_score.word_class(b"zyx")] > 3000


def test_states_tell_groups_apart():
    pairs = np.zeros((4, 4))
    pairs[:2, :2], pairs[2:, 2:] = 1000, 1000  # words of two kinds that do not mix
    singles = np.zeros(lm_score.CLASSES)
    singles[:4] = 2000
    pi, a, e = lm_score.paired_model(singles, pairs, 2)
    assert np.allclose(pi, 0.5, atol=0.02) and a[0, 0] > 0.95 and a[1, 1] > 0.95
    assert np.allclose(a.sum(1), 1) and np.allclose(e.sum(0), 1) and max(e[0, 0], e[0, 1]) > 10 * min(e[0, 0], e[0, 1])
    nothing = lm_score.paired_model(np.zeros(lm_score.CLASSES), np.zeros((4, 4)))
    assert all(np.isfinite(x).all() for x in nothing)
