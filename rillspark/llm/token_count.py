"""Token counts by a unigram segmentation whose work is shared along a trie.

The distinct pre-tokens of a stretch of documents are put in order and walked as a
trie, depth first: a prefix that several pre-tokens share gets its best forward score
once, and each terminal stores the number of tokens of its best segmentation.  The
documents then add up stored counts.  No row leaves its partition, so a hot word, key
or source costs nothing, and no state outlives a batch but a bounded memory of words.

The vocabulary is a public one and is never trained.  It has ranks in place of
probabilities; a piece at rank r gets the score ``-ln(r + 1)`` (Zipf's law, up to a
constant for each token that is added here as well).  A character in no piece falls back
to its UTF-8 bytes, one token each.  Ties go to the segmentation with fewer tokens.

Nulls and empty texts have no pre-tokens and no tokens.  A pre-token is a run of
``[^\\x20\\x09-\\x0D]``, with the vocabulary's word mark before it.
"""

from __future__ import annotations

import math
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rillspark.llm.common import sliced

MARK = "▁"
#: Distinct pre-tokens that a Python worker remembers; then it starts afresh.
KEPT_WORDS = 500_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def piece_scores(path: str) -> dict[str, float]:
    """Score of each piece; control, unknown and byte pieces have none of their own."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    size = math.log(sum(1 / (i + 1) for i in range(n)))
    return {sp.id_to_piece(i): -math.log(i + 1) - size for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}


def byte_score(scores: dict[str, float]) -> float:
    """Below every piece, so that a byte is used only where no piece fits."""
    return 2 * min(scores.values())


def terminal_counts(in_order: list[str], scores: dict[str, float]) -> list[int]:
    """Tokens of the best segmentation of each word of a sorted list.

    ``best`` and ``count`` hold the forward scores of the trie path of the word at hand;
    the next word keeps those of the prefix that it shares and extends them.
    """
    longest, low = max(map(len, scores)), byte_score(scores)
    get, out = scores.get, []
    best, count, before = [0.0], [0], ""
    for word in in_order:
        same = len(os.path.commonprefix((before, word)))
        del best[same + 1 :], count[same + 1 :]
        for end in range(same + 1, len(word) + 1):
            n_bytes = len(word[end - 1].encode("utf-8", "replace"))
            top, tokens = best[end - 1] + low * n_bytes, count[end - 1] + n_bytes
            for start in range(max(0, end - longest), end):
                s = get(word[start:end])
                if s is not None:
                    v, c = best[start] + s, count[start] + 1
                    if v > top or v == top and c < tokens:
                        top, tokens = v, c
            best.append(top)
            count.append(tokens)
        out.append(count[len(word)])
        before = word
    return out


SCHEMA = "n_pretokens long, n_tokens long"


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_pretokens and n_tokens of every row; repeated rows give repeated rows."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = piece_scores(path)
        known: dict[bytes, int] = {}
        for b in sliced(batches, text_col):
            per_doc = [Counter(t.encode("utf-8", "replace").split()) if t else Counter() for t in b.column(text_col).to_pylist()]
            if len(known) > KEPT_WORDS:
                known.clear()
            new = sorted({w for c in per_doc for w in c if w not in known}) if known else sorted(set().union(*per_doc))
            known.update(zip(new, terminal_counts([MARK + w.decode("utf-8", "replace") for w in new], scores), strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(id_col),
                    pa.array(np.array([c.total() for c in per_doc], dtype="i8")),
                    pa.array(np.array([sum(known[w] * n for w, n in c.items()) for c in per_doc], dtype="i8")),
                ],
                names=[id_col, "n_pretokens", "n_tokens"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {SCHEMA}")
