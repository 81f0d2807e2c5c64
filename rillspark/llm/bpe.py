"""Ids of a public byte-level BPE vocabulary, from the tokenizers library.

The pre-tokenizer of that vocabulary starts a new pre-token at a blank, and at a newline,
that stands between two characters that are not white space; it never looks back.  So a
text may be cut before each of them, each distinct part encoded once, and the joined ids
are those of the whole text.  A text in which other white space touches white space is cut more
carefully, and one that holds a special string of the vocabulary is encoded as one.

Parts have numbers.  Their ids stand one after the other in one flat array, so a batch of
texts is one look-up for each part and one gather.  A word with punctuation behind
it takes its ids from those of the word and those of the punctuation: a run of letters and a
run of punctuation are always pre-tokens of their own.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct parts, and characters of long ones, kept by a Python worker; beyond that the memory starts afresh.
KEPT_PARTS, KEPT_CHARS = 1_000_000, 50_000_000
#: A word of Latin letters, which are letters in every version of Unicode, and punctuation behind it; no
#: apostrophe, as some endings with one are pre-tokens.
WORD = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]+)([*$%&#.,;:!?|<>\")\]]*)").fullmatch
#: Characters of parts that are encoded together.
JOINED = 4000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Numbers(dict):
    """Numbers of keys in the order in which they come up; new keys are listed in ``fresh``."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        self.fresh.append(key)
        return n


class Growing:
    """A numpy array that is appended to."""

    def __init__(self, kind: str):
        self.data, self.n = np.empty(1 << 16, kind), 0

    def add(self, more: np.ndarray) -> None:
        need = self.n + len(more)
        if need > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.empty(max(need, self.n), self.data.dtype)])
        self.data[self.n : need] = more
        self.n = need


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all spans, one span after the other."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class PartEncoder:
    """Keys of parts: ``word`` is a part with a blank before it, a part that starts with a newline
    stands for itself, and `` text`` (a blank first) is a text as it is, encoded by itself."""

    def __init__(self, path: str, kept: int = KEPT_PARTS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.kept = kept
        #: In a byte-level vocabulary each character of a token's name is one byte.
        self.n_bytes = np.array([len(self.tok.id_to_token(i) or "") for i in range(self.tok.get_vocab_size())])
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.chars = Numbers(), 0
        self.ids, self.starts, self.lengths, self.odd = Growing("<u4"), Growing("i8"), Growing("i8"), Growing("?")

    def _learn(self) -> None:
        """Ids of the parts that have come up since the last call."""
        fresh, first = self.numbers.fresh, self.starts.n
        numbers = self.numbers
        joined, alone, made = [], [], []
        odd = []
        # the list grows while it is read: a word, and what stands behind it, may be new parts themselves
        for i, key in enumerate(fresh):
            n = first + i
            if m := WORD(key):
                if m[2]:
                    made.append((n, numbers[m[1]], numbers[" " + m[2]]))
                else:
                    joined.append((n, " " + key))
            elif key[:1] == " ":
                alone.append((n, key[1:]))
                self.chars += len(key)
            elif not key or key[-1].isspace() or key[0].isspace() and (key[0] != "\n" or key[1].isspace()):
                odd.append(n)
            else:
                joined.append((n, key if key[0] == "\n" else " " + key))
        total = len(fresh)
        fresh.clear()
        starts, lengths, is_odd = np.zeros(total, "i8"), np.zeros(total, "i8"), np.zeros(total, bool)
        is_odd[np.array(odd, "i8") - first] = True

        def add(which: list[int], ids: np.ndarray, sizes: np.ndarray) -> None:
            at = np.array(which, "i8") - first
            starts[at], lengths[at] = self.ids.n + np.cumsum(sizes) - sizes, sizes
            self.ids.add(ids)

        if alone:
            ids = [np.array(e.ids, "<u4") for e in self.tok.encode_batch_fast([t for _, t in alone], add_special_tokens=False)]
            add([n for n, _ in alone], np.concatenate(ids), np.array([len(x) for x in ids]))
        if joined:
            texts, at, size = [], 0, 0
            for i, (_, t) in enumerate(joined):
                size += len(t)
                if size >= JOINED or i + 1 == len(joined):
                    texts.append("".join(x for _, x in joined[at : i + 1]))
                    at, size = i + 1, 0
            ids = np.concatenate([np.array(e.ids, "<u4") for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)])
            # each id stands for a known number of bytes, so their running sum tells where parts end
            until = np.searchsorted(np.cumsum(self.n_bytes[ids]), np.cumsum([len(t) if t.isascii() else len(t.encode()) for _, t in joined])) + 1
            add([n for n, _ in joined], ids, np.diff(until, prepend=0))
        self.starts.add(starts)
        self.lengths.add(lengths)
        self.odd.add(is_odd)
        if made:
            which = np.array(made, "i8")
            pairs = which[:, 1:].ravel()
            sizes = self.lengths.data[pairs]
            both = self.ids.data[spans(self.starts.data[pairs], sizes)]
            total_of = sizes.reshape(-1, 2).sum(1)
            self.starts.data[which[:, 0]], self.lengths.data[which[:, 0]] = self.ids.n + np.cumsum(total_of) - total_of, total_of
            self.ids.add(both)

    def _numbered(self, keys: list[str]) -> np.ndarray:
        return np.fromiter(map(self.numbers.__getitem__, keys), np.int64, len(keys))

    def encode(self, texts: pa.Array | Iterable[str | None], end: int) -> tuple[np.ndarray, np.ndarray]:
        """The unsigned 32-bit ids of all texts, each with ``end`` behind it, and how many each has.

        Cutting and finding the distinct parts of the batch is Arrow's work; only those are looked up.
        """
        if len(self.numbers) > self.kept or self.chars > KEPT_CHARS:
            self._forget()
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        n = len(texts)
        if not n:
            return np.zeros(0, "<u4"), np.zeros(0, "i8")
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        offsets, parts = lists.offsets.to_numpy(), lists.flatten()
        distinct = parts.dictionary_encode()
        heads = parts.take(pa.array(offsets[:-1])).to_pylist()
        # one text of all distinct parts, as none holds a blank: made into Python's strings at once
        whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(distinct.dictionary)], pa.int32()), distinct.dictionary), " ")
        own = self._numbered(whole[0].as_py().split(" "))
        first = self._numbered([" " + h for h in heads])
        self._learn()
        which = own[distinct.indices.to_numpy()]
        odd = self.odd.data[which]
        odd[offsets[:-1]] = False  # a head is encoded as it is
        keep = np.ones(len(which), bool)
        keep[offsets[:-1]] = [bool(h) for h in heads]
        which[offsets[:-1]] = first
        special = np.zeros(n, bool)
        for mark in self.special:
            special |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        apart = special | np.logical_or.reduceat(odd, offsets[:-1])
        counts = np.add.reduceat(keep.astype(np.int64), offsets[:-1])
        which = which[keep]
        if apart.any():
            found = np.split(which, np.cumsum(counts)[:-1])
            for i in np.flatnonzero(apart).tolist():
                t = texts[i].as_py()
                found[i] = self._numbered([" " + p for p in ([t] if special[i] else careful_parts(t))])
            counts = np.array([len(f) for f in found], "i8")
            which = np.concatenate(found)
            self._learn()
        sizes = self.lengths.data[which]
        ids = self.ids.data[spans(self.starts.data[which], sizes)]
        until = np.r_[0, np.cumsum(sizes)][np.cumsum(counts)]
        return np.insert(ids, until, np.uint32(end)), np.diff(until, prepend=0) + 1


def careful_parts(text: str) -> list[str]:
    """Parts of a text with runs of white space: no cut where white space is on both sides of the blank."""
    first, *rest = text.split(" ")
    parts, now = [], first
    for p in rest:
        if now and now[-1].isspace() and (not p or p[0].isspace()):
            now += " " + p
        else:
            parts.append(now)
            now = " " + p
    parts.append(now)
    return [p for p in parts if p]


_encoders: dict[str, PartEncoder] = {}


def encoder(path: str) -> PartEncoder:
    """One for each Python worker and vocabulary."""
    if path not in _encoders:
        _encoders[path] = PartEncoder(path)
    return _encoders[path]
