"""Subword ids of whole texts, one distinct word at a time."""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterable

import numpy as np

#: Words that a worker remembers: those of late, and as many of before.
MOST_WORDS = 500_000
#: ASCII marks but the apostrophe, which may begin an ending.
MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words encoded in one string.
JOINED = 512


def _letters(word: str) -> bool:
    """Whether the tokenizer, too, sees nothing but letters: some fall into a letter and a mark."""
    return word.isalpha() and (word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha())


class WordIds:
    """Ids of a text as little-endian unsigned 32-bit bytes.

    Neither tokenizer joins what white space parts, so the ids of a text are those of its words in turn,
    and a word is encoded once while it is remembered. New words are encoded many to a string, which
    is cut where ids begin (``lead``: each word is encoded with the space before it) or end a word; where that doesn't give
    one piece for each word, each is encoded by itself.
    """

    def __init__(self, path: str, lead: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.lead = Tokenizer.from_file(path), lead
        if lead:
            self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        self.edge[[i for t, i in vocabulary.items() if (t.startswith("Ġ") if lead else t.endswith("</w>"))]] = True
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def _encoded(self, words: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(e.ids, "<u4") for e in found]

    def _single(self, words: list[bytes]) -> None:
        space = " " if self.lead else ""
        for w, ids in zip(words, self._encoded([space + w.decode("utf-8", "replace") for w in words])):
            self.known[w] = ids.tobytes()

    def _together(self, words: list[bytes]) -> None:
        for at in range(0, len(words), JOINED):
            some = words[at : at + JOINED]
            (ids,) = self._encoded([(" " if self.lead else "") + b" ".join(some).decode("utf-8", "replace")])
            edges = np.nonzero(self.edge[ids])[0]
            if self.lead:
                whole = len(edges) == len(some) and edges[0] == 0
                ends = [*edges[1:], len(ids)]
            else:
                whole = len(edges) == len(some) and edges[-1] == len(ids) - 1
                ends = edges + 1
            if not whole:
                self._single(some)
                continue
            data, start = ids.tobytes(), 0
            for w, end in zip(some, (4 * np.asarray(ends)).tolist()):
                self.known[w] = data[start:end]
                start = end

    def learn(self, words: set[bytes]) -> None:
        """Remember ``words``, which are all those of a text; its memory may begin anew."""
        new: Iterable[bytes] = words.difference(self.known)
        if len(self.known) + len(new) > MOST_WORDS:
            self.before, self.known, new = self.known, {}, words
        fresh = []
        for w in new:
            if (ids := self.before.get(w)) is None:
                fresh.append(w)
            else:
                self.known[w] = ids
        if self.lead:
            self._together(fresh)
        else:
            self._by_letters(fresh)

    def _by_letters(self, words: list[bytes]) -> None:
        """Only a word of letters alone is sure to be one piece before its subwords are found; ASCII marks after it are pieces of their own."""
        alone, rest, parted = [], [], []
        for w in words:
            stem = w.rstrip(MARKS)
            if not _letters(stem.decode("utf-8", "replace")):
                rest.append(w)
            elif len(stem) == len(w):
                alone.append(w)
            else:
                parted.append((w, stem, w[len(stem) :]))
        known = self.known
        self._together([*alone, *{s for _, s, _ in parted}.difference(known, alone)])
        self._single([*rest, *{m for _, _, m in parted}.difference(known, rest)])
        for w, stem, marks in parted:
            known[w] = known[stem] + known[marks]

    def of_words(self, words: list[bytes]) -> bytes:
        self.learn(set(words))
        return b"".join(map(self.known.__getitem__, words))

    def of_text(self, text: bytes) -> bytes:
        """bytes split at space and tab to carriage return alone."""
        return self.of_words(text.split())


_COPIES: dict[tuple[str, bool], WordIds] = {}


def word_ids(path: str, lead: bool = False) -> WordIds:
    """One copy for each worker process, which outlives its tasks."""
    if (path, lead) not in _COPIES:
        _COPIES[path, lead] = WordIds(path, lead)
    return _COPIES[path, lead]
