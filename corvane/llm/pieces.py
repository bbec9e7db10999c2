"""Ids of words that were met before: a table in a worker, bounded, filled by the tokenizer."""

from __future__ import annotations

import numpy as np


class _Words(dict):
    """A word's number, in order of first sight; `new` are those without ids as yet."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Pieces:
    """Numbers of words and the ids of each, as the tokenizer gives them for `lead` + word between spaces.

    For tokenizers whose tokens don't go over a space, or begin with it: then a text's ids are those of
    its words, one after the other. A word that begins with white space, or an empty one, is marked as
    `odd`: what stands beside it decides, so its text must be encoded as a whole.
    """

    def __init__(self, tokenizer, lead: str = "", most: int = 1_200_000) -> None:
        self.tokenizer, self.lead, self.most = tokenizer, lead, most
        self.clear()

    def clear(self) -> None:
        self.words = _Words()
        self.flat, self.used = np.empty(1 << 20, np.uint16), 0
        self.offs, self.known = np.zeros(1 << 18, np.int64), 0
        self.odd: set[int] = set()

    def numbers(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The numbers of each list's words; after this their ids are known."""
        if len(self.words) > self.most:
            self.clear()
        look = self.words.__getitem__
        out = [np.fromiter(map(look, t), np.int32, len(t)) for t in texts]
        new, self.words.new = self.words.new, []
        for i in range(0, len(new), 128):
            self._learn(new[i : i + 128])
        return out

    def _learn(self, some: list[str]) -> None:
        self.odd.update(self.known + k for k, w in enumerate(some) if not w or w[0].isspace())
        if self.lead and self.odd and max(self.odd) >= self.known:  # an odd word would change its neighbours
            parts = [np.array(e.ids, np.uint16) for e in self.tokenizer.encode_batch_fast([self.lead + w for w in some], add_special_tokens=False)]
            ids, at = np.concatenate(parts), np.cumsum([len(p) for p in parts])
        else:
            done = self.tokenizer.encode(self.lead + " ".join(some), add_special_tokens=False)
            ids = np.array(done.ids, np.uint16)
            first = np.fromiter((a for a, _ in done.offsets), np.int64, len(ids))
            at = np.searchsorted(first, np.cumsum([len(w) + 1 for w in some]), "left")
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        if self.known + len(some) + 1 > len(self.offs):
            self.offs = np.concatenate([self.offs, np.zeros_like(self.offs)])
        self.offs[self.known + 1 : self.known + 1 + len(some)] = self.used + at
        self.used += len(ids)
        self.known += len(some)

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the numbered words, joined, and where each word's end among them."""
        size = (self.offs[1 : self.known + 1] - self.offs[: self.known])[numbers]
        last = np.cumsum(size)
        total = int(last[-1]) if len(last) else 0
        return self.flat[np.arange(total) + np.repeat(self.offs[numbers] - (last - size), size)], last
