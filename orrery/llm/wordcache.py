"""A bounded per-process store of per-word id lists, so that a batch of texts becomes flat id arrays by gathers."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places starts[i], starts[i] + 1, ... (lengths[i] of them) for all i, one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


class WordIds(dict):
    """Word -> code; ids of code c are flat[start[c]:start[c + 1]]. New words are encoded together: `encode` gives flat
    ids and lengths. `split` may give two parts of a word whose ids follow each other; they are stored once."""

    def __init__(self, encode: Callable[[list], tuple[np.ndarray, np.ndarray]], limit: int = 200_000, split: Callable | None = None):
        super().__init__()
        self.encode, self.limit, self.split = encode, limit, split
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.words: list = []
        self.word_codes: list[int] = []
        self.joined: list[tuple[int, int, int]] = []
        self.flat, self.start = np.empty(0, np.int32), np.zeros(1, np.int64)

    def __missing__(self, word) -> int:
        parts = self.split(word) if self.split else None
        if parts:
            a, b = self[parts[0]], self[parts[1]]
            self[word] = code = len(self)
            self.joined.append((code, a, b))
        else:
            self[word] = code = len(self)
            self.words.append(word)
            self.word_codes.append(code)
        return code

    def flush(self) -> None:
        """Encode what has come in since the last time."""
        new, lengths = self.encode(self.words)
        old, n = len(self.start) - 1, len(self)
        size = np.zeros(n - old, np.int64)
        at = np.array(self.word_codes, np.int64) - old
        size[at] = lengths
        j = np.array(self.joined, np.int64).reshape(-1, 3)
        length = lambda c: np.where(c < old, np.diff(self.start)[np.minimum(c, max(0, old - 1))] if old else 0, size[np.maximum(c - old, 0)])
        first, second = length(j[:, 1]), length(j[:, 2])
        size[j[:, 0] - old] = first + second
        start = np.concatenate((self.start, self.start[-1] + np.cumsum(size)))
        flat = np.empty(int(start[-1]), np.int32)
        flat[: len(self.flat)] = self.flat
        flat[spans(start[at + old], lengths)] = new
        flat[spans(start[j[:, 0]], first)] = flat[spans(start[j[:, 1]], first)]
        flat[spans(start[j[:, 0]] + first, second)] = flat[spans(start[j[:, 2]], second)]
        self.flat, self.start, self.words, self.word_codes, self.joined = flat, start, [], [], []

    def ids(self, docs: list[list]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all docs (lists of words) in one array, and the bounds of each doc in it."""
        if len(self) > self.limit:
            self.reset()
        codes = np.fromiter(map(self.__getitem__, chain.from_iterable(docs)), np.int64, sum(map(len, docs)))
        if self.words or self.joined:
            self.flush()
        first = self.start[codes]
        n = self.start[codes + 1] - first
        flat = self.flat[spans(first, n)]
        words = np.cumsum([0, *map(len, docs)])
        return flat, np.concatenate(([0], np.cumsum(n)))[words]
