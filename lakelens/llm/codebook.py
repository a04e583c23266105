"""Token memo with vectorised expansion, shared by the text operators.

A text operator sees the same surface tokens again and again. ``Codebook`` keeps one small integer per
distinct token and, per integer, the list of ids it stands for (BPE ids, word ids, ...). A batch then costs one
dictionary lookup per token; everything after it is numpy. The memo is bounded: it is emptied when it exceeds
``limit`` tokens, so memory doesn't grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import numpy as np


class Codebook:
    """Maps tokens to codes; ``expand(new_tokens)`` returns one id sequence for each new token."""

    def __init__(self, expand: Callable[[list[str]], Sequence[Sequence[int]]], limit: int = 400_000):
        self.expand, self.limit = expand, limit
        self.reset()

    def reset(self) -> None:
        self.memo: dict[str, int] = {}
        self.starts = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def learn(self, tokens: Iterable[str]) -> None:
        fresh = list(set(tokens).difference(self.memo))
        if not fresh:
            return
        if len(self.memo) + len(fresh) > self.limit and self.memo:
            self.reset()
            fresh = list(set(tokens))
        ids = self.expand(fresh)
        base = len(self.memo)
        self.memo.update(zip(fresh, range(base, base + len(fresh))))
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for row in ids for i in row), np.int32, int(counts.sum()))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.flat = np.concatenate([self.flat, flat])

    def ids(self, tokens: list[str], per_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all tokens in order, and how many of them each document has."""
        self.learn(tokens)
        codes = np.fromiter(map(self.memo.__getitem__, tokens), np.int64, len(tokens))
        counts = self.counts[codes]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.starts[codes] - (ends - counts), counts) + np.arange(total)
        before = np.concatenate([[0], ends])
        bounds = np.concatenate([[0], np.cumsum(per_doc)])
        return self.flat[at], np.diff(before[bounds])


def slices(texts: list[str | None], chars: int = 2_000_000) -> Iterable[tuple[int, int]]:
    """Consecutive ranges of ``texts`` of about ``chars`` characters each; a longer text is a range of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
