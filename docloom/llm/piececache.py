"""Ids of repeated text pieces: each distinct piece is encoded once by a worker, told apart by its 64-bit hash."""

from __future__ import annotations

import numpy as np
import pandas as pd

from .textarrays import code_points, span_hashes

#: Distinct pieces whose ids a Python worker keeps before it forgets the rare ones.
KEPT_PIECES = 250_000


class PieceCache:
    """Cuts texts into pieces with ``cuts`` and encodes new pieces with ``learn``; both come from a subclass.

    ``cuts(points, starts)`` marks the first code point of each piece; ``learn(pieces)`` gives the flat ids of
    strings and how many ids each has. Cuts must not change the ids of a text.
    """

    def __init__(self, dtype):
        self.slots: dict[int, int] = {}
        self.seen = np.zeros(0, np.int32)
        self.flat, self.at = np.zeros(0, dtype), np.zeros(1, np.int64)

    def cuts(self, points: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def forget(self) -> None:
        """Keeps the pieces that more than one run of texts had, or none if they are too many."""
        kept = np.flatnonzero(self.seen > 1)
        kept = kept if len(kept) <= KEPT_PIECES // 2 else kept[:0]
        n = self.at[kept + 1] - self.at[kept]
        at = np.concatenate(([0], np.cumsum(n)))
        self.flat = self.flat[np.arange(at[-1]) + np.repeat(self.at[kept] - at[:-1], n)]
        self.at = at
        names = np.fromiter(self.slots, np.uint64, len(self.slots))
        self.slots = {h: i for i, h in enumerate(names[kept].tolist())}
        self.seen = np.ones(len(kept), np.int32)

    def __call__(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts and where each text's start (n + 1 numbers); null is the empty text."""
        if len(self.slots) > KEPT_PIECES:
            self.forget()
        points, starts = code_points(texts)
        cuts = self.cuts(points)
        cuts[starts[:-1]] = True
        cuts[starts[1:] - 1] = True  # the line feed that ends each text
        first = np.flatnonzero(cuts)
        end = np.append(first[1:], len(points))[: len(first)]
        kept = ~np.isin(first, starts[1:] - 1)
        counts_at = np.concatenate(([0], np.cumsum(kept)))[np.searchsorted(first, starts)]
        first, end = first[kept], end[kept]
        codes, distinct = pd.factorize(span_hashes(points, first, end))
        _, where = np.unique(codes, return_index=True)
        known = len(self.slots)
        slot = np.fromiter((self.slots.setdefault(h, len(self.slots)) for h in distinct.tolist()), np.int64, len(distinct))
        new = np.flatnonzero(slot >= known)
        self.seen = np.concatenate((self.seen, np.zeros(len(new), np.int32)))
        self.seen[slot] += 1
        if len(new):
            a, b = first[where[new]], end[where[new]]
            ids, n = self.learn([points[i:j].tobytes().decode("utf-32-le", "surrogatepass") for i, j in zip(a.tolist(), b.tolist(), strict=True)])
            self.at = np.concatenate((self.at, self.at[-1] + np.cumsum(n)))
            self.flat = np.concatenate((self.flat, ids.astype(self.flat.dtype)))
        index = slot[codes]
        n = self.at[index + 1] - self.at[index]
        ends = np.zeros(len(index) + 1, np.int64)
        np.cumsum(n, out=ends[1:])
        ids = self.flat[np.arange(ends[-1]) + np.repeat(self.at[index] - ends[:-1], n)]
        return ids, ends[counts_at]
