"""A linear-chain conditional random field in numpy: training on padded batches and Viterbi decoding."""

from __future__ import annotations

import numpy as np


class Crf:
    """Emissions are sums of weights of hashed features; transitions are a label-by-label matrix."""

    def __init__(self, n_features: int, n_labels: int):
        self.emit = np.zeros((n_features, n_labels))
        self.move = np.zeros((n_labels, n_labels))

    def _scores(self, features: np.ndarray) -> np.ndarray:
        """features: [..., k] feature numbers; the sum of their weights for every label."""
        return self.emit[features].sum(-2)

    def fit(self, features: np.ndarray, labels: np.ndarray, lengths: np.ndarray, epochs: int = 120, rate: float = 0.1, l2: float = 1e-3) -> Crf:
        """Gradient ascent (Adam) on the regularised log-likelihood.

        features [n, t, k] and labels [n, t] are padded to the longest of ``lengths`` [n]. Without any
        sequence the weights stay zero.
        """
        n, t, k = features.shape
        if not n:
            return self
        size = len(self.move)
        inside = np.arange(t)[None] < lengths[:, None]
        gold = np.eye(size)[labels] * inside[..., None]
        pair_inside = inside[:, 1:]
        gold_move = np.einsum("nti,ntj->ij", gold[:, :-1], gold[:, 1:])
        memory = [[np.zeros_like(x), np.zeros_like(x)] for x in (self.emit, self.move)]
        for step in range(1, epochs + 1):
            score = self._scores(features)
            forward, backward = np.zeros((n, t, size)), np.zeros((n, t, size))
            forward[:, 0] = score[:, 0]
            for i in range(1, t):
                new = score[:, i] + np.logaddexp.reduce(forward[:, i - 1, :, None] + self.move, axis=1)
                forward[:, i] = np.where(inside[:, i, None], new, forward[:, i - 1])
            for i in range(t - 2, -1, -1):
                new = np.logaddexp.reduce(self.move + (score[:, i + 1] + backward[:, i + 1])[:, None], axis=2)
                backward[:, i] = np.where(inside[:, i + 1, None], new, 0)
            total = np.logaddexp.reduce(forward[:, -1], axis=1)[:, None]
            seen = np.exp(forward + backward - total[..., None]) * inside[..., None]
            pairs = forward[:, :-1, :, None] + self.move + (score[:, 1:] + backward[:, 1:])[:, :, None] - total[..., None, None]
            pairs = np.where(pair_inside[..., None, None], np.exp(np.minimum(pairs, 0)), 0)
            up = np.zeros_like(self.emit)
            np.add.at(up, features, np.broadcast_to((gold - seen)[:, :, None], (n, t, k, size)))
            grads = (up / n - l2 * self.emit, (gold_move - pairs.sum((0, 1))) / n - l2 * self.move)
            for weight, grad, (first, second) in zip((self.emit, self.move), grads, memory, strict=True):
                first += 0.1 * (grad - first)
                second += 0.001 * (grad**2 - second)
                weight += rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        return self

    def viterbi(self, features: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best labels [n, t] of padded sequences; ties go to the lower label."""
        n, t, _ = features.shape
        score = self._scores(features)
        best, back = score[:, 0], np.zeros((n, t, len(self.move)), np.int16)
        for i in range(1, t):
            ways = best[:, :, None] + self.move
            back[:, i] = ways.argmax(1)
            best = np.where((i < lengths)[:, None], ways.max(1) + score[:, i], best)
        labels = np.zeros((n, t), np.int16)
        at = best.argmax(1)
        for i in range(t - 1, -1, -1):
            labels[:, i] = at
            at = np.where(i < lengths, back[np.arange(n), i, at], at)
        return labels
