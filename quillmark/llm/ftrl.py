"""Logistic regression over hashed features, trained by follow-the-regularised-leader with per-coordinate rates."""

from __future__ import annotations

import numpy as np


class Ftrl:
    """FTRL-proximal. l1 keeps weights of rare or uninformative features at exactly zero."""

    def __init__(self, size: int, alpha: float = 0.1, beta: float = 1.0, l1: float = 1.0, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)  # the last one is the bias, which has no penalty

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, self.l1)
        w = (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, at: np.ndarray, value: np.ndarray, label: float, weight: float = 1.0) -> None:
        at, value = np.append(at, len(self.z) - 1), np.append(value, 1.0)
        w = self.weights(at)
        g = (sigmoid(w @ value) - label) * value * weight
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g

    def dense(self) -> np.ndarray:
        """All weights as 32-bit floats, the bias last."""
        return self.weights(np.arange(len(self.z))).astype(np.float32)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60.0, 60.0)))


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of each row's values; rows are parted by offsets."""
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def distinct_per_row(feature: np.ndarray, row: np.ndarray, rows: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct features of each row with their counts: features, counts, row offsets."""
    key, count = np.unique((row.astype(np.int64) << bits) | feature, return_counts=True)
    offsets = np.searchsorted(key, np.arange(rows + 1, dtype=np.int64) << bits)
    return key & ((1 << bits) - 1), count, offsets
