"""Hashed byte n-grams and small linear models, shared by the classifiers. Runs inside tasks, or on a bounded sample."""

from __future__ import annotations

import numpy as np

from . import shared

_ODD = np.uint64(0x9E3779B97F4A7C15)


def gram_ids(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    """A hashed id of `bits` bits for each n-byte gram (n up to 8) of data, A-Z lowered."""
    if len(data) < n:
        return np.zeros(0, np.int64)
    packed = shared._LOWER[data].astype(np.uint64)
    have = 1
    while have < n:  # grams of `have` bytes double, or grow by what is missing
        add = min(have, n - have)
        tail = packed[have: len(packed)] if add == have else packed[have: len(packed)] >> np.uint64(8 * (have - add))
        packed = (packed[: len(packed) - have] << np.uint64(8 * add)) | tail
        have += add
        packed = packed[: len(data) - have + 1]
    return ((mix_in(packed, n) * _ODD) >> np.uint64(64 - bits)).astype(np.int64)


def mix_in(packed: np.ndarray, n: int) -> np.ndarray:
    return packed ^ (packed >> np.uint64(29)) ^ np.uint64(n)


def text_grams(data: np.ndarray, off: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(gram ids, text index) of all n-grams inside the texts that off separates; none spans two texts."""
    ids = gram_ids(data[off[0]: off[-1]], n, bits)
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))
    if not len(ids):
        return ids, text[:0]
    inside = text[: len(ids)] == text[n - 1: n - 1 + len(ids)]
    return ids[inside], text[: len(ids)][inside]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float, steps: int = 400, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features, outputs) and intercepts of logistic regressions for targets y (rows, outputs) in [0, 1].

    Accelerated gradient descent with a step from the largest curvature; deterministic.
    """
    n, d = x.shape
    x, y = x.astype(np.float32, copy=False), y.astype(np.float32)
    weight = np.full(n, 1 / n) if weight is None else weight / weight.sum()
    weight = weight.astype(np.float32)
    v = np.ones(d + 1, np.float32)
    for _ in range(30):
        u = x @ v[:d] + v[d]
        v = np.append(x.T @ (weight * u), (weight * u).sum())
        top = np.linalg.norm(v) or 1.0
        v = v / top
    rate = 1 / (top / 4 + l2)
    rate, l2 = np.float32(rate), np.float32(l2)
    w = np.zeros((d + 1, y.shape[1]), np.float32)
    z, t = w.copy(), 1.0
    for _ in range(steps):
        e = (sigmoid(x @ z[:d] + z[d]) - y) * weight[:, None]
        g = np.vstack([x.T @ e + l2 * z[:d], e.sum(axis=0)])
        new = z - rate * g
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + np.float32((t - 1) / t2) * (new - w), new, t2
    return w[:d], w[d]
