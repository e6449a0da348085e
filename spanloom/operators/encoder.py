"""A small transformer encoder in numpy, to be run as a scorer: no dropout, any window length from 1."""

from __future__ import annotations

import math

import numpy as np

_erf = np.vectorize(math.erf, otypes=[float])


def rotated(x: np.ndarray) -> np.ndarray:
    """Rotary positions over the whole hidden size, before heads are split; angles grow with the pair's number."""
    n, dim = x.shape
    theta = 10000.0 ** (np.arange(dim // 2) * 2.0 / dim)
    angle = np.arange(n)[:, None] * theta[None, :]
    even, odd = x[:, 0::2], x[:, 1::2]
    out = np.empty_like(x, dtype=float)
    out[:, 0::2] = even * np.cos(angle) - odd * np.sin(angle)
    out[:, 1::2] = odd * np.cos(angle) + even * np.sin(angle)
    return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + _erf(x / math.sqrt(2)))


def normed(x: np.ndarray, weight: tuple | None = None, eps: float = 1e-5) -> np.ndarray:
    """Layer norm, with (scale, shift) if given."""
    found = (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + eps)
    return found if weight is None else found * weight[0] + weight[1]


def attention(x: np.ndarray, qkv: tuple, out: tuple, heads: int) -> np.ndarray:
    """Multi-head self-attention of (n, dim); ``qkv`` and ``out`` are (weight, bias)."""
    n, dim = x.shape
    q, k, v = np.split(x @ qkv[0] + qkv[1], 3, axis=-1)
    cut = lambda t: t.reshape(n, heads, dim // heads).transpose(1, 0, 2)
    q, k, v = cut(rotated(q)), cut(rotated(k)), cut(v)
    weights = softmax(q @ k.transpose(0, 2, 1) / math.sqrt(dim // heads))
    return (weights @ v).transpose(1, 0, 2).reshape(n, dim) @ out[0] + out[1]


def gated(x: np.ndarray, w: tuple) -> np.ndarray:
    gate, value = np.split(x @ w[0] + w[1], 2, axis=-1)
    return gelu(gate) * value


class Encoder:
    """Pre-norm layers with gated feed-forward parts, then one softmax classifier a head.

    Token ids take the branch through the frozen ``table`` (ids, dim) and a projection that starts as the identity; vectors pass it by.
    """

    def __init__(self, dim: int, labels: list[int], layers: int = 2, heads: int = 4, seed: int = 0, table: np.ndarray | None = None):
        if dim % heads or dim % 2:
            raise ValueError("the hidden size must be even and divisible by the heads")
        rng = np.random.default_rng(seed)
        lin = lambda a, b: (rng.normal(0, 1 / math.sqrt(a), (a, b)), np.zeros(b))
        self.dim, self.labels, self.heads, self.table = dim, labels, heads, table
        self.projection = (np.eye(dim), np.zeros(dim))
        norm = lambda n: (np.ones(n), np.zeros(n))
        self.layers = [
            {"qkv": lin(dim, 3 * dim), "out": lin(dim, dim), "up": lin(dim, 2 * dim), "gate": lin(2 * dim, 4 * dim), "down": lin(2 * dim, dim), "norms": (norm(dim), norm(dim))}
            for _ in range(layers)
        ]
        self.first = lin(dim, 2 * dim * len(labels))
        self.second = [lin(2 * dim, n) for n in labels]

    def hidden(self, x: np.ndarray) -> np.ndarray:
        for p in self.layers:
            x = x + attention(normed(x, p["norms"][0]), p["qkv"], p["out"], self.heads)
            x = x + gated(normed(x, p["norms"][1]) @ p["up"][0] + p["up"][1], p["gate"]) @ p["down"][0] + p["down"][1]
        return x

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """(n, dim) vectors, or n token ids, to (n, labels) confidences."""
        x = np.asarray(x)
        if x.ndim == 1:
            if self.table is None:
                raise ValueError("token ids need a table of vectors")
            x = self.table[x] @ self.projection[0] + self.projection[1]
        parts = np.split(gelu(self.hidden(x) @ self.first[0] + self.first[1]), len(self.labels), axis=-1)
        return np.hstack([softmax(normed(h) @ w + b) for h, (w, b) in zip(parts, self.second)])
