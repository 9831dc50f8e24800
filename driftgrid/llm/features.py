"""Hashed n-gram features over batches of texts, and a sparse softmax learner."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd

MIX = np.uint64(0x9E3779B97F4A7C15)
TOKEN = re.compile(r"\w+|[^\w\s]+")


def char_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts end to end (each lowered, white space runs as one space, a space at both ends), starts and ends."""
    clean = [" " + " ".join(t.lower().split()) + " " for t in texts]
    lengths = np.array([len(t) for t in clean], dtype=np.int64)
    points = np.frombuffer("".join(clean).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    ends = np.cumsum(lengths)
    return points, ends - lengths, ends


def char_codes(points: np.ndarray, ends: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Hashed code of the n-gram that starts at each position; 2^bits where it would cross a text's end."""
    n = len(points)
    code = np.full(n, order, dtype=np.uint64)
    for k in range(order):
        code[:n - k] = (code[:n - k] ^ points[k:]) * MIX
        code[:n - k] ^= code[:n - k] >> np.uint64(29)
    out = ((code * MIX) >> np.uint64(64 - bits)).astype(np.int64)
    for k in range(1, order):
        at = ends - k
        out[at[at >= 0]] = 1 << bits
    return out


def text_codes(text: str, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """Codes of all n-grams of one text."""
    points, _, ends = char_points([text])
    codes = np.concatenate([char_codes(points, ends, k, bits) for k in orders])
    return codes[codes < (1 << bits)]


def word_hashes(text: str) -> np.ndarray:
    """64-bit hash of each token (a word, or a run of marks) of the lowered text."""
    words = TOKEN.findall(text.lower())
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False) if words else np.zeros(0, dtype=np.uint64)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, width: int, passes: int = 3, alpha: float = 0.5,
         beta: float = 1.0, l1: float = 0.02, l2: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression by follow-the-regularised-leader with an elastic net; weights (width, classes) and biases.

    rows: (codes, values, class), in the order they are learned. The bias is not penalised.
    """
    z, n = np.zeros((width + 1, classes)), np.zeros((width + 1, classes))

    def weights(codes: np.ndarray) -> np.ndarray:
        zc = z[codes]
        lim = np.where(codes == width, 0.0, l1)[:, None]
        return np.where(np.abs(zc) <= lim, 0.0, -(zc - np.sign(zc) * lim) / ((beta + np.sqrt(n[codes])) / alpha + l2))

    for _ in range(passes):
        for codes, values, label in rows:
            codes, values = np.append(codes, width), np.append(values, 1.0)
            w = weights(codes)
            s = values @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[label] -= 1.0
            g = values[:, None] * p[None, :]
            g2 = g * g
            z[codes] += g - (np.sqrt(n[codes] + g2) - np.sqrt(n[codes])) / alpha * w
            n[codes] += g2
    every = np.arange(width + 1)
    w = weights(every)
    return w[:width], w[width]
