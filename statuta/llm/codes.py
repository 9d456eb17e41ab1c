"""Texts of one Arrow batch as code point arrays: the numpy helpers that the text operators share."""

from __future__ import annotations

import numpy as np


def joined(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """All texts in one string with a newline behind each, its code points, and where each text starts (one more at the end)."""
    whole = "\n".join(texts) + "\n" if texts else ""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return whole, np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32), starts


def mixed(x: np.ndarray) -> np.ndarray:
    """Well spread 64-bit values of ``x`` (a bijection)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def window_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of ``k`` neighbouring code points; equal runs have equal hashes wherever they stand."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mixed(codes.astype(np.uint64) + np.uint64(0x1234567)) * _powers(_BASE, len(codes)), out=sums[1:], dtype=np.uint64)
    back = _powers(pow(_BASE, -1, 1 << 64), n)
    return mixed((sums[k:] - sums[:n]) * back)


def _sliding(h: np.ndarray, w: int, f: np.ufunc) -> np.ndarray:
    """``f`` over each window of ``w`` values, by doubling."""
    out, have = h, 1
    while have < w:
        step = min(have, w - have)
        out = f(out[: len(out) - step], out[step:])
        have += step
    return out


def winnowed(h: np.ndarray, w: int) -> np.ndarray:
    """Positions of ``h`` that are the least of some window of ``w`` neighbours, every equal one included."""
    if len(h) < w:
        return np.zeros(0, np.int64)
    least = _sliding(h, w, np.minimum)
    edge = np.zeros(w - 1, h.dtype)
    greatest = _sliding(np.concatenate([edge, least, edge]), w, np.maximum)
    return np.flatnonzero(greatest == h)
