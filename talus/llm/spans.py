"""Arrays of words: starts, ends and rolling hashes of word k-mers, and least k-mers of sliding windows."""

from __future__ import annotations

import numpy as np

_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_LETTERS = mixed(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_BASE, _STEP = 0xD6E8FEB86659FD93, 1 << 12
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** i mod 2 ** 64."""
    own = _powers.get(base)
    if own is None or len(own) < n:
        size = 1 << max(12, (n - 1).bit_length())
        own = np.full(size, base, np.uint64)
        own[0] = 1
        own = _powers[base] = np.multiply.accumulate(own)
    return own[:n]


class Words:
    """text: words with one space between them."""

    def __init__(self, text: bytes):
        self.text = text
        raw = np.frombuffer(text, np.uint8)
        gaps = np.flatnonzero(raw == 32)
        self.n = len(gaps) + 1 if text else 0
        self.starts = np.concatenate([[0], gaps + 1])[: self.n]
        self.ends = np.concatenate([gaps, [len(raw)]])[: self.n]
        self._sums: np.ndarray | None = None

    def kmers(self, k: int) -> np.ndarray:
        """A hash of the bytes of each run of k words."""
        if self.n < k:
            return np.zeros(0, np.uint64)
        if self._sums is None:
            raw = np.frombuffer(self.text, np.uint8)
            sums = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(_LETTERS[raw] * powers(_BASE, len(raw)), out=sums[1:])
            self._sums = sums
        s, e = self.starts[: self.n - k + 1], self.ends[k - 1 :]
        return mixed((self._sums[e] - self._sums[s]) * powers(_INVERSE, len(self.text) + 1)[s] + (e - s).astype(np.uint64))

    def bytes_of(self, first: int, last: int) -> bytes:
        """Words first to last, exclusive."""
        return self.text[self.starts[first] : self.ends[last - 1]]


def least(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of width, the place of its least value, the first of equals."""
    return np.lib.stride_tricks.sliding_window_view(h, width).argmin(axis=1) + np.arange(len(h) - width + 1)
