"""Rabin-Karp hashes of words in numpy: polynomials modulo 2^64 over random 64-bit word hashes."""

from __future__ import annotations

import numpy as np
import xxhash


class Rolling:
    """Hashes of any span of words from one running sum; the base is odd, so a span's place can be divided out."""

    def __init__(self, base: int):
        self.base = base | 1
        self.powers = self.inverse = np.ones(1, np.uint64)

    def sums(self, words: np.ndarray) -> np.ndarray:
        n = len(words)
        if n + 1 > len(self.powers):
            size = max(4096, 2 * (n + 1))
            self.powers, self.inverse = (
                np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (self.base, pow(self.base, -1, 1 << 64))
            )
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(words * self.powers[:n], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((sums[end] - sums[start]) * self.inverse[start])

    def windows(self, sums: np.ndarray, length: int) -> np.ndarray:
        return mixed((sums[length:] - sums[:-length]) * self.inverse[: len(sums) - length])


def mixed(hashes: np.ndarray) -> np.ndarray:
    """Spread the hash over all its bits."""
    hashes = (hashes ^ (hashes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    hashes = (hashes ^ (hashes >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return hashes ^ (hashes >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Two independent 64-bit hashes of each word."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), "<u8").reshape(-1, 2).astype(np.uint64)
