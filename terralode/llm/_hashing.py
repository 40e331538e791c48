"""Word hashes of many texts at once, with numpy. A word is a run of bytes other than the six ASCII white-space bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Texts are hashed in groups of about so many bytes.
CHUNK = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of MurmurHash3)."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


class Powers:
    """Powers of an odd base modulo 2**64, and of its inverse, as long as asked for."""

    def __init__(self, base: int = _BASE, inverse: int = _INVERSE) -> None:
        self.base, self.inverse, self.up, self.down = base, inverse, np.ones(1, U), np.ones(1, U)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", self.inverse)):
                powers = np.full(size, b, U)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))
        return self.up[:n], self.down[:n]


def hashed(texts: list[bytes | None], powers: Powers) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yields (index of the first text, hash of each word, where each text's words begin and end) for groups of texts."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size < CHUNK):
            size += len(texts[end] or b"") + 1
            end += 1
        group = [t or b"" for t in texts[at:end]]
        data = np.frombuffer(b" " + b" ".join(group) + b" ", np.uint8)
        up, down = powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, U)
        np.cumsum((data.astype(U) + U(1)) * up[1:], out=sums[1:])
        space = _SPACE[data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        starts, ends = edge[0::2], edge[1::2]
        words = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))
        begin = np.cumsum([1, *(len(t) + 1 for t in group)])
        yield at, words, np.searchsorted(starts, begin)
        at = end


def rolled(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words (by the run's first word)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    for j in range(k):
        out = out * U(0xD6E8FEB86659FD93) + words[j : j + n]
    return mix(out)
