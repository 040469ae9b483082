"""Vectorised words and word-window fingerprints of a batch of texts.

A word is a maximal run of bytes other than space and 0x09-0x0D.  All work is
done on one concatenated byte buffer with numpy, so a batch costs a few passes
over its bytes and no Python loop over words.  Fingerprints are polynomials
modulo 2**64 over a fixed pseudo-random byte table, finished by a bit mixer; they
are made stretch by stretch, so that eight-byte numbers for each byte of a batch
are never held at once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

from .infra import working

U = np.uint64
_MULT = 0x9E3779B97F4A7C15 | 1
_ROUTES = {"byte": 0xD6E8FEB86659FD93, "win": 0xA0761D6478BD642F, "win2": 0xE7037ED1A0B428DB}
_pow_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Bytes of a stretch of words (a longer word is a stretch of its own); fingerprints don't depend on it.
STRETCH = 1 << 17


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply, xor-shift)."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * U(_MULT))
_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _pow_cache.get(base)
    working("words", _pow_cache.clear)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(base, -1, 1 << 64)
        both = []
        for b in (base, inverse):
            steps = np.full(size, b, dtype=np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        have = _pow_cache[base] = (both[0], both[1])
        if size > 1 << 23:  # one huge text must not pin its tables
            _pow_cache.pop(base)
    return have


class Words:
    """The words of a batch: fingerprint and document number of each, in order."""

    __slots__ = ("buf", "counts", "doc", "ends", "first", "hash", "starts")

    def __init__(self, texts: list[bytes], lower: bool = False):
        raw = b" ".join(texts) + b" "
        buf = np.frombuffer(raw, dtype=np.uint8)
        self.buf = raw
        sep = _SEP[buf]
        edge = np.flatnonzero(sep[1:] != sep[:-1]) + 1
        if len(buf) and not sep[0]:
            edge = np.concatenate(([0], edge))
        self.starts, self.ends = edge[0::2], edge[1::2]
        sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        upto = np.cumsum(sizes)
        self.doc = np.searchsorted(upto, self.starts, side="right").astype(np.int64)
        self.counts = np.bincount(self.doc, minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.counts)))
        self.hash = np.empty(len(self.starts), np.uint64)
        i = 0
        while i < len(self.starts):
            at = self.starts[i]
            j = max(i + 1, int(np.searchsorted(self.ends, at + STRETCH, side="right")))
            self.hash[i:j] = self._hashes(buf[at : self.ends[j - 1]], self.starts[i:j] - at, self.ends[i:j] - at, lower)
            i = j

    @staticmethod
    def _hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
        up, down = _powers(_ROUTES["byte"], len(buf) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(buf) + 1, dtype=np.uint64)
            np.cumsum(_TABLE[_LOWER[buf] if lower else buf] * up[: len(buf)], out=total[1:])
            return mix((total[ends] - total[starts]) * down[starts] + U(_MULT))

    def windows(self, k: int, route: str = "win") -> np.ndarray:
        """Fingerprint of the k words from each word on; only those of ``inside(k)`` mean anything."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, dtype=np.uint64)
        base = _ROUTES[route]
        with np.errstate(over="ignore"):
            h = self.hash if route == "win" else mix(self.hash + U(base))
            if k <= 8:
                out = h[: n - k + 1].copy()
                for j in range(1, k):
                    out *= U(base)
                    out += h[j : n - k + 1 + j]
                return mix(out)
            up, down = _powers(base, n + 1)
            total = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(h * up[:n], out=total[1:])
            return mix((total[k:] - total[:-k]) * down[: n - k + 1])

    def inside(self, k: int) -> np.ndarray:
        """For each window of ``windows(k)``: whether it lies in one document."""
        n = len(self.doc)
        return self.doc[: n - k + 1] == self.doc[k - 1 :] if n >= k else np.zeros(0, dtype=bool)


def chunks(texts: Iterable, most_bytes: int = 1 << 21) -> Iterator[tuple[int, list]]:
    """(index of the first, texts) so that each chunk has about most_bytes (of strings: characters); a longer text is a chunk of its own."""
    start, size, held = 0, 0, []
    for i, t in enumerate(texts):
        if held and size + len(t) > most_bytes:
            yield start, held
            start, size, held = i, 0, []
        held.append(t)
        size += len(t)
    if held:
        yield start, held
