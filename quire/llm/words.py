"""Words of many texts at once, as numpy arrays of 64-bit hashes.

Texts are taken in slices of bounded size, so the memory of a task follows the longest text and not the batch.
Arithmetic is modulo 2^64; tables and multipliers are drawn once from a fixed seed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

SLICE_BYTES = 1 << 20
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P, _A, _B = (np.uint64(x) | np.uint64(1) for x in _RNG.integers(2**62, 2**63, 3, dtype=np.uint64))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def _inverse(a: np.uint64) -> np.uint64:
    return np.uint64(pow(int(a), -1, 1 << 64))


@dataclass
class Slice:
    """Some texts: ``h`` has a hash of every word, text j's words are ``h[first[j]:first[j + 1]]``."""

    rows: np.ndarray
    h: np.ndarray
    first: np.ndarray

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows)), np.diff(self.first))

    def left(self) -> np.ndarray:
        """Words from each word to the end of its text, itself included."""
        return np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.h))


def slices(texts: Iterable[str | None], lower: bool = False, most: int = SLICE_BYTES) -> Iterator[Slice]:
    """Hashes of the words of ``texts``, white space parting them; null texts have none."""
    held: list[bytes] = []
    rows: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        held.append((t or "").encode())
        rows.append(i)
        size += len(held[-1])
        if size >= most:
            yield _hashed(held, rows, lower)
            held, rows, size = [], [], 0
    if held:
        yield _hashed(held, rows, lower)


def _hashed(held: list[bytes], rows: list[int], lower: bool) -> Slice:
    ends = np.cumsum([len(b) + 1 for b in held])
    buf = np.frombuffer(b"\n".join(held) + b"\n", np.uint8)
    if lower:
        buf = _LOWER[buf]
    space = _IS_SPACE[buf]
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    stops = np.flatnonzero(space & np.concatenate(([False], ~space[:-1])))
    first = np.concatenate(([0], np.searchsorted(starts, ends)))
    if not len(starts):
        return Slice(np.array(rows), np.zeros(0, np.uint64), first)
    lengths = stops - starts
    at = np.cumsum(lengths) - lengths
    inside = np.arange(int(lengths.sum())) - np.repeat(at, lengths)
    values = _BYTE[buf[~space]] * _powers(_P, int(lengths.max()))[inside]
    return Slice(np.array(rows), mix(np.add.reduceat(values, at) + lengths.astype(np.uint64)), first)


class Rolling:
    """Hashes of any run of words of a slice, from prefix sums."""

    def __init__(self, h: np.ndarray, base: np.uint64 = _A):
        n = len(h) + 1
        self.back = _powers(_inverse(base), n)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * _powers(base, n)[: n - 1], dtype=np.uint64)))

    def runs(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.back[start] + (stop - start).astype(np.uint64))


def two_hashes(h: np.ndarray) -> tuple[Rolling, Rolling]:
    """Two independent ones: together 128 bits."""
    return Rolling(h, _A), Rolling(mix(h ^ np.uint64(0x9E3779B97F4A7C15)), _B)


def least_in(g: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost least value among ``g[i:i + width]`` for each i; ``len(g) - width + 1`` of them."""
    pos, span = np.arange(len(g)), 1
    while span * 2 <= width:
        a, b = pos[: len(pos) - span], pos[span:]
        pos = np.where(g[a] <= g[b], a, b)
        span *= 2
    if span < width:
        shift = width - span
        a, b = pos[: len(pos) - shift], pos[shift:]
        pos = np.where(g[a] <= g[b], a, b)
    return pos
