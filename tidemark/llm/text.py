"""Vectorised splitting and hashing of many texts at once, on the byte buffers of Arrow columns.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D, which on UTF-8 are the words
`[^\\x20\\x09-\\x0D]+`. Byte ranges (words, lines) are hashed eight bytes a step with a mixing function
between steps; windows of words are hashed by mixing halves; neither has the algebraic collisions of
polynomials modulo 2**64. Hashes of arbitrary ranges (`RangeHash`) join such a polynomial with a second
one modulo the prime 2**31 - 1, so that strings that collide in the first differ in the second.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text that one vectorised step handles; a single longer text is handled alone.
STEP_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
WORD_BASE = 0xC2B2AE3D27D4EB4F | 1


PRIME = np.uint64((1 << 31) - 1)
PRIME_BASE = 0x3C6EF372
#: Longest sequence whose powers a worker keeps; longer ones are rare and computed each time.
KEPT = 1 << 21
#: Steps of eight bytes; what a range has beyond them is digested.
MOST_STEPS = 64


def _powers_sized(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 1 << 64)
    up, down = np.full(n + 1, base, np.uint64), np.full(n + 1, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _prime_powers_sized(n: int) -> tuple[np.ndarray, np.ndarray]:
    """PRIME_BASE**i and its inverse, modulo the prime, by doubling."""
    out = []
    for base in (PRIME_BASE, pow(PRIME_BASE, -1, int(PRIME))):
        powers = np.ones(1, np.uint64)
        while len(powers) <= n:
            powers = np.concatenate([powers, powers * np.uint64(pow(base, len(powers), int(PRIME))) % PRIME])
        out.append(powers[: n + 1].astype(np.uint32))
    return out[0], out[1]


_kept_powers = lru_cache(maxsize=2)(_powers_sized)
_kept_prime_powers = lru_cache(maxsize=1)(_prime_powers_sized)


def _rounded(n: int) -> int:
    return STEP_BYTES if n <= STEP_BYTES else KEPT if n <= KEPT else n


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i in 0..n at least."""
    return (_kept_powers if n <= KEPT else _powers_sized)(base, _rounded(n))


def prime_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return (_kept_prime_powers if n <= KEPT else _prime_powers_sized)(_rounded(n))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class RollingHash:
    """Hashes of ranges that only bring equal ranges together: different ones may collide."""

    def __init__(self, values: np.ndarray, base: int = BASE) -> None:
        up, self.down = powers(base, len(values))
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=self.sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64)

    def loose(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, end))


class RangeHash(RollingHash):
    """64-bit hashes of any ranges of a sequence of integers, of two independent polynomials (`of`)."""

    def __init__(self, values: np.ndarray, base: int = BASE) -> None:
        super().__init__(values, base)
        up, self.prime_down = prime_powers(len(values))
        small = values.astype(np.uint64) + np.uint64(1)
        if values.dtype.itemsize > 2:
            small = mix(small) >> np.uint64(34)
        terms = small * up[: len(values)]
        terms = (terms & PRIME) + (terms >> np.uint64(31))
        self.prime_sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(terms, out=self.prime_sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        second = (self.prime_sums[end] - self.prime_sums[start]) % PRIME * self.prime_down[start] % PRIME
        return mix(self.raw(start, end) ^ mix(second))


def _mixed(h: np.ndarray, more: np.ndarray) -> np.ndarray:
    """One step: a bijection of `h` for each `more`, not linear in either."""
    h = (h ^ more) * np.uint64(0x9FB21C651E98DF25)
    h ^= h >> np.uint64(32)
    return h


#: Masks of the first 0 to 8 bytes of a little-endian number.
HEADS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte ranges."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))
    left = (end - start).astype(np.int64)
    h = (left.astype(np.uint64) + np.uint64(seed)) * np.uint64(BASE)
    rows, at = np.arange(len(h)), np.asarray(start, np.int64)
    for step in range(MOST_STEPS + 1):
        if not len(rows):
            break
        if step == MOST_STEPS:
            for i, a, n in zip(rows.tolist(), at.tolist(), left.tolist(), strict=True):
                rest = np.frombuffer(hashlib.blake2b(data[a : a + n].tobytes(), digest_size=8).digest(), "<u8")
                h[i] = _mixed(h[i : i + 1], rest)[0]
            break
        part = eight[at] & HEADS[np.minimum(left, 8)]
        h[rows] = _mixed(h[rows], part) if step else _mixed(h, part)
        more = np.flatnonzero(left > 8)
        rows, at, left = rows[more], at[more] + 8, left[more] - 8
    return mix(h)


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-long windows of a sequence of hashes: windows of powers of two, then joined."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out, done, size, powered = None, 0, 1, hashes.astype(np.uint64)
    while True:
        if n & size:
            piece = powered[done : done + count]
            out = piece if out is None else _mixed(out * np.uint64(WORD_BASE), piece)
            done += size
        if done == n:
            return mix(out + np.uint64(n))
        powered = _mixed(powered[:-size] * np.uint64(BASE), powered[size:])
        size *= 2


@dataclass
class Texts:
    """Texts of one step: `data[bounds[i]:bounds[i + 1]]` are the bytes of text `first + i` of the batch."""

    data: np.ndarray
    bounds: np.ndarray
    first: int

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def lowered(self) -> Texts:
        return Texts(LOWER[self.data], self.bounds, self.first)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of a string column; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), bounds


def steps(column: pa.Array, size: int = STEP_BYTES) -> Iterator[Texts]:
    """The column in runs of whole texts of about `size` bytes."""
    if not len(column):
        return
    data, bounds = buffers(column)
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + size, "right")) - 1)
        yield Texts(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], i)
        i = j


@dataclass
class Words:
    """Byte ranges of words; words of text i are `first[i]:first[i + 1]`."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words(texts: Texts) -> Words:
    inside = ~SPACE[texts.data]
    edge = np.zeros(len(inside) + 1, bool)
    edge[texts.bounds] = True
    before = np.zeros(len(inside) + 1, bool)
    before[1:] = inside
    here = np.zeros(len(inside) + 1, bool)
    here[:-1] = inside
    start = np.flatnonzero(here & (~before | edge))
    end = np.flatnonzero(before & (~here | edge))
    return Words(start, end, np.searchsorted(start, texts.bounds))


def word_hashes(texts: Texts, found: Words) -> np.ndarray:
    return range_hashes(texts.data, found.start, found.end)


def grams(hashes: np.ndarray, found: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the first words of all n-word windows that stay in their text, and the windows' hashes."""
    left = np.repeat(found.first[1:], found.counts) - np.arange(len(hashes))
    at = np.flatnonzero(left >= n)
    return at, window_hashes(hashes, n)[at]


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def give_back() -> None:
    """Unused memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # elsewhere than on Linux there is no such call
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(function: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A partition function after which the worker, which Spark keeps, gives unused memory back."""

    def run(*args: object) -> Iterator:
        yield from function(*args)
        give_back()

    return run


class Lookup:
    """Places of 64-bit keys: keys by multiplicative slot, probed one after the other within a slot."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(4, int(len(keys)).bit_length() + 1)
        slot = self._slot(keys)
        self.order = np.argsort(slot, kind="stable").astype(np.int32)
        self.keys = keys[self.order]
        self.first = np.zeros((1 << self.bits) + 1, np.int32)
        np.cumsum(np.bincount(slot, minlength=1 << self.bits), out=self.first[1:])

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key in the given order of keys, -1 if absent."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.keys):
            return out
        slot = self._slot(keys)
        at, end = self.first[slot].astype(np.int64), self.first[slot + 1]
        left = np.flatnonzero(at < end)
        at, end, wanted = at[left], end[left], keys[left]
        while len(left):
            hit = self.keys[at] == wanted
            out[left[hit]] = self.order[at[hit]]
            at = at + 1
            more = ~hit & (at < end)
            left, at, end, wanted = left[more], at[more], end[more], wanted[more]
        return out
