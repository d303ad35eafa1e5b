"""Words and word shingles as 64-bit hashes, whole arrays at a time.

A word's hash is the sum of one random number for each of its bytes and their places (tabulation hashing), a longer
word's is xxh3; a window's is the sum of its words' hashes, each times a random odd number of its place. Both differ
for any two inputs but by a chance of about 2^-62, whatever their structure.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from itertools import islice
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash

P = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of texts that are hashed together, bytes of a word up to which the table is used, longest window.
STRETCH, WIDTH, LONGEST = 1 << 18, 64, 256
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_random = np.random.Generator(np.random.PCG64(20_240_607))  # the same numbers in every worker
_TABLE = _random.integers(0, 1 << 64, (WIDTH, 256), np.uint64)
_LOWER_TABLE = _TABLE.copy()
_LOWER_TABLE[:, 65:91] = _TABLE[:, 97:123]
_PLACES = _random.integers(0, 1 << 63, LONGEST, np.uint64) * np.uint64(2) + np.uint64(1)
_TO_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def hash_words(texts: list[str | None], lower: bool = True) -> list[np.ndarray]:
    """The hash of every word of each text, in order; words lie between spaces and \\t-\\r, A-Z count as a-z if lower."""
    out: list[np.ndarray] = []
    held: list[bytes] = []
    size = 0
    for t in texts:
        held.append(t.encode() if t else b"")
        size += len(held[-1]) + 1
        if size > STRETCH:
            out += _stretch(held, lower)
            held, size = [], 0
    return out + (_stretch(held, lower) if held else [])


def ragged(starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, at): for the elements of spans of n > 0 elements from starts on, their places in their span and their
    indexes, span after span."""
    total = int(n.sum())
    kind = np.int32 if total < 1 << 23 and int(starts.max()) < 1 << 30 else np.int64  # shifted by a byte, places still fit
    place = np.arange(total, dtype=kind)
    place -= np.repeat((np.cumsum(n) - n).astype(kind), n)
    return place, place + np.repeat(starts.astype(kind), n)


def span_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """The hash of each span of bytes, none of them empty."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = ends - starts
    short = np.minimum(n, WIDTH)
    place, at = ragged(starts, short)
    place <<= 8
    place |= b[at]
    h = np.add.reduceat((_LOWER_TABLE if lower else _TABLE).ravel()[place], np.cumsum(short) - short)
    for i in np.flatnonzero(n > WIDTH).tolist():
        word = b[starts[i] : ends[i]].tobytes()
        h[i] = xxhash.xxh3_64_intdigest(word.translate(_TO_LOWER) if lower else word)
    return h


def same_spans(a: np.ndarray, starts: np.ndarray, b: np.ndarray, others: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether a[start:start+n] equals b[other:other+n], for each of the spans, none of them empty."""
    if not len(n):
        return np.zeros(0, bool)
    place, at = ragged(starts, n)
    place += np.repeat(others.astype(place.dtype), n)
    return np.logical_and.reduceat(a[at] == b[place], np.cumsum(n) - n)


def _stretch(parts: list[bytes], lower: bool) -> list[np.ndarray]:
    b = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    edge = np.flatnonzero(np.diff(_SPACE[b], prepend=True))
    starts, ends = edge[::2], edge[1::2]
    h = span_hashes(b, starts, ends, lower)
    cuts = np.cumsum([len(x) + 1 for x in parts[:-1]])
    return np.split(h, np.searchsorted(starts, cuts))


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, place): where each distinct hash stands first, and for every hash the number of its distinct one.

    Hashes meet in a table by their upper bits; the few that find another hash there are sorted out afterwards.
    """
    n = len(h)
    bits = max(n, 1).bit_length() + 1
    slot = (h >> np.uint64(64 - bits)).astype(np.intp)
    table = np.empty(1 << bits, np.intp)
    table[slot[::-1]] = np.arange(n - 1, -1, -1)
    chosen = table[slot]
    other = np.flatnonzero(h[chosen] != h)
    if len(other):
        _, first, inverse = np.unique(h[other], return_index=True, return_inverse=True)
        chosen[other] = other[first][inverse]
    own = chosen == np.arange(n)
    number = np.cumsum(own) - 1
    return np.flatnonzero(own), number[chosen]


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k-word window in order."""
    n = len(hashes) - k + 1
    s = hashes[:n] * _PLACES[0]
    for i in range(1, k):
        s += hashes[i : i + n] * _PLACES[i]
    return _mixed(s)


def run_hashes(hashes: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k-word window at each of the starts."""
    s = np.zeros(len(starts), np.uint64)
    for i in range(k):
        s += hashes[starts + i] * _PLACES[i]
    return _mixed(s)


def _mixed(s: np.ndarray) -> np.ndarray:
    s ^= s >> np.uint64(29)
    s *= P
    s ^= s >> np.uint64(32)
    return s


def shingle_set(hashes: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct shingles; fewer than k words make one shingle, no words none."""
    if not len(hashes):
        return hashes
    if len(hashes) < k:
        return windows(hashes, len(hashes)) + np.uint64(len(hashes))
    s = windows(hashes, k)
    s.sort()
    keep = np.ones(len(s), bool)
    np.not_equal(s[1:], s[:-1], out=keep[1:])
    return s[keep]


def name_of(values: np.ndarray, clash: frozenset = frozenset()) -> int:
    """A signed 64-bit name for an array of values; one of `clash` stands for several and is replaced."""
    raw = values.tobytes()
    c = xxhash.xxh3_64_intdigest(raw) - (1 << 63)
    return c if c not in clash else xxhash.xxh3_64_intdigest(raw, 1) - (1 << 63)


def check_of(values: np.ndarray) -> int:
    """A second hash, independent of the name."""
    return xxhash.xxh64_intdigest(values.tobytes(), 2) - (1 << 63)


def trim(known: dict, most: int) -> None:
    """Halve a full memory. What came first came often, so the newest entries go."""
    if len(known) > most:
        for key in list(islice(reversed(known), most // 2)):
            del known[key]


_held: dict = {}


def held(key: tuple, build: Callable[[], Any]) -> Any:
    """What build() makes, kept in this Python worker until something else is asked for: one operator's tables at a time."""
    if key not in _held:
        _held.clear()
        _held[key] = build()
    return _held[key]


def let_go() -> None:
    """At the start of a task that needs no tables: those of an earlier operator go."""
    if _held:
        _held.clear()
        release()


def release() -> None:
    """At a task's end: hand the worker's free memory back, for the worker waits for the next task of any operator."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
