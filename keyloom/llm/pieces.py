"""Splitting texts into the pieces that byte-level tokenizers encode one by one."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import regex

from keyloom.llm.shingles import distinct, same_spans, span_hashes, trim

#: Fixed value: the usual pattern of byte-level tokenizers.
USUAL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Bytes of texts that are cut and looked up together.
STRETCH = 1 << 18


def _latin() -> re.Pattern:
    """The usual pattern for texts of code points below 256, for the faster engine; letters first, as they start apart
    from all else."""
    of = lambda kind: "".join(re.escape(chr(c)) for c in range(256) if unicodedata.category(chr(c))[0] == kind)
    letters, numbers, spaces = of("L"), of("N"), "\\t-\\r \\x85\\xa0"
    return re.compile(f" ?[{letters}]+| ?[{numbers}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^{spaces}{letters}{numbers}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+")


@lru_cache(4)
def splitter(pattern: str) -> Callable[[str], list[str]]:
    """text -> its pieces, equal to the pattern's matches in order."""
    whole = regex.compile(pattern).findall
    if pattern != USUAL:
        return whole
    latin = _latin().findall

    def split(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return whole(text)
        return latin(text)

    return split


#: Classes of code points below 256: letter, number, white space, other.
_KIND = np.array([0 if (k := unicodedata.category(chr(c))[0]) == "L" else 1 if k == "N" else 2 if chr(c) in "\t\n\v\f\r \x85\xa0" else 3 for c in range(256)], np.uint8)
_SUFFIX = np.zeros(256, bool)
_SUFFIX[list(b"stmd")] = True


def latin_pieces(b: np.ndarray, stops: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the usual pattern's matches in code points below 256, whole arrays at a time.

    Runs of one class are pieces, but: a blank before a run of another class than white space belongs to that run; of
    white space before such a run the last character stands alone otherwise; and a lone apostrophe at the start of a
    piece takes the letters of a contraction. stops: places between texts, which belong to no piece.
    """
    n = len(b)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _KIND[b]
    if stops is not None:
        kind[stops] = 4
    starts = np.flatnonzero(np.diff(kind, prepend=255))
    last = np.append(starts[1:], n) - 1  # last place of each run
    behind = np.append(kind[starts[1:]], 4)  # class of what follows
    cut = (kind[starts] == 2) & (behind != 4)  # white space with something behind it
    blank = cut & (b[last] == 32)
    # A run of white space before something: all but its last character, then that one, alone or with what follows.
    extra = last[cut & (last > starts)]
    mark = np.zeros(n + 1, bool)
    mark[starts] = True
    mark[last[blank] + 1] = False
    mark[last[blank]] = True
    mark[extra] = True
    # Contractions: a piece that is one apostrophe, with letters behind.
    q = np.flatnonzero((b == 39) & mark[:n])
    q = q[q + 1 < n]
    q = q[mark[q + 1] & (kind[q + 1] == 0)]
    if len(q):
        one = _SUFFIX[b[q + 1]]
        at = np.minimum(q + 2, n - 1)
        c2 = np.where(kind[at] == 0, b[at], 0)
        two = (q + 2 < n) & (((b[q + 1] == 114) | (b[q + 1] == 118)) & (c2 == 101) | (b[q + 1] == 108) & (c2 == 108))
        mark[q[one | two] + 1] = False
        mark[q[one] + 2] = True
        mark[q[two] + 3] = True
    mark[n] = True
    at = np.flatnonzero(mark)
    starts, ends = at[:-1], at[1:]
    if stops is not None:
        own = kind[starts] != 4
        starts, ends = starts[own], ends[own]
    return starts, ends


class HashMemory:
    """Hash -> a piece's bytes and ids, in plain arrays: an open-addressing table over a store of bytes and one of ids.

    When `most` hashes are held, the first half stays: what came first came often.
    """

    def __init__(self, most: int):
        self.most, self.bits = most, (2 * most).bit_length()
        self._clear()

    def _clear(self) -> None:
        size = 1 << self.bits
        self.keys = np.zeros(size, np.uint64)  # 0: free
        self.at, self.width = np.zeros(size, np.int32), np.zeros(size, np.int32)  # of the ids
        self.begin, self.length = np.zeros(size, np.int32), np.zeros(size, np.int32)  # of the bytes
        self.store, self.end, self.text, self.text_end, self.held = np.zeros(1 << 16, np.uint32), 0, np.zeros(1 << 16, np.uint8), 0, 0

    def _slots(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.intp)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The slot of each hash, -1 if it isn't held."""
        slot, left, out = self._slots(h), np.arange(len(h)), np.full(len(h), -1)
        while len(left):
            key = self.keys[slot[left]]
            hit = key == h[left]
            out[left[hit]] = slot[left[hit]]
            left = left[~hit & (key != 0)]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
        return out

    def equal(self, slot: np.ndarray, b: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the bytes held at each slot are b[start:start+n]."""
        same = self.length[slot] == n
        same[same] = same_spans(b, starts[same], self.text, self.begin[slot[same]].astype(np.int64), n[same])
        return same

    def add(self, h: np.ndarray, width: np.ndarray, ids: np.ndarray, length: np.ndarray, text: np.ndarray) -> None:
        """Distinct hashes that are not held, with the numbers of their ids and bytes, and all of these in that order."""
        if self.held + len(h) > self.most:
            self._halve()
        if self.held + len(h) > self.most:  # more at once than half the memory takes
            n = self.most - self.held
            h, width, ids, length, text = h[:n], width[:n], ids[: int(width[:n].sum())], length[:n], text[: int(length[:n].sum())]
        self.store, self.text = _room(self.store, self.end + len(ids)), _room(self.text, self.text_end + len(text))
        self.store[self.end : self.end + len(ids)] = ids
        self.text[self.text_end : self.text_end + len(text)] = text
        at, begin = self.end + np.cumsum(width) - width, self.text_end + np.cumsum(length) - length
        slot, left = self._slots(h), np.arange(len(h))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            self.keys[slot[free]] = h[free]  # of those that want one slot, one gets it
            won = left[self.keys[slot[left]] == h[left]]
            self.at[slot[won]], self.width[slot[won]] = at[won], width[won]
            self.begin[slot[won]], self.length[slot[won]] = begin[won], length[won]
            left = left[self.keys[slot[left]] != h[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
        self.end += len(ids)
        self.text_end += len(text)
        self.held += len(h)

    def _halve(self) -> None:
        own = np.flatnonzero(self.keys)
        own = own[np.argsort(self.begin[own], kind="stable")][: self.most // 2]
        h, width, length = self.keys[own], self.width[own].astype(np.int64), self.length[own].astype(np.int64)
        ids = self.store[: int(self.at[own[-1]] + width[-1])].copy() if len(own) else self.store[:0]
        text = self.text[: int(self.begin[own[-1]] + length[-1])].copy() if len(own) else self.text[:0]
        self._clear()
        self.add(h, width, ids, length, text)


def _room(store: np.ndarray, n: int) -> np.ndarray:
    """The store, with room for n entries."""
    return store if n <= len(store) else np.concatenate([store, np.zeros(max(n, 3 * len(store) // 2) - len(store), store.dtype)])


class PieceCoder:
    """Texts -> ids, encoding each distinct piece once and remembering it within bounds.

    Texts of code points below 256 are cut and looked up by hashes of their pieces, a stretch of texts at a time; the
    bytes are compared wherever hashes are equal, and a stretch in which equal hashes have different bytes goes piece by
    piece, as any other text does. encode_new: pieces -> the bytes of their ids (unsigned 32-bit).
    """

    def __init__(self, pattern: str, encode_new: Callable[[list[str]], list[bytes]], memory: int):
        self.split, self.latin, self.encode_new, self.memory = splitter(pattern), pattern == USUAL, encode_new, memory
        self.known = HashMemory(memory)
        self.by_text: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        held, places, size = [], [], 0
        for i, t in enumerate(texts):
            if not t:
                continue
            try:
                data = t.encode("latin-1") if self.latin else None
            except UnicodeEncodeError:
                data = None
            if data is None:
                out[i] = self._slow(t)
                continue
            held.append(data)
            places.append(i)
            size += len(data) + 1
            if size > STRETCH:
                for j, ids in zip(places, self._stretch(held), strict=True):
                    out[j] = ids
                held, places, size = [], [], 0
        if held:
            for j, ids in zip(places, self._stretch(held), strict=True):
                out[j] = ids
        return out

    def _slow(self, text: str) -> np.ndarray:
        trim(self.by_text, self.memory // 4)
        pieces = self.split(text)
        new = list(set(pieces).difference(self.by_text))
        self.by_text.update(zip(new, self.encode_new(new), strict=True))
        return np.frombuffer(b"".join(map(self.by_text.__getitem__, pieces)), "<u4")

    def _stretch(self, parts: list[bytes]) -> list[np.ndarray]:
        data = b" ".join(parts) + b" "
        b = np.frombuffer(data, np.uint8)
        stops = np.cumsum([len(x) + 1 for x in parts]) - 1
        starts, ends = latin_pieces(b, stops)
        n = ends - starts
        h = span_hashes(b, starts, ends)
        h[h == 0] = 1
        first, place = distinct(h)
        if (n[first][place] != n).any() or not same_spans(b, starts, b, starts[first][place], n).all():
            return [self._slow(x.decode("latin-1")) for x in parts]
        keys, known, starts_d, n_d = h[first], self.known, starts[first], n[first]
        slot = known.find(keys)
        held, new = slot >= 0, np.flatnonzero(slot < 0)
        if not known.equal(slot[held], b, starts_d[held], n_d[held]).all():
            return [self._slow(x.decode("latin-1")) for x in parts]
        at, width = known.at[slot].astype(np.int64), known.width[slot].astype(np.int64)
        base, fresh = known.store, np.zeros(0, np.uint32)
        if len(new):
            pieces = [data[s:e].decode("latin-1") for s, e in zip(starts_d[new].tolist(), ends[first[new]].tolist(), strict=True)]
            got = self.encode_new(pieces)
            wide = np.fromiter(map(len, got), np.int64, len(got)) // 4
            fresh = np.frombuffer(b"".join(got), "<u4")
            at[new], width[new] = np.cumsum(wide) - wide, wide
        count = width[place]
        done = np.cumsum(count)
        read = np.repeat(at[place] - (done - count), count) + np.arange(int(done[-1]) if len(done) else 0)
        old = np.repeat(held[place], count)
        out = np.empty(len(read), np.uint32)
        out[old], out[~old] = base[read[old]], fresh[read[~old]]
        if len(new):
            known.add(keys[new], width[new], fresh, n_d[new], np.frombuffer("".join(pieces).encode("latin-1"), np.uint8))
        cuts = np.concatenate([[0], done])[np.searchsorted(starts, stops)]
        return np.split(out, cuts[:-1])
