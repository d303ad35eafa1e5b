"""Token-id files under Re-Pair grammar compression.

Documents are range-partitioned by id, encoded in order, and cut into shards of about SHARD ids. In each shard the
most frequent pairs of neighbouring symbols are replaced by nonterminals again and again, until no pair stands twice;
the shard stores the rules, the expansion length of every nonterminal, the remaining symbols and the documents'
lengths. Expansion lengths make any slice of the ids readable without expanding what stands before it.

Pairs are counted exactly. A round replaces every pair that is at least a SPREADth as frequent as the round's most
frequent one, of pairs that overlap the more frequent one first, and then counts anew. Each rule takes two symbols or
more out of the sequence, so a shard has fewer rules than half its ids.

A shard is one row of a Parquet table, its payload a self-contained binary block: Spark's committers write it whole or
not at all, on any file system that Spark reads, and a lost executor's shards are simply written again.

Cases: null text is the empty text (the end id alone); a text that holds a special token's string is encoded as the
library does, by that token's id; a document longer than a shard makes a long shard; equal documents keep a row each,
null doc_ids stand first; an empty table makes no shards; extra columns are not read.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.common import Scratch
from keyloom.llm.pieces import PieceCoder
from keyloom.llm.shingles import held as held_by_worker, release

#: Ids after which a shard is closed.
SHARD = 1 << 20
#: Pairs of one round: the most frequent one's count over the least; below FEW, every pair that stands twice.
SPREAD, FEW = 8, 256
_BUCKETS = 20  # bits of the hash that leaves out pairs too rare for a round before the exact count
#: Pieces that a worker remembers.
CACHE = 520_000
_MAGIC, _HEAD = b"KLRP0001", struct.Struct("<8sIIIIQ")


def _candidates(seq: np.ndarray) -> tuple[np.ndarray, int]:
    """(places, least): places that hold all pairs of at least that count, and the least count of the round's pairs.

    A bucket holds at least as many places as each of its pairs, so places in emptier buckets need no exact count.
    """
    bucket = seq[:-1] * np.uint32(0x9E3779B1)
    bucket += seq[1:] * np.uint32(0x85EBCA77)
    bucket >>= np.uint32(32 - _BUCKETS)
    full = np.bincount(bucket, minlength=1 << _BUCKETS)
    top = int(full.max())
    least = 2 if top < FEW else max(top // SPREAD, 2)
    return np.flatnonzero((full >= least)[bucket]), least


def _grouped(left: np.ndarray, right: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, order): the pairs' codes in sorted order and where they stand; symbols have at most so many bits."""
    code = left.astype(np.uint64) << np.uint64(bits) | right
    room = np.uint64(max(len(code), 1).bit_length())
    if 2 * bits + int(room) > 64:
        order = np.argsort(code, kind="stable")
        return code[order], order
    both = np.sort(code << room | np.arange(len(code), dtype=np.uint64))
    return both >> room, (both & ((np.uint64(1) << room) - np.uint64(1))).astype(np.int64)


def _frequent(seq: np.ndarray, places: np.ndarray, least: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, at, k, every): the pairs of at least that count, most frequent first; places without overlap of a pair
    with itself, and the numbers of their pairs; every place of them.

    Only a pair of one symbol can overlap itself: of a run of the symbol every second place counts.
    """
    left, right = seq[places], seq[places + 1]
    apart = np.ones(len(places), bool)
    twins = np.flatnonzero(left == right)
    if len(twins):
        at = places[twins]
        begins = np.ones(len(twins), bool)
        begins[1:] = np.diff(at) > 1
        apart[twins] = (at - np.maximum.accumulate(np.where(begins, at, 0))) % 2 == 0
    codes, order = _grouped(left, right, bits)
    begin = np.flatnonzero(np.append(len(codes) > 0, codes[1:] != codes[:-1]))
    size = np.diff(begin, append=len(codes))
    count = np.add.reduceat(apart[order], begin, dtype=np.int64) if len(twins) else size
    own = np.flatnonzero(count >= least)
    if not len(own):
        return np.zeros((0, 2), np.uint32), places[:0], places[:0], places[:0]
    own = own[np.argsort(-count[own], kind="stable")]
    rank = np.full(len(begin), -1, np.int32)
    rank[own] = np.arange(len(own))
    k = np.empty(len(places), np.int32)
    k[order] = np.repeat(rank, size)
    pair, hit = codes[begin[own]], k >= 0
    pairs = np.stack([pair >> np.uint64(bits), pair & np.uint64((1 << bits) - 1)], 1).astype(np.uint32)
    return pairs, places[hit & apart], k[hit & apart], places[hit]


def compress(ids: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """(rules, symbols): rules[k] is the pair that nonterminal first + k stands for."""
    seq, rules, made, watched = ids.astype(np.uint32), [], 0, None
    while len(seq) >= 2:
        places, least = _candidates(seq) if watched is None else (watched, 2)
        bits = (first + made).bit_length()
        pairs, at, k, every = _frequent(seq, places, least, bits)
        while not len(pairs) and least > 2:  # buckets of many rare pairs
            least = max(least // SPREAD, 2)
            pairs, at, k, every = _frequent(seq, np.arange(len(seq) - 1), least, bits)
        if not len(pairs):
            break
        # Of places that follow each other, those whose pair is more frequent than both neighbours' are taken.
        near = np.diff(at) == 1
        wins = np.ones(len(at), bool)
        wins[1:] &= ~near | (k[1:] < k[:-1])
        wins[:-1] &= ~near | (k[:-1] < k[1:])
        enough = np.bincount(k[wins], minlength=len(pairs)) >= 2  # one place alone is no rule
        wins &= enough[k]
        at, names, used = at[wins], np.cumsum(enough)[k[wins]], pairs[enough]
        seq[at] = (first + made + names - 1).astype(np.uint32)
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        if least == 2:  # from now on only pairs with a new symbol, and this round's that were left, can stand twice
            moved = np.cumsum(keep) - 1
            mark = np.zeros(int(moved[-1]) + 2, bool)  # by the places to come, all one further
            mark[moved[at]] = mark[moved[at] + 1] = True
            mark[moved[every[keep[every] & keep[every + 1]]] + 1] = True
            watched = np.flatnonzero(mark[1:-1])
        seq = seq[keep]
        rules.append(used)
        made += len(used)
    return (np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)), seq


def expansion_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """Number of ids under each nonterminal; a rule only refers to earlier ones, round by round."""
    n = np.zeros(len(rules), np.int64)
    open_ = np.arange(len(rules))
    while len(open_):
        parts = rules[open_].astype(np.int64) - first
        sizes = np.where(parts < 0, 1, n[np.maximum(parts, 0)])
        ready = (sizes > 0).all(1)
        n[open_[ready]] = sizes[ready].sum(1)
        open_ = open_[~ready]
    return n


def write_shard(docs: list[np.ndarray], first: int) -> bytes:
    """The binary block of one shard. first: the least id that no token has."""
    ids = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
    rules, seq = compress(ids, first)
    sizes = np.array([len(d) for d in docs], "<u4")
    head = _HEAD.pack(_MAGIC, first, len(docs), len(rules), len(seq), len(ids))
    return head + sizes.tobytes() + rules.astype("<u4").tobytes() + expansion_lengths(rules, first).astype("<u4").tobytes() + seq.astype("<u4").tobytes()


class ShardReader:
    def __init__(self, block: bytes):
        magic, self.first, docs, rules, symbols, self.n_ids = _HEAD.unpack_from(block)
        if magic != _MAGIC:
            raise ValueError("not a token shard")
        whole = np.frombuffer(block, "<u4", offset=_HEAD.size)
        sizes, rest = whole[:docs], whole[docs:]
        self.sizes = sizes.astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.rules, self.lengths = rest[: 2 * rules].reshape(-1, 2), rest[2 * rules : 3 * rules]
        self.symbols = rest[3 * rules : 3 * rules + symbols]
        self._ends = None

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of symbols. Expansion lengths tell where each symbol's ids begin, so that a round touches only the
        symbols that the last one left to expand."""
        symbols = np.asarray(symbols, np.uint32)
        width = np.ones(len(symbols), np.int64)
        deep = np.flatnonzero(symbols >= self.first)
        width[deep] = self.lengths[symbols[deep] - self.first]
        at = np.cumsum(width) - width
        out = np.empty(int(width.sum()), np.uint32)
        while len(symbols):
            deep = symbols >= self.first
            out[at[~deep]] = symbols[~deep]
            rule, left = symbols[deep] - self.first, at[deep]
            pair = self.rules[rule]
            right = left + self.lengths[rule]
            last = pair[:, 1]
            own = last >= self.first
            size = np.ones(len(last), np.int64)
            size[own] = self.lengths[last[own] - self.first]
            symbols, at = np.concatenate([pair[:, 0], last]), np.concatenate([left, right - size])
        return out

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids start..stop: finds the symbols that cover them by their expansion lengths and expands only those."""
        if start >= stop:
            return np.zeros(0, np.uint32)
        if self._ends is None:
            own = np.ones(len(self.symbols), np.int64)
            deep = self.symbols >= self.first
            own[deep] = self.lengths[self.symbols[deep] - self.first]
            self._ends = np.cumsum(own)
        a, b = np.searchsorted(self._ends, start, "right"), np.searchsorted(self._ends, stop, "left")
        before = int(self._ends[a - 1]) if a else 0
        return self.expand(self.symbols[a : b + 1])[start - before : stop - before]

    def document(self, i: int) -> np.ndarray:
        return self.slice(int(self.starts[i]), int(self.starts[i + 1]))

    def documents(self) -> Iterator[np.ndarray]:
        ids = self.expand(self.symbols)
        for i in range(len(self.sizes)):
            yield ids[self.starts[i] : self.starts[i + 1]]


def _encode_pieces(tokenizer, width: np.ndarray, new: list[str]) -> list[bytes]:
    """Ids of pieces. Those of a space and letters follow each other in one text, in which each is a piece again; the
    tokens' widths in bytes tell where one ends."""
    plain = [p for p in new if p[0] == " " and p[1:].isalpha()]
    out = {}
    for at in range(0, len(plain), 2048):
        own = plain[at : at + 2048]
        found = np.array(tokenizer.encode_batch_fast(["".join(own)], add_special_tokens=False)[0].ids, "<u4")
        ends, want = np.cumsum(width[found]), np.cumsum([len(p.encode()) for p in own])
        cuts = np.searchsorted(ends, want)
        if (ends[cuts] == want).all():  # else the library takes other characters for letters than Python does
            ids, places = found.tobytes(), [0, *(4 * cuts + 4).tolist()]
            out.update(zip(own, map(ids.__getitem__, map(slice, places, places[1:])), strict=True))
    rest = [p for p in new if p not in out]
    out.update(zip(rest, (np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(rest, add_special_tokens=False)), strict=True))
    return [out[p] for p in new]


class Coder:
    """The tokenizers library behind a memory of pieces. Texts with a special token's string go to the library whole."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.first = max(vocabulary.values()) + 1  # the least id that no token has
        width = np.zeros(self.first, np.int64)
        for token, i in vocabulary.items():
            width[i] = len(token)  # a character of a token is a byte
        self.pieces = PieceCoder(pattern, partial(_encode_pieces, self.library, width), CACHE)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        whole = [bool(t) and any(x in t for x in self.special) for t in texts]
        out = self.pieces.encode([None if w else t for t, w in zip(texts, whole, strict=True)])
        for i in np.flatnonzero(whole).tolist():
            out[i] = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        return out


def coder(path: str, pattern: str) -> Coder:
    """One per Python worker; the file lies on every node at the path given."""
    return held_by_worker(("shards", path, pattern), partial(Coder, path, pattern))


SHARDS = "part int, shard int, n_ids long, doc_ids array<bigint>, block binary"


def write(docs: DataFrame, path: str, pattern: str, scratch: Scratch, end_id: int = 0, shard_ids: int = SHARD) -> DataFrame:
    """Stored shards of all documents (doc_id, text) in ascending doc_id order, each document ended by end_id."""
    end = np.uint32(end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, names, own, n = TaskContext.get().partitionId(), 0, [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal shard, names, own, n
            row = {"part": [part], "shard": [shard], "n_ids": [n], "doc_ids": [names], "block": [write_shard(own, coder(path, pattern).first)]}
            shard, names, own, n = shard + 1, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(row[c], t) for c, t in (("part", pa.int32()), ("shard", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("block", pa.binary()))], names=list(row))

        for b in batches:
            for name, ids in zip(b.column("doc_id").to_pylist(), coder(path, pattern).encode(b.column("text").to_pylist()), strict=True):
                names.append(name)
                own.append(np.append(ids, end))
                n += len(own[-1])
                if n >= shard_ids:
                    yield close()
        if own:
            yield close()
        release()

    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    d = d.withColumn("_h", F.xxhash64("text")).repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h").select("doc_id", "text")
    return scratch.keep(d.mapInArrow(run, SHARDS))


def offsets(shards: DataFrame) -> DataFrame:
    """(part, shard, base): ids before each shard; sums by part, then within each part."""
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    before = parts.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_before"))  # a row for each writing task
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_ids")
    return shards.select("part", "shard", within.alias("_within")).join(before, "part").select("part", "shard", (F.col("_before") + F.col("_within")).alias("base"))


def read(shards: DataFrame) -> DataFrame:
    """(part, shard, doc_id, at, ids): every document's ids from the stored shards; at: its start within its shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, shard, names, block in zip(b.column("part").to_pylist(), b.column("shard").to_pylist(), b.column("doc_ids").to_pylist(), b.column("block").to_pylist(), strict=True):
                reader = ShardReader(block)
                ids = [x.astype("<u4").tobytes() for x in reader.documents()]
                n = len(names)
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([shard] * n, pa.int32()), pa.array(names, pa.int64()), pa.array(reader.starts[:-1], pa.int64()), pa.array(ids, pa.binary())], names=["part", "shard", "doc_id", "at", "ids"])

    return shards.select("part", "shard", "doc_ids", "block").mapInArrow(run, "part int, shard int, doc_id bigint, at bigint, ids binary")


def checksums(shards: DataFrame) -> DataFrame:
    """(part, shard, doc_id, at, n_tokens, ids_crc32) of every document as read back from the stored shards; what
    `read` returns, summed up where it is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, shard, names, block in zip(b.column("part").to_pylist(), b.column("shard").to_pylist(), b.column("doc_ids").to_pylist(), b.column("block").to_pylist(), strict=True):
                reader = ShardReader(block)
                crc = [zlib.crc32(ids.astype("<u4", copy=False)) for ids in reader.documents()]
                n = len(names)
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([shard] * n, pa.int32()), pa.array(names, pa.int64()), pa.array(reader.starts[:-1], pa.int64()), pa.array(reader.sizes, pa.int64()), pa.array(crc, pa.int64())], names=["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    return shards.select("part", "shard", "doc_ids", "block").mapInArrow(run, "part int, shard int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint")


def digests(shards: DataFrame) -> DataFrame:
    """Start, length and checksum of every document as read back."""
    placed = checksums(shards).join(offsets(shards.select("part", "shard", "n_ids")), ["part", "shard"])
    return placed.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
