"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece there is exactly one token that can end the encoding of that prefix; storing these
last tokens is enough to read the encoding of any prefix backwards. A new prefix takes the token t ending there whose
predecessor, the stored last token of the prefix before t, forms a valid pair with it: a pair is valid if the merge
rules leave the two tokens as they are. Appending bytes extends the table; an edit recomputes only from the piece
that can see it to the piece where old and new boundaries meet again.

Cases: null text is the empty text (no ids); very long texts and pieces are linear in their length; repeated rows
each give their row; an empty table gives no rows; other columns are kept as they are, but `ids` and `decoded` of the
input are replaced.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.llm.pieces import PieceCoder
from keyloom.llm.shingles import held, release, trim

#: Pieces, and pairs of tokens, that a worker remembers before it halves its memory of them.
CACHE, PAIRS = 260_000, 120_000
#: Rows that are coded and decoded together.
FEW = 100


_LEAF: dict = {}


class PrefixCoder:
    """The vocabulary with its trie, valid pairs and prefix tables."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.trie: dict = {}  # byte -> [token that ends here or -1, the same below]
        for token, rank in ranks.items():
            node = self.trie
            for byte in token[:-1]:
                below = node.get(byte)
                if below is None:
                    below = node[byte] = [-1, _LEAF]
                if below[1] is _LEAF:
                    below[1] = {}
                node = below[1]
            node.setdefault(token[-1], [-1, _LEAF])[0] = rank
        self._longest = max(map(len, ranks))
        self._pairs: dict[int, bool] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}

    def merge(self, piece: bytes, below: int = 1 << 60) -> list[int]:
        """Plain merging, lowest rank first, of ranks below a limit: the definition that valid pairs refer to."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens of the last merge that makes this one; (-1, -1): it is a byte; None: merging never makes it."""
        if token not in self._halves:
            text, found = self.tokens[token], (-1, -1)
            if len(text) > 1:
                parts = self.merge(text, token)
                found = (parts[0], parts[1]) if len(parts) == 2 else None
            self._halves[token] = found
        return self._halves[token]

    def valid(self, before: int, token: int) -> bool:
        """Whether `before, token` may stand side by side; before = -1: whether token may stand first.

        Both are taken apart again, the merge that came last first. Of what then stands at the boundary, left and
        right, no merge may come before the one taken back; of equal ones the left comes first.
        """
        key = (before + 1) << 32 | token
        got = self._pairs.get(key)
        if got is None:
            trim(self._pairs, PAIRS)
            got = self._pairs[key] = self.halves(token) is not None and (before < 0 or self._apart(before, token))
        return got

    def _apart(self, a: int, b: int) -> bool:
        if self.halves(a) is None:
            return False
        limit = 1 << 60
        while True:
            joined = self.ranks.get(self.tokens[a] + self.tokens[b])
            if joined is not None and joined < limit:
                return False
            right, left = self.halves(a)[1], self.halves(b)[0]
            if right < 0 and left < 0:
                return True
            if left < 0 or (right >= 0 and a > b):
                limit, a = a, right
            else:
                limit, b = b + 1, left

    def extend(self, piece: bytes, last: list[int], start: int) -> list[int]:
        """last[i] is the last token of piece[:i]; fills it beyond `start`, to which it is known."""
        n, pairs, trie = len(piece), self._pairs, self.trie
        del last[start + 1 :]
        last += [-1] * (n - start)
        for j in range(max(0, start - self._longest) if start else 0, n):
            before, node = last[j], trie
            key = (before + 1) << 32
            for k in range(j, n):
                below = node.get(piece[k])
                if below is None:
                    break
                token, node = below
                if token >= 0 and last[k + 1] < 0:
                    ok = pairs.get(key | token)
                    if ok or (ok is None and self.valid(before, token)):
                        last[k + 1] = token
        return last

    def table(self, piece: bytes) -> list[int]:
        return self.extend(piece, [-1], 0)

    def read(self, last: list[int], end: int | None = None) -> list[int]:
        """The encoding of the prefix of `end` bytes (default: all), read backwards."""
        at, out = len(last) - 1 if end is None else end, []
        while at:
            out.append(last[at])
            at -= len(self.tokens[last[at]])
        return out[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.read(self.table(piece))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Document:
    """An encoded text that can be appended to and edited without encoding it all again."""

    def __init__(self, coder: PrefixCoder, pattern: regex.Pattern, text: str = ""):
        self.coder, self.pattern, self.text, self.ends, self.ids = coder, pattern, "", [], []
        self.encoded = 0  # pieces encoded so far, by all edits
        self.edit(0, 0, text)

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace text[start:end] by new.

        A match depends on nothing before it and on at most two characters after its end, so pieces that end two
        characters before the edit stay, and pieces after the first common boundary behind it stay too.
        """
        text = self.text[:start] + new + self.text[end:]
        shift = len(text) - len(self.text)
        keep = sum(1 for e in self.ends if e + 2 <= start)
        at = self.ends[keep - 1] if keep else 0
        old = {e + shift: i + 1 for i, e in enumerate(self.ends) if e >= end}
        ends, ids, rest = [], [], len(self.ends)
        for m in self.pattern.finditer(text, at):
            ends.append(m.end())
            ids.append(self.coder.encode_piece(m[0].encode()))
            self.encoded += 1
            if m.end() >= start + len(new) and m.end() in old:
                rest = old[m.end()]
                break
        tail = [e + shift for e in self.ends[rest:]]
        self.text, self.ends, self.ids = text, self.ends[:keep] + ends + tail, self.ids[:keep] + ids + self.ids[rest:]

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def all_ids(self) -> list[int]:
        return [i for piece in self.ids for i in piece]


def load(path: str, pattern: str) -> tuple[PrefixCoder, PieceCoder]:
    """One per Python worker; the file lies on every node at the path given."""

    def build() -> tuple[PrefixCoder, PieceCoder]:
        with open(path, "rb") as f:
            coder = PrefixCoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})
        return coder, PieceCoder(pattern, lambda new: [array("I", coder.encode_piece(p.encode())).tobytes() for p in new], CACHE)

    return held(("bpe", path, pattern), build)


def _replaced(df: DataFrame, name: str) -> tuple[T.StructType, list[str]]:
    rest = [c for c in df.columns if c != name]
    return T.StructType([*(df.schema[c] for c in rest), T.StructField(name, T.BinaryType())]), rest


def encode(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """df with `ids`: the tokens of each whole text as little-endian unsigned 32-bit integers."""
    schema, rest = _replaced(df, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path, pattern)[1]
        for b in batches:
            ids = [x.astype("<u4").tobytes() for x in pieces.encode(b.column(text).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(ids, pa.binary())], names=schema.names)
        release()

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """df with `decoded`: the bytes that `ids` stand for."""
    schema, rest = _replaced(df, "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, _ = load(path, pattern)
        for b in batches:
            got = [coder.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(got, pa.binary())], names=schema.names)
        release()

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """df with `ids` and, decoded from them, `decoded`, in one worker."""
    first, _ = _replaced(df, "ids")
    rest = [c for c in first.names if c not in ("ids", "decoded")]
    schema = T.StructType([*(df.schema[c] for c in rest), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, pieces = load(path, pattern)
        for b in (few.slice(at, FEW) for few in batches for at in range(0, few.num_rows, FEW)):
            ids = [x.astype("<u4", copy=False) for x in pieces.encode(b.column(text).to_pylist())]
            columns = [pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([coder.decode(x.tolist()) for x in ids], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), *columns], names=schema.names)
        release()

    return df.mapInArrow(run, schema)


def digests(df: DataFrame) -> DataFrame:
    """Length and SHA-256 digests of encoded and decoded rows."""
    return df.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
