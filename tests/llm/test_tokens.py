"""Byte-level BPE and token shards against the libraries themselves."""

import base64
import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers
import regex
import tiktoken
from tokenizers import Tokenizer

from keyloom.llm import bpe, pieces, token_shards
from keyloom.llm.common import Scratch
from keyloom.llm.pieces import USUAL, HashMemory, PieceCoder, latin_pieces, splitter
from keyloom.llm.shingles import distinct, hash_words, run_hashes, windows

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
JSON = public_tokenizers.path("byte_bpe_50k.json")


def _library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pieces_equal_the_pattern():
    assert USUAL == PATTERN
    whole, own = regex.compile(PATTERN).findall, splitter(PATTERN)
    for c in map(chr, [*range(1, 700), 0x2028, 0x3000, 0x65E5, 0x1F642]):
        for f in ("a{0}b 1{0} {0}{0}x", "{0} 's{0}'re {0}\n {0}"):
            assert own(f.format(c)) == whole(f.format(c))


def test_latin_pieces_equal_the_pattern():
    own, r = regex.compile(PATTERN).findall, random.Random(3)
    alphabet = ["a", "b", "s", "t", "re", "ll", "ve", "'", "'", "  ", " ", " ", "\n", "1", "22", "!", "é", "½", "\x85", "\xa0", "l", "v", "r", "e", "\x1c", "_"]
    for _ in range(2000):
        texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 12))) for _ in range(r.randint(1, 4))]
        joined = " ".join(texts) + " "
        stops = np.cumsum([len(t) + 1 for t in texts]) - 1
        a, b = latin_pieces(np.frombuffer(joined.encode("latin-1"), np.uint8), stops)
        assert [joined[x:y] for x, y in zip(a, b)] == [p for t in texts for p in own(t)]


def thue_morse(bits):
    """Two different words of 2 ** bits letters, each the other's complement: equal under any polynomial modulo 2^64."""
    flips = [bin(i).count("1") % 2 for i in range(1 << bits)]
    return "".join("ab"[x] for x in flips), "".join("ba"[x] for x in flips)


STRUCTURED = [w for bits in range(10, 14) for w in thue_morse(bits)]


def test_structured_words_differ():
    for lower in (False, True):
        assert len({int(h[0]) for h in hash_words(STRUCTURED, lower)}) == len(STRUCTURED)
    for bits in range(2, 8):  # words in that order
        a, b = hash_words([" ".join(w) for w in thue_morse(bits)])
        assert windows(a, len(a)) != windows(b, len(b)) and run_hashes(a, np.zeros(1, int), len(a)) != run_hashes(b, np.zeros(1, int), len(b))


def test_word_hashes_follow_words():
    r = random.Random(5)
    words = ["".join(r.choice("abAB é日") for _ in range(r.choice([1, 2, 5, 63, 64, 65, 90]))).replace(" ", "c") for _ in range(600)]
    for lower in (False, True):
        got = {}
        for t, h in zip(words, hash_words(words, lower), strict=True):
            got.setdefault("".join(chr(ord(c) + 32) if lower and "A" <= c <= "Z" else c for c in t), set()).add(int(h[0]))
        assert all(len(v) == 1 for v in got.values()) and len(set().union(*got.values())) == len(got)
    joined = hash_words([" ".join(words), None, "", " \t"])
    assert joined[0].tolist() == [int(h[0]) for h in hash_words(words)] and [len(x) for x in joined[1:]] == [0, 0, 0]


def test_equal_hashes_of_other_pieces(monkeypatch):
    """With a hash that collides all the time the coder still tells pieces apart."""
    monkeypatch.setattr(pieces, "span_hashes", lambda b, starts, ends: (ends - starts).astype(np.uint64))
    enc = _library()
    coder = PieceCoder(PATTERN, lambda new: [np.array(enc.encode_ordinary(p), "<u4").tobytes() for p in new], 100)
    for texts in (["one two six"], ["ten"], ["one two", "", None, "four five nine"], ["seven", "eight"]):
        assert [x.tolist() for x in coder.encode(texts)] == [enc.encode_ordinary(t or "") for t in texts]


def test_structured_words_are_encoded_apart(spark):
    texts = [*STRUCTURED, " ".join(STRUCTURED)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    enc, t = _library(), Tokenizer.from_file(JSON)
    got = {r["doc_id"]: r for r in bpe.digests(bpe.round_trip(df, RANKS, PATTERN)).collect()}
    shards = {r["doc_id"]: r["ids_crc32"] for r in token_shards.digests(token_shards.write(df, JSON, PATTERN, Scratch(spark))).collect()}
    for i, text in enumerate(texts):
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(enc.encode_ordinary(text), "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert shards[i] == zlib.crc32(np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4").tobytes())


def test_valid_pairs_equal_merging():
    """A pair may stand side by side exactly if merging leaves it, over pairs that do and that don't."""
    coder, _ = bpe.load(RANKS, PATTERN)
    r, seen = random.Random(2), [0, 0]
    for _ in range(8000):
        w = r.choice(coder.tokens) + r.choice(coder.tokens)[: r.randint(0, 3)]
        cut = r.randint(1, max(1, len(w) - 1))
        a, b = coder.ranks.get(w[:cut]), coder.ranks.get(w[cut:])
        if a is not None and b is not None:
            want = w not in coder.ranks and coder.merge(w) == [a, b]
            assert coder.valid(a, b) == want
            seen[want] += 1
    assert min(seen) > 500
    assert all(coder.valid(-1, i) == (coder.merge(t) == [i]) for i, t in enumerate(coder.tokens[::23]) for i in [coder.ranks[t]])


def test_bpe_equals_library(docs, rows, empty):
    enc = _library()
    coded = bpe.decode(bpe.encode(docs, RANKS, PATTERN), RANKS, PATTERN)
    assert {"n", "root", "kept"} <= set(coded.columns)
    got = sorted(map(tuple, bpe.digests(coded).collect()), key=repr)
    want = []
    for i, _, t in rows:
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert sorted(map(tuple, bpe.digests(bpe.round_trip(docs, RANKS, PATTERN)).collect()), key=repr) == got
    assert bpe.digests(bpe.decode(bpe.encode(empty, RANKS, PATTERN), RANKS, PATTERN)).count() == 0 == bpe.round_trip(empty, RANKS, PATTERN).count()


def test_edits_and_appends_equal_encoding_anew():
    coder, _ = bpe.load(RANKS, PATTERN)
    enc, pattern, r = _library(), regex.compile(PATTERN), random.Random(1)
    for _ in range(150):
        d = bpe.Document(coder, pattern, "".join(r.choice(["ab", "'re", " ", "  ", "\n", "é", "12", "x'", " the"]) for _ in range(r.randint(0, 40))))
        for _ in range(4):
            a = r.randint(0, len(d.text))
            d.edit(a, r.randint(a, min(len(d.text), a + 3)), "".join(r.choice(["'", "r", " ", "e", "\n", "7", " q"]) for _ in range(r.randint(0, 4))))
            assert d.all_ids() == enc.encode_ordinary(d.text)
    d = bpe.Document(coder, pattern, "many words here " * 500)
    before = d.encoded
    d.edit(4000, 4002, "zz")
    d.append(" and more")
    assert d.encoded - before < 12 and d.all_ids() == enc.encode_ordinary(d.text)


def test_prefix_table_extends():
    coder, _ = bpe.load(RANKS, PATTERN)
    piece = ("hello" * 60 + "a" * 200).encode()
    last = coder.table(piece[:137])
    coder.extend(piece, last, 137)
    assert coder.read(last) == coder.merge(piece) == _library().encode_ordinary(piece.decode())
    assert all(coder.read(last, e) == coder.merge(piece[:e]) for e in range(1, len(piece), 17))


def test_shards_round_trip(spark, docs, rows, empty):
    scratch = Scratch(spark)
    shards = token_shards.write(docs, JSON, PATTERN, scratch, shard_ids=20_000)
    assert shards.count() > 5
    whole = sorted((r["part"], r["shard"], r["at"], len(r["ids"]) // 4, zlib.crc32(r["ids"])) for r in token_shards.read(shards).collect())
    assert whole == sorted((r["part"], r["shard"], r["at"], r["n_tokens"], r["ids_crc32"]) for r in token_shards.checksums(shards).collect())
    got = sorted(map(tuple, token_shards.digests(shards).collect()), key=lambda r: r[1])
    t = Tokenizer.from_file(JSON)
    by_id = {}
    for i, _, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        by_id.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    names = [r[0] for r in got]
    assert names == sorted(names, key=lambda x: (x is not None, x or 0)) and len(names) == len(rows)
    at = 0
    for i, start, n, crc in got:
        assert start == at and (n, crc) in by_id[i]
        at += n
    assert token_shards.digests(token_shards.write(empty, JSON, PATTERN, scratch)).count() == 0


def test_special_tokens_as_the_library(spark):
    texts = ["a<|endoftext|>b", "<|endoftext|>", "x <|endoftext|><|endoftext|> y", "<|endoftext", "é日<|endoftext|> 's", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    t = Tokenizer.from_file(JSON)
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in token_shards.digests(token_shards.write(df, JSON, PATTERN, Scratch(spark), shard_ids=4)).collect()}
    for i, text in enumerate(texts):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        assert got[i] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert 50256 in t.encode(texts[0], add_special_tokens=False).ids


def test_grammar_ends_when_no_pair_repeats(monkeypatch):
    r = np.random.default_rng(4)
    for few in (2, 64):
        monkeypatch.setattr(token_shards, "FEW", few)
        for i in range(120):
            ids = r.integers(0, r.integers(1, 7), r.integers(0, 500)).astype(np.uint32) if i else np.tile(r.integers(0, 50, 37), 60).astype(np.uint32)
            rules, seq = token_shards.compress(ids, 50)
            at = {}
            for k, pair in enumerate(zip(seq.tolist(), seq.tolist()[1:])):
                at.setdefault(pair, []).append(k)
            assert all(v[-1] - v[0] < 2 if a == b else len(v) == 1 for (a, b), v in at.items())
            assert 2 * len(rules) <= len(ids)
            assert sum(np.append(np.ones(50, int), token_shards.expansion_lengths(rules, 50))[seq]) == len(ids)


def test_grammar_random_access():
    r = np.random.default_rng(0)
    for ids in (r.integers(0, 9, 5000), np.full(3000, 7), np.arange(100), np.zeros(0, int), np.tile([1, 2, 3], 500)):
        docs = [x.astype(np.uint32) for x in np.split(ids, range(0, len(ids), 333))] if len(ids) else []
        reader = token_shards.ShardReader(token_shards.write_shard(docs, 200))
        assert all(np.array_equal(reader.document(i), d) for i, d in enumerate(docs))
        for _ in range(50):
            a, b = sorted(r.integers(0, len(ids) + 1, 2))
            assert np.array_equal(reader.slice(int(a), int(b)), ids[a:b])
    rules, seq = token_shards.compress(np.tile(np.array([1, 2, 3, 4], np.uint32), 1000), 10)
    assert len(seq) < 1000 and len(rules)


def test_distinct_hashes():
    r = np.random.default_rng(0)
    for n in (0, 1, 2, 50, 5000):
        for h in (r.integers(0, n // 3 + 2, n).astype(np.uint64), r.integers(0, n // 3 + 2, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)):
            first, place = distinct(h)
            assert (h[first][place] == h).all() and len(set(h.tolist())) == len(first)


def test_memory_halves_and_stays_right():
    r, m = np.random.default_rng(1), HashMemory(500)
    held = {}
    for _ in range(40):
        h = np.unique(r.integers(1, 1 << 63, 90).astype(np.uint64))
        h = h[m.find(h) < 0]
        width = r.integers(0, 4, len(h))
        ids = r.integers(0, 1 << 32, int(width.sum())).astype(np.uint32)
        length = r.integers(1, 9, len(h))
        text = r.integers(0, 256, int(length.sum())).astype(np.uint8)
        m.add(h, width, ids, length, text)
        held.update(zip(h.tolist(), zip(np.split(ids, np.cumsum(width)[:-1]), np.split(text, np.cumsum(length)[:-1]), strict=True)))
        slot = m.find(np.array(list(held), np.uint64))
        assert (slot >= 0).sum() == m.held <= 500
        for key, s in zip(list(held), slot.tolist()):
            if s >= 0:
                ids, text = held[key]
                assert np.array_equal(m.store[m.at[s] : m.at[s] + m.width[s]], ids)
                one, n = np.array([s]), np.array([len(text)])
                assert m.equal(one, text, np.zeros(1, int), n).all() and not m.equal(one, text + np.uint8(1), np.zeros(1, int), n).any()
    m.add(np.arange(1, 2000, dtype=np.uint64), np.ones(1999, int), np.arange(1999).astype(np.uint32), np.ones(1999, int), np.ones(1999, np.uint8))
    assert m.held <= 500
    calls = []
    c = PieceCoder(USUAL, lambda new: [calls.append(p) or np.array([len(p), ord(p[0])], "<u4").tobytes() for p in new], 20)
    texts = ["a b c d", None, "", "x" * 9 + " a", "日本 a", " ".join(map(str, range(60))), "a b"]
    for t, ids in zip(texts * 2, c.encode(texts * 2), strict=True):
        assert ids.tolist() == [x for p in regex.findall(PATTERN, t or "") for x in (len(p), ord(p[0]))]


def test_deep_rules_expand_in_place():
    """A rule in a rule, 3,000 deep, among many plain ids: a round touches only what is left to expand."""
    first, deep, plain = 10, 3000, np.full(500_000, 3, np.uint32)
    reader = token_shards.ShardReader(token_shards.write_shard([np.zeros(1, np.uint32)], first))
    reader.rules = np.array([(first + k - 1 if k else 1, 2) for k in range(deep)], np.uint32)
    reader.lengths = np.arange(2, deep + 2)
    began = time.process_time()
    got = reader.expand(np.concatenate([plain, [first + deep - 1, 4]]).astype(np.uint32))
    assert time.process_time() - began < 2
    assert got[len(plain) :].tolist() == [1] + [2] * deep + [4] and (got[: len(plain)] == plain).all()
