"""N-gram Jaccard join by a token-group matrix.

Similar documents are put into groups; the matrix says which groups hold which tokens (shingles). A query document
opens a group only if its overlap with the group's token union can reach the threshold.

1. Tokens get a global order in which frequent ones stand last. Of a set of n shingles the first n - ceil(.75 n) + l
   matter (l = 1 + n // 20): two sets at the threshold share at least least(l, l') tokens among these.
2. Tokens of at least two sets are found by one sort. Each set is checked against the leaders (first sets) of its
   tokens, if it shares enough of them; what passes forms components.
3. Groups: the sets that share most tokens with the same leader, linked or not, in blocks of about BLOCK.
4. Matrix: (token, block) over tokens that more than one component holds. A query counts its tokens per block with
   another component; blocks below the bound stay closed. Open ones are checked with the full sets: first the overlap
   with the block's union, then a member of each component that is not yet linked with the query's. A link joins
   whole components, so their other pairs need no check: the components are those of all pairs.

Documents with equal sets are one class from the start. No step makes all pairs of a group.

Cases: null or empty text has no shingles and links with nothing; fewer words than a shingle make one shingle;
repeated rows fall into one class; null doc_ids do not name components unless they are all it has; an empty table
gives no rows; extra columns are not read, and kept by `keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import Scratch, clashes, connected_components, row_key
from keyloom.llm.shingles import check_of, hash_words, let_go, name_of, release, shingle_set

#: Threshold as a fraction, words of a shingle.
NUM, DEN, WORDS = 3, 4, 5
#: Sets in a block, queries that meet a block in one task.
BLOCK, QUERIES = 64, 512
#: Frequent tokens that are ordered last, at most, and the count that makes one: only the order depends on them.
HOT, HOT_AT = 200_000, 16
#: Rows up to which a small side is broadcast; beyond, it is joined by shuffle.
SMALL = 200_000


def least_overlap(n):
    """Least intersection of a set of n with any set at the threshold."""
    return -(-NUM * n // DEN)


def slack(n):
    return 1 + n // 20


def _sets(texts: list[str | None]) -> list[np.ndarray]:
    return [shingle_set(h, WORDS) for h in hash_words(texts)]


def hot_tokens(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent tokens (sorted) and their levels: repeats within stretches of the input, added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        held, n = [], 0

        def out() -> pa.RecordBatch:
            token, count = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            more = count >= 2
            return pa.RecordBatch.from_arrays([pa.array(token[more].view(np.int64)), pa.array(count[more], pa.int64())], names=["token", "n"])

        for b in batches:
            for s in _sets(b.column("text").to_pylist()):
                held.append(s)
                n += len(s)
                if n > 2_000_000:
                    yield out()
                    held, n = [], 0
        yield out()
        held = []
        release()

    counted = docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_AT)
    top = counted.orderBy(F.col("n").desc(), "token").limit(HOT).toArrow()
    token, n = top.column("token").to_numpy().astype(np.int64).view(np.uint64), top.column("n").to_numpy().astype(np.int64)
    order = np.argsort(token)
    return token[order], np.log2(np.maximum(n[order], 1)).astype(np.int8)


def signatures(docs: DataFrame, hot: tuple[np.ndarray, np.ndarray], clash: frozenset = frozenset()) -> DataFrame:
    """(_d, _k, doc_id, c, check, n, prefix): row name, class of the set (null without shingles) and a second hash of it,
    its size, its leading tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)  # at most HOT entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, level = shared.value
        for b in batches:
            cs, checks, ns, flat, ends = [], [], [], [], [0]
            for s in _sets(b.column("text").to_pylist()):
                n = len(s)
                cs.append(name_of(s, clash) if n else None)
                checks.append(check_of(s) if n else None)
                ns.append(n)
                take = n - int(least_overlap(n)) + slack(n) if n else 0
                if n and len(token):
                    at = np.minimum(np.searchsorted(token, s), len(token) - 1)
                    frequent = token[at] == s
                    if frequent.any():
                        late = s[frequent]
                        s = np.concatenate([s[~frequent], late[np.argsort(level[at[frequent]], kind="stable")]])
                flat.append(s[:take])
                ends.append(ends[-1] + min(take, n))
            values = np.concatenate(flat).view(np.int64) if flat else np.zeros(0, np.int64)
            prefix = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays([b.column("_d"), b.column("_k"), b.column("doc_id"), pa.array(cs, pa.int64()), pa.array(checks, pa.int64()), pa.array(ns, pa.int64()), prefix], names=["_d", "_k", "doc_id", "c", "check", "n", "prefix"])
        release()

    rows = docs.select(*row_key(), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, "_d long, _k long, doc_id bigint, c long, check long, n long, prefix array<bigint>")


def shared_tokens(signed: DataFrame) -> DataFrame:
    """(token, c, n, leader) for tokens of two classes or more; leader: the first class of the token.

    Reads sorted rows as a stream and holds one row, whatever the length of a token's run.
    """
    rows = signed.where("c IS NOT NULL").select(F.explode("prefix").alias("token"), "c", "n")
    rows = rows.repartition("token").sortWithinPartitions("token", "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None  # token, class and size of the open run's first row, and whether it has been given out
        last = None
        for b in batches:
            t, c, n = (b.column(x).to_numpy() for x in ("token", "c", "n"))
            if not len(t):
                continue
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1])
            if last is not None:
                new[0] = (t[0], c[0]) != last
            last = (t[-1], c[-1])
            t, c, n = t[new], c[new], n[new]
            if not len(t):
                continue
            given = False
            if head is not None:
                t, c, n, given = np.insert(t, 0, head[0]), np.insert(c, 0, head[1]), np.insert(n, 0, head[2]), head[3]
            begins = np.ones(len(t), bool)
            begins[1:] = t[1:] != t[:-1]
            first = np.maximum.accumulate(np.where(begins, np.arange(len(t)), 0))
            follows = ~begins
            emit = follows.copy()
            emit[:-1] |= begins[:-1] & follows[1:]
            at = first[-1]
            if given:
                emit[0] = False
            head = (t[at], c[at], n[at], bool(emit[at]) or (at == 0 and given))
            if emit.any():
                lead = c[first]
                yield pa.RecordBatch.from_arrays([pa.array(t[emit]), pa.array(c[emit]), pa.array(n[emit]), pa.array(lead[emit])], names=["token", "c", "n", "leader"])

    return rows.mapInArrow(run, "token long, c long, n long, leader long")


def full_sets(docs: DataFrame, signed: DataFrame, classes: DataFrame, clash: frozenset) -> DataFrame:
    """(c, tokens) of the asked classes, from the text of one row of each; other rows of its name are seen and left out."""
    need = signed.select("c", "_k").join(classes, "c", "left_semi").groupBy("c").agg(F.min("_k").alias("_k"))
    small = classes.count() <= SMALL
    rows = docs.select(F.xxhash64("doc_id", "text").alias("_k"), "text").join(F.broadcast(need) if small else need, "_k").select("c", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(c, s.tobytes()) for c, s in zip(b.column("c").to_pylist(), _sets(b.column("text").to_pylist()), strict=True) if len(s) and name_of(s, clash) == c]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["c", "tokens"])

    return rows.mapInArrow(run, "c long, tokens binary").dropDuplicates(["c"])


def links(asked: DataFrame, members: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): for every asked (c, root, g) a link from query c into each component of block g that it links with.
    members: (g, c, root). Members of c's own component, or of one already linked, need no check.

    A block with many queries is copied to several tasks, with its members, at most BLOCK or so sets.
    """
    load = asked.groupBy("g").agg((F.floor(F.count("*") / QUERIES) + 1).cast("int").alias("shares"))
    own = members.join(load, "g").select("g", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("kind"), "c", "root")
    ask = asked.join(load, "g").select("g", F.pmod(F.xxhash64("c"), F.col("shares")).cast("int").alias("share"), F.lit(1).alias("kind"), "c", "root")
    rows = own.unionByName(ask).join(sets, "c").repartition("g", "share").sortWithinPartitions("g", "share", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, held, union, up = None, [], None, {}

        def find(r: int) -> int:
            """The component that r belongs to by the links of this block."""
            while (above := up.get(r, r)) != r:
                r = above
            return r

        for b in batches:
            found = []
            for g, share, kind, c, root, tokens in zip(*(b.column(x).to_pylist() for x in ("g", "share", "kind", "c", "root", "tokens")), strict=True):
                if (g, share) != open_:
                    open_, held, union, up = (g, share), [], None, {}
                s = np.frombuffer(tokens, np.uint64)
                if kind == 0:
                    held.append((c, root, s))
                    continue
                if union is None:
                    union = np.unique(np.concatenate([m for _, _, m in held])) if held else np.zeros(0, np.uint64)
                n = len(s)
                if _common(s, union) < least_overlap(n):
                    continue
                own = find(root)
                for m, r, t in held:
                    if DEN * len(t) >= NUM * n and DEN * n >= NUM * len(t) and find(r) != own:
                        both = _common(s, t)
                        if DEN * both >= NUM * (n + len(t) - both):
                            found.append((c, m))
                            up[find(r)] = own
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])
        open_, held, union = None, [], None
        release()

    return rows.select("g", "share", "kind", "c", "root", "tokens").mapInArrow(run, "a long, b long")


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if not len(a) or not len(b):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _components(signed: DataFrame, docs: DataFrame, clash: frozenset, scratch: Scratch) -> DataFrame:
    """(c, root) for the classes that have links."""
    shared = scratch.keep(shared_tokens(signed))
    # Each class against the leaders of its tokens: the first links, which most of a group's others follow from.
    l_c = 1 + F.floor(F.col("n") / 20)
    stars = scratch.keep(shared.where("c <> leader").groupBy("c", "n", "leader").agg(F.count("*").alias("both")))
    asked = scratch.keep(stars.where(2 * F.col("both") >= l_c).select("c", F.col("c").alias("root"), F.col("leader").alias("g")))
    leaders = asked.select("g").distinct().select("g", F.col("g").alias("c"), F.col("g").alias("root"))
    classes = scratch.keep(asked.select("c").unionByName(leaders.select("c")).distinct())
    sets = scratch.keep(full_sets(docs, signed, classes, clash))
    edges = scratch.keep(links(asked, leaders, sets))
    roots = scratch.keep(connected_components(edges, scratch).select(F.col("node").alias("c"), "root"))
    scratch.drop(sets, classes, asked)
    # Groups of similar documents, linked or not: those of the leader that they share most tokens with, in blocks.
    near = stars.groupBy("c").agg(F.max_by("leader", F.struct("both", "leader")).alias("near"))
    placed = shared.select("c", "n").distinct().join(near, "c", "left").join(roots, "c", "left")
    placed = scratch.keep(placed.select("c", "n", F.coalesce("root", "c").alias("root"), F.coalesce("near", "c").alias("near")))
    size = placed.groupBy("near").agg((F.floor(F.count("*") / BLOCK) + 1).alias("blocks"))
    block = F.when(F.col("blocks") == 1, F.col("near")).otherwise(F.xxhash64("near", F.pmod(F.xxhash64("c"), F.col("blocks"))))
    placed = scratch.keep(placed.join(size, "near").select("c", "n", "root", block.alias("own")))
    # Matrix over tokens that more than one component holds.
    held = shared.select("token", "c").join(placed, "c")
    mixed = held.groupBy("token").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).where("_a < _b").select("token")
    held = scratch.keep(held.join(mixed, "token"))
    matrix = held.groupBy("token", F.col("own").alias("g")).agg(F.min("root").alias("_a"), F.max("root").alias("_b"), F.min("n").alias("low"), F.max("n").alias("high"))
    met = held.join(matrix, "token").where((F.col("own") >= F.col("g")) & ((F.col("_a") != F.col("root")) | (F.col("_b") != F.col("root"))) & (DEN * F.col("high") >= NUM * F.col("n")) & (DEN * F.col("n") >= NUM * F.col("low")))
    bound = F.least(l_c, 1 + F.floor(F.col("low") / 20))
    asked = met.groupBy("c", "n", "root", "g").agg(F.count("*").alias("both"), F.min("low").alias("low")).where(F.col("both") >= bound).select("c", "root", "g")
    asked = scratch.keep(asked)
    members = placed.select(F.col("own").alias("g"), "c", "root").join(asked.select("g").distinct(), "g", "left_semi")
    members = scratch.keep(members)
    classes = scratch.keep(asked.select("c").unionByName(members.select("c")).distinct())
    sets = scratch.keep(full_sets(docs, signed, classes, clash))
    more = scratch.keep(links(asked, members, sets))
    out = scratch.keep(connected_components(edges.unionByName(more), scratch).select(F.col("node").alias("c"), "root"))
    scratch.drop(shared, stars, edges, roots, placed, held, asked, members, classes, sets, more)
    return out


def components(docs: DataFrame) -> DataFrame:
    """(_d, _k, doc_id, n_shingles, component_id, root) of every document (doc_id, text)."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    hot = hot_tokens(docs)
    signed = scratch.keep(signatures(docs, hot))
    clash = clashes(signed, "c", "check")
    if clash:
        signed = scratch.keep(signatures(docs, hot, clash))
    roots = _components(signed, docs, clash, scratch)
    rows = signed.select("_d", "_k", "doc_id", "c", "n").join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
    rows = scratch.keep(rows)
    names = rows.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(names, "root", "left").select("_d", "_k", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "root")


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document (doc_id, text)."""
    return components(docs).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each component: the smallest doc_id. Documents without shingles stay, and columns of
    any name."""
    scratch, key = Scratch(docs.sparkSession), ["_d", "_k"]
    placed = scratch.keep(components(docs))
    small = lambda rows: F.broadcast(rows) if rows.count() <= SMALL else rows
    named = placed.where("root IS NOT NULL").groupBy("root", *key).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    named = scratch.keep(named)
    chosen = named.groupBy("root").agg(F.min(F.struct("doc_id", "_k", "_d")).alias("_best"), F.count("*").alias("_n")).where("_n > 1")
    others = named.join(chosen, "root").where((F.col("_k") != F.col("_best._k")) | (F.col("_d") != F.col("_best._d")))
    gone = scratch.keep(others.select(*key))
    out = docs.select(F.struct(*docs.columns).alias("row"), *row_key()).join(small(gone), key, "left_anti")
    twice = scratch.keep(named.where("copies > 1").select(*key).join(gone, key, "left_anti"))
    if not twice.isEmpty():  # equal rows: the one that stays is there more than once
        mark = out.join(small(twice), key, "left_semi").dropDuplicates(key)
        out = out.join(small(twice), key, "left_anti").unionByName(mark)
    return out.select("row.*")
