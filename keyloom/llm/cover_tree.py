"""Embedding near-dedup: exact cosine-threshold links by covering-radius bounds.

For unit vectors a cosine of at least COSINE is a distance of at most TAU. A cover tree has nested levels with halving
radii: the balls of a level that hold enough points become nodes, the rest stays one node of its own. Two nodes whose
centres lie further apart than both radii plus TAU hold no link; two that lie within TAU with both radii link fully
and are counted without looking inside; only what remains is compared vector by vector.

The top of the tree comes from a bounded sample; every vector is then put into its cell, and its cell's true covering
radius is taken over all members. Cells are cut into blocks; a vector goes, as a query, to the blocks of later cells
that its distance to their centre cannot rule out. In each task the block's own tree meets the tree of each chunk of
queries, both opened where they must be. Cells narrow enough link fully and need no comparison inside, so a hot group of near-equal vectors costs its
size. Equal vectors are one node with a weight.

In high dimension, vectors that are all about equally far apart cannot be pruned by any radius: the work among them
is quadratic in their number, done in matrix products.

Cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of
different length never link; repeated vec_ids are vectors of their own; null vec_ids do not name components; an empty
table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import Scratch, clashes, connected_components

COSINE = 0.9
#: Sampled vectors for the top of the tree; members of a block; queries that one task meets; queries of a chunk.
SAMPLE, BLOCK, QUERIES, CHUNK = 4096, 4096, 65_536, 2048
#: Least points of a ball that becomes a node, smallest radius of a level, and the margin of the bounds.
BALL, FINEST, EPS = 64, 0.04, 1e-6


def tau(cosine: float) -> float:
    return float(np.sqrt(2 - 2 * cosine))


@dataclass
class Node:
    centre: np.ndarray
    radius: float
    lo: int
    hi: int
    children: list[Node] = field(default_factory=list)

    def leaves(self) -> Iterator[Node]:
        if not self.children:
            yield self
        for c in self.children:
            yield from c.leaves()


class CoverTree:
    """Nodes are ranges of `order`, a permutation of the rows of X (unit vectors)."""

    def __init__(self, X: np.ndarray, ball: int = BALL):
        self.X, self.ball, self.order = X, ball, np.arange(len(X))
        centre = X.mean(0) if len(X) else np.zeros(0)
        self.root = self._node(centre, 0, len(X))
        if len(X):
            self._grow(self.root)

    def _node(self, centre: np.ndarray, lo: int, hi: int) -> Node:
        own = self.X[self.order[lo:hi]]
        return Node(centre, float(np.sqrt(((own - centre) ** 2).sum(1).max())) if hi > lo else 0.0, lo, hi)

    def _grow(self, node: Node) -> None:
        n, r = node.hi - node.lo, node.radius / 2
        if n < 2 * self.ball or r < FINEST:
            return
        idx = self.order[node.lo : node.hi]
        own = self.X[idx].astype(np.float32)
        near = own @ own.T
        left, balls = np.ones(n, bool), []
        while r >= FINEST and left.sum() >= self.ball:
            close = near >= 1 - r * r / 2
            while True:
                reach = close @ left.astype(np.float32) * left
                c = int(reach.argmax())
                if reach[c] < self.ball:
                    break
                take = close[c] & left
                balls.append((idx[c], np.flatnonzero(take)))
                left &= ~take
            r /= 2
        if not balls or (len(balls) == 1 and len(balls[0][1]) == n and node.radius <= 2 * FINEST):
            return
        at, parts = node.lo, []
        new = np.concatenate([*(b for _, b in balls), np.flatnonzero(left)])
        self.order[node.lo : node.hi] = idx[new]
        for c, b in balls:
            parts.append((self.X[c], at, at + len(b)))
            at += len(b)
        if at < node.hi:
            parts.append((node.centre, at, node.hi))
        node.children = [self._node(*p) for p in parts]
        for child, (c, _) in zip(node.children, balls, strict=False):
            if child.radius < 0.75 * node.radius:
                self._grow(child)


def meet(tree: CoverTree, asked: CoverTree, cosine: float = COSINE) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(queries, members, whole): whole: every one links with every other; else the pairs, entry by entry.

    A dual traversal: a pair of nodes that neither bound settles is opened on the side of the larger radius, and only
    pairs of leaves are compared, first each query with the node, then vector by vector.
    """
    t, Q = tau(cosine), asked.X
    stack = [(tree.root, asked.root)]
    Q32 = Q.astype(np.float32)
    while stack:
        node, own = stack.pop()
        if own.hi == own.lo or node.hi == node.lo:
            continue
        gap = np.sqrt(((own.centre - node.centre) ** 2).sum())
        if gap > own.radius + node.radius + t + EPS:
            continue
        q, members = asked.order[own.lo : own.hi], tree.order[node.lo : node.hi]
        if gap + own.radius + node.radius <= t - EPS:
            yield q, members, True
            continue
        if node.children and (not own.children or node.radius >= own.radius):
            stack += [(c, own) for c in node.children]
            continue
        if own.children:
            stack += [(node, c) for c in own.children]
            continue
        d = np.sqrt(np.maximum(((Q[q] - node.centre) ** 2).sum(1), 0))
        whole = d + node.radius <= t - EPS
        if whole.any():
            yield q[whole], members, True
        q = q[~whole & (d <= node.radius + t + EPS)]
        if len(q):
            M = tree.X[members]
            a, b = np.nonzero(Q32[q] @ M.astype(np.float32).T >= cosine - 1e-5)
            exact = np.einsum("ij,ij->i", Q[q[a]], M[b]) >= cosine
            yield q[a[exact]], members[b[exact]], False


class Links:
    """Weights of the links of a block's members and, chunk by chunk, of queries; components among members."""

    def __init__(self, X: np.ndarray, weight: np.ndarray, cosine: float):
        self.tree, self.weight, self.cosine = CoverTree(X), weight, cosine
        self.count, self.label = np.zeros(len(X), np.int64), np.arange(len(X))

    def ask(self, Q: np.ndarray, weight: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(weight of links, a linked member or -1) of each query; own: the queries' places if they are members."""
        count, label = np.zeros(len(Q), np.int64), np.full(len(Q), len(self.label))
        found = list(meet(self.tree, CoverTree(Q), self.cosine))
        for q, m, whole in found:
            if whole:
                count[q] += self.weight[m].sum()
                if own is None:
                    self.count[m] += weight[q].sum()
            else:
                np.add.at(count, q, self.weight[m])
                if own is None:
                    np.add.at(self.count, m, weight[q])
        while True:
            before = self.label.copy()
            for q, m, whole in found:
                if not len(q) or not len(m):
                    continue
                if whole:
                    low = min(self.label[m].min(), label[q].min())
                    self.label[m], label[q] = low, low
                else:
                    np.minimum.at(label, q, self.label[m])
                    np.minimum.at(self.label, m, label[q])
            self.label = self.label[self.label]
            if (before == self.label).all():
                break
        for q, m, whole in found:
            if len(q) and len(m):
                if whole:
                    label[q] = np.minimum(label[q], self.label[m].min())
                else:
                    np.minimum.at(label, q, self.label[m])
        if own is not None:
            self.count[own] += count - self.weight[own]  # every vector finds itself
        return count, np.where(label == len(self.label), -1, label)


def _unit(raw: list[bytes], dim: int) -> np.ndarray:
    """Unit rows, in double precision, of packed vectors of 32 or 64 bits a component."""
    X = np.frombuffer(b"".join(raw), "<f4" if raw and len(raw[0]) == 4 * dim else "<f8").reshape(len(raw), dim).astype(np.float64)
    top = np.abs(X).max(1, keepdims=True)
    X /= np.where(top == 0, 1, top)
    return X / np.sqrt((X * X).sum(1, keepdims=True))


def pack(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, vec): packed vectors, in the precision of the column, NULL where a vector cannot link."""
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    packed = "<f4" if kind == "float" else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, dims = [], []
            for v in b.column("embedding"):
                x = None
                if v.is_valid and len(v.values) and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False).astype(packed) + np.zeros(1, packed)  # no negative zero
                    x = x if np.isfinite(x).all() and x.any() else None
                out.append(None if x is None else x.tobytes())
                dims.append(None if x is None else len(x))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], names=["vec_id", "dim", "vec"])

    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    return rows.mapInArrow(run, "vec_id bigint, dim int, vec binary")


def _linked(nodes: DataFrame, dim: int, scratch: Scratch, cosine: float) -> DataFrame:
    """(h, n, root): weights of links found for node h, and a node that it is connected with; nodes: (h, w, vec)."""
    t, spark = tau(cosine), nodes.sparkSession
    sample = nodes.orderBy("h").limit(SAMPLE).toArrow()  # h is a hash: a random sample
    tree = CoverTree(_unit(sample.column("vec").to_pylist(), dim))
    leaves = [x for x in tree.root.leaves() if x.radius < 0.5]
    centres = np.array([tree.root.centre, *(x.centre for x in leaves)])
    reach = np.array([np.inf, *(x.radius for x in leaves)])
    top = spark.sparkContext.broadcast((centres, reach))  # at most SAMPLE / BALL centres or so

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, far = top.value
        for b in batches:
            if not b.num_rows:
                continue
            X = _unit(b.column("vec").to_pylist(), dim)
            d = np.sqrt(np.maximum((X**2).sum(1)[:, None] - 2 * X @ c.T + (c**2).sum(1), 0))
            cell = np.where(d <= far, d, np.inf)
            cell[:, 0] = 10.0  # the rest, if no ball takes it
            cell = cell.argmin(1)
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("w"), b.column("vec"), pa.array(cell, pa.int32()), pa.array(np.sqrt(((X - c[cell]) ** 2).sum(1)))], names=["h", "w", "vec", "cell", "d"])

    placed = scratch.keep(nodes.mapInArrow(place, "h long, w long, vec binary, cell int, d double"))
    cells = {r["cell"]: r for r in placed.groupBy("cell").agg(F.max("d").alias("radius"), F.count("*").alias("n"), F.sum("w").alias("w"), F.min("h").alias("h")).collect()}  # a row for each centre
    k, total = len(centres), sum(r["n"] for r in cells.values())
    radius = np.array([cells[i]["radius"] if i in cells else -10.0 for i in range(k)])
    blocks = np.array([-(-cells[i]["n"] // BLOCK) if i in cells else 0 for i in range(k)])
    narrow = (radius >= 0) & (2 * radius <= t - EPS)
    shares = -(-total // QUERIES) if total else 1
    plan = spark.sparkContext.broadcast((radius, blocks, narrow))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (c, _), (radius, blocks, narrow) = top.value, plan.value
        first = np.concatenate([[0], np.cumsum(blocks)])
        names = ["block", "share", "kind", "cell", "h", "w", "vec"]
        for b in batches:
            if not b.num_rows:
                continue
            X, h, cell = _unit(b.column("vec").to_pylist(), dim), b.column("h").to_numpy(), b.column("cell").to_numpy()
            mix = (h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
            own = (mix % blocks[cell].astype(np.uint64)).astype(np.int64)
            share = ((mix >> np.uint64(22)) % np.uint64(shares)).astype(np.int64)
            d = np.sqrt(np.maximum((X**2).sum(1)[:, None] - 2 * X @ c.T + (c**2).sum(1), 0))
            goes = (d <= radius + t + EPS) & (np.arange(len(radius)) > cell[:, None])
            dealt = [(first[cell] + own, s, 0, np.arange(len(h))) for s in np.full(shares, 0) + np.arange(shares)]
            for other in range(len(radius)):
                to = np.flatnonzero(goes[:, other])
                dealt += [(np.full(len(to), first[other] + j), share[to], 1, to) for j in range(blocks[other])]
                if not narrow[other]:
                    for j in range(1, blocks[other]):
                        to = np.flatnonzero((cell == other) & (own < j))
                        dealt.append((np.full(len(to), first[other] + j), share[to], 1, to))
            for block, s, kind, at in dealt:
                if len(at):
                    rows = b.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(np.broadcast_to(s, len(at)), pa.int32()), pa.array(np.full(len(at), kind), pa.int32()), rows.column("cell"), rows.column("h"), rows.column("w"), rows.column("vec")], names=names)

    rows = placed.mapInArrow(deal, "block long, share int, kind int, cell int, h long, w long, vec binary")
    rows = rows.repartition("block", "share").sortWithinPartitions("block", "share", "kind", "cell")
    narrow_blocks = frozenset(int(x) for i in range(k) if narrow[i] for x in range(int(blocks[:i].sum()), int(blocks[: i + 1].sum())))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {"group": None}

        def result(h, n, root) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(n, pa.int64()), pa.array(root, pa.int64())], names=["h", "n", "root"])

        def start() -> None:
            """All members are there: build the block's tree; members among themselves in the first share."""
            if state["links"] is not None or not state["mh"]:
                return
            state["mh"] = np.array(state["mh"])
            links = state["links"] = Links(_unit(state["mv"], dim), np.array(state["mw"]), cosine)
            state["mv"] = None
            if state["group"][1] == 0 and state["group"][0] not in narrow_blocks:
                X = links.tree.X
                for i in range(0, len(X), CHUNK):
                    own = np.arange(i, min(i + CHUNK, len(X)))
                    links.ask(X[own], links.weight[own], own)

        def ask() -> Iterator[pa.RecordBatch]:
            if state["qh"]:
                start()
                links, h = state["links"], np.array(state["qh"])
                if links is not None:
                    n, label = links.ask(_unit(state["qv"], dim), np.array(state["qw"]))
                    hit = label >= 0
                    if hit.any():
                        yield result(h[hit], n[hit], state["mh"][label[hit]])
                state["qh"], state["qw"], state["qv"] = [], [], []

        def finish() -> Iterator[pa.RecordBatch]:
            if state["group"] is not None:
                yield from ask()
                start()
                links = state["links"]
                if links is not None:
                    hit = (links.count > 0) | (links.label != np.arange(len(links.label)))
                    if hit.any():
                        yield result(state["mh"][hit], links.count[hit], state["mh"][links.label[hit]])

        for b in batches:
            for block, share, kind, cell, h, w, vec in zip(*(b.column(x).to_pylist() for x in ("block", "share", "kind", "cell", "h", "w", "vec")), strict=True):
                if (block, share) != state["group"]:
                    yield from finish()
                    state = {"group": (block, share), "links": None, "mh": [], "mw": [], "mv": [], "qh": [], "qw": [], "qv": [], "cell": None}
                side = "m" if kind == 0 else "q"
                if side == "q" and (len(state["qh"]) >= CHUNK or cell != state["cell"]):
                    yield from ask()
                    state["cell"] = cell
                state[side + "h"].append(h)
                state[side + "w"].append(w)
                state[side + "v"].append(vec)
        yield from finish()

    found = rows.mapInArrow(compare, "h long, n long, root long")
    whole = [(i, int(cells[i]["w"]), int(cells[i]["h"])) for i in range(k) if narrow[i]]
    if whole:
        full = F.broadcast(spark.createDataFrame(whole, "cell int, _w long, root long"))  # at most a row for each centre
        found = found.unionByName(placed.join(full, "cell").select("h", (F.col("_w") - F.col("w")).alias("n"), "root"))
    return scratch.keep(found)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector (vec_id, embedding)."""
    scratch = Scratch(vectors.sparkSession)
    packed = scratch.keep(pack(vectors).withColumn("h", F.when(F.col("vec").isNotNull(), F.xxhash64("vec"))))
    clash = sorted(clashes(packed.withColumn("_check", F.xxhash64(F.lit(1), "vec")), "h", "_check"))
    if clash:
        packed = packed.withColumn("h", F.when(F.col("h").isin(clash), F.xxhash64(F.lit(1), "vec")).otherwise(F.col("h")))
    found = None
    for dim in sorted(r[0] for r in packed.where("dim IS NOT NULL").select("dim").distinct().collect()):
        nodes = scratch.keep(packed.where(F.col("dim") == dim).groupBy("h").agg(F.count("*").alias("w"), F.first("vec").alias("vec")))
        one = _linked(nodes, dim, scratch, cosine)
        found = one if found is None else found.unionByName(one)
    rows = packed.select("vec_id", "h")
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    roots = scratch.keep(connected_components(found.select(F.col("h").alias("a"), F.col("root").alias("b")), scratch).select(F.col("node").alias("h"), F.col("root").alias("c")))
    sums = found.groupBy("h").agg(F.sum("n").alias("n"))
    equal = rows.where("h IS NOT NULL").groupBy("h").agg(F.count("*").alias("w"), F.min("vec_id").alias("least"))
    known = equal.join(sums, "h", "left").join(roots, "h", "left").select("h", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("c", "h").alias("c"), "least")
    known = scratch.keep(known)
    names = known.groupBy("c").agg(F.min("least").alias("component_id"))
    known = scratch.keep(known.join(names, "c").select("h", "n_links", "component_id"))
    out = rows.join(known, "h", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
