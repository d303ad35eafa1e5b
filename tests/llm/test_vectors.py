"""Embedding near-dedup against brute force."""

import numpy as np
import pytest

from keyloom.llm import cover_tree as ct
from keyloom.llm.common import ship


def _brute(rows):
    good = {}
    for i, (_, v) in enumerate(rows):
        if v and None not in v and np.isfinite(v).all() and any(v):
            x = np.array(v, np.float32).astype(float)
            good[i] = x / np.sqrt((x * x).sum())
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(good)
    for dim in {len(good[i]) for i in keys}:
        own = [i for i in keys if len(good[i]) == dim]
        X = np.array([good[i] for i in own])
        for a, b in zip(*np.nonzero(np.triu(X @ X.T >= ct.COSINE, 1))):
            links[own[a]] += 1
            links[own[b]] += 1
            root[find(own[a])] = find(own[b])
    names = {}
    for i, (v, _) in enumerate(rows):
        if v is not None:
            names[find(i)] = min(names.get(find(i), v), v)
    return sorted(((v, links[i], names.get(find(i)), v == names.get(find(i))) for i, (v, _) in enumerate(rows)), key=repr)


def _rows(r, n=700, dim=12):
    X = r.normal(size=(n, dim))
    X[100:300] = X[0] + 0.12 * r.normal(size=(200, dim))
    X[300:350] = X[0] + 0.3 * r.normal(size=(50, dim))
    X[350:450] = X[5] + 0.02 * r.normal(size=(100, dim))
    X[450:500] = X[7]
    return [(int(i), [float(y) for y in x]) for i, x in enumerate(X.astype(np.float32))]


@pytest.mark.parametrize("block,queries,ball", [(4096, 65536, 64), (60, 100, 16), (33, 50, 8)])
def test_links_equal_brute_force(spark, monkeypatch, block, queries, ball):
    ship(spark)
    monkeypatch.setattr(ct, "BLOCK", block)
    monkeypatch.setattr(ct, "QUERIES", queries)
    monkeypatch.setattr(ct, "BALL", ball)
    rows = _rows(np.random.default_rng(block))
    rows += [(2000, None), (2001, []), (2002, [0.0] * 12), (2003, [1.0, None] * 6), (2004, [float("nan")] * 12), (2005, [1.0, 2.0]), (2006, [2.0, 4.0]), (2007, [2.0, 4.0]), (2007, [1.0, -1.0]), (None, [1.0, 2.0]), (2008, [1e30, 2e30]), (2009, [1e-40, 2e-40])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "0 AS h", "1 AS n_links").repartition(3)
    got = sorted((tuple(r) for r in ct.near_duplicates(df).collect()), key=repr)
    assert got == _brute(rows)


def test_empty_and_invalid(spark):
    df = spark.createDataFrame([(1, None)], "vec_id bigint, embedding array<float>")
    assert [tuple(r) for r in ct.near_duplicates(df).collect()] == [(1, 0, 1, True)]
    assert ct.near_duplicates(df.where("false")).count() == 0


def test_tree_covers_and_nests():
    r = np.random.default_rng(3)
    X = r.normal(size=(900, 16))
    X[:400] = X[0] + 0.05 * r.normal(size=(400, 16))
    X /= np.linalg.norm(X, axis=1, keepdims=True)
    t = ct.CoverTree(X)
    assert sorted(t.order) == list(range(900)) and t.root.children

    def walk(n):
        own = X[t.order[n.lo : n.hi]]
        assert (np.linalg.norm(own - n.centre, axis=1) <= n.radius + 1e-9).all()
        assert not n.children or (n.children[0].lo, n.children[-1].hi) == (n.lo, n.hi)
        for c in n.children:
            walk(c)

    walk(t.root)


def test_recall_is_whole_on_fixture(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], list(r["embedding"])) for r in df.collect()]
    assert sorted((tuple(r) for r in ct.near_duplicates(df).collect()), key=repr) == _brute(rows)
