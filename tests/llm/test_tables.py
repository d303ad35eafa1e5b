"""Source mixing and URL filter against brute force."""

import re
from collections import defaultdict

import pytest

from keyloom.llm import mixing, url_filter


def _targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        free = sum(w[s] for s in names if s not in capped)
        t = {s: 3.0 * sizes[s] if s in capped else left * w[s] / free for s in names}
        over = {s for s in names if s not in capped and t[s] > 3 * sizes[s]}
        if not over:
            return t
        capped |= over


def test_mix(docs, rows, empty, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE", 16)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    count = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    sizes = defaultdict(int)
    for _, s, t in rows:
        sizes[s] += count(t)
    want, taken = _targets(sizes), defaultdict(int)
    assert sorted(((r["doc_id"], r["size"]) for r in got), key=repr) == sorted(((i, count(t)) for i, _, t in rows), key=repr)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"])
        taken[r["source"]] += r["taken"]
    largest = max(r["size"] for r in got)
    assert all(abs(taken[s] - want[s]) <= largest for s in want) and sum(taken.values()) <= sum(sizes.values())
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs.repartition(7)).collect()))
    assert mixing.mix(empty).count() == 0


def test_mixed_rows_follow_taken(docs):
    copies = defaultdict(int)
    for r in mixing.mix(docs).collect():
        copies[r["doc_id"]] += r["copies"]
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    seen = defaultdict(int)
    for r in out.collect():
        seen[r["doc_id"]] += 1
    assert dict(seen) == {k: v for k, v in copies.items() if v}


def test_targets_cap(spark):
    rows = [("a", 1), ("b", 1000), ("c", 10), (None, 0), ("d", 500)]
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(rows, "source string, size bigint")).collect()}
    assert got == pytest.approx(_targets(dict(rows)))


def _rule(host, path):
    best = None
    for v, r in url_filter.RULES:
        h, _, p = r.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(r) > len(best[1])):
            best = (v, r)
    return best


def test_url_filter(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    odd = [(9001, None), (9002, "no scheme"), (9003, "HTTP://WWW.Example.COM/en/x?y://z/"), (9004, "x://"), (9005, "x://a.com"), (9006, "x://example.com?/en/"), (9007, "a://b://c/d#e"), (None, "http://ÄB.net/es/"), (9008, "h://n.net/fr"), (9009, "h://" + "p" * 20000 + ".net/fr/"), (9003, "HTTP://WWW.Example.COM/en/x?y://z/"), (9010, "h://a\n.b/c\nd?e")]
    pages = pages.unionByName(spark.createDataFrame(odd, "page_id bigint, url string"))
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = url_filter.judge(pages, url_filter.label_outcomes(labels)).collect()
    want = []
    for p, u in [(r["page_id"], r["url"]) for r in pages.collect()]:
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        b = _rule(host, path)
        want.append((p, host, path, b and b[1], b and b[0]))
    ours = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"] if r["rule"] else None) for r in got]
    assert sorted(ours, key=repr) == sorted(want, key=repr)
    assert {r["verdict"] for r in got} <= {"allow", "block"}
    assert url_filter.judge(pages.where("false"), url_filter.label_outcomes(labels)).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, url_filter.label_outcomes(labels.where("false"))).collect() if not r["rule"]} == {"allow"}


def test_suffixes_are_a_parameter(spark):
    """Two shops below one suffix of two labels are one domain, or two if the list says so."""
    rows = [(i, f"http://{'ab'[i % 2]}.shop.example/{i}") for i in range(200)] + [(900, "http://c.shop.example/")]
    good = [(i, i % 2) for i in range(200)]
    args = spark.createDataFrame(rows, "page_id bigint, url string"), spark.createDataFrame(good, "page_id bigint, good int")
    one = {r["host"]: r["reputation"] for r in url_filter.judge(*args).collect()}
    two = {r["host"]: r["reputation"] for r in url_filter.judge(*args, wide=["shop.example"]).collect()}
    assert two["a.shop.example"] < 0.2 < 0.8 < two["b.shop.example"] and one["a.shop.example"] < one["c.shop.example"] < one["b.shop.example"]


def test_reputation_shrinks(spark):
    """Bad hosts are blocked once their outcomes outweigh the prior; hosts with few outcomes lean on their domain."""
    rows, good = [], []
    for i in range(400):
        host = ["bad.site.org", "good.site.org", "fine.other.org"][i % 3]
        rows.append((i, f"http://{host}/p{i}"))
        good.append((i, 0 if i % 3 == 0 else 1))
    rows += [(1000, "http://rare.site.org/"), (1001, "http://rare.other.org/")]
    got = {r["host"]: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id bigint, url string"), spark.createDataFrame(good, "page_id bigint, good int")).collect()}
    assert got["bad.site.org"]["verdict"] == "block" and got["good.site.org"]["verdict"] == "allow"
    assert got["bad.site.org"]["reputation"] < got["rare.site.org"]["reputation"] < got["rare.other.org"]["reputation"] <= got["fine.other.org"]["reputation"]
