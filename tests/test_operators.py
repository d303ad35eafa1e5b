"""Hand-written cases: ordering, ranges, negative indexes, expiry, globs, recovery, transactions, streaming."""

import pytest
from pyspark.sql import functions as F

from keyloom.functions.text import glob_regex
from keyloom.operators import bitmaps, core, evict, hashes, hll, keys, lists, pubsub, scripts, sets, streams, strings, tx, zsets
from keyloom.sources import snapshot
from keyloom.streaming import keyspace_stream as ss


def _z(spark, *rows):
    return spark.createDataFrame([(0, "k", m, float(s)) for m, s in rows], "db int, key string, member string, score double")


def test_zset_sequence(spark):
    z = _z(spark, ("one", 1), ("two", 2), ("three", 3))
    assert core.count_per_key(z).first()["n"] == 3
    ranks = {r["member"]: r["rank"] for r in zsets.zrank(z, z).collect()}
    assert ranks == {"one": 0, "two": 1, "three": 2}
    assert zsets.zrange(z, 0, -1).count() == 3
    z = zsets.zincrby(z, spark.createDataFrame([(0, "k", "two", 2.0)], "db int, key string, member string, delta double"))
    assert {r["member"]: r["score"] for r in z.collect()}["two"] == 4.0
    assert zsets.zcount(z, 2, 5).first()["n"] == 2 and zsets.zcount(z, "(3", "+inf").first()["n"] == 1
    top = zsets.zpop(z, 1, highest=True)
    assert top.first()["member"] == "two"
    z = zsets.zrem(z, top)
    assert zsets.zpop(z, 1, highest=True).first()["member"] == "three"
    z = zsets.zrem(z, zsets.zpop(z, 1, highest=True))
    assert core.count_per_key(z).first()["n"] == 1


def test_zset_ties_and_updates(spark):
    z = _z(spark, ("9", 1), ("10", 1), ("a", 0))
    assert [r["member"] for r in zsets.zrange(z, 0, -1).orderBy("rank").collect()] == ["a", "10", "9"]
    new = spark.createDataFrame([(0, "k", "9", 5.0, 1), (0, "k", "9", 7.0, 2), (0, "k", "n", 1.0, 3)], "db int, key string, member string, score double, seq long")
    scores = lambda df: {r["member"]: r["score"] for r in df.collect()}
    assert scores(zsets.zadd(z, new)) == {"9": 7.0, "10": 1.0, "a": 0.0, "n": 1.0}
    assert scores(zsets.zadd(z, new, "nx")) == {"9": 1.0, "10": 1.0, "a": 0.0, "n": 1.0}
    assert scores(zsets.zadd(z, new, "xx")) == {"9": 7.0, "10": 1.0, "a": 0.0}
    with pytest.raises(ValueError):
        zsets.zadd(z, new, "gt")
    with pytest.raises(ValueError):
        zsets.zunion(z, ["k"], aggregate="avg")


def test_expiry_boundary(spark):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    meta = spark.sql("SELECT 0 AS db, k AS key, CAST(e AS TIMESTAMP_NTZ) AS expire_at FROM VALUES ('past', '2023-01-01'), ('now', '2024-01-01'), ('half', '2024-01-01 00:00:00.5'), ('never', NULL) t(k, e)")
    left = {r["key"]: (r["ttl"], r["pttl"]) for r in keys.ttl(meta, now).collect()}
    assert left == {"past": (-2, -2), "now": (-2, -2), "half": (0, 500), "never": (-1, -1)}
    assert {r["key"] for r in keys.expire(meta, now, 5).collect()} == {"half", "never"}
    assert keys.dbsize(meta, now).first()["keys"] == 2


def test_text_is_kept_and_counters_overflow(spark):
    t = spark.createDataFrame([(0, "a", "007"), (0, "b", str(2**63 - 1)), (0, "c", "x" * 45)], "db int, key string, value string")
    assert strings.get(t, "a").first()["value"] == "007"
    d = spark.createDataFrame([(0, "a", 1), (0, "b", 1), (0, "new", 5)], "db int, key string, delta long")
    got = {r["key"]: (r["value"], r["overflow"]) for r in strings.incrby(t.where("key <> 'c'"), d).collect()}
    assert got == {"a": (8, False), "b": (None, True), "new": (5, False)}
    assert {r["key"]: r["encoding"] for r in keys.encoding(t).collect()} == {"a": "int", "b": "int", "c": "raw"}
    r = {x["key"]: x["value"] for x in strings.getrange(t.where("key = 'a'"), -2, -1).collect()}
    assert r == {"a": "07"}
    assert strings.setrange(t.where("key = 'a'"), 5, "Z").first()["value"] == "007\0\0Z"


def test_list_edges(spark):
    t = spark.createDataFrame([(0, "k", i, v) for i, v in enumerate("abcab")], "db int, key string, pos long, value string")
    values = lambda df: "".join(r["value"] for r in df.orderBy("pos").collect())
    assert values(lists.lrem(t, 1, "a")) == "bcab" and values(lists.lrem(t, -1, "a")) == "abcb" and values(lists.lrem(t, 0, "a")) == "bcb"
    assert values(lists.linsert(t, "b", "X", True)) == "aXbcab" and values(lists.linsert(t, "b", "X", False)) == "abXcab" and values(lists.linsert(t, "none", "X", True)) == "abcab"
    assert values(lists.ltrim(t, 1, -2)) == "bca" and values(lists.ltrim(t, 9, 12)) == "abcab"
    assert lists.lindex(t, -1).count() == 0 and lists.lpos(t, "b").first()["i"] == 1


def test_set_algebra_laws(spark):
    t = spark.createDataFrame([(0, k, str(m)) for k, ms in (("a", range(10)), ("b", range(5, 15)), ("c", range(8, 9))) for m in ms], "db int, key string, member string")
    m = lambda df: {r["member"] for r in df.collect()}
    inter, union, diff = m(sets.sinter(t, ["a", "b"])), m(sets.sunion(t, ["a", "b"])), m(sets.sdiff(t, "a", ["b"]))
    assert inter <= union and inter | diff == {str(i) for i in range(10)} and not inter & diff
    assert m(sets.sinter(t, ["a", "none"])) == set()
    assert sets.is_subset(t, "c", "a").first()["subset"] and not sets.is_subset(t, "b", "a").first()["subset"]
    stored = sets.store(t, "c", sets.sinter(t, ["a", "b"]))
    assert {r["member"] for r in stored.where("key = 'c'").collect()} == inter
    once = sets.smove(t, "a", "b", "7")
    assert once.where("key = 'a'").count() == 9 and once.where("key = 'b'").count() == 10


def test_bit_laws(spark):
    t = spark.createDataFrame([(0, k, b) for k, bs in (("a", [0, 1, 2, 9]), ("b", [1, 2, 3])) for b in bs], "db int, key string, bit long")
    x = bitmaps.bitop(t, "XOR", ["a", "b"]).select("db", F.lit("x").alias("key"), "bit")
    back = bitmaps.bitop(t.where("key = 'b'").unionByName(x), "XOR", ["b", "x"])
    assert {r["bit"] for r in back.collect()} == {0, 1, 2, 9}
    assert {r["key"]: r["pos"] for r in bitmaps.bitpos(t, 0).collect()} == {"a": 3, "b": 0}
    assert {r["bit"] for r in bitmaps.bitnot(t, "a").collect()} == {3, 4, 5, 6, 7, 8, 10, 11, 12, 13, 14, 15}


def test_globs():
    import re

    ok = lambda p, s: re.search(glob_regex(p), s) is not None
    assert ok("a*c", "abbc") and not ok("a*c", "abcd") and ok("h?llo", "hello") and ok("[ab]x", "bx") and not ok("[ab]x", "cx")
    assert ok("*a*b*", "xxayyb") and ok("a.c", "a.c") and not ok("a.c", "abc") and ok("\\*", "*") and not ok("\\*", "x") and ok("[^a]", "b")
    with pytest.raises(ValueError):
        glob_regex("")


def test_fold_equals_snapshot_and_compaction(spark, tmp_path):
    log = spark.createDataFrame([(0, "a", 1, "SET", "1"), (0, "a", 2, "SET", "2"), (0, "b", 3, "SET", "x"), (0, "b", 4, "DEL", None), (1, "a", 5, "SET", "other")], "db int, key string, seq long, op string, value string")
    state = strings.set_(log).select("db", "key", "value")
    rows = sorted(map(tuple, state.collect()))
    assert rows == [(0, "a", "2"), (1, "a", "other")]
    path = str(tmp_path / "snap")
    snapshot.save(state, path, 1)
    snapshot.bgsave(state.where("db = 0"), path, 2).result(60)
    assert snapshot.lastsave(spark, path).first()["version"] == 2 and snapshot.load(spark, path).count() == 1
    c = snapshot.ChangeLog(str(tmp_path / "log"))
    c.append(log.where("seq <= 3"))
    c.append(log.where("seq > 3"))
    c.enabled = False
    c.append(log)
    assert c.read(spark).count() == 5
    assert sorted((r["db"], r["key"], r["value"]) for r in c.replay(spark).collect()) == rows
    assert sorted((r["db"], r["key"], r["value"]) for r in strings.set_(snapshot.rewrite(log)).collect()) == rows


def test_transaction(spark):
    state = spark.createDataFrame([(0, "a", "1")], "db int, key string, value string")
    t = tx.Transaction()
    with pytest.raises(ValueError):
        t.exec(state, {})
    t.watch({"a": 1})
    t.multi()
    with pytest.raises(ValueError):
        t.multi()
    t.add(lambda s: s.withColumn("value", F.lit("2")))
    assert t.exec(state, {"a": 2}) is None
    t.watch({"a": 2})
    t.multi()
    t.add(lambda s: s.withColumn("value", F.lit("2")))
    assert t.exec(state, {"a": 2}).first()["value"] == "2"
    t.multi()
    t.discard()
    t.unwatch()


def test_scripts(spark):
    r = scripts.ScriptRegistry()
    sha = r.load("SELECT :argv[0] AS a, size(:keys) AS n")
    assert r.exists(sha, "0" * 40) == [1, 0] and r.show(sha)
    assert tuple(r.evalsha(spark, sha, ["k1", "k2"], ["v"]).first()) == ("v", 2)
    r.flush()
    with pytest.raises(KeyError):
        r.evalsha(spark, sha)


def test_sketch_bounds(spark):
    items = spark.range(20_000).select(F.lit(0).alias("db"), (F.col("id") % 2).cast("string").alias("key"), (F.col("id") % 7000).alias("item"))
    sketches = hll.pfadd(items, "item")
    one = {r["key"]: r["estimate"] for r in hll.pfcount(sketches).collect()}
    both = hll.pfcount(hll.pfmerge(sketches, "m")).first()["estimate"]
    assert all(abs(e - 3500) < 350 for e in one.values()) and abs(both - 7000) < 700


def test_eviction_budget(spark):
    meta = spark.sql("SELECT 0 AS db, CAST(id AS STRING) AS key, TIMESTAMP_NTZ '2024-01-01' + make_dt_interval(0, 0, 0, id) AS last_access, TIMESTAMP_NTZ '2024-02-01' - make_dt_interval(0, 0, 0, id) AS expire_at, CAST(id % 7 AS INT) AS freq, CAST(10 AS BIGINT) AS size FROM range(100)")
    assert {r["key"] for r in evict.evict(meta, "lru", 45).collect()} == {"0", "1", "2", "3", "4"}
    assert {r["key"] for r in evict.evict(meta, "ttl", 30).collect()} == {"99", "98", "97"}
    assert evict.evict(meta, "random", 100).count() == 10 and evict.evict(meta, "noeviction", 100).count() == 0


def test_stream_ids(spark):
    t = spark.createDataFrame([(0, "k", 100, 3)], "db int, key string, ms long, seq long")
    new = spark.createDataFrame([(0, "k", 100, 1), (0, "k", 90, 2), (0, "k", 105, 3), (0, "k", 101, 4)], "db int, key string, ms long, ord long")
    got = sorted((r["ms"], r["seq"]) for r in streams.xadd(t, new).collect())
    assert got == [(100, 3), (100, 4), (100, 5), (105, 0), (105, 1)]
    assert [(r["ms"], r["seq"]) for r in streams.xtrim(streams.xadd(t, new), 1).collect()] == [(105, 1)]


def test_hash_updates(spark):
    t = spark.createDataFrame([(0, "h", "f", "1"), (0, "h", "g", "x")], "db int, key string, field string, value string")
    d = spark.createDataFrame([(0, "h", "f", 2), (0, "h", "n", 5)], "db int, key string, field string, delta long")
    assert {r["field"]: r["value"] for r in hashes.hincrby(t, d).collect()} == {"f": 3, "g": 0, "n": 5}
    assert hashes.hgetall(t).first()["entries"] == {"f": "1", "g": "x"}


def test_unsubscribe_all(spark):
    subs = spark.createDataFrame([("c", "channel", "x"), ("c", "pattern", "x*"), ("d", "channel", "x")], "conn string, kind string, pattern string")
    gone = spark.createDataFrame([("c", "channel", None)], "conn string, kind string, pattern string")
    assert {tuple(r) for r in pubsub.unsubscribe(subs, gone).collect()} == {("c", "pattern", "x*"), ("d", "channel", "x")}


def test_streaming_equals_batch(spark, tmp_path):
    rows = [("a", 10, 0, 1), ("a", 12, 0, 2), ("a", 11, 0, 3), ("b", 5, 0, 4), ("a", 12, 1, 5), ("b", 4, 9, 6)]
    src = str(tmp_path / "in")
    for i in (0, 3):
        spark.createDataFrame(rows[i : i + 3], ss.ENTRY).coalesce(1).write.mode("append").parquet(src)
    ss.run_available(ss.reject_late(ss.tail(spark, src)), str(tmp_path / "ck1"), str(tmp_path / "out1"))
    batch = streams.reject_late(spark.createDataFrame([(0, *r, r[3]) for r in rows], "db int, key string, ms long, seq long, event_id long, ord long"))
    got = {r["event_id"] for r in spark.read.parquet(str(tmp_path / "out1")).collect()}
    assert got == {r["event_id"] for r in batch.collect()} == {1, 2, 4, 5}
    ss.run_available(ss.consumer_group(ss.tail(spark, src), 2), str(tmp_path / "ck2"), str(tmp_path / "out2"))
    dealt = spark.read.parquet(str(tmp_path / "out2")).groupBy("key", "consumer").count().collect()
    assert {(r["key"], r["consumer"]): r["count"] for r in dealt} == {("a", 0): 2, ("a", 1): 2, ("b", 0): 1, ("b", 1): 1}
    names = spark.createDataFrame([("a",), ("b",)], "channel string")
    subs = spark.createDataFrame([("c1", "channel", "a"), ("c2", "pattern", "?")], "conn string, kind string, pattern string")
    live = ss.tail(spark, src).withColumnRenamed("key", "channel")
    ss.run_available(ss.deliver(live, names, subs), str(tmp_path / "ck3"), str(tmp_path / "out3"))
    assert spark.read.parquet(str(tmp_path / "out3")).count() == 10
    ss.run_available(ss.counts(ss.tail(spark, src)), str(tmp_path / "ck4"), "lengths", "complete")
    assert {r["key"]: r["length"] for r in spark.table("lengths").collect()} == {"a": 4, "b": 2}


def test_glob_columns_follow_the_rules_of_path_globs(spark):
    from keyloom.functions.text import glob_prefix_column, glob_regex_column

    cases = [
        ("[^a]*", "bcd", True), ("[^a]*", "abc", False), ("\\*x", "*x", True), ("\\*x", "ax", False), ("a*", "a/b", False), ("a?c", "a/c", False), ("a[b-d]", "ac", True), ("a[^b-d]", "ac", False),
        ("a[", "a[", False), ("a\\", "a\\", False), ("[]a]", "]", False), ("[\\]]", "]", True), ("a.b", "axb", False), ("(x|y)+", "(x|y)+", True), ("[a&&b]", "&", True), ("[[x]", "[", True), ("", "", True), ("", "a", False), ("*", "x\n", True), ("é*", "éa", True), ("[a^]", "^", True), ("{1}$^", "{1}$^", True),
    ]
    df = spark.createDataFrame(cases, "pattern string, name string, want boolean")
    got = df.select("pattern", "name", "want", F.rlike("name", glob_regex_column(F.col("pattern"))).alias("got"), glob_prefix_column(F.col("pattern")).alias("prefix")).collect()
    assert [r for r in got if r["got"] != r["want"]] == []
    assert all(not r["want"] or r["name"].startswith(r["prefix"]) for r in got)


def test_routes_find_names_by_prefix_and_without(spark):
    from keyloom.operators import pubsub

    names = ["news.sport", "news.art", "new", "x", "verylongchannelname1", "verylongchannelname2"]
    subs = [("a", "pattern", p) for p in ("news.*", "*", "verylongchannelname[^1]", "new?", "[^n]*", "x")] + [("b", "channel", "x")]
    got = {(r["channel"], r["pattern"], r["kind"]) for r in pubsub.routes(spark.createDataFrame([(n,) for n in names], "channel string"), spark.createDataFrame(subs, "conn string, kind string, pattern string")).collect()}
    want = {(n, "*", "pattern") for n in names} | {("news.sport", "news.*", "pattern"), ("news.art", "news.*", "pattern"), ("verylongchannelname2", "verylongchannelname[^1]", "pattern"), ("x", "x", "pattern"), ("x", "x", "channel")}
    assert got == want | {(n, "[^n]*", "pattern") for n in names if n[0] != "n"}


def test_scan_by_last_row_seen(spark):
    from keyloom.operators import core

    df = spark.createDataFrame([(i % 5, f"m{i:03d}") for i in range(200)], "score int, member string")
    pages, last = [], None
    while page := core.scan(df, ["score", "member"], count=30, match=("member", "m*"), after=last).collect():
        pages += [tuple(r) for r in page]
        last = pages[-1]
    assert pages == sorted(map(tuple, df.collect()))


def test_radius_by_member_against_all_pairs(spark):
    """Over the poles and the date line, for circles from small to more than half the globe."""
    import math
    import random

    from keyloom.functions import geo as g
    from keyloom.operators import geo

    r = random.Random(3)
    points = [(0, "k", f"m{i}", r.uniform(-180, 180), math.degrees(math.asin(r.uniform(-1, 1)))) for i in range(150)]
    points += [(0, "k", f"e{i}", lon, lat) for i, (lon, lat) in enumerate([(180.0, 0.0), (-180.0, 0.0), (179.9, 80.0), (-179.9, 80.0), (0.0, 90.0), (90.0, -90.0), (10.0, 89.9), (-170.0, 89.9), (0.0, 0.0)])]
    table = spark.createDataFrame(points, "db int, key string, member string, lon double, lat double").cache()

    def dist(a, b):
        x, y, dx, dy = math.radians(a[4]), math.radians(b[4]), math.radians(b[3] - a[3]), math.radians(b[4] - a[4])
        return 2 * g.RADIUS_M * math.asin(min(1.0, math.sqrt(math.sin(dy / 2) ** 2 + math.cos(x) * math.cos(y) * math.sin(dx / 2) ** 2))) / 1000

    for km in (100, 1500, 9000, 15000):
        got = [(x["centre"], x["member"]) for x in geo.georadiusbymember(table, table.select("db", "key", "member"), km, "km").collect()]
        assert sorted(got) == sorted((a[2], b[2]) for a in points for b in points if a[2] != b[2] and dist(a, b) <= km)


def test_evict_cuts_hot_values_to_small_parts(spark, monkeypatch):
    """Most rows of one value and an outlier: the same victims as by ranking all, with few rows ranked."""
    import datetime
    import random

    r = random.Random(1)
    day = datetime.datetime(2024, 1, 1)
    rows = [(0, f"key:{i % 7}:{i:05d}" if i % 3 else f"k{i}", day + datetime.timedelta(days=40) if i % 5 else None, day if i % 10 else day + datetime.timedelta(days=r.choice([-9000, 1, 5])), 3 if i % 4 else r.randrange(9), r.randrange(1, 90)) for i in range(600)]
    meta = spark.createDataFrame(rows, "db int, key string, expire_at timestamp_ntz, last_access timestamp_ntz, freq int, size bigint").cache()
    orders = {"lru": lambda x: (x[3], x[1]), "lfu": lambda x: (x[4], x[3], x[1]), "ttl": lambda x: (x[2], x[1])}
    monkeypatch.setattr(evict, "SMALL", 20)
    for policy, order in orders.items():
        for need in (1, 5000, 9000, 10**9):
            want, ahead = [], 0
            for x in sorted((x for x in rows if policy != "ttl" or x[2] is not None), key=order):
                if ahead < need:
                    want.append(x[1])
                ahead += x[5]
            assert sorted(y["key"] for y in evict.evict(meta, policy, need, buckets=16).collect()) == sorted(want)
    many = {y["key"] for y in evict.evict(meta, "random", 5000, seed=1, buckets=16).collect()}
    monkeypatch.setattr(evict, "SMALL", 1000)
    assert many == {y["key"] for y in evict.evict(meta, "random", 5000, seed=1).collect()}
