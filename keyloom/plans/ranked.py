"""Queries over ranked sets, bitmaps, sketches and geo sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.functions import geo as gx
from keyloom.operators import bitmaps, core, geo, hll, zsets
from keyloom.registry import query

A, B, C = "click:2024-01-01", "click:2024-01-02", "view:2024-01-01"
ASC = "row_number() OVER (PARTITION BY key ORDER BY score, member) - 1"
DESC = "row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1"
SEG = "BUILDING"


@query("zrevrange", f"SELECT key, member, score, rank FROM (SELECT *, {DESC} AS rank FROM zsets) WHERE rank <= 9", "zsets")
def _(ks):
    """Top ten of every ranked set, best first."""
    return zsets.zrange(ks.zsets, 0, 9, reverse=True).select("key", "member", "score", "rank")


def _scored(ks):
    return ks.table("orders").select(F.lit(0).alias("db"), F.lit(SEG).alias("key"), F.col("o_custkey").cast("string").alias("member"), F.col("o_totalprice").alias("score"), F.col("o_orderkey").alias("seq"))


_LAST = f"(SELECT '{SEG}' AS key, CAST(o_custkey AS VARCHAR) AS member, arg_max(o_totalprice, o_orderkey) AS score FROM orders GROUP BY 2)"


@query("zadd", f"SELECT coalesce(n.key, z.key) AS key, coalesce(n.member, z.member) AS member, coalesce(n.score, z.score) AS score FROM zsets z FULL JOIN {_LAST} n ON z.key = n.key AND z.member = n.member", "zsets")
def _(ks):
    return zsets.zadd(ks.zsets, _scored(ks)).select("key", "member", "score")


@query("zadd_nx", f"SELECT key, member, score FROM zsets UNION ALL SELECT n.key, n.member, n.score FROM {_LAST} n WHERE NOT EXISTS (SELECT 1 FROM zsets z WHERE z.key = n.key AND z.member = n.member)", "zsets")
def _(ks):
    return zsets.zadd(ks.zsets, _scored(ks), "nx").select("key", "member", "score")


@query("zadd_xx", f"SELECT z.key, z.member, coalesce(n.score, z.score) AS score FROM zsets z LEFT JOIN {_LAST} n ON z.key = n.key AND z.member = n.member", "zsets")
def _(ks):
    return zsets.zadd(ks.zsets, _scored(ks), "xx").select("key", "member", "score")


@query("zrem", "SELECT key, member, score FROM zsets WHERE CAST(member AS BIGINT) % 3 <> 0", "zsets")
def _(ks):
    return zsets.zrem(ks.zsets, ks.zsets.where(F.col("member").cast("bigint") % 3 == 0)).select("key", "member", "score")


@query("zscore", f"SELECT score FROM zsets WHERE key = '{SEG}' AND member = '12'", "zsets")
def _(ks):
    return ks.zsets.where((F.col("key") == SEG) & (F.col("member") == "12")).select("score")


@query("zmscore", "SELECT r.idx, r.key, r.member, z.score FROM (VALUES (0, 'HOUSEHOLD', '0'), (1, 'MACHINERY', '1'), (2, 'HOUSEHOLD', 'none')) r(idx, key, member) LEFT JOIN zsets z ON r.key = z.key AND r.member = z.member", "zsets")
def _(ks):
    asked = ks.spark.createDataFrame([(0, "HOUSEHOLD", "0"), (1, "MACHINERY", "1"), (2, "HOUSEHOLD", "none")], "idx int, key string, member string")
    return zsets.zmscore(ks.zsets, asked).select("idx", "key", "member", "score")


@query("zincrby", "SELECT key, member, CAST(sum(score) AS BIGINT) AS score FROM (SELECT key, member, score FROM zdays UNION ALL SELECT event_type || ':' || CAST(CAST(ts AS DATE) AS VARCHAR), CAST(user_id AS VARCHAR), 1 FROM events) GROUP BY 1, 2", "zdays")
def _(ks):
    e = ks.table("events").select(F.lit(0).alias("db"), ks._event_day.alias("key"), F.col("user_id").cast("string").alias("member"), F.lit(1).cast("bigint").alias("delta"))
    return zsets.zincrby(ks.zdays, e).select("key", "member", "score")


@query("zcard", "SELECT key, CAST(count(*) AS BIGINT) AS card FROM zsets GROUP BY key", "zsets")
def _(ks):
    return core.count_per_key(ks.zsets, "card").select("key", "card")


@query("zcount", "SELECT key, CAST(count(*) FILTER (WHERE score > 1000 AND score <= 5000) AS BIGINT) AS n FROM zsets GROUP BY key", "zsets")
def _(ks):
    return zsets.zcount(ks.zsets, "(1000", 5000).select("key", "n")


@query("zrange", f"SELECT key, member, score, rank FROM (SELECT *, {ASC} AS rank, count(*) OVER (PARTITION BY key) AS n FROM zsets) WHERE rank BETWEEN n - 5 AND n - 2", "zsets")
def _(ks):
    return zsets.zrange(ks.zsets, -5, -2).select("key", "member", "score", "rank")


@query("zrangebyscore", f"SELECT key, member, score, rank - 2 AS rank FROM (SELECT *, {ASC} AS rank FROM zsets WHERE score BETWEEN 1000 AND 9000) WHERE rank BETWEEN 2 AND 6", "zsets")
def _(ks):
    return zsets.zrangebyscore(ks.zsets, 1000, 9000, 2, 5).select("key", "member", "score", "rank")


@query("zrevrangebyscore", f"SELECT key, member, score, rank - 2 AS rank FROM (SELECT *, {DESC} AS rank FROM zsets WHERE score BETWEEN 1000 AND 9000) WHERE rank BETWEEN 2 AND 6", "zsets")
def _(ks):
    return zsets.zrangebyscore(ks.zsets, 1000, 9000, 2, 5, reverse=True).select("key", "member", "score", "rank")


for _name, _rank, _rev in (("zrank", ASC, False), ("zrevrank", DESC, True)):

    @query(_name, f"SELECT key, member, {_rank} AS rank FROM zsets", "zsets")
    def _(ks, rev=_rev):
        return zsets.zrank(ks.zsets, ks.zsets, rev).select("key", "member", "rank")


for _name, _rank, _top in (("zpopmax", DESC, True), ("zpopmin", ASC, False)):

    @query(_name, f"SELECT key, member, score, rank FROM (SELECT *, {_rank} AS rank FROM zsets) WHERE rank < 3", "zsets")
    def _(ks, top=_top):
        return zsets.zpop(ks.zsets, 3, top).select("key", "member", "score", "rank")


@query("zremrangebyrank", f"SELECT key, member, score FROM (SELECT *, {ASC} AS rank, count(*) OVER (PARTITION BY key) AS n FROM zsets) WHERE rank NOT BETWEEN 5 AND n - 10", "zsets")
def _(ks):
    return zsets.zremrangebyrank(ks.zsets, 5, -10).select("key", "member", "score")


@query("zremrangebyscore", "SELECT key, member, score FROM zsets WHERE score NOT BETWEEN 0 AND 5000", "zsets")
def _(ks):
    return zsets.zremrangebyscore(ks.zsets, 0, 5000).select("key", "member", "score")


_W = f"(SELECT member, score * CASE key WHEN '{A}' THEN 2 WHEN '{B}' THEN 3 ELSE -1 END AS score, key FROM zdays WHERE key IN ('{A}', '{B}', '{C}'))"
_MERGES = {
    "zunion": (lambda t: zsets.zunion(t, [A, B, C], [2, 3, -1]), f"(SELECT member, CAST(sum(score) AS BIGINT) AS score FROM {_W} GROUP BY member)"),
    "zinter": (lambda t: zsets.zinter(t, [A, B, C], [2, 3, -1], "max"), f"(SELECT member, CAST(max(score) AS BIGINT) AS score FROM {_W} GROUP BY member HAVING count(DISTINCT key) = 3)"),
    "zdiff": (lambda t: zsets.zdiff(t, A, [B, C]), f"(SELECT member, score FROM zdays z WHERE key = '{A}' AND NOT EXISTS (SELECT 1 FROM zdays y WHERE y.key IN ('{B}', '{C}') AND y.member = z.member))"),
}
for _name, (_fn, _sql) in _MERGES.items():

    @query(_name, f"SELECT member, score FROM {_sql}", "zdays")
    def _(ks, fn=_fn):
        return fn(ks.zdays).select("member", "score")

    @query(_name + "store", f"SELECT key, member, score FROM zdays WHERE key <> '{C}' UNION ALL SELECT '{C}', member, score FROM {_sql}", "zdays")
    def _(ks, fn=_fn):
        return zsets.store(ks.zdays, C, fn(ks.zdays)).select("key", "member", "score")


@query("zunion_min", f"SELECT member, CAST(min(score) AS BIGINT) AS score FROM {_W} GROUP BY member", "zdays")
def _(ks):
    return zsets.zunion(ks.zdays, [A, B, C], [2, 3, -1], "min").select("member", "score")


@query("zscan", f"SELECT member, score FROM zsets WHERE key = '{SEG}' AND member LIKE '1%' ORDER BY score, member LIMIT 10 OFFSET 10", "zsets")
def _(ks):
    return core.scan(ks.zsets.where(F.col("key") == SEG), ["score", "member"], 10, 10, ("member", "1*")).select("member", "score")


@query("zrandmember", "SELECT key, member, score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY md5('3:0:' || key || ':' || member), member) AS rn FROM zsets) WHERE rn <= 5", "zsets")
def _(ks):
    return core.sample_per_key(ks.zsets, "member", 5, seed=3).select("key", "member", "score")


# Bitmaps


@query("setbit", "SELECT key, bit FROM bits WHERE bit % 5 <> 0 UNION SELECT DISTINCT key, CAST(1000 AS BIGINT) FROM bits", "bits")
def _(ks):
    on = ks.bits.select("db", "key").distinct().withColumn("bit", F.lit(1000).cast("bigint"))
    return bitmaps.setbit(ks.bits, on, ks.bits.where("bit % 5 = 0")).select("key", "bit")


@query("getbit", f"SELECT r.idx, r.key, r.bit, CASE WHEN b.key IS NULL THEN 0 ELSE 1 END AS value FROM (VALUES (0, '{A}', 8), (1, '{A}', 9), (2, '{B}', 46), (3, 'none', 1)) r(idx, key, bit) LEFT JOIN bits b ON r.key = b.key AND r.bit = b.bit", "bits")
def _(ks):
    asked = ks.spark.createDataFrame([(0, A, 8), (1, A, 9), (2, B, 46), (3, "none", 1)], "idx int, key string, bit int")
    return bitmaps.getbit(ks.bits, asked).select("idx", "key", "bit", "value")


@query("bitcount", "SELECT key, CAST(count(*) FILTER (WHERE bit BETWEEN 8 AND 63) AS BIGINT) AS n FROM bits GROUP BY key", "bits")
def _(ks):
    return bitmaps.bitcount(ks.bits, 1, 7).select("key", "n")


@query("bitcount_packed", "SELECT key, CAST(count(*) AS BIGINT) AS n FROM bits GROUP BY key", "bits")
def _(ks):
    return bitmaps.packed_count(bitmaps.packed(ks.bits)).select("key", "n")


@query("bitpos", "SELECT key, min(bit) AS pos FROM bits WHERE bit >= 16 GROUP BY key", "bits")
def _(ks):
    return bitmaps.bitpos(ks.bits, 1, 2).select("key", "pos")


@query("bitpos_clear", "SELECT k.key, min(r.i) AS pos FROM (SELECT DISTINCT key FROM bits) k, range(0, 1001) r(i) WHERE NOT EXISTS (SELECT 1 FROM bits b WHERE b.key = k.key AND b.bit = r.i) GROUP BY k.key", "bits")
def _(ks):
    return bitmaps.bitpos(ks.bits, 0).select("key", "pos")


for _op, _have in (("AND", "= 3"), ("OR", "> 0"), ("XOR", "IN (1, 3)")):

    @query("bitop_" + _op.lower(), f"SELECT bit FROM bits WHERE key IN ('{A}', '{B}', '{C}') GROUP BY bit HAVING count(*) {_have}", "bits")
    def _(ks, op=_op):
        return bitmaps.bitop(ks.bits, op, [A, B, C]).select("bit")


@query("bitop_not", f"SELECT i AS bit FROM range(0, 100000) r(i) WHERE i < 8 * ((SELECT max(bit) FROM bits WHERE key = '{A}') // 8 + 1) AND i NOT IN (SELECT bit FROM bits WHERE key = '{A}')", "bits")
def _(ks):
    return bitmaps.bitnot(ks.bits, A).select("bit")


@query("bitfield", "SELECT o_orderkey AS id, ((o_orderkey % 300 + 100) % 256) AS wrap, least(o_orderkey % 300 + 100, 127) AS sat, CASE WHEN o_orderkey % 300 + 100 <= 255 THEN o_orderkey % 300 + 100 END AS fail FROM orders")
def _(ks):
    v, d = F.col("o_orderkey") % 300, F.lit(100)
    return ks.table("orders").select(F.col("o_orderkey").alias("id"), bitmaps.bitfield_incrby(v, d, "u8").alias("wrap"), bitmaps.bitfield_incrby(v, d, "i8", "SAT").alias("sat"), bitmaps.bitfield_incrby(v, d, "u8", "FAIL").alias("fail"))


@query("bitfield_ro", "SELECT o_orderkey AS id, o_orderkey % 256 AS u8, CASE WHEN o_orderkey % 256 >= 128 THEN o_orderkey % 256 - 256 ELSE o_orderkey % 256 END AS i8 FROM orders")
def _(ks):
    return ks.table("orders").select(F.col("o_orderkey").alias("id"), bitmaps.bitfield_get(F.col("o_orderkey"), "u8").alias("u8"), bitmaps.bitfield_get(F.col("o_orderkey"), "i8").alias("i8"))


# Sketches: the estimate is compared with the exact count within a bound.


def _items(ks):
    return ks.table("events").select(F.lit(0).alias("db"), F.col("event_type").alias("key"), F.concat_ws(":", F.col("user_id").cast("string"), "props").alias("item"))


def _bounded(estimates, exact):
    return estimates.join(exact, "key").select("key", (F.abs(F.col("estimate") - F.col("n")) <= 0.1 * F.col("n")).alias("within"))


@query("pfadd", "SELECT DISTINCT event_type AS key, 0 AS changed FROM events")
def _(ks):
    """The reply to adding all items to a merged sketch once more: no estimate changes."""
    once = hll.pfadd(_items(ks), "item")
    merged = lambda s: s.groupBy("db", "key").agg(F.hll_union_agg("sketch").alias("sketch"))
    held = merged(once.unionByName(once))
    twice = merged(held.unionByName(once))
    estimates = hll.pfcount(held).select("key", "estimate").join(hll.pfcount(twice).select("key", F.col("estimate").alias("after")), "key")
    return estimates.select("key", (F.col("estimate") != F.col("after")).cast("int").alias("changed"))


@query("pfcount", "SELECT DISTINCT event_type AS key, true AS within FROM events")
def _(ks):
    exact = _items(ks).groupBy("key").agg(F.countDistinct("item").alias("n"))
    return _bounded(hll.pfcount(hll.pfadd(_items(ks), "item")), exact)


@query("pfmerge", "SELECT 'all' AS key, true AS within")
def _(ks):
    exact = _items(ks).agg(F.countDistinct("item").alias("n")).withColumn("key", F.lit("all"))
    return _bounded(hll.pfcount(hll.pfmerge(hll.pfadd(_items(ks), "item"), "all")), exact)


# Geo


def _bits(x: str, low: float, high: float, shift: int) -> str:
    v = f"least(greatest(CAST(floor(({x} - ({low})) / ({high} - ({low})) * 67108864) AS BIGINT), 0), 67108863)"
    return f"(SELECT CAST(sum((({v} >> i) & 1) << (2 * i + {shift})) AS BIGINT) FROM range(0, 26) t(i))"


@query("geoadd", f"SELECT key, member, {_bits('lon', *gx.LON, 1)} + {_bits('lat', *gx.LAT, 0)} AS score FROM geo", "geo")
def _(ks):
    return geo.geoadd(ks.geo.where(F.lit(False)), ks.geo.drop("score")).select("key", "member", "score")


def _hav(a: str, b: str, c: str, d: str) -> str:
    return f"2 * {gx.RADIUS_M} * asin(sqrt(least(1.0, pow(sin(radians({d} - {b}) / 2), 2) + cos(radians({b})) * cos(radians({d})) * pow(sin(radians({c} - {a}) / 2), 2))))"


@query("geodist", f"SELECT a.key, a.member AS a, b.member AS b, round({_hav('a.lon', 'a.lat', 'b.lon', 'b.lat')} / 1000, 3) AS dist FROM geo a JOIN geo b ON a.key = b.key AND CAST(b.member AS BIGINT) = CAST(a.member AS BIGINT) + 5", "geo")
def _(ks):
    pairs = ks.geo.select("db", "key", F.col("member").alias("a"), (F.col("member").cast("bigint") + 5).cast("string").alias("b"))
    return geo.geodist(ks.geo, pairs, "km").select("key", "a", "b", F.round("dist", 3).alias("dist"))


def _side(x: str, low: float, high: float) -> str:
    return f"greatest(CAST(ceil(({x} - ({low})) / ({high} - ({low})) * 33554432) AS BIGINT) - 1, 0)"


@query("geohash", f"SELECT key, member, (SELECT string_agg(substr('{gx.ALPHABET}', CAST((SELECT sum(CASE WHEN (5 * c + j) % 2 = 0 THEN ((x >> (24 - (5 * c + j) // 2)) & 1) ELSE ((y >> (24 - (5 * c + j) // 2)) & 1) END << (4 - j)) FROM range(0, 5) u(j)) AS BIGINT) + 1, 1), '' ORDER BY c) FROM range(0, 10) t(c)) AS hash FROM (SELECT key, member, {_side('lon', -180, 180)} AS x, {_side('lat', -90, 90)} AS y FROM geo)", "geo")
def _(ks):
    return geo.geohash(ks.geo).select("key", "member", "hash")


@query("geopos", "SELECT key, member, round(lon, 3) AS lon, round(lat, 3) AS lat FROM (SELECT key, member, -180 + floor((lon + 180) / 360 * 67108864) / 67108864 * 360 AS lon, -85.05112878 + floor((lat + 85.05112878) / 170.10225756 * 67108864) / 67108864 * 170.10225756 AS lat FROM geo)", "geo")
def _(ks):
    return geo.geopos(ks.geo).select("key", "member", F.round("lon", 3).alias("lon"), F.round("lat", 3).alias("lat"))


@query("georadius", f"SELECT key, member, round(d, 3) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY d, member) AS rn FROM (SELECT key, member, {_hav('10.0', '20.0', 'lon', 'lat')} / 1000 AS d FROM geo) WHERE d <= 5000) WHERE rn <= 20", "geo")
def _(ks):
    return geo.georadius(ks.geo, 10.0, 20.0, 5000, "km", count=20).select("key", "member", F.round("dist", 3).alias("dist"))


@query("georadiusbymember", f"SELECT key, centre, member, round(d, 3) AS dist FROM (SELECT a.key, a.member AS centre, b.member, {_hav('a.lon', 'a.lat', 'b.lon', 'b.lat')} / 1000 AS d FROM geo a JOIN geo b ON a.key = b.key AND a.member <> b.member WHERE CAST(a.member AS BIGINT) % 50 = 0) WHERE d <= 1000", "geo")
def _(ks):
    centres = ks.geo.where(F.col("member").cast("bigint") % 50 == 0)  # the query set of a search, against all rows
    return geo.georadiusbymember(ks.geo, centres, 1000, "km").select("key", "centre", "member", F.round("dist", 3).alias("dist"))
