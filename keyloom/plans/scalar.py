"""Queries over strings, counters, hashes, lists and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.operators import core, hashes, lists, sets, strings
from keyloom.registry import query
from keyloom.sources.fixtures import Keyspace

LAST = "(SELECT key, arg_max(op, seq) AS op, arg_max(value, seq) AS value FROM changes GROUP BY key)"
NEWER = "(SELECT * FROM strings WHERE CAST(substr(key, 6) AS BIGINT) % 5 = 0)"


def fresh(ks: Keyspace):
    """New values: every fifth part renamed, and as many keys that do not exist yet."""
    fifth = ks.strings.where(F.substring("key", 6, 20).cast("bigint") % 5 == 0)
    return fifth.withColumn("value", F.upper("value")).unionByName(fifth.withColumn("key", F.concat("key", F.lit(":new"))))


FRESH = "(SELECT key, upper(value) AS value FROM strings WHERE CAST(substr(key, 6) AS BIGINT) % 5 = 0 UNION ALL SELECT key || ':new', value FROM strings WHERE CAST(substr(key, 6) AS BIGINT) % 5 = 0)"


@query("set", f"SELECT key, value FROM {LAST} WHERE op = 'SET'", "changes")
def _(ks):
    return strings.set_(ks.changes).select("key", "value")


@query("set_xx", f"SELECT s.key, coalesce(f.value, s.value) AS value FROM strings s LEFT JOIN {FRESH} f ON s.key = f.key", "strings")
def _(ks):
    return strings.set_xx(ks.strings, fresh(ks)).select("key", "value")


@query("get", "SELECT key, value FROM strings WHERE key = 'part:7'", "strings")
def _(ks):
    return strings.get(ks.strings, "part:7").select("key", "value")


@query("mget", "SELECT r.idx, r.key, coalesce(s.value, '') AS value FROM (VALUES (0, 'part:3'), (1, 'nope'), (2, 'part:11'), (3, 'part:3')) r(idx, key) LEFT JOIN strings s ON r.key = s.key", "strings")
def _(ks):
    return strings.mget(ks.strings, ks.requests("key", ["part:3", "nope", "part:11", "part:3"])).select("idx", "key", "value")


@query("mset", f"SELECT coalesce(f.key, s.key) AS key, coalesce(f.value, s.value) AS value FROM strings s FULL JOIN {FRESH} f ON s.key = f.key", "strings")
def _(ks):
    return strings.mset(ks.strings, fresh(ks)).select("key", "value")


@query("setex", "SELECT key, value, TIMESTAMP '1997-01-01 00:00:00' + INTERVAL 90 SECOND AS expire_at FROM strings", "strings")
def _(ks):
    return strings.setex(ks.strings, ks.now, F.lit(90)).select("key", "value", "expire_at")


@query("psetex", "SELECT key, value, TIMESTAMP '1997-01-01 00:00:00' + INTERVAL 1500 MILLISECOND AS expire_at FROM strings", "strings")
def _(ks):
    return strings.psetex(ks.strings, ks.now, F.lit(1500)).select("key", "value", "expire_at")


@query("setnx", f"SELECT key, value FROM strings UNION ALL SELECT key, value FROM {FRESH} f WHERE NOT EXISTS (SELECT 1 FROM strings s WHERE s.key = f.key)", "strings")
def _(ks):
    return strings.set_nx(ks.strings, fresh(ks)).select("key", "value")


def _deltas(ks, delta):
    return ks.table("orders").select(F.lit(0).alias("db"), F.concat(F.lit("cust:"), F.col("o_custkey").cast("string")).alias("key"), delta.alias("delta"))


def _counter(sign: int, column: str) -> str:
    return f"SELECT coalesce(c.key, d.key) AS key, CAST(coalesce(c.value, 0) + coalesce(d.delta, 0) AS BIGINT) AS value, false AS overflow FROM counters c FULL JOIN (SELECT 'cust:' || CAST(o_custkey AS VARCHAR) AS key, {sign} * sum({column}) AS delta FROM orders GROUP BY 1) d ON c.key = d.key"


for _name, _sign, _sql, _col in (("incr", 1, "1", lambda: F.lit(1)), ("incrby", 1, "CAST(o_orderkey % 100 AS BIGINT)", lambda: F.col("o_orderkey") % 100), ("decr", -1, "1", lambda: F.lit(1)), ("decrby", -1, "CAST(o_orderkey % 100 AS BIGINT)", lambda: F.col("o_orderkey") % 100)):

    @query(_name, _counter(_sign, _sql), "counters")
    def _(ks, sign=_sign, col=_col):
        return strings.incrby(ks.counters, _deltas(ks, (col() * sign).cast("bigint"))).select("key", "value", "overflow")


@query("incrbyfloat", "SELECT c.key, round(c.value + coalesce(d.delta, 0), 2) AS value FROM counters c LEFT JOIN (SELECT 'cust:' || CAST(o_custkey AS VARCHAR) AS key, sum(CAST(o_orderkey % 100 AS DOUBLE) / 4) AS delta FROM orders GROUP BY 1) d ON c.key = d.key", "counters")
def _(ks):
    return strings.incrbyfloat(ks.counters, _deltas(ks, (F.col("o_orderkey") % 100).cast("double") / 4)).select("key", F.round("value", 2).alias("value"))


@query("append", "SELECT key, string_agg(value, '' ORDER BY seq) AS value, CAST(strlen(string_agg(value, '' ORDER BY seq)) AS BIGINT) AS length FROM changes GROUP BY key", "changes")
def _(ks):
    return strings.append(ks.changes).select("key", "value", "length")


@query("strlen", "SELECT key, CAST(strlen(value) AS BIGINT) AS length FROM strings", "strings")
def _(ks):
    return strings.strlen(ks.strings).select("key", "length")


@query("getrange", "SELECT key, substr(value, 3, greatest(length(value) - 3, 0)) AS value FROM strings", "strings")
def _(ks):
    return strings.getrange(ks.strings, 2, -2).select("key", "value")


@query("setrange", "SELECT key, substr(value, 1, 2) || 'XY' || substr(value, 5) AS value FROM strings", "strings")
def _(ks):
    return strings.setrange(ks.strings, 2, "XY").select("key", "value")


@query("getset", "SELECT key, seq, lag(CASE WHEN op = 'SET' THEN value END) OVER (PARTITION BY key ORDER BY seq) AS old FROM changes", "changes")
def _(ks):
    return strings.getset(ks.changes).select("key", "seq", "old")


# Hashes

NEWH = "(SELECT key, field, 'new' AS value FROM hashes WHERE CAST(field AS BIGINT) % 7 = 0 UNION ALL SELECT key, field || 'x', 'added' FROM hashes WHERE CAST(field AS BIGINT) % 7 = 0)"


def _newh(ks):
    seventh = ks.hashes.where(F.col("field").cast("bigint") % 7 == 0)
    return seventh.withColumn("value", F.lit("new")).unionByName(seventh.withColumns({"field": F.concat("field", F.lit("x")), "value": F.lit("added")}))


_HSET = f"SELECT key, field, value FROM {NEWH} UNION ALL SELECT key, field, value FROM hashes h WHERE CAST(field AS BIGINT) % 7 <> 0"
for _name in ("hset", "hmset"):

    @query(_name, _HSET, "hashes")
    def _(ks):
        return hashes.hset(ks.hashes, _newh(ks)).select("key", "field", "value")


@query("hset_added", "SELECT key, CAST(count(*) AS BIGINT) AS added FROM hashes WHERE CAST(field AS BIGINT) % 7 = 0 GROUP BY key", "hashes")
def _(ks):
    return hashes.hset_counts(ks.hashes, _newh(ks)).select("key", "added")


@query("hget", "SELECT key, field, value FROM hashes WHERE key = '899' AND field = '0'", "hashes")
def _(ks):
    return hashes.hget(ks.hashes, "899", "0").select("key", "field", "value")


_HREQ = "(VALUES (0, '899', '0'), (1, '769', '1'), (2, '899', 'none'), (3, 'none', '0')) r(idx, key, field)"


def _hreq(ks):
    return ks.spark.createDataFrame([(0, "899", "0"), (1, "769", "1"), (2, "899", "none"), (3, "none", "0")], "idx int, key string, field string")


@query("hmget", f"SELECT r.idx, r.key, r.field, h.value FROM {_HREQ} LEFT JOIN hashes h ON r.key = h.key AND r.field = h.field", "hashes")
def _(ks):
    return hashes.hmget(ks.hashes, _hreq(ks)).select("idx", "key", "field", "value")


@query("hsetnx", f"SELECT key, field, value FROM hashes UNION ALL SELECT n.key, n.field, n.value FROM {NEWH} n WHERE NOT EXISTS (SELECT 1 FROM hashes h WHERE h.key = n.key AND h.field = n.field)", "hashes")
def _(ks):
    return hashes.hsetnx(ks.hashes, _newh(ks)).select("key", "field", "value")


@query("hdel", "SELECT key, field, value FROM hashes WHERE value <> '1-URGENT'", "hashes")
def _(ks):
    return hashes.hdel(ks.hashes, ks.hashes.where("value = '1-URGENT'")).select("key", "field", "value")


@query("hdel_removed", "SELECT key, CAST(count(*) AS BIGINT) AS removed FROM hashes WHERE value = '1-URGENT' GROUP BY key", "hashes")
def _(ks):
    return core.removed_counts(ks.hashes, ks.hashes.where("value = '1-URGENT'"), hashes.FIELD).select("key", "removed")


@query("hexists", f"SELECT r.idx, r.key, r.field, CASE WHEN h.key IS NULL THEN 0 ELSE 1 END AS found FROM {_HREQ} LEFT JOIN hashes h ON r.key = h.key AND r.field = h.field", "hashes")
def _(ks):
    return hashes.hexists(ks.hashes, _hreq(ks)).select("idx", "key", "field", "found")


def _spent(ks, kind):
    o = ks.table("orders").select(F.lit(0).alias("db"), F.col("o_custkey").cast("string").alias("key"), F.col("o_orderpriority").alias("field"), (F.round(F.col("o_totalprice") * 100)).cast("bigint").alias("delta"))
    base = ks.hashes.select("db", "key", F.col("value").alias("field")).distinct().withColumn("value", F.lit("10"))
    return hashes.hincrby(base, o.withColumn("delta", F.col("delta") / 4) if kind == "double" else o, kind)


@query("hincrby", "SELECT CAST(o_custkey AS VARCHAR) AS key, o_orderpriority AS field, CAST(10 + sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS value FROM orders GROUP BY 1, 2")
def _(ks):
    return _spent(ks, "bigint").select("key", "field", "value")


@query("hincrbyfloat", "SELECT CAST(o_custkey AS VARCHAR) AS key, o_orderpriority AS field, round(10 + sum(CAST(round(o_totalprice * 100) AS DOUBLE) / 4), 2) AS value FROM orders GROUP BY 1, 2")
def _(ks):
    return _spent(ks, "double").select("key", "field", F.round("value", 2).alias("value"))


@query("hkeys", "SELECT field FROM hashes WHERE key = '899'", "hashes")
def _(ks):
    return ks.hashes.where("key = '899'").select("field")


@query("hvals", "SELECT value FROM hashes WHERE key = '899'", "hashes")
def _(ks):
    return ks.hashes.where("key = '899'").select("value")


@query("hgetall", "SELECT key, string_agg(field || '=' || value, ',' ORDER BY field) AS entries FROM hashes GROUP BY key", "hashes")
def _(ks):
    flat = F.transform(F.map_entries("entries"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return hashes.hgetall(ks.hashes).select("key", F.concat_ws(",", flat).alias("entries"))


@query("hlen", "SELECT key, CAST(count(*) AS BIGINT) AS length FROM hashes GROUP BY key", "hashes")
def _(ks):
    return hashes.hlen(ks.hashes).select("key", "length")


@query("hstrlen", "SELECT key, field, CAST(strlen(value) AS BIGINT) AS length FROM hashes", "hashes")
def _(ks):
    return hashes.hstrlen(ks.hashes).select("key", "field", "length")


@query("hscan", "SELECT field, value FROM hashes WHERE key = '899' AND field LIKE '1%' ORDER BY field LIMIT 3 OFFSET 0", "hashes")
def _(ks):
    return core.scan(ks.hashes.where("key = '899'"), ["field"], 0, 3, ("field", "1*")).select("field", "value")


@query("hrandfield", "SELECT key, field, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY md5('0:0:' || key || ':' || field), field) AS rn FROM hashes) WHERE rn <= 2", "hashes")
def _(ks):
    return core.sample_per_key(ks.hashes, "field", 2).select("key", "field", "value")


# Lists


def _pushed(ks):
    """Two values for every list: its key, then its key with a mark."""
    keys = ks.lists.select("db", "key").distinct()
    return keys.select("db", "key", F.explode(F.array(F.struct(F.lit(0).alias("ord"), F.lit("a").alias("value")), F.struct(F.lit(1).alias("ord"), F.lit("b").alias("value")))).alias("x")).select("db", "key", "x.ord", "x.value")


@query("lpush", "SELECT key, pos + 2 AS pos, value FROM lists UNION ALL SELECT DISTINCT key, 0, 'b' FROM lists UNION ALL SELECT DISTINCT key, 1, 'a' FROM lists", "lists")
def _(ks):
    return lists.push(ks.lists, _pushed(ks), head=True).select("key", "pos", "value")


@query("rpush", "SELECT key, pos, value FROM lists UNION ALL SELECT key, count(*), 'a' FROM lists GROUP BY key UNION ALL SELECT key, count(*) + 1, 'b' FROM lists GROUP BY key", "lists")
def _(ks):
    return lists.push(ks.lists, _pushed(ks), head=False).select("key", "pos", "value")


@query("lpop", "SELECT key, arg_min(value, pos) AS value FROM lists GROUP BY key", "lists")
def _(ks):
    return lists.ends(ks.lists, head=True).select("key", "value")


@query("rpop", "SELECT key, arg_max(value, pos) AS value FROM lists GROUP BY key", "lists")
def _(ks):
    return lists.ends(ks.lists, head=False).select("key", "value")


@query("rpop_rest", "SELECT key, pos, value FROM (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM lists) WHERE pos < n - 1", "lists")
def _(ks):
    return lists.pop_rest(ks.lists, head=False).select("key", "pos", "value")


@query("llen", "SELECT key, CAST(count(*) AS BIGINT) AS length FROM lists GROUP BY key", "lists")
def _(ks):
    return lists.llen(ks.lists).select("key", "length")


@query("lindex", "SELECT key, value FROM lists WHERE pos = 2", "lists")
def _(ks):
    return lists.lindex(ks.lists, 2).select("key", "value")


@query("lset", "SELECT key, pos, CASE WHEN pos = n - 1 THEN 'X' ELSE value END AS value FROM (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM lists)", "lists")
def _(ks):
    return lists.lset(ks.lists, -1, "X").select("key", "pos", "value")


@query("lrange", "SELECT key, pos AS i, value FROM (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM lists) WHERE pos BETWEEN 1 AND n - 2", "lists")
def _(ks):
    return lists.lrange(ks.lists, 1, -2).select("key", "i", "value")


@query("ltrim", "SELECT key, CASE WHEN n < 3 THEN pos ELSE pos - 1 END AS pos, value FROM (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM lists) WHERE n < 3 OR pos BETWEEN 1 AND n - 2", "lists")
def _(ks):
    return lists.ltrim(ks.lists, 1, -2).select("key", "pos", "value")


@query("lrem", "SELECT key, row_number() OVER (PARTITION BY key ORDER BY pos) - 1 AS pos, value FROM (SELECT *, row_number() OVER (PARTITION BY key, value ORDER BY pos) AS nth FROM lists) WHERE NOT (value = '5' AND nth <= 1)", "lists")
def _(ks):
    return lists.lrem(ks.lists, 1, "5").select("key", "pos", "value")


@query("linsert", "SELECT key, row_number() OVER (PARTITION BY key ORDER BY p) - 1 AS pos, value FROM (SELECT key, 2 * pos AS p, value FROM lists UNION ALL SELECT key, 2 * min(pos) - 1, 'X' FROM lists WHERE value = '5' GROUP BY key)", "lists")
def _(ks):
    return lists.linsert(ks.lists, "5", "X", before=True).select("key", "pos", "value")


@query("lpos", "SELECT key, min(pos) AS i FROM lists WHERE value = '5' GROUP BY key", "lists")
def _(ks):
    return lists.lpos(ks.lists, "5").select("key", "i")


# Sets

A, B, C = "click:2024-01-01", "click:2024-01-02", "view:2024-01-01"
_NEWS = "(SELECT DISTINCT 'click:2024-01-01' AS key, member FROM sets WHERE key = 'view:2024-01-01')"


def _news(ks):
    return ks.sets.where(F.col("key") == C).withColumn("key", F.lit(A))


@query("sadd", f"SELECT key, member FROM sets UNION SELECT key, member FROM {_NEWS}", "sets")
def _(ks):
    return sets.sadd(ks.sets, _news(ks)).select("key", "member")


@query("sadd_added", f"SELECT key, CAST(count(*) AS BIGINT) AS added FROM (SELECT key, member FROM {_NEWS} EXCEPT SELECT key, member FROM sets) GROUP BY key", "sets")
def _(ks):
    return sets.sadd_counts(ks.sets, _news(ks)).select("key", "added")


@query("srem", f"SELECT key, member FROM sets EXCEPT SELECT key, member FROM {_NEWS}", "sets")
def _(ks):
    return sets.srem(ks.sets, _news(ks)).select("key", "member")


@query("spop", "SELECT key, member FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY md5('1:0:' || key || ':' || member), member) AS rn FROM sets) WHERE rn <= 1", "sets")
def _(ks):
    return core.sample_per_key(ks.sets, "member", 1, seed=1).select("key", "member")


@query("srandmember", "SELECT key, member FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY md5('2:0:' || key || ':' || member), member) AS rn FROM sets) WHERE rn <= 3", "sets")
def _(ks):
    return core.sample_per_key(ks.sets, "member", 3, seed=2).select("key", "member")


_SREQ = "(VALUES (0, 'click:2024-01-01', '8'), (1, 'click:2024-01-01', '46'), (2, 'view:2024-01-01', '8'), (3, 'none', '8')) r(idx, key, member)"
for _name in ("sismember", "smismember"):

    @query(_name, f"SELECT r.idx, r.key, r.member, CASE WHEN s.key IS NULL THEN 0 ELSE 1 END AS found FROM {_SREQ} LEFT JOIN sets s ON r.key = s.key AND r.member = s.member", "sets")
    def _(ks):
        asked = ks.spark.createDataFrame([(0, A, "8"), (1, A, "46"), (2, C, "8"), (3, "none", "8")], "idx int, key string, member string")
        return sets.sismember(ks.sets, asked).select("idx", "key", "member", "found")


@query("smembers", "SELECT member FROM brands WHERE key = 'Brand#2'", "brands")
def _(ks):
    return ks.brands.where("key = 'Brand#2'").select("member")


@query("scard", "SELECT key, CAST(count(DISTINCT member) AS BIGINT) AS card FROM sets GROUP BY key", "sets")
def _(ks):
    return sets.scard(ks.sets).select("key", "card")


@query("smove", f"SELECT DISTINCT CASE WHEN key = '{A}' AND member = '8' THEN '{B}' ELSE key END AS key, member FROM sets", "sets")
def _(ks):
    return sets.smove(ks.sets, A, B, "8").select("key", "member")


def _of(k: str) -> str:
    return f"SELECT member FROM sets WHERE key = '{k}'"


_ALGEBRA = {
    "sinter": (lambda t: sets.sinter(t, [A, B, C]), f"({_of(A)} INTERSECT {_of(B)} INTERSECT {_of(C)})"),
    "sunion": (lambda t: sets.sunion(t, [A, B, C]), f"({_of(A)} UNION {_of(B)} UNION {_of(C)})"),
    "sdiff": (lambda t: sets.sdiff(t, A, [B, C]), f"({_of(A)} EXCEPT ({_of(B)} UNION {_of(C)}))"),
}
for _name, (_fn, _sql) in _ALGEBRA.items():

    @query(_name, f"SELECT member FROM {_sql}", "sets")
    def _(ks, fn=_fn):
        return fn(ks.sets).select("member")

    @query(_name + "store", f"SELECT key, member FROM sets WHERE key <> '{C}' UNION ALL SELECT '{C}', member FROM {_sql}", "sets")
    def _(ks, fn=_fn):
        return sets.store(ks.sets, C, fn(ks.sets)).select("key", "member")


@query("sscan", "SELECT member FROM sets WHERE key = 'click:2024-01-01' ORDER BY member LIMIT 10 OFFSET 5", "sets")
def _(ks):
    return core.scan(ks.sets.where(F.col("key") == A), ["member"], 5, 10).select("member")


@query("is_subset", "SELECT NOT EXISTS (SELECT member FROM brands WHERE key = 'Brand#2' EXCEPT SELECT member FROM brands WHERE key = 'Brand#17') AS subset", "brands")
def _(ks):
    return sets.is_subset(ks.brands, "Brand#2", "Brand#17").select("subset")
