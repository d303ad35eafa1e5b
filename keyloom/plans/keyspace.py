"""Queries over key metadata, TTL, introspection, eviction, persistence, pub/sub, transactions and scripts."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import functions as F

from keyloom.client import command_info
from keyloom.operators import core, evict, keys, pubsub, scripts, tx
from keyloom.registry import query
from keyloom.sources import snapshot

T = "TIMESTAMP '1997-01-01 00:00:00'"


@query("del", "SELECT key FROM meta WHERE CAST(substr(key, 7) AS BIGINT) % 3 <> 0", "meta")
def _(ks):
    return keys.delete(ks.meta, ks.meta.where(F.substring("key", 7, 20).cast("bigint") % 3 == 0)).select("key")


@query("exists", "SELECT CAST(count(*) AS BIGINT) AS n FROM (VALUES ('order:0'), ('order:1'), ('order:1'), ('order:10'), ('none')) r(key) JOIN live l ON r.key = l.key", "meta live")
def _(ks):
    return keys.exists(ks.meta, ks.requests("key", ["order:0", "order:1", "order:1", "order:10", "none"]), ks.now)


@query("type", "SELECT DISTINCT key, 'string' AS type FROM strings UNION ALL SELECT DISTINCT key, 'hash' FROM hashes UNION ALL SELECT DISTINCT key, 'set' FROM sets UNION ALL SELECT DISTINCT key, 'zset' FROM zsets UNION ALL SELECT DISTINCT key, 'stream' FROM streams", "strings hashes sets zsets streams")
def _(ks):
    return keys.type_of(string=ks.strings, hash=ks.hashes, set=ks.sets, zset=ks.zsets, stream=ks.streams).select("key", "type")


@query("keys", "SELECT key FROM live WHERE key LIKE 'order:1_5%'", "meta live")
def _(ks):
    return keys.keys(ks.meta, "order:1?5*", ks.now).select("key")


@query("randomkey", "SELECT key FROM live ORDER BY md5('0:' || key), key LIMIT 1", "meta live")
def _(ks):
    return keys.randomkey(ks.meta, ks.now).select("key")


_ROW = "expire_at, size"


@query("rename", f"SELECT CASE WHEN key = 'order:5' THEN 'order:6' ELSE key END AS key, {_ROW} FROM meta WHERE key <> 'order:6'", "meta")
def _(ks):
    return keys.rename(ks.meta, "order:5", "order:6").select("key", "expire_at", "size")


@query("renamenx", f"SELECT CASE WHEN key = 'order:5' THEN 'fresh' ELSE key END AS key, {_ROW} FROM meta", "meta")
def _(ks):
    return keys.renamenx(keys.renamenx(ks.meta, "order:5", "order:6"), "order:5", "fresh").select("key", "expire_at", "size")


@query("expire", f"SELECT key, {T} + INTERVAL 100 SECOND AS expire_at FROM live", "meta live")
def _(ks):
    return keys.expire(ks.meta, ks.now, 100).select("key", "expire_at")


@query("expireat", "SELECT key, TIMESTAMP '2001-09-09 01:46:40' AS expire_at FROM live", "meta live")
def _(ks):
    return keys.expireat(ks.meta, ks.now, 1_000_000_000).select("key", "expire_at")


for _name, _unit in (("ttl", 1), ("pttl", 1000)):

    @query(_name, f"SELECT key, CASE WHEN expire_at IS NULL THEN -1 WHEN expire_at <= {T} THEN -2 ELSE {_unit} * date_diff('second', {T}, expire_at) END AS {_name} FROM meta", "meta")
    def _(ks, name=_name):
        return keys.ttl(ks.meta, ks.now).select("key", name)


@query("persist", "SELECT key, CAST(NULL AS TIMESTAMP) AS expire_at FROM live", "meta live")
def _(ks):
    return keys.persist(ks.meta, ks.now).select("key", "expire_at")


@query("flushdb", "SELECT key FROM meta WHERE false", "meta")
def _(ks):
    return keys.flush(ks.meta, 0).select("key")


@query("flushall", "SELECT key FROM meta WHERE false", "meta")
def _(ks):
    return keys.flush(ks.meta).select("key")


@query("scan", "SELECT key FROM meta WHERE key LIKE 'order:2%' ORDER BY key LIMIT 50 OFFSET 100", "meta")
def _(ks):
    return core.scan(ks.meta, ["key"], 100, 50, ("key", "order:2*")).select("key")


@query("expired", f"SELECT key FROM meta WHERE expire_at <= {T}", "meta")
def _(ks):
    """What an active expiry sweep removes."""
    return ks.meta.join(core.live(ks.meta, ks.now), ["db", "key"], "left_anti").select("key")


@query("object", "SELECT key, CASE WHEN try_cast(value AS BIGINT) IS NOT NULL THEN 'int' WHEN strlen(value) <= 44 THEN 'embstr' ELSE 'raw' END AS encoding FROM (SELECT key, value FROM strings UNION ALL SELECT key, CAST(value AS VARCHAR) FROM counters)", "strings counters")
def _(ks):
    return keys.encoding(ks.strings.unionByName(ks.counters.withColumn("value", F.col("value").cast("string")))).select("key", "encoding")


@query("memory", "SELECT key, CAST(32 + strlen(value) AS BIGINT) AS bytes FROM strings UNION ALL SELECT DISTINCT key, CAST(160 AS BIGINT) FROM hashes UNION ALL SELECT DISTINCT key, CAST(96 AS BIGINT) FROM lists UNION ALL SELECT DISTINCT 'l' || key, CAST(288 AS BIGINT) FROM streams", "strings hashes lists streams")
def _(ks):
    types = keys.type_of(string=ks.strings, hash=ks.hashes, list=ks.lists, stream=ks.streams.withColumn("key", F.concat(F.lit("l"), "key")))
    return keys.memory_usage(types, ks.strings).select("key", "bytes")


# Eviction

_VICTIMS = "SELECT key FROM (SELECT key, sum(size) OVER (ORDER BY {} ROWS UNBOUNDED PRECEDING) - size AS ahead FROM meta {}) WHERE ahead < 20000"
for _policy, _order, _where in (("lru", "last_access, key", ""), ("lfu", "freq, last_access, key", ""), ("ttl", "expire_at, key", "WHERE expire_at IS NOT NULL")):

    @query("evict_" + _policy, _VICTIMS.format(_order, _where), "meta")
    def _(ks, policy=_policy):
        return evict.evict(ks.meta, policy, 20000).select("key")


@query("evict_random", _VICTIMS.format("md5('0:' || key), key", ""), "meta")
def _(ks):
    return evict.evict(ks.meta, "random", 20000).select("key")


@query("lfu_decay", f"SELECT key, CAST(greatest(freq - greatest(date_diff('minute', last_access, {T}) // 10000, 0), 0) AS BIGINT) AS freq FROM meta", "meta")
def _(ks):
    return evict.lfu_decay(ks.meta, ks.now, 10000).select("key", "freq")


# Persistence: the state equals the replay of the compacted log.

_STATE = "SELECT key, arg_max(value, seq) AS value FROM changes GROUP BY key HAVING arg_max(op, seq) = 'SET'"


@query("bgrewriteaof", _STATE, "changes")
def _(ks):
    return core.fold_last(snapshot.rewrite(ks.changes), ["db", "key"]).select("key", "value")


@query("changelog_versions", "SELECT key, CAST(count(*) AS BIGINT) AS version FROM changes GROUP BY key", "changes")
def _(ks):
    return tx.versions(ks.changes).select("key", "version")


def _stored(ks) -> str:
    return f"{snapshot.scratch_dir(ks.spark)}/saved-{uuid.uuid4().hex}"


@query("save", "SELECT key, value FROM counters", "counters")
def _(ks):
    """What a snapshot gives back."""
    path = _stored(ks)
    snapshot.save(ks.counters, path, 1)
    return snapshot.load(ks.spark, path).select("key", "value")


@query("bgsave", "SELECT key, value FROM counters WHERE value > 0", "counters")
def _(ks):
    """The latest of two snapshots, the second from a driver thread."""
    path = _stored(ks)
    snapshot.save(ks.counters, path, 1)
    snapshot.bgsave(ks.counters.where("value > 0"), path, 2).result()
    return snapshot.load(ks.spark, path).select("key", "value")


@query("lastsave", "SELECT CAST(2 AS BIGINT) AS version, true AS at_its_time")
def _(ks):
    path, began = _stored(ks), int(time.time())
    for version in (1, 2):
        snapshot.save(ks.strings, path, version)
    return snapshot.lastsave(ks.spark, path).select("version", F.col("saved_at").between(began, int(time.time())).alias("at_its_time"))


@query("appendonly", _STATE, "changes")
def _(ks):
    """State from a log appended to in two parts."""
    log = snapshot.ChangeLog(_stored(ks))
    for odd in (0, 1):
        log.append(ks.changes.where(F.col("seq") % 2 == odd))
    return log.replay(ks.spark).select("key", "value")


# Pub/sub

#: The two patterns with escapes, and the one that is no pattern, as the regular expressions that they stand for.
_REGEX = r"CASE s.pattern WHEN '\*lick' THEN '\*lick' WHEN 'v[iI]e\w' THEN 'v[iI]ew' WHEN 'cl[ick' THEN '[^\s\S]' ELSE replace(replace(s.pattern, '*', '[^/]*'), '?', '[^/]') END"
_MATCH = f"((s.kind = 'channel' AND s.pattern = e.channel) OR (s.kind = 'pattern' AND regexp_full_match(e.channel, {_REGEX})))"


@query("publish", f"SELECT e.event_id, CAST(count(*) FILTER (WHERE s.kind = 'channel') AS BIGINT) AS channel_receivers, CAST(count(*) FILTER (WHERE s.kind = 'pattern') AS BIGINT) AS pattern_receivers FROM (SELECT event_type AS channel, event_id FROM events) e LEFT JOIN subs s ON {_MATCH} GROUP BY e.event_id", "subs")
def _(ks):
    return pubsub.publish(ks.messages, ks.subs).select("event_id", "channel_receivers", "pattern_receivers")


for _name, _kind in (("subscribe", "channel"), ("psubscribe", "pattern")):

    @query(_name, f"SELECT s.conn, e.channel, CAST(count(*) AS BIGINT) AS n FROM (SELECT event_type AS channel, event_id FROM events) e JOIN subs s ON {_MATCH} WHERE s.kind = '{_kind}' GROUP BY ALL", "subs")
    def _(ks, kind=_kind):
        return pubsub.deliveries(ks.messages, ks.subs.where(F.col("kind") == kind)).groupBy("conn", "channel").agg(F.count("*").alias("n"))


@query("unsubscribe", "SELECT conn, kind, pattern FROM subs WHERE NOT (conn = 'c1' AND kind = 'channel') AND NOT (conn = 'c2' AND kind = 'channel' AND pattern = 'click')", "subs")
def _(ks):
    gone = ks.spark.createDataFrame([("c1", "channel", None), ("c2", "channel", "click")], "conn string, kind string, pattern string")
    return pubsub.unsubscribe(ks.subs, gone).select("conn", "kind", "pattern")


@query("punsubscribe", "SELECT conn, kind, pattern FROM subs WHERE NOT (conn = 'c3' AND kind = 'pattern')", "subs")
def _(ks):
    gone = ks.spark.createDataFrame([("c3", "pattern", None)], "conn string, kind string, pattern string")
    return pubsub.unsubscribe(ks.subs, gone).select("conn", "kind", "pattern")


@query("pubsub_channels", "SELECT DISTINCT pattern AS channel FROM subs WHERE kind = 'channel' AND pattern LIKE 'c%'", "subs")
def _(ks):
    return pubsub.channels(ks.subs, "c*")


@query("pubsub_numsub", "SELECT pattern AS channel, CAST(count(DISTINCT conn) AS BIGINT) AS n FROM subs WHERE kind = 'channel' GROUP BY 1", "subs")
def _(ks):
    return pubsub.numsub(ks.subs)


@query("pubsub_numpat", "SELECT CAST(count(DISTINCT pattern) AS BIGINT) AS n FROM subs WHERE kind = 'pattern'", "subs")
def _(ks):
    return pubsub.numpat(ks.subs)


# Transactions: a batch is one customer's orders of a day; it watched the customer at version = order count so far.


def _batches(ks):
    o = ks.table("orders")
    queued = o.select(F.concat_ws(":", F.col("o_custkey").cast("string"), F.to_date("o_orderdate").cast("string")).alias("batch"), F.lit(0).alias("db"), F.col("o_custkey").cast("string").alias("key"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("value"))
    current = queued.groupBy("db", "key").agg(F.count("*").alias("version"))
    seen = queued.groupBy("batch", "db", "key").agg((F.max("seq") % 20).alias("version"))
    return queued, seen, current


_TX = "q AS (SELECT CAST(o_custkey AS VARCHAR) || ':' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS batch, CAST(o_custkey AS VARCHAR) AS key, o_orderkey AS seq, o_orderpriority AS value FROM orders), cur AS (SELECT key, count(*) AS version FROM q GROUP BY key), bad AS (SELECT b.batch FROM (SELECT batch, key, max(seq) % 20 AS version FROM q GROUP BY batch, key) b JOIN cur c ON b.key = c.key WHERE b.version <> c.version)"


@query("watch", f"WITH {_TX} SELECT DISTINCT batch FROM bad")
def _(ks):
    _, seen, current = _batches(ks)
    return tx.conflicts(seen, current).select("batch")


@query("exec", f"WITH {_TX} SELECT key, max(seq) AS seq, arg_max(value, seq) AS value FROM q WHERE batch NOT IN (SELECT batch FROM bad) GROUP BY key")
def _(ks):
    queued, seen, current = _batches(ks)
    return tx.exec_(queued, seen, current).select("key", "seq", "value")


def _raised(ks, t: tx.Transaction):
    """Two queued steps: every counter plus one, those below 100 removed."""
    t.multi()
    t.add(lambda state: state.withColumn("value", F.col("value") + 1))
    t.add(lambda state: state.where("value >= 100"))
    return t


_RAISED = "SELECT key, value + 1 AS value FROM counters WHERE value + 1 >= 100"


@query("multi", _RAISED, "counters")
def _(ks):
    return _raised(ks, tx.Transaction()).exec(ks.counters, {}).select("key", "value")


@query("discard", "SELECT key, value FROM counters", "counters")
def _(ks):
    """Discarded steps leave no trace in the next transaction."""
    t = _raised(ks, tx.Transaction())
    t.discard()
    t.multi()
    return t.exec(ks.counters, {}).select("key", "value")


@query("unwatch", _RAISED, "counters")
def _(ks):
    """A watched key that moved does not matter after UNWATCH."""
    t = tx.Transaction()
    t.watch({"cust:1": 1})
    t.unwatch()
    return _raised(ks, t).exec(ks.counters, {"cust:1": 2}).select("key", "value")


# Scripts and server

_BODY = "SELECT key, value FROM {strings} WHERE array_contains(:keys, key) OR value = :argv[0]"
_SCRIPT = "SELECT key, value FROM strings WHERE key IN ('part:1', 'part:2') OR value = 'red widget'"


@query("eval", _SCRIPT, "strings")
def _(ks):
    return scripts.ScriptRegistry().eval(ks.spark, _BODY, ["part:1", "part:2"], ["red widget"], strings=ks.strings)


@query("evalsha", _SCRIPT, "strings")
def _(ks):
    r = scripts.ScriptRegistry()
    return r.evalsha(ks.spark, r.load(_BODY), ["part:1", "part:2"], ["red widget"], strings=ks.strings)


@query("script", "SELECT * FROM (VALUES ('loaded', 1), ('unknown', 0), ('flushed', 0)) t(what, n)")
def _(ks):
    r = scripts.ScriptRegistry()
    sha = r.load(_BODY)
    found = [("loaded", *r.exists(sha)), ("unknown", *r.exists("0" * 40))]
    r.flush()
    return ks.spark.createDataFrame([*found, ("flushed", *r.exists(sha))], "what string, n int")


@query("ping", "SELECT 'PONG' AS reply")
def _(ks):
    return ks.spark.range(1).select(F.lit("PONG").alias("reply"))


@query("echo", "SELECT 'hello' AS reply")
def _(ks):
    return ks.spark.range(1).select(F.lit("hello").alias("reply"))


@query("select", "SELECT key FROM meta WHERE 0 = 0", "meta")
def _(ks):
    return ks.meta.where("db = 0").select("key")


@query("info", f"SELECT CAST(count(*) AS BIGINT) AS keys, CAST(count(expire_at) AS BIGINT) AS expires, CAST(floor(avg(date_diff('second', {T}, expire_at))) AS BIGINT) AS avg_ttl FROM live", "meta live")
def _(ks):
    return keys.info(ks.meta, ks.now).select("keys", "expires", "avg_ttl")


@query("dbsize", "SELECT CAST(count(*) AS BIGINT) AS keys FROM live", "meta live")
def _(ks):
    return keys.dbsize(ks.meta, ks.now).select("keys")


@query("time", "SELECT true AS near, true AS in_range")
def _(ks):
    """The reply's seconds against the driver's clock, and its microseconds."""
    us = ks.spark.range(1).select(F.unix_micros(F.current_timestamp()).alias("us"))
    reply = us.select(F.floor(F.col("us") / 1_000_000).alias("seconds"), (F.col("us") % 1_000_000).alias("micros"))
    return reply.select((F.abs(F.col("seconds") - F.lit(int(time.time()))) < 600).alias("near"), F.col("micros").between(0, 999_999).alias("in_range"))


#: Name, arity, first key, last key and step of some commands.
_INFO = [("GET", 2, 1, 1, 1), ("SET", -3, 1, 1, 1), ("MGET", -2, 1, -1, 1), ("HGET", 3, 1, 1, 1), ("HSET", -4, 1, 1, 1), ("LPUSH", -3, 1, 1, 1), ("LRANGE", 4, 1, 1, 1), ("SADD", -3, 1, 1, 1), ("SINTER", -2, 1, -1, 1), ("ZADD", -4, 1, 1, 1), ("ZSCORE", 3, 1, 1, 1), ("DEL", -2, 1, -1, 1), ("EXPIRE", 3, 1, 1, 1), ("TTL", 2, 1, 1, 1), ("PING", -1, 0, 0, 0)]


@query("command", f"SELECT * FROM (VALUES {', '.join(map(str, _INFO))}) t(name, arity, first_key, last_key, step)")
def _(ks):
    rows = [(i[0], i[1], *i[3:]) for i in (command_info(x[0]) for x in _INFO)]
    return ks.spark.createDataFrame(rows, "name string, arity int, first_key int, last_key int, step int")
