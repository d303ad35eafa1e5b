"""Queries over append-only streams and consumer groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.operators import streams
from keyloom.registry import query

LO, HI = 1704300000000, 1705300000000
AFTER = "(s.ms > g.last_ms OR (s.ms = g.last_ms AND s.seq > g.last_seq))"


@query("xadd", "SELECT key, ms, seq, event_id FROM hours", "hours")
def _(ks):
    """Hour-granular ids by appending every event to empty streams."""
    new = ks.hours.withColumn("ord", F.col("event_id"))
    return streams.xadd(ks.hours.where(F.lit(False)), new).select("key", "ms", "seq", "event_id")


@query("xlen", "SELECT key, CAST(count(*) AS BIGINT) AS length FROM streams GROUP BY key", "streams")
def _(ks):
    return streams.xlen(ks.streams).select("key", "length")


for _name, _dir, _rev in (("xrange", "", False), ("xrevrange", "DESC", True)):

    @query(_name, f"SELECT key, ms, seq, user_id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms {_dir}, seq {_dir}) AS rn FROM streams WHERE ms BETWEEN {LO} AND {HI}) WHERE rn <= 25", "streams")
    def _(ks, rev=_rev):
        return streams.xrange(ks.streams, (LO, 0), (HI, 1 << 40), 25, rev).select("key", "ms", "seq", "user_id")


@query("xread", f"SELECT s.key, s.ms, s.seq FROM streams s JOIN groups g ON s.key = g.key WHERE {AFTER}", "streams groups")
def _(ks):
    return streams.xread(ks.streams, ks.groups.drop("grp")).select("key", "ms", "seq")


@query("xdel", "SELECT key, ms, seq FROM streams WHERE event_id % 4 <> 0", "streams")
def _(ks):
    return streams.xdel(ks.streams, ks.streams.where("event_id % 4 = 0")).select("key", "ms", "seq")


@query("xtrim", "SELECT key, ms, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms DESC, seq DESC) AS rn FROM streams) WHERE rn <= 100", "streams")
def _(ks):
    return streams.xtrim(ks.streams, 100).select("key", "ms", "seq")


@query("xgroup", "SELECT key, 'g2' AS grp, max(ms) AS last_ms, arg_max(seq, (ms, seq)) AS last_seq FROM streams GROUP BY key UNION ALL SELECT key, grp, last_ms, last_seq FROM groups", "streams groups")
def _(ks):
    return streams.xgroup_create(ks.streams, "g2", True).unionByName(ks.groups).select("key", "grp", "last_ms", "last_seq")


def _consumer():
    return F.concat(F.lit("consumer"), (F.col("event_id") % 3).cast("string"))


def _delivered(ks):
    return streams.xreadgroup(ks.streams, ks.groups, _consumer()).select("db", "key", "grp", "consumer", "ms", "seq", "event_id")


def _pending(ks):
    return streams.xack(_delivered(ks), _delivered(ks).where("event_id % 4 = 0"))


@query("xreadgroup", f"SELECT key, ms, seq, consumer FROM (SELECT s.key, s.ms, s.seq, 'consumer' || CAST(s.event_id % 3 AS VARCHAR) AS consumer, row_number() OVER (PARTITION BY s.key ORDER BY s.ms, s.seq) AS rn FROM streams s JOIN groups g ON s.key = g.key WHERE {AFTER}) WHERE rn <= 50", "streams groups")
def _(ks):
    return streams.xreadgroup(ks.streams, ks.groups, _consumer(), 50).select("key", "ms", "seq", "consumer")


@query("xgroup_advance", "SELECT key, grp, max(ms) AS last_ms, arg_max(seq, (ms, seq)) AS last_seq FROM delivered GROUP BY key, grp", "streams groups delivered")
def _(ks):
    return streams.advance(ks.groups, _delivered(ks)).select("key", "grp", "last_ms", "last_seq")


@query("xack", "SELECT key, ms, seq, consumer FROM pending", "streams groups delivered pending")
def _(ks):
    return _pending(ks).select("key", "ms", "seq", "consumer")


@query("xclaim", "SELECT key, ms, seq, CASE WHEN event_id % 5 = 0 THEN 'consumer9' ELSE consumer END AS consumer FROM pending", "streams groups delivered pending")
def _(ks):
    p = _pending(ks)
    return streams.xclaim(p, p.where("event_id % 5 = 0"), "consumer9").select("key", "ms", "seq", "consumer")


@query("xpending", "SELECT key, grp, consumer, CAST(count(*) AS BIGINT) AS n, min(ms) AS min_ms, max(ms) AS max_ms FROM pending GROUP BY key, grp, consumer", "streams groups delivered pending")
def _(ks):
    return streams.xpending(_pending(ks)).select("key", "grp", "consumer", "n", "min_ms", "max_ms")


@query("xinfo", "SELECT key, CAST(count(*) AS BIGINT) AS length, min(ms) AS first_ms, max(ms) AS last_ms, CAST(1 AS BIGINT) AS groups FROM streams GROUP BY key", "streams")
def _(ks):
    return streams.xinfo(ks.streams, ks.groups).select("key", "length", "first_ms", "last_ms", "groups")


@query("reject_late", "SELECT key, event_id FROM (SELECT *, max(ms2) OVER (PARTITION BY key ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM (SELECT key, event_id, CASE WHEN event_id % 7 = 0 THEN ms - 90000000 ELSE ms END AS ms2 FROM streams)) WHERE best IS NULL OR ms2 > best", "streams")
def _(ks):
    """Every seventh id is a day old: late ones are refused (ids are unique per ms here)."""
    new = ks.streams.withColumns({"ms": F.when(F.col("event_id") % 7 == 0, F.col("ms") - 90_000_000).otherwise(F.col("ms")), "ord": F.col("event_id"), "seq": F.lit(0).cast("bigint")})
    return streams.reject_late(new).select("key", "event_id")
