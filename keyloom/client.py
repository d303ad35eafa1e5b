"""Text commands over a stored keyspace: one command at a time, each running the set-oriented operators.

State is a versioned Parquet table per type under one path, written by a single writer: a write makes a new immutable
version of its table, then the pointer in this object moves. A client opened on a path that holds versions goes on from
the last whole one of each table, and no version is ever written over. This is a convenience for trying commands and for
scripts; bulk work belongs to the operators themselves, which take whole tables of requests.

Replies: None for nil, int, float, str, list or dict. Errors are raised as CommandError.
"""

from __future__ import annotations

import datetime
import inspect
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions.text import glob_regex
from keyloom.operators import bitmaps, core, geo, hashes, hll, keys, lists, pubsub, scripts, sets, streams, strings, tx, zsets

TABLES = {
    "string": "db int, key string, value string",
    "hash": "db int, key string, field string, value string",
    "list": "db int, key string, pos bigint, value string",
    "set": "db int, key string, member string",
    "zset": "db int, key string, member string, score double",
    "stream": "db int, key string, ms bigint, seq bigint, fields map<string,string>",
    "bitmap": "db int, key string, bit bigint",
    "hll": "db int, key string, sketch binary",
    "geo": "db int, key string, member string, lon double, lat double, score bigint",
    "expiry": "db int, key string, expire_at timestamp_ntz",
    "version": "db int, key string, version bigint",
    "grp": "db int, key string, grp string, last_ms bigint, last_seq bigint",
    "pending": "db int, key string, grp string, consumer string, ms bigint, seq bigint",
    "subs": "conn string, kind string, pattern string",
}
TYPED = ("string", "hash", "list", "set", "zset", "stream", "bitmap", "hll", "geo")
#: Types as commands name them.
NAMES = {"bitmap": "string", "hll": "string", "geo": "zset"}


class CommandError(ValueError):
    pass


def _int(text: str) -> int:
    try:
        return int(text)
    except ValueError:
        raise CommandError("value is not an integer or out of range") from None


def _flat(pairs: list[str]) -> list[tuple[str, str]]:
    if not pairs or len(pairs) % 2:
        raise CommandError("wrong number of arguments")
    return list(zip(pairs[::2], pairs[1::2], strict=True))


def _number(x: float) -> str:
    return str(int(x)) if float(x).is_integer() and abs(x) < 1e17 else repr(float(x))


class Client:
    def __init__(self, spark: SparkSession, path: str, db: int = 0, clock: Callable[[], float] = time.time, conn: str = "c0"):
        self.spark, self.path, self.db, self.clock, self.conn = spark, path.rstrip("/"), db, clock, conn
        self.current: dict[str, DataFrame] = {}
        self.writes, self.saved, self.log = 0, 0, True
        self.registry, self.transaction = scripts.ScriptRegistry(), tx.Transaction()
        self._open()

    # State

    def _open(self) -> None:
        """Point to the last whole version of every table under the path."""
        new = self.spark._jvm.org.apache.hadoop.fs.Path
        files = new(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for name in TABLES:
            if not files.exists(new(f"{self.path}/{name}")):
                continue
            versions = sorted(n for n in (f.getPath().getName() for f in files.listStatus(new(f"{self.path}/{name}"))) if n.startswith("version="))
            self.writes = max([self.writes, *(int(n.partition("=")[2]) for n in versions[-1:])])
            whole = [n for n in versions if files.exists(new(f"{self.path}/{name}/{n}/_SUCCESS"))]
            if whole:
                self.current[name] = self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}/{whole[-1]}")

    def _now(self):
        return datetime.datetime.fromtimestamp(self.clock(), datetime.UTC).replace(tzinfo=None)

    def _rows(self, name: str, rows: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(rows, TABLES[name])

    def _all(self, name: str) -> DataFrame:
        if name not in self.current:
            self.current[name] = self._rows(name, [])
        return self.current[name]

    def _expired(self) -> DataFrame:
        return self._all("expiry").where(F.col("expire_at") <= F.lit(self._now()).cast("timestamp_ntz")).select("db", "key")

    def _t(self, name: str) -> DataFrame:
        """Live rows of all databases."""
        if "expiry" not in self.current:
            return self._all(name)
        return self._all(name).join(self._expired(), ["db", "key"], "left_anti")

    def _own(self, name: str, *names: str) -> DataFrame:
        t = self._t(name).where(F.col("db") == self.db)
        return t.where(F.col("key").isin(list(names))) if names else t

    def _write(self, name: str, df: DataFrame, *touched: str) -> None:
        self.writes += 1
        new = self.spark._jvm.org.apache.hadoop.fs.Path
        files = new(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        while files.exists(new(target := f"{self.path}/{name}/version={self.writes:012d}")):  # of another client
            self.writes += 1
        df.select([c.split()[0] for c in TABLES[name].replace("map<string,string>", "map").split(", ")]).coalesce(1).write.mode("errorifexists").parquet(target)
        self.current[name] = self.spark.read.schema(TABLES[name]).parquet(target)
        if touched and name != "expiry":
            self._forget(name, touched)
        if touched:
            self._write("version", _bumped(self._all("version"), self._rows("version", [(self.db, k, 1) for k in touched])))

    def _forget(self, name: str, touched: tuple[str, ...]) -> None:
        """Keys written anew after their deadline: what is left of their former lives goes."""
        at = (F.col("db") == self.db) & F.col("key").isin(list(touched))
        dead = "expiry" in self.current and [r["key"] for r in self._expired().where(at).collect()]
        if dead:
            gone = (F.col("db") == self.db) & F.col("key").isin(dead)
            for other in (*TYPED, "expiry"):
                if other in self.current and other != name and not self._all(other).where(gone).isEmpty():
                    self._write(other, self._all(other).where(~gone))

    def _type(self, key: str) -> str | None:
        found = [self._own(n, key).select(F.lit(n).alias("type")).limit(1) for n in TYPED if n in self.current]
        if not found:
            return None
        every = found[0]
        for f in found[1:]:
            every = every.unionByName(f)
        row = every.first()
        return row and row["type"]

    def _expect(self, name: str, *names: str) -> None:
        for key in names:
            have = self._type(key)
            if have not in (None, name):
                raise CommandError("WRONGTYPE Operation against a key holding the wrong kind of value")

    def _drop(self, *names: str, but: str = "") -> None:
        """Remove keys from every typed table (except one) and their deadlines."""
        for name in (*TYPED, "expiry"):
            if name in self.current and name != but and not self._all(name).where((F.col("db") == self.db) & F.col("key").isin(list(names))).isEmpty():
                self._write(name, self._all(name).where(~((F.col("db") == self.db) & F.col("key").isin(list(names)))))

    def _live_keys(self) -> DataFrame:
        return keys.type_of(**{n: self._own(n) for n in TYPED}).select("db", "key").distinct()

    def _expire(self, key: str, at: datetime.datetime | None) -> None:
        rest = self._all("expiry").where(~((F.col("db") == self.db) & (F.col("key") == key)))
        self._write("expiry", rest if at is None else rest.unionByName(self._rows("expiry", [(self.db, key, at)])), key)

    # Dispatch

    def execute(self, name: str, *args):
        """Run one command; queued between MULTI and EXEC."""
        name, args = name.upper(), [str(a) for a in args]
        found = getattr(self, "do_" + name.lower(), None)
        if found is None:
            raise CommandError(f"unknown command '{name}'")
        if self.transaction.queue is not None and name not in ("EXEC", "DISCARD", "MULTI", "WATCH"):
            self.transaction.queue.append((name, args))
            return "QUEUED"
        try:
            return found(*args)
        except TypeError as e:
            if "positional argument" in str(e):
                raise CommandError(f"wrong number of arguments for '{name}'") from None
            raise

    # Strings

    def _get(self, key: str) -> str | None:
        row = strings.get(self._own("string"), key).first()
        return row and row["value"]

    def do_set(self, key, value, *options):
        opts, at, nx, xx, want = [o.upper() for o in options], None, False, False, False
        i = 0
        while i < len(opts):
            o = opts[i]
            if o in ("EX", "PX", "EXAT", "PXAT"):
                n = _int(options[i + 1]) / (1000 if o[0] == "P" else 1)
                at = self._now() + datetime.timedelta(seconds=n) if len(o) == 2 else datetime.datetime.fromtimestamp(n, datetime.UTC).replace(tzinfo=None)
                i += 1
            elif o in ("NX", "XX", "GET"):
                nx, xx, want = nx or o == "NX", xx or o == "XX", want or o == "GET"
            else:
                raise CommandError("syntax error")
            i += 1
        if nx and xx:
            raise CommandError("syntax error")
        kind = self._type(key)
        old, there = self._get(key) if want or kind == "string" else None, kind is not None
        if (nx and there) or (xx and not there):
            return old if want else None
        new = self._rows("string", [(self.db, key, value)])
        if kind not in (None, "string"):
            self._drop(key, but="string")
        self._write("string", strings.mset(self._t("string"), new), key)
        if at is not None:
            self._expire(key, at)
        return old if want else "OK"

    def do_get(self, key):
        return self._get(key)

    def do_mget(self, *names):
        asked = self.spark.createDataFrame(list(enumerate(names)), "idx int, key string")
        return [r["value"] for r in strings.mget(self._own("string"), asked).orderBy("idx").collect()]

    def do_mset(self, *pairs):
        rows = dict(_flat(list(pairs)))
        self._write("string", strings.mset(self._t("string"), self._rows("string", [(self.db, k, v) for k, v in rows.items()])), *rows)
        return "OK"

    def do_setex(self, key, seconds, value):
        if _int(seconds) < 0:
            raise CommandError("invalid expire time")
        return self.do_set(key, value, "EX", seconds)

    def do_psetex(self, key, millis, value):
        if _int(millis) < 0:
            raise CommandError("invalid expire time")
        return self.do_set(key, value, "PX", millis)

    def do_setnx(self, key, value):
        return int(self.do_set(key, value, "NX") is not None)

    def do_incrby(self, key, delta):
        have = self._get(key)
        if have is not None:
            _int(have)
        d = self.spark.createDataFrame([(self.db, key, _int(delta))], "db int, key string, delta bigint")
        row = strings.incrby(self._own("string", key), d).first()
        if row["overflow"]:
            raise CommandError("increment or decrement would overflow")
        self._write("string", strings.mset(self._t("string"), self._rows("string", [(self.db, key, str(row["value"]))])), key)
        return row["value"]

    def do_incr(self, key):
        return self.do_incrby(key, "1")

    def do_decr(self, key):
        return self.do_incrby(key, "-1")

    def do_decrby(self, key, delta):
        return self.do_incrby(key, str(-_int(delta)))

    def do_incrbyfloat(self, key, delta):
        d = self.spark.createDataFrame([(self.db, key, float(delta))], "db int, key string, delta double")
        value = strings.incrbyfloat(self._own("string", key), d).first()["value"]
        if value is None:
            raise CommandError("increment would produce NaN or Infinity")
        self.do_set(key, _number(value))
        return _number(value)

    def do_append(self, key, more):
        value = (self._get(key) or "") + more
        self.do_set(key, value)
        return len(value.encode())

    def do_strlen(self, key):
        row = strings.strlen(self._own("string", key)).first()
        return row["length"] if row else 0

    def do_getrange(self, key, start, stop):
        row = strings.getrange(self._own("string", key), _int(start), _int(stop)).first()
        return row["value"] if row else ""

    def do_setrange(self, key, offset, piece):
        value = strings.setrange(self._rows("string", [(self.db, key, self._get(key) or "")]), _int(offset), piece).first()["value"]
        self.do_set(key, value)
        return len(value.encode())

    def do_getset(self, key, value):
        return self.do_set(key, value, "GET")

    # Hashes

    def do_hset(self, key, *pairs):
        self._expect("hash", key)
        new = self._rows("hash", [(self.db, key, f, v) for f, v in dict(_flat(list(pairs))).items()])
        added = hashes.hset_counts(self._own("hash", key), new).first()["added"]
        self._write("hash", hashes.hset(self._t("hash"), new), key)
        return added

    def do_hmset(self, key, *pairs):
        self.do_hset(key, *pairs)
        return "OK"

    def do_hget(self, key, field):
        return self.do_hmget(key, field)[0]

    def do_hmget(self, key, *fields):
        self._expect("hash", key)
        asked = self.spark.createDataFrame([(i, key, f) for i, f in enumerate(fields)], "idx int, key string, field string")
        return [r["value"] for r in hashes.hmget(self._own("hash"), asked).orderBy("idx").collect()]

    def do_hsetnx(self, key, field, value):
        if self.do_hexists(key, field):
            return 0
        return self.do_hset(key, field, value)

    def do_hdel(self, key, *fields):
        gone = self._rows("hash", [(self.db, key, f, None) for f in set(fields)]).drop("value")
        n = core.removed_counts(self._own("hash", key), gone, hashes.FIELD).first()
        self._write("hash", hashes.hdel(self._t("hash"), gone), key)
        return n["removed"] if n else 0

    def do_hexists(self, key, field):
        asked = self.spark.createDataFrame([(0, key, field)], "idx int, key string, field string")
        return hashes.hexists(self._own("hash"), asked).first()["found"]

    def _hincr(self, key, field, delta, kind):
        d = self.spark.createDataFrame([(self.db, key, field, delta)], f"db int, key string, field string, delta {kind}")
        value = hashes.hincrby(self._own("hash", key).where(F.col("field") == field), d, kind).first()["value"]
        self.do_hset(key, field, _number(value) if kind == "double" else str(value))
        return value

    def do_hincrby(self, key, field, delta):
        return self._hincr(key, field, _int(delta), "bigint")

    def do_hincrbyfloat(self, key, field, delta):
        return _number(self._hincr(key, field, float(delta), "double"))

    def do_hgetall(self, key):
        self._expect("hash", key)
        row = hashes.hgetall(self._own("hash", key)).first()
        return row["entries"] if row else {}

    def do_hkeys(self, key):
        return list(self.do_hgetall(key))

    def do_hvals(self, key):
        return list(self.do_hgetall(key).values())

    def do_hlen(self, key):
        row = hashes.hlen(self._own("hash", key)).first()
        return row["length"] if row else 0

    def do_hstrlen(self, key, field):
        row = hashes.hstrlen(self._own("hash", key)).where(F.col("field") == field).first()
        return row["length"] if row else 0

    def _page(self, table: DataFrame, order: list[str], columns: list[str], cursor: str, options: tuple, match: str):
        opts = {k.upper(): v for k, v in _flat(list(options))} if options else {}
        count = _int(opts.get("COUNT", "10"))
        rows = core.scan(table, order, _int(cursor), count, (match, opts["MATCH"]) if "MATCH" in opts else None).select(columns).collect()
        return [_int(cursor) + count if len(rows) == count else 0, [tuple(r) if len(columns) > 1 else r[0] for r in rows]]

    def do_hscan(self, key, cursor, *options):
        return self._page(self._own("hash", key), ["field"], ["field", "value"], cursor, options, "field")

    def do_hrandfield(self, key, n="1", *options):
        rows = core.sample_per_key(self._own("hash", key), "field", abs(_int(n))).collect()
        return [(r["field"], r["value"]) if options else r["field"] for r in rows]

    # Lists

    def _push(self, key, values, head):
        self._expect("list", key)
        new = self.spark.createDataFrame([(self.db, key, i, v) for i, v in enumerate(values)], "db int, key string, ord int, value string")
        self._write("list", lists.push(self._t("list"), new, head), key)
        return self.do_llen(key)

    def do_lpush(self, key, *values):
        return self._push(key, values, True)

    def do_rpush(self, key, *values):
        return self._push(key, values, False)

    def _pop(self, key, head):
        self._expect("list", key)
        row = lists.ends(self._own("list", key), head).first()
        if row:
            rest = lists.pop_rest(self._own("list", key), head)
            self._write("list", self._others("list", key).unionByName(rest), key)
        return row and row["value"]

    def _others(self, name, *names):
        return self._t(name).where(~((F.col("db") == self.db) & F.col("key").isin(list(names))))

    def do_lpop(self, key):
        return self._pop(key, True)

    def do_rpop(self, key):
        return self._pop(key, False)

    def do_llen(self, key):
        row = lists.llen(self._own("list", key)).first()
        return row["length"] if row else 0

    def do_lindex(self, key, index):
        row = lists.lindex(self._own("list", key), _int(index)).first()
        return row and row["value"]

    def _relist(self, key, table):
        self._write("list", self._others("list", key).unionByName(table), key)

    def do_lset(self, key, index, value):
        n = self.do_llen(key)
        if not n:
            raise CommandError("no such key")
        if not -n <= _int(index) < n:
            return None
        self._relist(key, lists.lset(self._own("list", key), _int(index), value))
        return "OK"

    def do_lrange(self, key, start, stop):
        self._expect("list", key)
        return [r["value"] for r in lists.lrange(self._own("list", key), _int(start), _int(stop)).orderBy("i").collect()]

    def do_ltrim(self, key, start, stop):
        self._relist(key, lists.ltrim(self._own("list", key), _int(start), _int(stop)))
        return "OK"

    def do_lrem(self, key, count, value):
        before = self.do_llen(key)
        self._relist(key, lists.lrem(self._own("list", key), _int(count), value))
        return before - self.do_llen(key)

    def do_linsert(self, key, where, pivot, value):
        if where.upper() not in ("BEFORE", "AFTER"):
            raise CommandError("syntax error")
        before = self.do_llen(key)
        self._relist(key, lists.linsert(self._own("list", key), pivot, value, where.upper() == "BEFORE"))
        after = self.do_llen(key)
        return after if after > before else None

    # Sets

    def _members(self, key, members):
        return self._rows("set", [(self.db, key, m) for m in members])

    def do_sadd(self, key, *members):
        self._expect("set", key)
        row = sets.sadd_counts(self._own("set", key), self._members(key, members)).first()
        self._write("set", sets.sadd(self._t("set"), self._members(key, members)), key)
        return row["added"] if row else 0

    def do_srem(self, key, *members):
        n = core.removed_counts(self._own("set", key), self._members(key, set(members)), sets.MEMBER).first()
        self._write("set", sets.srem(self._t("set"), self._members(key, members)), key)
        return n["removed"] if n else 0

    def do_srandmember(self, key, n="1"):
        return [r["member"] for r in core.sample_per_key(self._own("set", key), "member", abs(_int(n)), self.writes).collect()]

    def do_spop(self, key, n="1"):
        got = self.do_srandmember(key, n)
        if got:
            self.do_srem(key, *got)
        return got if n != "1" else (got[0] if got else None)

    def do_smismember(self, key, *members):
        asked = self.spark.createDataFrame([(i, key, m) for i, m in enumerate(members)], "idx int, key string, member string")
        return [r["found"] for r in sets.sismember(self._own("set"), asked).orderBy("idx").collect()]

    def do_sismember(self, key, member):
        return self.do_smismember(key, member)[0]

    def do_smembers(self, key):
        self._expect("set", key)
        return sorted(r["member"] for r in self._own("set", key).collect())

    def do_scard(self, key):
        row = sets.scard(self._own("set", key)).first()
        return row["card"] if row else 0

    def do_smove(self, source, target, member):
        if not self.do_sismember(source, member):
            return 0
        self._write("set", self._others("set", source, target).unionByName(sets.smove(self._own("set", source, target), source, target, member)), source, target)
        return 1

    def _algebra(self, kind, names):
        t = self._own("set")
        return {"sinter": lambda: sets.sinter(t, list(names)), "sunion": lambda: sets.sunion(t, list(names)), "sdiff": lambda: sets.sdiff(t, names[0], list(names[1:]))}[kind]()

    def _stored(self, kind, target, names):
        got = [r["member"] for r in self._algebra(kind, names).collect()]
        self._drop(target)
        if got:
            self._write("set", self._others("set", target).unionByName(self._members(target, got)), target)
        return len(got)

    def do_sinter(self, *names):
        return sorted(r["member"] for r in self._algebra("sinter", names).collect())

    def do_sunion(self, *names):
        return sorted(r["member"] for r in self._algebra("sunion", names).collect())

    def do_sdiff(self, *names):
        return sorted(r["member"] for r in self._algebra("sdiff", names).collect())

    def do_sinterstore(self, target, *names):
        return self._stored("sinter", target, names)

    def do_sunionstore(self, target, *names):
        return self._stored("sunion", target, names)

    def do_sdiffstore(self, target, *names):
        return self._stored("sdiff", target, names)

    def do_sscan(self, key, cursor, *options):
        return self._page(self._own("set", key), ["member"], ["member"], cursor, options, "member")

    # Ranked sets

    def do_zadd(self, key, *args):
        self._expect("zset", key)
        args, flags = list(args), set()
        while args and args[0].upper() in ("NX", "XX", "CH", "INCR"):
            flags.add(args.pop(0).upper())
        if {"NX", "XX"} <= flags:
            raise CommandError("XX and NX options at the same time are not compatible")
        pairs = _flat(args)
        if "INCR" in flags:
            return self.do_zincrby(key, *pairs[0])
        new = self.spark.createDataFrame([(self.db, key, m, float(s), i) for i, (s, m) in enumerate(pairs)], "db int, key string, member string, score double, seq int")
        old = {r["member"]: r["score"] for r in self._own("zset", key).where(F.col("member").isin([m for _, m in pairs])).collect()}
        self._write("zset", zsets.zadd(self._t("zset"), new, "nx" if "NX" in flags else "xx" if "XX" in flags else ""), key)
        wanted = {m: float(s) for s, m in pairs}
        added = sum(m not in old for m in wanted) if "XX" not in flags else 0
        changed = sum(m in old and old[m] != s for m, s in wanted.items()) if "NX" not in flags else 0
        return added + (changed if "CH" in flags else 0)

    def do_zrem(self, key, *members):
        gone = self._rows("zset", [(self.db, key, m, None) for m in set(members)]).drop("score")
        n = core.removed_counts(self._own("zset", key), gone, zsets.MEMBER).first()
        self._write("zset", zsets.zrem(self._t("zset"), gone), key)
        return n["removed"] if n else 0

    def do_zmscore(self, key, *members):
        asked = self.spark.createDataFrame([(i, key, m) for i, m in enumerate(members)], "idx int, key string, member string")
        return [r["score"] for r in zsets.zmscore(self._own("zset"), asked).orderBy("idx").collect()]

    def do_zscore(self, key, member):
        return self.do_zmscore(key, member)[0]

    def do_zincrby(self, key, delta, member):
        self._expect("zset", key)
        d = self.spark.createDataFrame([(self.db, key, member, float(delta))], "db int, key string, member string, delta double")
        self._write("zset", zsets.zincrby(self._t("zset"), d), key)
        return self.do_zscore(key, member)

    def do_zcard(self, key):
        row = core.count_per_key(self._own("zset", key)).first()
        return row["n"] if row else 0

    def do_zcount(self, key, low, high):
        row = zsets.zcount(self._own("zset", key), low, high).first()
        return row["n"] if row else 0

    def _ranked(self, df, options=()):
        rows = df.orderBy("rank").collect()
        return [(r["member"], r["score"]) if "WITHSCORES" in [o.upper() for o in options] else r["member"] for r in rows]

    def do_zrange(self, key, start, stop, *options):
        return self._ranked(zsets.zrange(self._own("zset", key), _int(start), _int(stop)), options)

    def do_zrevrange(self, key, start, stop, *options):
        return self._ranked(zsets.zrange(self._own("zset", key), _int(start), _int(stop), True), options)

    def _by_score(self, key, low, high, options, reverse):
        opts, offset, count = [o.upper() for o in options], 0, -1
        if "LIMIT" in opts:
            i = opts.index("LIMIT")
            offset, count = _int(options[i + 1]), _int(options[i + 2])
        return self._ranked(zsets.zrangebyscore(self._own("zset", key), low, high, offset, count, reverse), options)

    def do_zrangebyscore(self, key, low, high, *options):
        return self._by_score(key, low, high, options, False)

    def do_zrevrangebyscore(self, key, high, low, *options):
        return self._by_score(key, low, high, options, True)

    def _rank(self, key, member, reverse):
        asked = self.spark.createDataFrame([(key, member)], "key string, member string")
        row = zsets.zrank(self._own("zset", key), asked, reverse).first()
        return row and row["rank"]

    def do_zrank(self, key, member):
        return self._rank(key, member, False)

    def do_zrevrank(self, key, member):
        return self._rank(key, member, True)

    def _zpop(self, key, n, highest):
        got = self._ranked(zsets.zpop(self._own("zset", key), _int(n), highest), ("WITHSCORES",))
        if got:
            self.do_zrem(key, *(m for m, _ in got))
        return got

    def do_zpopmax(self, key, n="1"):
        return self._zpop(key, n, True)

    def do_zpopmin(self, key, n="1"):
        return self._zpop(key, n, False)

    def _zkeep(self, key, table):
        before = self.do_zcard(key)
        self._write("zset", self._others("zset", key).unionByName(table), key)
        return before - self.do_zcard(key)

    def do_zremrangebyrank(self, key, start, stop):
        return self._zkeep(key, zsets.zremrangebyrank(self._own("zset", key), _int(start), _int(stop)))

    def do_zremrangebyscore(self, key, low, high):
        return self._zkeep(key, zsets.zremrangebyscore(self._own("zset", key), low, high))

    def _merge(self, kind, args):
        n = _int(args[0])
        names, rest = list(args[1 : 1 + n]), list(args[1 + n :])
        if n < 1 or len(names) < n:
            raise CommandError("syntax error")
        weights, how = None, "sum"
        while rest:
            o = rest.pop(0).upper()
            if o == "WEIGHTS":
                weights, rest = [float(x) for x in rest[:n]], rest[n:]
            elif o == "AGGREGATE" and rest:
                how = rest.pop(0).lower()
            elif o != "WITHSCORES":
                raise CommandError("syntax error")
        t = self._own("zset")
        out = zsets.zdiff(t, names[0], names[1:]) if kind == "zdiff" else getattr(zsets, kind)(t, names, weights, how)
        return [(r["member"], r["score"]) for r in out.orderBy("score", "member").collect()]

    def _zstored(self, kind, target, args):
        got = self._merge(kind, args)
        self._drop(target)
        if got:
            self._write("zset", self._others("zset", target).unionByName(self._rows("zset", [(self.db, target, m, s) for m, s in got])), target)
        return len(got)

    def do_zunion(self, *args):
        return self._merge("zunion", args)

    def do_zinter(self, *args):
        return self._merge("zinter", args)

    def do_zdiff(self, *args):
        return self._merge("zdiff", args)

    def do_zunionstore(self, target, *args):
        return self._zstored("zunion", target, args)

    def do_zinterstore(self, target, *args):
        return self._zstored("zinter", target, args)

    def do_zdiffstore(self, target, *args):
        return self._zstored("zdiff", target, args)

    def do_zscan(self, key, cursor, *options):
        return self._page(self._own("zset", key), ["member"], ["member", "score"], cursor, options, "member")

    def do_zrandmember(self, key, n="1", *options):
        rows = core.sample_per_key(self._own("zset", key), "member", abs(_int(n)), self.writes).collect()
        return [(r["member"], r["score"]) if options else r["member"] for r in rows]

    # Streams

    @staticmethod
    def _id(text: str, high: bool = False) -> tuple[int, int]:
        if text in ("-", "+"):
            return (0, 0) if text == "-" else ((1 << 62), 1 << 62)
        ms, _, seq = text.partition("-")
        return _int(ms), _int(seq) if seq else ((1 << 62) if high else 0)

    @staticmethod
    def _entry(r):
        return f"{r['ms']}-{r['seq']}", r["fields"]

    def do_xadd(self, key, ident, *pairs):
        self._expect("stream", key)
        fields, t = dict(_flat(list(pairs))), self._own("stream", key)
        if ident in ("*", "0-0"):
            new = self.spark.createDataFrame([(self.db, key, int(self.clock() * 1000), 0, fields)], "db int, key string, ms bigint, ord int, fields map<string,string>")
            out = streams.xadd(t, new)
        else:
            last = t.agg(F.max(F.struct("ms", "seq")).alias("l")).first()["l"]
            if last is not None and self._id(ident) <= (last["ms"], last["seq"]):
                raise CommandError("The ID specified in XADD is equal or smaller than the target stream top item")
            out = t.unionByName(self._rows("stream", [(self.db, key, *self._id(ident), fields)]))
        self._write("stream", self._others("stream", key).unionByName(out), key)
        top = self._own("stream", key).agg(F.max(F.struct("ms", "seq")).alias("l")).first()["l"]
        return f"{top['ms']}-{top['seq']}"

    def do_xlen(self, key):
        row = streams.xlen(self._own("stream", key)).first()
        return row["length"] if row else 0

    def _xrange(self, key, a, b, options, reverse):
        count = _int(options[1]) if options else None
        rows = streams.xrange(self._own("stream", key), self._id(a), self._id(b, True), count, reverse)
        order = [F.col(c).desc() if reverse else F.col(c) for c in streams.ID]
        return [self._entry(r) for r in rows.orderBy(*order).collect()]

    def do_xrange(self, key, start, end, *options):
        return self._xrange(key, start, end, options, False)

    def do_xrevrange(self, key, end, start, *options):
        return self._xrange(key, start, end, options, True)

    def _from(self, args):
        at = [a.upper() for a in args].index("STREAMS")
        opts = {k.upper(): v for k, v in _flat(list(args[:at]))} if at else {}
        rest = list(args[at + 1 :])
        half = len(rest) // 2
        return (_int(opts["COUNT"]) if "COUNT" in opts else None), rest[:half], rest[half:]

    def _read(self, rows):
        out: dict = {}
        for r in rows.orderBy("key", "ms", "seq").collect():
            out.setdefault(r["key"], []).append(self._entry(r))
        return out

    def do_xread(self, *args):
        count, names, ids = self._from(args)
        at = [(self.db, k, *((1 << 62, 0) if i == "$" else self._id(i))) for k, i in zip(names, ids, strict=True)]
        offsets = self.spark.createDataFrame(at, "db int, key string, last_ms bigint, last_seq bigint")
        return self._read(streams.xread(self._own("stream"), offsets, count))

    def _gone(self, key, ids):
        return self.spark.createDataFrame([(self.db, key, *self._id(i)) for i in ids], "db int, key string, ms bigint, seq bigint")

    def do_xdel(self, key, *ids):
        before = self.do_xlen(key)
        self._write("stream", streams.xdel(self._t("stream"), self._gone(key, ids)), key)
        return before - self.do_xlen(key)

    def do_xtrim(self, key, how, *n):
        if how.upper() != "MAXLEN":
            raise CommandError("syntax error")
        before = self.do_xlen(key)
        self._write("stream", self._others("stream", key).unionByName(streams.xtrim(self._own("stream", key), _int(n[-1]))), key)
        return before - self.do_xlen(key)

    def do_xgroup(self, sub, key, *args):
        sub = sub.upper()
        if sub == "CREATE":
            new = streams.xgroup_create(self._own("stream", key), args[0], args[1] == "$")
            if new.isEmpty():
                new = self._rows("grp", [(self.db, key, args[0], 0, 0)])
            self._write("grp", core.insert_absent(self._all("grp"), new, ["db", "key", "grp"]).unionByName(self._all("grp")))
            return "OK"
        if sub == "DESTROY":
            hit = (F.col("db") == self.db) & (F.col("key") == key) & (F.col("grp") == args[0])
            n = self._all("grp").where(hit).count()
            self._write("grp", self._all("grp").where(~hit))
            self._write("pending", self._all("pending").where(~hit))
            return n
        if sub == "CREATECONSUMER":
            return 1
        if sub == "DELCONSUMER":
            hit = (F.col("db") == self.db) & (F.col("key") == key) & (F.col("grp") == args[0]) & (F.col("consumer") == args[1])
            n = self._all("pending").where(hit).count()
            self._write("pending", self._all("pending").where(~hit))
            return n
        raise CommandError("unknown subcommand")

    def do_xreadgroup(self, word, grp, consumer, *args):
        count, names, _ = self._from(args)
        g = self._all("grp").where((F.col("db") == self.db) & F.col("key").isin(names) & (F.col("grp") == grp))
        if g.isEmpty():
            raise CommandError("NOGROUP No such consumer group")
        got = streams.xreadgroup(self._own("stream"), g, F.lit(consumer), 1 if count is None else count)
        out = self._read(got)
        rows = [(self.db, k, grp, consumer, *self._id(i)) for k, es in out.items() for i, _ in es]
        if rows:
            new = self._rows("pending", rows)
            self._write("pending", self._all("pending").unionByName(new))
            self._write("grp", self._all("grp").join(g.select("db", "key", "grp"), ["db", "key", "grp"], "left_anti").unionByName(streams.advance(g, new)))
        return out

    def do_xack(self, key, grp, *ids):
        acks = self._gone(key, ids).withColumn("grp", F.lit(grp))
        before = self._all("pending").count()
        self._write("pending", streams.xack(self._all("pending"), acks))
        return before - self._all("pending").count()

    def do_xclaim(self, key, grp, consumer, idle, *ids):
        claims = self._gone(key, ids).withColumn("grp", F.lit(grp))
        self._write("pending", streams.xclaim(self._all("pending"), claims, consumer))
        own = self._all("pending").join(claims, ["db", "key", "grp", "ms", "seq"], "left_semi")
        return [self._entry(r) for r in self._own("stream", key).join(own, ["db", "key", "ms", "seq"], "left_semi").orderBy("ms", "seq").collect()]

    def do_xpending(self, key, grp, *_):
        p = self._all("pending").where((F.col("db") == self.db) & (F.col("key") == key) & (F.col("grp") == grp))
        return {r["consumer"]: (r["n"], f"{r['min_ms']}-{r['min_seq']}", f"{r['max_ms']}-{r['max_seq']}") for r in streams.xpending(p).collect()}

    def do_xinfo(self, sub, key, *args):
        g = self._all("grp").where((F.col("db") == self.db) & (F.col("key") == key))
        if sub.upper() == "STREAM":
            row = streams.xinfo(self._own("stream", key), g).first()
            return row and row.asDict()
        if sub.upper() == "GROUPS":
            return [(r["grp"], f"{r['last_ms']}-{r['last_seq']}") for r in g.orderBy("grp").collect()]
        return {c: n for c, (n, _, _) in self.do_xpending(key, args[0]).items()}

    # Bitmaps, sketches, geo

    def do_setbit(self, key, offset, bit):
        old = self.do_getbit(key, offset)
        one = self._rows("bitmap", [(self.db, key, _int(offset))])
        self._write("bitmap", bitmaps.setbit(self._t("bitmap"), *((one, None) if bit == "1" else (None, one))), key)
        return old

    def do_getbit(self, key, offset):
        asked = self.spark.createDataFrame([(0, key, _int(offset))], "idx int, key string, bit bigint")
        return bitmaps.getbit(self._own("bitmap"), asked).first()["value"]

    def do_bitcount(self, key, *bounds):
        row = bitmaps.bitcount(self._own("bitmap", key), *map(_int, bounds)).first()
        return row["n"] if row else 0

    def do_bitpos(self, key, bit, start="0", *_):
        row = bitmaps.bitpos(self._own("bitmap", key), _int(bit), _int(start)).first()
        return row["pos"] if row else (-1 if bit == "1" else 0)

    def do_bitop(self, op, target, *names):
        t = self._own("bitmap")
        out = bitmaps.bitnot(t, names[0]) if op.upper() == "NOT" else bitmaps.bitop(t, op.upper(), list(names))
        longest = t.where(F.col("key").isin(list(names))).agg(F.max("bit")).first()[0]
        self._write("bitmap", self._others("bitmap", target).unionByName(out.select("db", F.lit(target).alias("key"), "bit")), target)
        return 0 if longest is None else longest // 8 + 1

    def _field(self, key, kind, offset):
        bits, at = int(kind[1:]), int(offset.lstrip("#")) * (int(kind[1:]) if offset[0] == "#" else 1)
        on = {r["bit"] for r in self._own("bitmap", key).where(F.col("bit").between(at, at + bits - 1)).collect()}
        return at, bits, sum(1 << (bits - 1 - i) for i in range(bits) if at + i in on)

    def do_bitfield(self, key, *args):
        args, how, out = list(args), "WRAP", []
        one = lambda c: self.spark.range(1).select(c).first()[0]
        while args:
            o = args.pop(0).upper()
            if o == "OVERFLOW":
                how = args.pop(0).upper()
                continue
            kind, offset = args.pop(0), args.pop(0)
            at, bits, raw = self._field(key, kind, offset)
            old = one(bitmaps.bitfield_get(F.lit(raw).cast("bigint"), kind))
            if o == "GET":
                out.append(old)
                continue
            value = _int(args.pop(0))
            new = one(bitmaps.bitfield_incrby(F.lit(old if o == "INCRBY" else 0).cast("bigint"), F.lit(value).cast("bigint"), kind, how if o == "INCRBY" else "WRAP"))
            out.append(old if o == "SET" else new)
            if new is not None:
                rest = self._t("bitmap").where(~((F.col("db") == self.db) & (F.col("key") == key) & F.col("bit").between(at, at + bits - 1)))
                on = [(self.db, key, at + i) for i in range(bits) if new >> (bits - 1 - i) & 1]
                self._write("bitmap", rest.unionByName(self._rows("bitmap", on)), key)
        return out

    def do_bitfield_ro(self, key, *args):
        if any(a.upper() in ("SET", "INCRBY") for a in args):
            raise CommandError("BITFIELD_RO only supports the GET subcommand")
        return self.do_bitfield(key, *args)

    def do_pfadd(self, key, *items):
        before = self.do_pfcount(key)
        new = hll.pfadd(self.spark.createDataFrame([(self.db, key, i) for i in items], "db int, key string, item string"), "item")
        self._write("hll", self._others("hll", key).unionByName(hll.pfmerge(self._own("hll", key).unionByName(new), key)), key)
        return int(self.do_pfcount(key) != before)

    def do_pfcount(self, *names):
        row = hll.pfcount(hll.pfmerge(self._own("hll", *names), "all")).first()
        return row["estimate"] if row else 0

    def do_pfmerge(self, target, *names):
        both = hll.pfmerge(self._own("hll", target, *names), target)
        self._write("hll", self._others("hll", target).unionByName(both), target)
        return "OK"

    def do_geoadd(self, key, *args):
        args = [a for a in args if a.upper() not in ("NX", "XX", "CH")] if args and args[0].upper() in ("NX", "XX", "CH") else list(args)
        new = [(self.db, key, args[i + 2], float(args[i]), float(args[i + 1])) for i in range(0, len(args), 3)]
        df = self.spark.createDataFrame(new, "db int, key string, member string, lon double, lat double")
        before = self._own("geo", key).count()
        self._write("geo", geo.geoadd(self._t("geo"), df), key)
        return self._own("geo", key).count() - before

    def do_geodist(self, key, a, b, unit="m"):
        row = geo.geodist(self._own("geo", key), self.spark.createDataFrame([(self.db, key, a, b)], "db int, key string, a string, b string"), unit.lower()).first()
        return row and round(row["dist"], 4)

    def do_geohash(self, key, *members):
        got = {r["member"]: r["hash"] for r in geo.geohash(self._own("geo", key)).where(F.col("member").isin(list(members))).collect()}
        return [got.get(m) for m in members]

    def do_geopos(self, key, *members):
        got = {r["member"]: (r["lon"], r["lat"]) for r in geo.geopos(self._own("geo", key)).where(F.col("member").isin(list(members))).collect()}
        return [got.get(m) for m in members]

    def _radius(self, df, key, options):
        opts = [o.upper() for o in options]
        rows = [(r["member"], r["dist"], r["lon"], r["lat"], r["score"]) for r in df.collect()]
        rows.sort(key=lambda r: (r[1], r[0]), reverse="DESC" in opts)
        rows = rows[: _int(options[opts.index("COUNT") + 1])] if "COUNT" in opts else rows
        for store in ("STORE", "STOREDIST"):
            if store in opts:
                target = options[opts.index(store) + 1]
                self._drop(target)
                self._write("zset", self._others("zset", target).unionByName(self._rows("zset", [(self.db, target, r[0], float(r[4] if store == "STORE" else r[1])) for r in rows])), target)
                return len(rows)
        more = [o for o in ("WITHDIST", "WITHHASH", "WITHCOORD") if o in opts]
        return [(r[0], *({"WITHDIST": round(r[1], 4), "WITHHASH": r[4], "WITHCOORD": (r[2], r[3])}[o] for o in more)) if more else r[0] for r in rows]

    def do_georadius(self, key, lon, lat, radius, unit, *options):
        return self._radius(geo.georadius(self._own("geo", key), float(lon), float(lat), float(radius), unit.lower()), key, options)

    def do_georadiusbymember(self, key, member, radius, unit, *options):
        at = self._own("geo", key).where(F.col("member") == member).first()
        if at is None:
            raise CommandError("could not decode requested zset member")
        others = self._own("geo", key).where(F.col("member") != member)
        return self._radius(geo.georadius(others, at["lon"], at["lat"], float(radius), unit.lower()), key, options)

    # Keys

    def do_del(self, *names):
        n = self._live_keys().where(F.col("key").isin(list(names))).count()
        self._drop(*names)
        return n

    def do_exists(self, *names):
        asked = self.spark.createDataFrame(list(enumerate(names)), "idx int, key string")
        return asked.join(self._live_keys(), "key").count()

    def do_type(self, key):
        kind = self._type(key)
        return "none" if kind is None else NAMES.get(kind, kind)

    def do_keys(self, pattern):
        return sorted(r["key"] for r in self._live_keys().where(F.col("key").rlike(glob_regex(pattern))).collect())

    def do_randomkey(self):
        row = self._live_keys().orderBy(F.xxhash64(F.lit(self.writes), "key")).first()
        return row and row["key"]

    def do_rename(self, old, new):
        if not self.do_exists(old):
            raise CommandError("no such key")
        if old != new:
            self._drop(new)
            for name in (*TYPED, "expiry"):
                if not self._own(name, old).isEmpty():
                    self._write(name, self._t(name).withColumn("key", F.when((F.col("db") == self.db) & (F.col("key") == old), new).otherwise(F.col("key"))), old, new)
        return "OK"

    def do_renamenx(self, old, new):
        if self.do_exists(new) or old == new:
            return 0
        self.do_rename(old, new)
        return 1

    def _deadline(self, key, at):
        if not self.do_exists(key):
            return 0
        self._expire(key, at)
        return 1

    def do_expire(self, key, seconds):
        return self._deadline(key, self._now() + datetime.timedelta(seconds=_int(seconds)))

    def do_expireat(self, key, at):
        return self._deadline(key, datetime.datetime.fromtimestamp(_int(at), datetime.UTC).replace(tzinfo=None))

    def _left(self, key, unit):
        if not self.do_exists(key):
            return -2
        now = F.lit(self._now()).cast("timestamp_ntz")
        row = keys.ttl(self._own("expiry", key), now).first()
        return row[unit] if row else -1

    def do_ttl(self, key):
        return self._left(key, "ttl")

    def do_pttl(self, key):
        return self._left(key, "pttl")

    def do_persist(self, key):
        had = self.do_exists(key) and not self._own("expiry", key).isEmpty()
        if had:
            self._expire(key, None)
        return int(had)

    def do_flushdb(self, *_):
        for name in (*TYPED, "expiry", "grp", "pending"):
            if name in self.current:
                self._write(name, keys.flush(self._all(name), self.db))
        return "OK"

    def do_flushall(self, *_):
        for name in (*TYPED, "expiry", "grp", "pending"):
            if name in self.current:
                self._write(name, keys.flush(self._all(name)))
        return "OK"

    def do_scan(self, cursor, *options):
        return self._page(self._live_keys(), ["key"], ["key"], cursor, options, "key")

    def do_object(self, sub, key):
        kind = self._type(key)
        if kind is None:
            return None
        if sub.upper() == "ENCODING":
            named = {"list": "linkedlist", "hash": "hashtable", "set": "hashtable", "zset": "skiplist", "geo": "skiplist", "stream": "stream", "bitmap": "raw", "hll": "raw"}
            return named.get(kind) or keys.encoding(self._own("string", key)).first()["encoding"]
        return {"IDLETIME": 0, "REFCOUNT": 1}.get(sub.upper())

    def do_memory(self, sub, key):
        types = keys.type_of(**{n: self._own(n, key) for n in TYPED}).replace(NAMES, subset=["type"])
        row = keys.memory_usage(types, self._own("string", key)).first()
        return row and row["bytes"]

    # Persistence

    def do_save(self):
        for name in self.current:
            self._all(name).write.mode("overwrite").parquet(f"{self.path}/snapshot/{name}")
        self.saved = int(self.clock())
        return "OK"

    def do_bgsave(self):
        self.do_save()
        return "Background saving started"

    def do_lastsave(self):
        return self.saved

    def load(self, names=tuple(TABLES)) -> None:
        """Go on from the last snapshot: its tables become new versions, tables that it lacks become empty."""
        for name in names:
            try:
                self._write(name, self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/snapshot/{name}"))
            except Exception as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                if name in self.current:
                    self._write(name, self._rows(name, []))

    def do_appendonly(self, state):
        self.log = state.lower() == "yes"
        return "OK"

    def do_bgrewriteaof(self):
        self.do_save()
        return "Background append only file rewriting started"

    # Publish / subscribe

    def _subscribe(self, kind, names):
        new = self.spark.createDataFrame([(self.conn, kind, n) for n in names], TABLES["subs"])
        self._write("subs", pubsub.subscribe(self._all("subs"), new))
        return [(n, i + 1) for i, n in enumerate(names)]

    def _unsubscribe(self, kind, names):
        gone = self.spark.createDataFrame([(self.conn, kind, n) for n in names or (None,)], TABLES["subs"])
        self._write("subs", pubsub.unsubscribe(self._all("subs"), gone))
        return self._all("subs").where((F.col("conn") == self.conn) & (F.col("kind") == kind)).count()

    def do_publish(self, channel, message):
        m = self.spark.createDataFrame([(channel, message)], "channel string, message string")
        return pubsub.publish(m, self._all("subs")).first()["channel_receivers"]

    def do_subscribe(self, *names):
        return self._subscribe("channel", names)

    def do_psubscribe(self, *names):
        return self._subscribe("pattern", names)

    def do_unsubscribe(self, *names):
        return self._unsubscribe("channel", names)

    def do_punsubscribe(self, *names):
        return self._unsubscribe("pattern", names)

    def do_pubsub(self, sub, *args):
        s = self._all("subs")
        if sub.upper() == "CHANNELS":
            return sorted(r["channel"] for r in pubsub.channels(s, *(args or ("*",))).collect())
        if sub.upper() == "NUMPAT":
            return pubsub.numpat(s).first()["n"]
        got = {r["channel"]: r["n"] for r in pubsub.numsub(s).collect()}
        return {a: got.get(a, 0) for a in args} if args else got

    # Transactions

    def _versions(self, names):
        rows = self._all("version").where((F.col("db") == self.db) & F.col("key").isin(list(names))).collect()
        return {k: 0 for k in names} | {r["key"]: r["version"] for r in rows}

    def do_watch(self, *names):
        self.transaction.watch(self._versions(names))
        return "OK"

    def do_unwatch(self):
        self.transaction.unwatch()
        return "OK"

    def do_multi(self):
        self.transaction.multi()
        return "OK"

    def do_discard(self):
        self.transaction.discard()
        return "OK"

    def do_exec(self):
        t = self.transaction
        if t.queue is None:
            raise CommandError("EXEC without MULTI")
        steps, t.queue = t.queue, None
        moved = any(self._versions([k])[k] != v for k, v in t.watched.items())
        t.watched.clear()
        return None if moved else [self.execute(n, *a) for n, a in steps]

    # Scripts

    def _keyspace(self):
        return {n + "s": self._own(n) for n in TYPED}

    def do_eval(self, body, n, *args):
        k = _int(n)
        used = {name: t for name, t in self._keyspace().items() if "{" + name + "}" in body}
        return [tuple(r) for r in self.registry.eval(self.spark, body, args[:k], args[k:], **used).collect()]

    def do_evalsha(self, sha, n, *args):
        if not self.registry.exists(sha)[0]:
            raise CommandError("NOSCRIPT No matching script. Please use EVAL.")
        return self.do_eval("\n".join(self.registry.show(sha.lower())), n, *args)

    def do_script(self, sub, *args):
        sub = sub.upper()
        if sub == "LOAD":
            return self.registry.load(args[0])
        if sub == "EXISTS":
            return self.registry.exists(*args)
        if sub == "SHOW":
            return self.registry.show(args[0])
        if sub == "FLUSH":
            self.registry.flush()
        return "OK"

    # Connection and server

    def do_ping(self, message="PONG"):
        return message

    def do_echo(self, message):
        return message

    def do_select(self, n):
        if _int(n) < 0:
            raise CommandError("DB index is out of range")
        self.db = _int(n)
        return "OK"

    def do_quit(self):
        return "OK"

    def do_auth(self, *_):
        return "OK"

    def do_hello(self, *_):
        return {"server": "keyloom", "proto": 2}

    def do_info(self, *_):
        meta = self._live_keys().join(self._t("expiry"), ["db", "key"], "left")
        row = keys.info(meta, F.lit(self._now()).cast("timestamp_ntz")).first()
        return row.asDict() if row else {"db": self.db, "keys": 0, "expires": 0, "avg_ttl": 0}

    def do_dbsize(self):
        return self._live_keys().count()

    def do_time(self):
        t = self.clock()
        return [int(t), int(t % 1 * 1_000_000)]

    def do_command(self, sub="COUNT", *names):
        every = sorted(n[3:].upper() for n in dir(self) if n.startswith("do_"))
        if sub.upper() == "COUNT":
            return len(every)
        if sub.upper() == "INFO":
            return [command_info(n) if n.upper() in every else None for n in names or every]
        if sub.upper() == "GETKEYS":
            return command_keys(*names)
        if sub.upper() == "LIST":
            return every
        raise CommandError(f"unknown subcommand '{sub}'")

    def do_debug(self, sub, key):
        return {"type": self.do_type(key), "encoding": self.do_object("ENCODING", key)}

    def do_client(self, sub, *args):
        if sub.upper() == "SETNAME":
            self.conn = args[0]
        return {"GETNAME": self.conn, "ID": 1, "LIST": [self.conn]}.get(sub.upper(), "OK")

    def do_module(self, sub, *_):
        if sub.upper() != "LIST":
            raise CommandError("modules are not supported")
        return []


#: Arguments that a repeated parameter of this name needs at least, and commands that differ.
_AT_LEAST = {"pairs": 2, "names": 1, "values": 1, "members": 1, "fields": 1, "items": 1, "ids": 1, "channels": 1, "patterns": 1}
_LEAST_OF = {"ZADD": 2, "GEOADD": 3, "XADD": 3, "EVAL": 0, "EVALSHA": 0}
#: Names of first parameters that are keys.
_KEYS = {"key", "names", "target", "source", "old", "first"}


def command_info(name: str) -> list:
    """[name, arity, flags, first key, last key, step] of a command, read from its handler: a negative arity is the least
    number of words; a command that writes a table has the flag write."""
    handler = getattr(Client, "do_" + name.lower())
    given = list(inspect.signature(handler).parameters.values())[1:]
    many = next((p.name for p in given if p.kind is p.VAR_POSITIONAL), None)
    needed = 1 + sum(p.kind is p.POSITIONAL_OR_KEYWORD and p.default is p.empty for p in given)
    least = needed + _LEAST_OF.get(name.upper(), _AT_LEAST.get(many, 0))
    fixed = many is None and all(p.default is p.empty for p in given)
    keyed = bool(given) and given[0].name in _KEYS
    writes = any(x in handler.__code__.co_names for x in ("_write", "_drop", "_expire", "_store", "_add"))
    return [name.upper(), least if fixed else -least, ["write" if writes else "readonly"], int(keyed), (-1 if many == "names" else 1) if keyed else 0, int(keyed)]


def command_keys(name: str, *args: str) -> list[str]:
    """The keys among a command's arguments."""
    _, _, _, first, last, _ = command_info(name)
    return list(args[first - 1 : None if last < 0 else last]) if first else []


def _bumped(have: DataFrame, one: DataFrame) -> DataFrame:
    return have.unionByName(one).groupBy("db", "key").agg(F.sum("version").alias("version"))
