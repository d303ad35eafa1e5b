"""Commands as text, one after the other."""

import pytest

from keyloom.client import Client, CommandError


@pytest.fixture(scope="module")
def c(spark, tmp_path_factory):
    clock = [1_000_000.0]
    client = Client(spark, str(tmp_path_factory.mktemp("ks")), clock=lambda: clock[0])
    client.tick = lambda s: clock.__setitem__(0, clock[0] + s)
    return client


def test_strings(c):
    x = c.execute
    assert x("SET", "s", "v") == "OK" and x("get", "s") == "v" and x("SET", "s", "w", "NX") is None and x("SET", "s", "w", "XX", "GET") == "v"
    assert x("MSET", "a", "1", "b", "007") == "OK" and x("MGET", "a", "none", "b") == ["1", "", "007"]
    assert x("INCR", "a") == 2 and x("DECRBY", "a", 5) == -3 and x("INCRBYFLOAT", "a", "0.5") == "-2.5"
    assert x("APPEND", "s", "é") == 3 and x("STRLEN", "s") == 3 and x("GETRANGE", "s", 0, -2) == "w" and x("SETRANGE", "s", 1, "xyz") == 4 and x("GETSET", "s", "n") == "wxyz"
    assert x("SETEX", "t", 10, "v") == "OK" and x("TTL", "t") == 10 and x("PSETEX", "p", 500, "v") == "OK" and x("PTTL", "p") == 500
    c.tick(1)
    assert x("GET", "p") is None and x("EXISTS", "t", "t", "p") == 2 and x("PERSIST", "t") == 1 and x("TTL", "t") == -1 and x("TTL", "p") == -2
    assert x("SET", "p", "again") == "OK" and x("GET", "p") == "again" and x("TTL", "p") == -1
    with pytest.raises(CommandError):
        x("INCR", "s")
    with pytest.raises(CommandError):
        x("MSET", "odd")
    with pytest.raises(CommandError):
        x("NOPE")
    with pytest.raises(CommandError):
        x("GET")


def test_hashes_lists(c):
    x = c.execute
    assert x("HSET", "h", "f", "1", "g", "2") == 2 and x("HSET", "h", "f", "3") == 0 and x("HMGET", "h", "f", "z") == ["3", None] and x("HINCRBY", "h", "f", 4) == 7
    assert x("HGETALL", "h") == {"f": "7", "g": "2"} and x("HDEL", "h", "g", "z") == 1 and x("HLEN", "h") == 1 and x("HSETNX", "h", "f", "0") == 0 and x("HSCAN", "h", 0) == [0, [("f", "7")]]
    with pytest.raises(CommandError, match="WRONGTYPE"):
        x("LPUSH", "h", "x")
    assert x("RPUSH", "l", "a", "b", "c") == 3 and x("LPUSH", "l", "z", "y") == 5 and x("LRANGE", "l", 0, -1) == ["y", "z", "a", "b", "c"]
    assert x("LPOP", "l") == "y" and x("RPOP", "l") == "c" and x("LINSERT", "l", "AFTER", "a", "q") == 4 and x("LREM", "l", 0, "z") == 1 and x("LSET", "l", -1, "B") == "OK" and x("LINDEX", "l", 2) == "B"
    assert x("LTRIM", "l", 0, 1) == "OK" and x("LRANGE", "l", 0, -1) == ["a", "q"]


def test_sets_ranked(c):
    x = c.execute
    assert x("SADD", "s1", "a", "b", "c") == 3 and x("SADD", "s2", "b", "c", "d") == 3 and x("SINTER", "s1", "s2") == ["b", "c"] and x("SDIFFSTORE", "s3", "s1", "s2") == 1 and x("SMEMBERS", "s3") == ["a"]
    assert x("SMOVE", "s1", "s2", "a") == 1 and x("SCARD", "s2") == 4 and x("SMISMEMBER", "s2", "a", "x") == [1, 0] and x("SPOP", "s3") == "a" and x("TYPE", "s3") == "none"
    assert x("ZADD", "z", 1, "one", 2, "two", 3, "three") == 3 and x("ZADD", "z", "CH", 4, "two") == 1 and x("ZREVRANGE", "z", 0, 0) == ["two"] and x("ZRANK", "z", "three") == 1
    assert x("ZRANGEBYSCORE", "z", "(1", "+inf", "WITHSCORES", "LIMIT", 0, 1) == [("three", 3.0)] and x("ZCOUNT", "z", "-inf", 3) == 2 and x("ZINCRBY", "z", 1.5, "one") == 2.5
    assert x("ZADD", "y", 10, "one") == 1 and x("ZUNION", 2, "z", "y", "WEIGHTS", 2, 1) == [("three", 6.0), ("two", 8.0), ("one", 15.0)] and x("ZINTERSTORE", "w", 2, "z", "y", "AGGREGATE", "MAX") == 1 and x("ZSCORE", "w", "one") == 10.0
    assert x("ZPOPMAX", "z") == [("two", 4.0)] and x("ZREMRANGEBYRANK", "z", 0, 0) == 1 and x("ZRANGE", "z", 0, -1) == ["three"] and x("ZDIFF", 2, "z", "y") == [("three", 3.0)]


def test_streams_bits_geo(c):
    x = c.execute
    assert x("XADD", "st", "5-1", "a", "1") == "5-1" and x("XADD", "st", "*", "b", "2") == f"{int(c.clock() * 1000)}-0"
    with pytest.raises(CommandError):
        x("XADD", "st", "5-1", "a", "1")
    assert x("XLEN", "st") == 2 and x("XRANGE", "st", "-", "+", "COUNT", 1) == [("5-1", {"a": "1"})] and x("XGROUP", "CREATE", "st", "g", "0") == "OK"
    assert x("XREADGROUP", "GROUP", "g", "c1", "COUNT", 5, "STREAMS", "st", ">")["st"][0][0] == "5-1" and x("XPENDING", "st", "g")["c1"][0] == 2 and x("XACK", "st", "g", "5-1", "9-9") == 1
    assert len(x("XCLAIM", "st", "g", "c2", 0, f"{int(c.clock() * 1000)}-0")) == 1 and list(x("XPENDING", "st", "g")) == ["c2"] and x("XTRIM", "st", "MAXLEN", 1) == 1 and x("XINFO", "STREAM", "st")["length"] == 1
    assert x("SETBIT", "b", 7, 1) == 0 and x("GETBIT", "b", 7) == 1 and x("BITCOUNT", "b") == 1 and x("BITPOS", "b", 1) == 7 and x("BITFIELD", "b", "GET", "u8", 0, "INCRBY", "u8", 0, 255) == [1, 0] and x("BITOP", "NOT", "nb", "nb0") == 0
    assert x("PFADD", "p1", "a", "b") == 1 and x("PFADD", "p2", "b", "c") == 1 and x("PFCOUNT", "p1", "p2") == 3 and x("PFMERGE", "p3", "p1", "p2") == "OK" and x("PFCOUNT", "p3") == 3
    assert x("GEOADD", "g", 13.361389, 38.115556, "Palermo", 15.087269, 37.502669, "Catania") == 2 and abs(x("GEODIST", "g", "Palermo", "Catania", "km") - 166.2) < 0.5
    assert x("GEORADIUS", "g", 15, 37, 100, "km") == ["Catania"] and x("GEORADIUSBYMEMBER", "g", "Palermo", 200, "km") == ["Catania"] and x("GEOHASH", "g", "Palermo")[0].startswith("sqc8b49rny")


def test_keys_server(c):
    x = c.execute
    x("SET", "k1", "v")
    x("SET", "taken", "v")
    assert x("RENAME", "k1", "k2") == "OK" and x("KEYS", "k?") == ["k2"] and x("RENAMENX", "k2", "taken") == 0 and x("OBJECT", "ENCODING", "k2") == "embstr" and x("MEMORY", "USAGE", "k2") == 33
    assert x("SUBSCRIBE", "news") and x("PSUBSCRIBE", "n*") and x("PUBLISH", "news", "hi") == 1 and x("PUBSUB", "NUMSUB", "news") == {"news": 1} and x("UNSUBSCRIBE") == 0
    assert x("WATCH", "k2") == "OK" and x("MULTI") == "OK" and x("SET", "k2", "n") == "QUEUED" and x("EXEC") == ["OK"]
    x("WATCH", "k2")
    x("SET", "k2", "moved")
    x("MULTI")
    x("GET", "k2")
    assert x("EXEC") is None
    sha = x("SCRIPT", "LOAD", "SELECT value FROM {strings} WHERE key = :keys[0]")
    assert x("EVALSHA", sha, 1, "k2") == [("moved",)]
    assert x("PING") == "PONG" and x("DBSIZE") >= 2 and x("INFO")["keys"] == x("DBSIZE") and x("COMMAND") == 163
    assert x("SAVE") == "OK" and x("DEL", "k2", "none") == 1 and x("SELECT", 1) == "OK" and x("DBSIZE") == 0 and x("SELECT", 0) == "OK"
    again = Client(c.spark, c.path, clock=c.clock)
    again.load()
    assert again.execute("GET", "k2") == "moved"
    assert x("FLUSHALL") == "OK" and x("DBSIZE") == 0


def test_reopened_path_goes_on(spark, tmp_path):
    a = Client(spark, str(tmp_path))
    a.execute("SET", "a", "1")
    a.execute("RPUSH", "l", "x", "y")
    b = Client(spark, str(tmp_path))
    assert b.execute("GET", "a") == "1" and b.execute("LRANGE", "l", 0, -1) == ["x", "y"]
    b.execute("SET", "b", "2")
    c = Client(spark, str(tmp_path))
    assert [c.execute("GET", k) for k in "ab"] == ["1", "2"]
    c.execute("SAVE")
    c.execute("SET", "a", "9")
    c.load()
    d = Client(spark, str(tmp_path))
    assert [x.execute("GET", "a") for x in (c, d)] == ["1", "1"]


def test_sketches_and_command_info(spark, tmp_path):
    c = Client(spark, str(tmp_path))
    assert c.execute("PFADD", "p", "a", "b", "a") == 1 and c.execute("PFADD", "p", "a") == 0 and c.execute("PFCOUNT", "p") == 2
    c.execute("PFADD", "q", "b", "c")
    assert c.execute("PFMERGE", "r", "p", "q") == "OK" and c.execute("PFCOUNT", "r") == 3 and c.execute("PFCOUNT", "p", "q") == 3
    assert c._all("hll").columns == ["db", "key", "sketch"]
    assert c.execute("COMMAND", "INFO", "get", "set", "nope") == [["GET", 2, ["readonly"], 1, 1, 1], ["SET", -3, ["write"], 1, 1, 1], None]
    assert c.execute("COMMAND", "GETKEYS", "MGET", "a", "b") == ["a", "b"] and c.execute("COMMAND", "COUNT") == len(c.execute("COMMAND", "LIST"))
