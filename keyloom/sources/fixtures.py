"""Keyspace tables over the relational fixtures, and the same tables as SQL views for oracles."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.functions.geo import encode_score

NOW = "1997-01-01 00:00:00"

VIEWS = {
    "strings": "SELECT 'part:' || CAST(p_partkey AS VARCHAR) AS key, p_name AS value FROM part",
    "counters": "SELECT 'cust:' || CAST(c_custkey AS VARCHAR) AS key, CAST(round(c_acctbal) AS BIGINT) AS value FROM customer",
    "hashes": "SELECT CAST(o_custkey AS VARCHAR) AS key, CAST(o_orderkey AS VARCHAR) AS field, o_orderpriority AS value FROM orders",
    "lists": "SELECT CAST(l_orderkey AS VARCHAR) AS key, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos, CAST(l_partkey AS VARCHAR) AS value FROM lineitem",
    "sets": "SELECT DISTINCT event_type || ':' || CAST(CAST(ts AS DATE) AS VARCHAR) AS key, CAST(user_id AS VARCHAR) AS member FROM events",
    "brands": "SELECT DISTINCT p_brand AS key, p_type AS member FROM part",
    "zsets": "SELECT c_mktsegment AS key, CAST(c_custkey AS VARCHAR) AS member, c_acctbal AS score FROM customer",
    "zdays": "SELECT event_type || ':' || CAST(CAST(ts AS DATE) AS VARCHAR) AS key, CAST(user_id AS VARCHAR) AS member, max(CAST(round(value * 100) AS BIGINT)) AS score FROM events GROUP BY 1, 2",
    "streams": "SELECT event_type AS key, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY event_type, epoch_us(ts) // 1000 ORDER BY event_id) - 1 AS seq, CAST(user_id AS VARCHAR) AS user_id, event_id FROM events",
    "hours": "SELECT event_type AS key, (epoch_us(ts) // 3600000000) * 3600000 AS ms, row_number() OVER (PARTITION BY event_type, epoch_us(ts) // 3600000000 ORDER BY event_id) - 1 AS seq, CAST(user_id AS VARCHAR) AS user_id, event_id FROM events",
    "bits": "SELECT DISTINCT event_type || ':' || CAST(CAST(ts AS DATE) AS VARCHAR) AS key, user_id AS bit FROM events",
    "geo": "SELECT c_mktsegment AS key, CAST(c_custkey AS VARCHAR) AS member, -180 + ((c_custkey * 7919) % 36000) / 100.0::DOUBLE AS lon, -85 + ((c_custkey * 104729) % 17000) / 100.0::DOUBLE AS lat FROM customer",
    "meta": "SELECT 'order:' || CAST(o_orderkey AS VARCHAR) AS key, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderdate + INTERVAL 90 DAY END AS expire_at, o_orderdate AS last_access, CAST(o_orderkey % 256 AS INTEGER) AS freq, CAST(32 + length(o_orderpriority) AS BIGINT) AS size FROM orders",
    "live": "SELECT * FROM meta WHERE expire_at IS NULL OR expire_at > TIMESTAMP '1997-01-01 00:00:00'",
    "changes": "SELECT row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq, 'part:' || CAST(l_partkey AS VARCHAR) AS key, CASE WHEN l_returnflag = 'R' THEN 'DEL' ELSE 'SET' END AS op, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS value FROM lineitem",
    "subs": "SELECT * FROM (VALUES ('c1', 'channel', 'click'), ('c1', 'channel', 'view'), ('c2', 'channel', 'click'), ('c2', 'pattern', 's*'), ('c3', 'pattern', '*e*'), ('c3', 'pattern', 'vi?w'), ('c4', 'pattern', '[ce]*'), ('c5', 'pattern', '[^cv]*'), ('c5', 'pattern', '\\*lick'), ('c6', 'pattern', 's[a-l]*'), ('c6', 'pattern', 'v[iI]e\\w'), ('c6', 'pattern', 'cl[ick')) t(conn, kind, pattern)",
    "groups": "SELECT key, 'g1' AS grp, max(ms) - 864000000 AS last_ms, CAST(0 AS BIGINT) AS last_seq FROM streams GROUP BY key",
    "delivered": "SELECT s.key, g.grp, s.ms, s.seq, s.event_id, 'consumer' || CAST(s.event_id % 3 AS VARCHAR) AS consumer FROM streams s JOIN groups g ON s.key = g.key WHERE s.ms > g.last_ms OR (s.ms = g.last_ms AND s.seq > g.last_seq)",
    "pending": "SELECT * FROM delivered WHERE event_id % 4 <> 0",
}


class Keyspace:
    """Lazy typed tables over one fixture directory. Nothing here triggers a job."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @staticmethod
    def _db(df: DataFrame) -> DataFrame:
        return df.select(F.lit(0).alias("db"), "*")

    def requests(self, column: str, values: list) -> DataFrame:
        """A request batch: `column` values with their 0-based position `idx`. Size: the caller's argument list."""
        kind = "string" if isinstance(values[0], str) else "bigint"
        return self.spark.createDataFrame(list(enumerate(values)), f"idx int, {column} {kind}")

    @cached_property
    def now(self):
        return F.lit(NOW).cast("timestamp_ntz")

    @cached_property
    def strings(self) -> DataFrame:
        return self._db(self.table("part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("key"), F.col("p_name").alias("value")))

    @cached_property
    def counters(self) -> DataFrame:
        return self._db(self.table("customer").select(F.concat(F.lit("cust:"), F.col("c_custkey").cast("string")).alias("key"), F.round("c_acctbal").cast("bigint").alias("value")))

    @cached_property
    def hashes(self) -> DataFrame:
        return self._db(self.table("orders").select(F.col("o_custkey").cast("string").alias("key"), F.col("o_orderkey").cast("string").alias("field"), F.col("o_orderpriority").alias("value")))

    @cached_property
    def lists(self) -> DataFrame:
        w = Window.partitionBy("key").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
        return self._db(self.table("lineitem").withColumn("key", F.col("l_orderkey").cast("string")).select("key", (F.row_number().over(w) - 1).cast("bigint").alias("pos"), F.col("l_partkey").cast("string").alias("value")))

    @cached_property
    def _event_day(self):
        return F.concat_ws(":", "event_type", F.to_date("ts").cast("string"))

    @cached_property
    def sets(self) -> DataFrame:
        return self._db(self.table("events").select(self._event_day.alias("key"), F.col("user_id").cast("string").alias("member")).distinct())

    @cached_property
    def brands(self) -> DataFrame:
        return self._db(self.table("part").select(F.col("p_brand").alias("key"), F.col("p_type").alias("member")).distinct())

    @cached_property
    def zsets(self) -> DataFrame:
        return self._db(self.table("customer").select(F.col("c_mktsegment").alias("key"), F.col("c_custkey").cast("string").alias("member"), F.col("c_acctbal").alias("score")))

    @cached_property
    def zdays(self) -> DataFrame:
        e = self.table("events").select(self._event_day.alias("key"), F.col("user_id").cast("string").alias("member"), F.round(F.col("value") * 100).cast("bigint").alias("score"))
        return self._db(e.groupBy("key", "member").agg(F.max("score").alias("score")))

    def _stream(self, ms) -> DataFrame:
        e = self.table("events").select(F.col("event_type").alias("key"), ms.alias("ms"), F.col("user_id").cast("string").alias("user_id"), "event_id")
        w = Window.partitionBy("key", "ms").orderBy("event_id")
        return self._db(e.select("key", "ms", (F.row_number().over(w) - 1).cast("bigint").alias("seq"), "user_id", "event_id"))

    @cached_property
    def _micros(self):
        return F.unix_micros(F.col("ts").cast("timestamp"))

    @cached_property
    def streams(self) -> DataFrame:
        return self._stream(F.floor(self._micros / 1000).cast("bigint"))

    @cached_property
    def hours(self) -> DataFrame:
        return self._stream(F.floor(self._micros / 3_600_000_000).cast("bigint") * 3_600_000)

    @cached_property
    def bits(self) -> DataFrame:
        return self._db(self.table("events").select(self._event_day.alias("key"), F.col("user_id").alias("bit")).distinct())

    @cached_property
    def geo(self) -> DataFrame:
        g = self.table("customer").select(F.col("c_mktsegment").alias("key"), F.col("c_custkey").cast("string").alias("member"), (-180 + F.pmod(F.col("c_custkey") * 7919, F.lit(36000)) / 100.0).alias("lon"), (-85 + F.pmod(F.col("c_custkey") * 104729, F.lit(17000)) / 100.0).alias("lat"))
        return self._db(g.withColumn("score", encode_score(F.col("lon"), F.col("lat"))))

    @cached_property
    def meta(self) -> DataFrame:
        expire = F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS"))
        return self._db(self.table("orders").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("key"), expire.alias("expire_at"), F.col("o_orderdate").alias("last_access"), (F.col("o_orderkey") % 256).cast("int").alias("freq"), (32 + F.length("o_orderpriority")).cast("bigint").alias("size")))

    @cached_property
    def changes(self) -> DataFrame:
        order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
        rows = self.table("lineitem").withColumn("key", F.concat(F.lit("part:"), F.col("l_partkey").cast("string")))  # dealt by key once
        return self._db(rows.select(F.row_number().over(Window.partitionBy("key").orderBy(*order)).cast("bigint").alias("seq"), "key", F.when(F.col("l_returnflag") == "R", "DEL").otherwise("SET").alias("op"), F.col("l_quantity").cast("bigint").cast("string").alias("value")))

    @cached_property
    def subs(self) -> DataFrame:
        rows = [("c1", "channel", "click"), ("c1", "channel", "view"), ("c2", "channel", "click"), ("c2", "pattern", "s*"), ("c3", "pattern", "*e*"), ("c3", "pattern", "vi?w"), ("c4", "pattern", "[ce]*"), ("c5", "pattern", "[^cv]*"), ("c5", "pattern", "\\*lick"), ("c6", "pattern", "s[a-l]*"), ("c6", "pattern", "v[iI]e\\w"), ("c6", "pattern", "cl[ick")]
        return self.spark.createDataFrame(rows, "conn string, kind string, pattern string")

    @cached_property
    def groups(self) -> DataFrame:
        return self.streams.groupBy("db", "key").agg((F.max("ms") - 864_000_000).alias("last_ms")).select("db", "key", F.lit("g1").alias("grp"), "last_ms", F.lit(0).cast("bigint").alias("last_seq"))

    @cached_property
    def messages(self) -> DataFrame:
        return self.table("events").select(F.col("event_type").alias("channel"), "event_id")
