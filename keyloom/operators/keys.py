"""Key management and TTL over the metadata table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.text import glob_regex
from keyloom.model import KEY
from keyloom.operators.core import live, shuffled


def delete(meta: DataFrame, keys: DataFrame) -> DataFrame:
    return meta.join(keys, ["key"], "left_anti")


def exists(meta: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """Number of live keys among the requests, repeats counted."""
    return requests.join(live(meta, now).select("key"), "key").agg(F.count("*").alias("n"))


def type_of(**tables: DataFrame) -> DataFrame:
    """(db, key, type) of all typed tables given by keyword."""
    out = None
    for kind, t in tables.items():
        one = t.select(*KEY).distinct().withColumn("type", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


def keys(meta: DataFrame, pattern: str, now: Column) -> DataFrame:
    return live(meta, now).where(F.col("key").rlike(glob_regex(pattern))).select(*KEY)


def randomkey(meta: DataFrame, now: Column, seed: int = 0) -> DataFrame:
    return live(meta, now).orderBy(shuffled(seed, "key"), "key").limit(1).select(*KEY)


def rename(meta: DataFrame, old: str, new: str) -> DataFrame:
    """old takes the name new with its own deadline; a former new is gone."""
    if old == new:
        return meta
    has = meta.where(F.col("key") == old).select("db").distinct().withColumn("_has", F.lit(True))
    kept = meta.join(F.broadcast(has), "db", "left").where(~((F.col("key") == new) & F.coalesce("_has", F.lit(False)))).drop("_has")  # one row a database
    return kept.withColumn("key", F.when(F.col("key") == old, new).otherwise(F.col("key"))).select(meta.columns)


def renamenx(meta: DataFrame, old: str, new: str) -> DataFrame:
    """rename unless new exists."""
    taken = meta.where(F.col("key") == new).select("db").distinct().withColumn("_has", F.lit(True))
    j = meta.join(F.broadcast(taken), "db", "left")  # one row a database
    return j.withColumn("key", F.when((F.col("key") == old) & F.col("_has").isNull(), new).otherwise(F.col("key"))).select(meta.columns)


def expire(meta: DataFrame, now: Column, seconds: int) -> DataFrame:
    """Live keys get a deadline seconds from now; expired ones are not revived."""
    return live(meta, now).withColumn("expire_at", now + F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)")))


def expireat(meta: DataFrame, now: Column, unix_seconds: int) -> DataFrame:
    return live(meta, now).withColumn("expire_at", F.timestamp_seconds(F.lit(unix_seconds)).cast("timestamp_ntz"))


def ttl(meta: DataFrame, now: Column) -> DataFrame:
    """Seconds (ttl) and milliseconds (pttl) left; -1 without a deadline, -2 once expired."""
    micros = F.timestamp_diff("MICROSECOND", now, F.col("expire_at"))
    left = lambda unit: F.when(F.col("expire_at").isNull(), -1).when(F.col("expire_at") <= now, -2).otherwise(F.floor(micros / unit)).cast("bigint")
    return meta.select(*KEY, left(1_000_000).alias("ttl"), left(1000).alias("pttl"))


def persist(meta: DataFrame, now: Column) -> DataFrame:
    return live(meta, now).withColumn("expire_at", F.lit(None).cast("timestamp_ntz"))


def flush(meta: DataFrame, db: int | None = None) -> DataFrame:
    """FLUSHDB with a db, FLUSHALL without."""
    return meta.where(F.lit(False)) if db is None else meta.where(F.col("db") != db)


def dbsize(meta: DataFrame, now: Column) -> DataFrame:
    return live(meta, now).groupBy("db").agg(F.count("*").alias("keys"))


def info(meta: DataFrame, now: Column) -> DataFrame:
    """Per db: live keys, those with a deadline, mean seconds left."""
    left = F.timestamp_diff("SECOND", now, F.col("expire_at"))
    return live(meta, now).groupBy("db").agg(F.count("*").alias("keys"), F.count("expire_at").alias("expires"), F.floor(F.coalesce(F.avg(left), F.lit(0))).alias("avg_ttl"))


def encoding(table: DataFrame) -> DataFrame:
    """OBJECT ENCODING of text values: int, embstr to 44 bytes, raw beyond."""
    v = F.col("value").cast("string")
    return table.select(*KEY, F.when(v.try_cast("bigint").isNotNull(), "int").when(F.octet_length(v) <= 44, "embstr").otherwise("raw").alias("encoding"))


def memory_usage(types: DataFrame, strings: DataFrame) -> DataFrame:
    """Estimated bytes: a header of 32 plus the text, or a fixed overhead by container type."""
    size = F.octet_length(F.col("value").cast("string"))
    fixed = F.when(F.col("type") == "list", 64).when(F.col("type") == "stream", 256).otherwise(128)
    j = types.join(strings.select(*KEY, "value"), KEY, "left")
    return j.select(*KEY, (32 + F.when(F.col("type") == "string", F.coalesce(size, F.lit(0))).otherwise(fixed)).cast("bigint").alias("bytes"))
