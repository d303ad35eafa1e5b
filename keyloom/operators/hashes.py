"""Hashes in long form (key, field, value): HSET HGET HMSET HMGET HSETNX HDEL HEXISTS HINCRBY* HKEYS HVALS HGETALL HLEN HSTRLEN HSCAN HRANDFIELD."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.model import KEY
from keyloom.operators import core

FIELD = [*KEY, "field"]


def hset(table: DataFrame, new: DataFrame) -> DataFrame:
    return core.upsert(table, new, FIELD)


def hset_counts(table: DataFrame, new: DataFrame) -> DataFrame:
    """Number of new fields per written key."""
    seen = table.select(*FIELD, F.lit(1).alias("_old"))
    return new.join(seen, FIELD, "left").groupBy(*KEY).agg(F.count(F.when(F.col("_old").isNull(), 1)).alias("added"))


def hget(table: DataFrame, key: str, field: str) -> DataFrame:
    return table.where((F.col("key") == key) & (F.col("field") == field))


def hmget(table: DataFrame, requests: DataFrame) -> DataFrame:
    return core.lookup(requests, table, ["key", "field"], "value")


def hsetnx(table: DataFrame, new: DataFrame) -> DataFrame:
    return table.unionByName(core.insert_absent(table, new, FIELD))


def hdel(table: DataFrame, gone: DataFrame) -> DataFrame:
    return core.remove(table, gone, FIELD)


def hexists(table: DataFrame, requests: DataFrame) -> DataFrame:
    got = requests.join(table.select("key", "field", F.lit(1).alias("_hit")), ["key", "field"], "left")
    return got.select("idx", "key", "field", F.coalesce("_hit", F.lit(0)).alias("found"))


def hincrby(table: DataFrame, deltas: DataFrame, kind: str = "bigint") -> DataFrame:
    """Numeric fields plus summed deltas; kind: bigint or double."""
    d = deltas.groupBy(*FIELD).agg(F.sum("delta").cast(kind).alias("delta"))
    v = F.coalesce(F.col("value").try_cast(kind), F.lit(0).cast(kind)) + F.coalesce(F.col("delta"), F.lit(0).cast(kind))
    return table.join(d, FIELD, "full_outer").select(*FIELD, v.alias("value"))


def hgetall(table: DataFrame) -> DataFrame:
    """One map per key, entries in field order."""
    entries = F.array_sort(F.collect_list(F.struct("field", "value")))
    return table.groupBy(*KEY).agg(F.map_from_entries(entries).alias("entries"))


def hlen(table: DataFrame) -> DataFrame:
    return core.count_per_key(table, "length")


def hstrlen(table: DataFrame) -> DataFrame:
    return table.select(*FIELD, F.octet_length("value").cast("bigint").alias("length"))
