"""Sets as distinct (key, member) rows. N-way algebra is one grouped count, not a chain of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.model import KEY
from keyloom.operators import core

MEMBER = [*KEY, "member"]


def sadd(table: DataFrame, new: DataFrame) -> DataFrame:
    return table.unionByName(new).dropDuplicates(MEMBER)


def sadd_counts(table: DataFrame, new: DataFrame) -> DataFrame:
    fresh = new.dropDuplicates(MEMBER).join(table, MEMBER, "left_anti")
    return core.count_per_key(fresh, "added")


def srem(table: DataFrame, gone: DataFrame) -> DataFrame:
    return core.remove(table, gone, MEMBER)


def sismember(table: DataFrame, requests: DataFrame) -> DataFrame:
    """0/1 per request row (SISMEMBER, SMISMEMBER)."""
    got = requests.join(table.select("key", "member", F.lit(1).alias("_hit")), ["key", "member"], "left")
    return got.select("idx", "key", "member", F.coalesce("_hit", F.lit(0)).alias("found"))


def scard(table: DataFrame) -> DataFrame:
    return table.groupBy(*KEY).agg(F.countDistinct("member").alias("card"))


def smove(table: DataFrame, source: str, target: str, member: str) -> DataFrame:
    """Move one member; if the target holds it already it only leaves the source."""
    touched = F.col("key").isin(source, target) & (F.col("member") == member)
    moved = table.where(touched).withColumn("key", F.lit(target)).dropDuplicates(MEMBER)  # two rows a database at most
    return table.where(~touched).unionByName(moved)


def sinter(table: DataFrame, keys: list[str]) -> DataFrame:
    """Members of all keys; a missing key makes it empty."""
    keys = list(dict.fromkeys(keys))
    hit = table.where(F.col("key").isin(keys)).groupBy("db", "member").agg(F.countDistinct("key").alias("_n"))
    return hit.where(F.col("_n") == len(keys)).select("db", "member")


def sunion(table: DataFrame, keys: list[str]) -> DataFrame:
    return table.where(F.col("key").isin(keys)).select("db", "member").distinct()


def sdiff(table: DataFrame, first: str, others: list[str]) -> DataFrame:
    """Members of first that no other key holds: one grouped pass."""
    t = table.where(F.col("key").isin([first, *others])).groupBy("db", "member")
    hit = t.agg(F.max(F.col("key") == first).alias("_a"), F.max(F.col("key").isin(others) if others else F.lit(False)).alias("_b"))
    return hit.where("_a AND NOT _b").select("db", "member")


def store(table: DataFrame, target: str, members: DataFrame) -> DataFrame:
    """The *STORE form: target's old members give way to the result."""
    return table.where(F.col("key") != target).unionByName(members.select("db", F.lit(target).alias("key"), "member"))


def is_subset(table: DataFrame, small: str, large: str) -> DataFrame:
    """One row: whether every member of small is in large."""
    t = table.where(F.col("key").isin(small, large)).groupBy("db", "member").agg(F.max(F.col("key") == small).alias("_a"), F.max(F.col("key") == large).alias("_b"))
    return t.agg(F.coalesce(F.bool_and(~F.col("_a") | F.col("_b")), F.lit(True)).alias("subset"))
