"""Ranked sets: one row per (key, member); order is (score, member bytes)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.text import slice_bounds
from keyloom.model import KEY
from keyloom.operators import core

MEMBER = [*KEY, "member"]


def _asc():
    return Window.partitionBy(*KEY).orderBy("score", "member")


def _desc():
    return Window.partitionBy(*KEY).orderBy(F.col("score").desc(), F.col("member").desc())


def _all():
    return Window.partitionBy(*KEY)


def zadd(table: DataFrame, new: DataFrame, mode: str = "") -> DataFrame:
    """new: (db, key, member, score, seq), last seq wins. mode: "", nx or xx."""
    latest = core.fold_last(new, MEMBER).select(*MEMBER, "score")
    if mode == "nx":
        return table.unionByName(core.insert_absent(table, latest, MEMBER))
    if mode == "xx":
        latest = core.update_present(table, latest, MEMBER)
    elif mode:
        raise ValueError("mode is nx, xx or empty")
    return core.upsert(table, latest, MEMBER)


def zrem(table: DataFrame, gone: DataFrame) -> DataFrame:
    return core.remove(table, gone, MEMBER)


def zmscore(table: DataFrame, requests: DataFrame) -> DataFrame:
    return core.lookup(requests, table, ["key", "member"], "score")


def zincrby(table: DataFrame, deltas: DataFrame) -> DataFrame:
    """Scores plus summed deltas; unknown members start at 0."""
    both = table.select(*MEMBER, "score").unionByName(deltas.select(*MEMBER, F.col("delta").alias("score")))
    return both.groupBy(*MEMBER).agg(F.sum("score").alias("score"))


def in_score_range(low: float | str, high: float | str) -> Column:
    """Predicate for bounds; text starting with ( is exclusive, -inf and +inf are open."""

    def side(bound, lower: bool) -> Column:
        exclusive = isinstance(bound, str) and bound.startswith("(")
        v = F.lit(float(str(bound).lstrip("(")))
        s = F.col("score")
        return (s > v if lower else s < v) if exclusive else (s >= v if lower else s <= v)

    return side(low, True) & side(high, False)


def zcount(table: DataFrame, low, high) -> DataFrame:
    """Also 0 for keys without a hit."""
    return table.groupBy(*KEY).agg(F.count(F.when(in_score_range(low, high), 1)).alias("n"))


def zrange(table: DataFrame, start: int, stop: int, reverse: bool = False) -> DataFrame:
    """Rank slice per key. With non-negative bounds no length is needed, so Spark keeps only the top ranks."""
    r = table.withColumn("rank", (F.row_number().over(_desc() if reverse else _asc()) - 1).cast("bigint"))
    if start >= 0 and stop >= 0:
        return r.where((F.col("rank") <= stop) & (F.col("rank") >= start))
    low, high = slice_bounds(start, stop, F.col("_n"))
    return r.withColumn("_n", F.count("*").over(_all())).where(F.col("rank").between(low, high)).drop("_n")


def zrangebyscore(table: DataFrame, low, high, offset: int = 0, count: int = -1, reverse: bool = False) -> DataFrame:
    """Score slice per key with LIMIT offset count (count < 0: all)."""
    hit = table.where(in_score_range(low, high))
    r = hit.withColumn("rank", (F.row_number().over(_desc() if reverse else _asc()) - 1).cast("bigint"))
    offset = max(offset, 0)
    return r.where((F.col("rank") >= offset) & (F.lit(True) if count < 0 else F.col("rank") < offset + count)).withColumn("rank", F.col("rank") - offset)


def zrank(table: DataFrame, members: DataFrame, reverse: bool = False) -> DataFrame:
    """0-based rank of the asked (key, member) rows."""
    r = table.withColumn("rank", (F.row_number().over(_desc() if reverse else _asc()) - 1).cast("bigint"))
    return r.join(members.select("key", "member"), ["key", "member"], "left_semi")


def zpop(table: DataFrame, n: int, highest: bool) -> DataFrame:
    return zrange(table, 0, n - 1, reverse=highest)


def zremrangebyrank(table: DataFrame, start: int, stop: int) -> DataFrame:
    low, high = slice_bounds(start, stop, F.col("_n"))
    r = table.withColumn("_i", F.row_number().over(_asc()) - 1).withColumn("_n", F.count("*").over(_all()))
    return r.where(~F.col("_i").between(low, high)).drop("_i", "_n")


def zremrangebyscore(table: DataFrame, low, high) -> DataFrame:
    return table.where(~in_score_range(low, high))


def _merged(table: DataFrame, keys: list[str], weights: list[float] | None, aggregate: str) -> DataFrame:
    if aggregate not in ("sum", "min", "max"):
        raise ValueError("aggregate is sum, min or max")
    weights = weights or [1] * len(keys)
    if len(weights) != len(keys):
        raise ValueError("one weight per key")
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.lit(w).alias("w")) for k, w in zip(keys, weights, strict=True))))
    asked = table.sparkSession.range(1).select(each.alias("a")).select("a.key", "a.w")
    hit = table.where(F.col("key").isin(keys)).join(F.broadcast(asked), "key")  # as many rows as arguments
    score = {"sum": F.sum, "min": F.min, "max": F.max}[aggregate](F.col("score") * F.col("w"))
    return hit.groupBy("db", "member").agg(score.alias("score"), F.countDistinct("key").alias("_n"))


def zunion(table: DataFrame, keys: list[str], weights: list[float] | None = None, aggregate: str = "sum") -> DataFrame:
    return _merged(table, keys, weights, aggregate).drop("_n")


def zinter(table: DataFrame, keys: list[str], weights: list[float] | None = None, aggregate: str = "sum") -> DataFrame:
    return _merged(table, keys, weights, aggregate).where(F.col("_n") == len(set(keys))).drop("_n")


def zdiff(table: DataFrame, first: str, others: list[str]) -> DataFrame:
    gone = table.where(F.col("key").isin(others)).select("db", "member")
    return table.where(F.col("key") == first).join(gone, ["db", "member"], "left_anti").select("db", "member", "score")


def store(table: DataFrame, target: str, members: DataFrame) -> DataFrame:
    return table.where(F.col("key") != target).unionByName(members.select("db", F.lit(target).alias("key"), "member", "score"))
