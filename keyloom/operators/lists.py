"""Lists as (key, pos, value); pos may be any increasing numbers, positions are re-ranked on read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.text import slice_bounds
from keyloom.model import KEY


def _by_pos():
    return Window.partitionBy(*KEY).orderBy("pos")


def _all():
    return Window.partitionBy(*KEY)


def ranked(table: DataFrame) -> DataFrame:
    """0-based `i` and length `n` for each element."""
    return table.withColumn("i", (F.row_number().over(_by_pos()) - 1).cast("bigint")).withColumn("n", F.count("*").over(_all()))


def _reposition(table: DataFrame) -> DataFrame:
    return table.withColumn("pos", (F.row_number().over(_by_pos()) - 1).cast("bigint"))


def push(table: DataFrame, new: DataFrame, head: bool) -> DataFrame:
    """LPUSH / RPUSH: new has (db, key, ord, value), pushed in ord order one by one."""
    edge = table.groupBy(*KEY).agg((F.min("pos") if head else F.max("pos")).alias("_edge"))
    step = F.row_number().over(Window.partitionBy(*KEY).orderBy("ord")).cast("bigint")
    placed = new.withColumn("_s", step).join(edge, KEY, "left")
    pos = F.coalesce("_edge", F.lit(0 if head else -1)) + (-F.col("_s") if head else F.col("_s"))
    return _reposition(table.unionByName(placed.select(*KEY, pos.cast("bigint").alias("pos"), "value")))


def ends(table: DataFrame, head: bool) -> DataFrame:
    """What LPOP / RPOP returns: the first or last element per key, by one aggregate."""
    pick = F.min_by if head else F.max_by
    return table.groupBy(*KEY).agg(pick("value", "pos").alias("value"))


def pop_rest(table: DataFrame, head: bool) -> DataFrame:
    """The lists after LPOP / RPOP; emptied keys are gone."""
    r = ranked(table)
    return r.where(F.col("i") > 0 if head else F.col("i") < F.col("n") - 1).drop("i", "n")


def llen(table: DataFrame) -> DataFrame:
    return table.groupBy(*KEY).agg(F.count("*").alias("length"))


def lindex(table: DataFrame, index: int) -> DataFrame:
    """Negative indexes give nothing."""
    return ranked(table).where(F.col("i") == index).select(*KEY, "value")


def lset(table: DataFrame, index: int, value: str) -> DataFrame:
    at = index if index >= 0 else F.col("n") + index
    return ranked(table).withColumn("value", F.when(F.col("i") == at, value).otherwise(F.col("value"))).drop("i", "n")


def lrange(table: DataFrame, start: int, stop: int) -> DataFrame:
    low, high = slice_bounds(start, stop, F.col("n"))
    return ranked(table).where(F.col("i").between(low, high)).select(*KEY, "i", "value")


def ltrim(table: DataFrame, start: int, stop: int) -> DataFrame:
    """Keep a range; a range that is empty for a key leaves that list as it is."""
    low, high = slice_bounds(start, stop, F.col("n"))
    return _reposition(ranked(table).where((low > high) | F.col("i").between(low, high)).drop("i", "n"))


def lrem(table: DataFrame, count: int, value: str) -> DataFrame:
    """Remove the first count matches (0: all; negative: from the tail)."""
    order = F.col("pos").desc() if count < 0 else F.col("pos")
    nth = F.row_number().over(Window.partitionBy(*KEY, "value").orderBy(order))
    gone = F.col("value") == value
    if count:
        gone &= F.col("_nth") <= abs(count)
    return _reposition(table.withColumn("_nth", nth).where(~gone).drop("_nth"))


def linsert(table: DataFrame, pivot: str, value: str, before: bool) -> DataFrame:
    """Insert beside the first pivot; keys without the pivot stay as they are. The list is read and dealt by key once."""
    first = F.min(F.when(F.col("value") == pivot, F.col("pos"))).over(Window.partitionBy(*KEY))
    own = F.struct((F.col("pos") * 2).alias("pos"), F.col("value").alias("value"))
    new = F.struct((F.col("pos") * 2 + (-1 if before else 1)).alias("pos"), F.lit(value).alias("value"))
    rows = table.withColumn("_first", first).select(*KEY, F.explode(F.when(F.col("pos") == F.col("_first"), F.array(own, new)).otherwise(F.array(own))).alias("_r"))
    return _reposition(rows.select(*KEY, "_r.pos", "_r.value"))


def lpos(table: DataFrame, value: str) -> DataFrame:
    return ranked(table).where(F.col("value") == value).groupBy(*KEY).agg(F.min("i").alias("i"))
