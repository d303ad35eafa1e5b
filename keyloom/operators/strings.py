"""Strings and counters: SET GET MGET MSET SETEX PSETEX SETNX INCR* DECR* APPEND STRLEN GETRANGE SETRANGE GETSET."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.text import slice_bounds
from keyloom.model import KEY
from keyloom.operators.core import fold_last, insert_absent, lookup, update_present, upsert


def set_(log: DataFrame) -> DataFrame:
    """State after a log of SET and DEL rows; the last write decides."""
    return fold_last(log, KEY).where("op = 'SET'").drop("op")


def set_nx(table: DataFrame, new: DataFrame) -> DataFrame:
    return table.unionByName(insert_absent(table, new, KEY))


def set_xx(table: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(table, update_present(table, new, KEY), KEY)


def get(table: DataFrame, key: str) -> DataFrame:
    return table.where(F.col("key") == key)


def mget(table: DataFrame, requests: DataFrame) -> DataFrame:
    """A missing key reads as the empty string."""
    return lookup(requests, table, ["key"], "value", "")


def mset(table: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(table, new, KEY)


def setex(new: DataFrame, now: Column, seconds: Column) -> DataFrame:
    """Rows with a deadline; negative seconds raise, zero expires at once."""
    checked = F.when(seconds >= 0, seconds).otherwise(F.raise_error(F.lit("invalid expire time")).cast("bigint"))
    return new.withColumn("expire_at", now + F.make_dt_interval(secs=checked.cast("decimal(18,6)")))


def psetex(new: DataFrame, now: Column, millis: Column) -> DataFrame:
    """Millisecond deadlines keep their fraction."""
    return setex(new, now, millis / F.lit(1000).cast("decimal(18,3)"))


def incrby(table: DataFrame, deltas: DataFrame) -> DataFrame:
    """Counters plus the sum of their deltas (columns key, delta); absent counters start at 0.
    An int64 overflow gives NULL with overflow = true."""
    d = deltas.groupBy(*KEY).agg(F.try_sum("delta").alias("delta"))
    joined = table.select(*KEY, F.col("value").try_cast("bigint").alias("value")).join(d, KEY, "full_outer")
    value = F.try_add(F.coalesce("value", F.lit(0)), F.coalesce("delta", F.lit(0)))
    return joined.select(*KEY, value.alias("value"), value.isNull().alias("overflow"))


def incrbyfloat(table: DataFrame, deltas: DataFrame) -> DataFrame:
    d = deltas.groupBy(*KEY).agg(F.sum("delta").alias("delta"))
    bad = lambda c: c.isin(float("inf"), float("-inf"), float("nan"))
    total = F.coalesce(F.col("value").cast("double"), F.lit(0.0)) + F.coalesce("delta", F.lit(0.0))
    return table.join(d, KEY, "full_outer").select(*KEY, F.when(~bad(total), total).alias("value"))


def append(log: DataFrame) -> DataFrame:
    """All values of a key joined in seq order, with the byte length."""
    joined = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda x: x["value"]))
    return log.groupBy(*KEY).agg(joined.alias("value")).withColumn("length", F.octet_length("value").cast("bigint"))


def strlen(table: DataFrame) -> DataFrame:
    return table.withColumn("length", F.octet_length("value").cast("bigint"))


def getrange(table: DataFrame, start: int, stop: int) -> DataFrame:
    low, high = slice_bounds(start, stop, F.char_length("value"))
    return table.withColumn("value", F.when(low > high, "").otherwise(F.substring(F.col("value"), (low + 1).cast("int"), (high - low + 1).cast("int"))))


def setrange(table: DataFrame, offset: int, piece: str) -> DataFrame:
    """Overwrite from a character offset; a gap is filled with NUL."""
    if offset < 0:
        raise ValueError("offset is out of range")
    v = F.col("value")
    padded = F.rpad(v, offset, "\0") if offset else F.lit("")
    return table.withColumn("value", F.concat(padded, F.lit(piece), F.substring(v, F.lit(offset + len(piece) + 1), F.greatest(F.char_length(v), F.lit(1)))))


def getset(log: DataFrame) -> DataFrame:
    """Each write with the value it replaced; a DEL leaves nothing behind."""
    w = Window.partitionBy(*KEY).orderBy("seq")
    return log.withColumn("old", F.lag(F.when(F.col("op") == "SET", F.col("value"))).over(w))
