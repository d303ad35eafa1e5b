"""Eviction rankings: which keys to drop until a byte budget holds. Exact where a server would sample."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.operators.core import shuffled

POLICIES = {"lru": ["last_access", "key"], "lfu": ["freq", "last_access", "key"], "ttl": ["expire_at", "key"], "random": None}
#: Rows that are ranked in one task at most, and bytes of a key that make one number.
SMALL, SLICE = 100_000, 6


def _digits(policy: str, seed: int) -> Iterator[Column]:
    """The policy's order as numbers, one after the other; those of the key go on without end."""
    name = shuffled(seed, "key") if policy == "random" else F.col("key")
    for c in (POLICIES[policy] or [])[:-1]:
        number = F.col(c) if c == "freq" else F.unix_micros(F.col(c).cast("timestamp"))
        yield F.coalesce(number.cast("double"), F.lit(-1e300))  # nulls come first
    for at in itertools.count(1, SLICE):
        part = F.substring(F.encode(name, "utf-8"), at, SLICE)
        yield F.conv(F.rpad(F.hex(part), 2 * SLICE, "0"), 16, 10).cast("double")


def evict(meta: DataFrame, policy: str, need_bytes: int, volatile: bool = False, seed: int = 0, buckets: int = 1024) -> DataFrame:
    """Victims in policy order whose cumulated size first reaches need_bytes.

    Sizes are summed in buckets of the order's first number; those before the bucket in which the budget is met go as a
    whole, that one is cut into buckets again, by the next number where the first is the same for all, until it has few
    enough rows to be ranked in one task. Each round brings `buckets` sums to the driver; equal values are no hot spot.
    """
    if policy == "noeviction":
        return meta.where(F.lit(False))
    table = meta.where(F.col("expire_at").isNotNull()) if volatile or policy == "ttl" else meta
    order = POLICIES[policy] or [shuffled(seed, "key"), F.col("key")]
    whole, inside, digits = F.lit(False), F.lit(True), _digits(policy, seed)
    digit = next(digits)
    while True:
        part = table.where(inside)
        lo, hi, n, total = part.agg(F.min(digit), F.max(digit), F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        if total < need_bytes:
            return table.where(whole | inside).select(*meta.columns)
        if n <= SMALL:
            ahead = F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
            last = part.withColumn("_ahead", ahead).where(F.col("_ahead") < need_bytes)  # at most SMALL rows
            return table.where(whole).unionByName(last.drop("_ahead")).select(*meta.columns)
        if lo == hi:
            digit = next(digits)
            continue
        bucket = F.least(F.floor((digit - lo) / (hi - lo) * buckets), F.lit(buckets - 1))
        sums = {r["b"]: r["s"] for r in part.groupBy(bucket.alias("b")).agg(F.sum("size").alias("s")).collect()}  # at most `buckets` rows
        before = 0
        for cut in sorted(sums):
            if before + sums[cut] >= need_bytes:
                break
            before += sums[cut]
        whole, inside, need_bytes = whole | (inside & (bucket < cut)), inside & (bucket == cut), need_bytes - before


def lfu_decay(meta: DataFrame, now, minutes: int = 1) -> DataFrame:
    """Counters lose one per elapsed interval, never below 0."""
    gone = F.floor(F.timestamp_diff("MINUTE", F.col("last_access"), now) / minutes)
    return meta.withColumn("freq", F.greatest(F.col("freq") - F.greatest(gone, F.lit(0)), F.lit(0)).cast("bigint"))
