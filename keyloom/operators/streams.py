"""Append-only logs with (ms, seq) ids and consumer groups, as batch relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.model import KEY

ID = ["ms", "seq"]


def _oldest():
    return Window.partitionBy(*KEY).orderBy("ms", "seq")


def _newest():
    return Window.partitionBy(*KEY).orderBy(F.col("ms").desc(), F.col("seq").desc())


def xadd(table: DataFrame, new: DataFrame) -> DataFrame:
    """Append rows (db, key, ms, ord, ...) with automatic seq: ids never fall below the key's last id."""
    last = table.groupBy(*KEY).agg(F.max(F.struct("ms", "seq")).alias("_last"))
    n = new.join(last, KEY, "left")
    base = F.coalesce(F.col("_last.ms"), F.lit(-1))
    n = n.withColumn("ms", F.greatest(F.col("ms"), base))
    n = n.withColumn("ms", F.max("ms").over(Window.partitionBy(*KEY).orderBy("ord")))  # a clock that steps back stays at the latest ms
    start = F.when(F.col("ms") == F.col("_last.ms"), F.col("_last.seq") + 1).otherwise(0)
    seq = F.row_number().over(Window.partitionBy(*KEY, "ms").orderBy("ord")) - 1 + start
    return table.unionByName(n.withColumn("seq", seq.cast("bigint")).select(table.columns))


def reject_late(new: DataFrame) -> DataFrame:
    """Explicit ids (db, key, ms, seq, ord): a row survives only if its id exceeds every earlier one of its key."""
    w = Window.partitionBy(*KEY).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    best = F.max(F.struct("ms", "seq")).over(w)
    return new.withColumn("_b", best).where(F.col("_b").isNull() | (F.struct("ms", "seq") > F.col("_b"))).drop("_b")


def xlen(table: DataFrame) -> DataFrame:
    return table.groupBy(*KEY).agg(F.count("*").alias("length"))


def xrange(table: DataFrame, start: tuple[int, int], end: tuple[int, int], count: int | None = None, reverse: bool = False) -> DataFrame:
    """Ids between both bounds, which need not exist; at most count per key in reading order."""
    ident = F.struct("ms", "seq")
    low, high = (F.struct(F.lit(a).cast("bigint").alias("ms"), F.lit(b).cast("bigint").alias("seq")) for a, b in (start, end))
    hit = table.where(F.col("ms").between(start[0], end[0]) & (ident >= low) & (ident <= high))
    if count is None:
        return hit
    return hit.withColumn("_rn", F.row_number().over(_newest() if reverse else _oldest())).where(F.col("_rn") <= count).drop("_rn")


def xread(table: DataFrame, offsets: DataFrame, count: int | None = None) -> DataFrame:
    """Entries after each key's (last_ms, last_seq)."""
    hit = table.join(offsets, KEY).where((F.col("ms") > F.col("last_ms")) | ((F.col("ms") == F.col("last_ms")) & (F.col("seq") > F.col("last_seq"))))
    if count is not None:
        hit = hit.withColumn("_rn", F.row_number().over(_oldest())).where(F.col("_rn") <= count).drop("_rn")
    return hit


def xdel(table: DataFrame, gone: DataFrame) -> DataFrame:
    return table.join(gone, [*KEY, *ID], "left_anti")


def xtrim(table: DataFrame, maxlen: int) -> DataFrame:
    """Keep the newest maxlen per key."""
    return table.withColumn("_rn", F.row_number().over(_newest())).where(F.col("_rn") <= maxlen).drop("_rn")


def trim_by_id(table: DataFrame, start: tuple[int, int], end: tuple[int, int]) -> DataFrame:
    return xrange(table, start, end)


def xgroup_create(table: DataFrame, grp: str, at_end: bool) -> DataFrame:
    """Group rows positioned at the end or before the start of each stream."""
    last = table.groupBy(*KEY).agg(F.max(F.struct("ms", "seq")).alias("_l"))
    zero = F.lit(0).cast("bigint")
    return last.select(*KEY, F.lit(grp).alias("grp"), (F.col("_l.ms") if at_end else zero).alias("last_ms"), (F.col("_l.seq") if at_end else zero).alias("last_seq"))


def xgroup_destroy(groups: DataFrame, grp: str) -> DataFrame:
    return groups.where(F.col("grp") != grp)


def xreadgroup(table: DataFrame, groups: DataFrame, consumer, count: int | None = None) -> DataFrame:
    """New entries of each group with the consumer (a column) they are delivered to: the new pending rows."""
    return xread(table, groups, count).withColumn("consumer", consumer)


def advance(groups: DataFrame, delivered: DataFrame) -> DataFrame:
    """Groups with their last id moved to the greatest delivered one."""
    top = delivered.groupBy(*KEY, "grp").agg(F.max(F.struct("ms", "seq")).alias("_t"))
    g = groups.join(top, [*KEY, "grp"], "left")
    return g.select(*KEY, "grp", F.coalesce("_t.ms", "last_ms").alias("last_ms"), F.coalesce("_t.seq", "last_seq").alias("last_seq"))


def xack(pending: DataFrame, acks: DataFrame) -> DataFrame:
    return pending.join(acks, [*KEY, "grp", *ID], "left_anti")


def xclaim(pending: DataFrame, claims: DataFrame, consumer: str) -> DataFrame:
    """Claimed rows change their owner; the old one loses them."""
    hit = claims.select(*KEY, "grp", *ID, F.lit(True).alias("_c"))
    return pending.join(hit, [*KEY, "grp", *ID], "left").withColumn("consumer", F.when(F.col("_c"), consumer).otherwise(F.col("consumer"))).drop("_c")


def xpending(pending: DataFrame) -> DataFrame:
    """Per consumer: count, smallest and greatest pending id."""
    p = pending.groupBy(*KEY, "grp", "consumer").agg(F.count("*").alias("n"), F.min(F.struct("ms", "seq")).alias("_a"), F.max(F.struct("ms", "seq")).alias("_b"))
    return p.select(*KEY, "grp", "consumer", "n", F.col("_a.ms").alias("min_ms"), F.col("_a.seq").alias("min_seq"), F.col("_b.ms").alias("max_ms"), F.col("_b.seq").alias("max_seq"))


def xinfo(table: DataFrame, groups: DataFrame) -> DataFrame:
    """Per stream: length, first and last id, number of groups."""
    s = table.groupBy(*KEY).agg(F.count("*").alias("length"), F.min(F.struct("ms", "seq")).alias("_a"), F.max(F.struct("ms", "seq")).alias("_b"))
    g = groups.groupBy(*KEY).agg(F.countDistinct("grp").alias("groups"))
    return s.join(g, KEY, "left").select(*KEY, "length", F.col("_a.ms").alias("first_ms"), F.col("_b.ms").alias("last_ms"), F.col("_b.seq").alias("last_seq"), F.coalesce("groups", F.lit(0)).alias("groups"))
