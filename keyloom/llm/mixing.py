"""Mixing sources to target weights by weighted fair queueing, on DataFrame functions alone.

Every document gets a shuffle position within its source by a hash; the virtual finish time of its e-th copy is the
source's cumulated words up to it, e full rounds included, divided by the source's target. All copies are
range-sorted by finish time and taken until the total budget is met. Which copies of a source are taken then shows
in one threshold on the hash per source and round, so the documents themselves are never moved.

A source may hold any share of the rows: sums within a source are taken in hash ranges of about RANGE rows, first the
range sums, then inside each range.

Cases: null text has size 0; null sources are one source, last in order; equal rows share a position and are taken or
left together; sources without words have target 0; an empty table gives no rows; extra columns are kept by `mixed`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.common import Scratch, count_words

#: Weights dealt to the sources in order, most copies of a document, rows of a hash range.
WEIGHTS, COPIES, RANGE = (5, 2, 1), 3, 4096
#: Sources up to which their table (a few numbers a row) is broadcast; beyond, joins are shuffled and AQE splits hot sources.
SMALL = 10_000


def position(seed: int = 0) -> Column:
    """A row's place in the shuffle, 60 bits: the same on any engine."""
    text = F.concat_ws("\x1f", F.lit(str(seed)), F.col("doc_id").cast("string"), "source", "text")
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def sized(docs: DataFrame, seed: int = 0) -> DataFrame:
    return docs.select("doc_id", "source", count_words(F.col("text")).alias("size"), position(seed).alias("h"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = COPIES) -> DataFrame:
    """(source, source_size, n, target) for a table (source, size).

    A target is least(most * source_size, level * weight) with one level for all, at which targets add up to the
    total: sources in order of cap by weight, capped until the level left for the rest lies below the next ratio.
    The windows run over one row per source.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = s.withColumn("w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * float(most)).withColumn("ratio", F.col("cap") / F.col("w"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1))
    left = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(before, F.lit(0.0))) / left)
    s = s.withColumn("i", F.row_number().over(order)).withColumn("open", F.col("ratio") > F.col("level"))
    level = F.min(F.when(F.col("open"), F.struct("i", "level"))).over(every)["level"]
    return s.withColumn("target", F.coalesce(F.least("cap", level * F.col("w")), F.col("cap"))).select("source", "source_size", "n", "target")


def _with_sources(df: DataFrame, table: DataFrame, n: int) -> DataFrame:
    t = table.withColumnRenamed("source", "_s")
    return df.join(F.broadcast(t) if n <= SMALL else t, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def plan(sizes: DataFrame, scratch: Scratch, weights: tuple = WEIGHTS, most: int = COPIES) -> tuple[DataFrame, int]:
    """(source, source_size, target, cut_0 ...) and the number of sources; sizes: a stored table (source, size, h).
    Copy e of a document is taken if its h is at most cut_e of its source."""
    goals = scratch.keep(targets(sizes, weights, most))
    n_sources, total = goals.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    docs = _with_sources(sizes, goals, n_sources)
    ranges = F.ceil(F.col("n") / RANGE)
    share = F.col("h").cast("double") / 2.0**60
    docs = docs.withColumn("r", F.least(F.floor(share * ranges), ranges - 1).cast("bigint"))
    sums = docs.groupBy("source", "r").agg(F.sum("size").alias("_s"))
    sums = sums.select(F.col("source").alias("_source"), F.col("r").alias("_r"), (F.sum("_s").over(Window.partitionBy("source").orderBy("r")) - F.col("_s")).alias("ahead"))
    within = F.sum("size").over(Window.partitionBy("source", "r").orderBy("h"))
    docs = docs.withColumn("cum", within).join(sums, F.col("source").eqNullSafe(F.col("_source")) & (F.col("r") == F.col("_r")))
    copy = F.explode(F.array(*(F.lit(e) for e in range(most)))).alias("e")
    copies = docs.where("target > 0").select("source", "h", "size", "target", "source_size", (F.col("ahead") + F.col("cum")).alias("cum"), copy)
    copies = copies.select("source", "h", "size", "e", ((F.col("e") * F.col("source_size") + F.col("cum")) / F.col("target")).alias("finish"))
    queue = scratch.keep(copies.repartitionByRange("finish", "h").withColumn("part", F.spark_partition_id()))
    parts = queue.groupBy("part").agg(F.sum("size").alias("_s"))
    parts = parts.select("part", (F.sum("_s").over(Window.orderBy("part")) - F.col("_s")).alias("ahead"))  # a row for each sorting task
    served = queue.join(parts, "part").withColumn("served", F.col("ahead") + F.sum("size").over(Window.partitionBy("part").orderBy("finish", "h")))
    taken = served.where(F.col("served") <= total).groupBy("source")
    cuts = taken.agg(*(F.max(F.when(F.col("e") == e, F.col("h"))).alias(f"cut_{e}") for e in range(most)))
    c = cuts.withColumnRenamed("source", "_s")
    out = scratch.keep(goals.join(c, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s", "n"))
    scratch.drop(goals, queue)
    return out, n_sources


def copies(most: int = COPIES) -> Column:
    """How often a row with column h is taken, after the join with its source's cuts."""
    return sum((F.coalesce((F.col("h") <= F.col(f"cut_{e}")).cast("int"), F.lit(0)) for e in range(most)), F.lit(0))


def mix(docs: DataFrame, seed: int = 0, weights: tuple = WEIGHTS, most: int = COPIES) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every document (doc_id, source, text)."""
    scratch = Scratch(docs.sparkSession)
    sizes = scratch.keep(sized(docs, seed))
    cuts, n = plan(sizes, scratch, weights, most)
    out = _with_sources(sizes, cuts, n).withColumn("copies", copies(most))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, seed: int = 0, weights: tuple = WEIGHTS, most: int = COPIES) -> DataFrame:
    """The mixture: the rows of docs, each as often as it is taken. Only thresholds are joined; texts stay in place."""
    scratch = Scratch(docs.sparkSession)
    sizes = scratch.keep(sized(docs, seed))
    cuts, n = plan(sizes, scratch, weights, most)
    c = cuts.select("source", *(f"cut_{e}" for e in range(most)))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "source", position(seed).alias("h"))
    rows = _with_sources(rows, c, n).withColumn("copies", copies(most)).where("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
