"""Cardinality sketches with mergeable binary state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.model import KEY

LG_K = 12


def pfadd(items: DataFrame, column: str, lg_k: int = LG_K) -> DataFrame:
    return items.groupBy(*KEY).agg(F.hll_sketch_agg(column, F.lit(lg_k)).alias("sketch"))


def pfcount(sketches: DataFrame) -> DataFrame:
    return sketches.select(*KEY, F.hll_sketch_estimate("sketch").alias("estimate"))


def pfmerge(sketches: DataFrame, target: str) -> DataFrame:
    return sketches.groupBy("db").agg(F.hll_union_agg("sketch").alias("sketch")).select("db", F.lit(target).alias("key"), "sketch")
