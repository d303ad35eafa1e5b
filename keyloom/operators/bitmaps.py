"""Bitmaps as (key, bit) rows of set bits; BITFIELD arithmetic on integers; packed form at the edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.model import KEY

BIT = [*KEY, "bit"]
#: Bytes of a bitmap whose positions one row makes.
BLOCK = 4096


def setbit(table: DataFrame, on: DataFrame | None = None, off: DataFrame | None = None) -> DataFrame:
    out = table if off is None else table.join(off, BIT, "left_anti")
    return out if on is None else out.unionByName(on).dropDuplicates(BIT)


def getbit(table: DataFrame, requests: DataFrame) -> DataFrame:
    got = requests.join(table.select("key", "bit", F.lit(1).alias("_b")), ["key", "bit"], "left")
    return got.select("idx", "key", "bit", F.coalesce("_b", F.lit(0)).alias("value"))


def bitcount(table: DataFrame, start_byte: int | None = None, end_byte: int | None = None) -> DataFrame:
    """Set bits per key, optionally within an inclusive byte range of non-negative indexes."""
    hit = F.lit(True) if start_byte is None else F.col("bit").between(8 * start_byte, 8 * end_byte + 7)
    return table.groupBy(*KEY).agg(F.countDistinct(F.when(hit, F.col("bit"))).alias("n"))


def bitpos(table: DataFrame, value: int, start_byte: int = 0) -> DataFrame:
    """First set or clear bit from a byte on. The first clear bit is where the run of set bits from the start ends:
    ranks and positions agree along that run, so no sequence of all positions is made."""
    from pyspark.sql import Window

    hit = table.where(F.col("bit") >= 8 * start_byte).dropDuplicates(BIT)
    if value:
        return hit.groupBy(*KEY).agg(F.min("bit").alias("pos"))
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy("bit")) - 1 + 8 * start_byte
    runs = hit.withColumn("_run", rank == F.col("bit"))
    keys = table.select(*KEY).distinct()
    ends = runs.where("_run").groupBy(*KEY).agg((F.max("bit") + 1).alias("pos"))
    return keys.join(ends, KEY, "left").withColumn("pos", F.coalesce("pos", F.lit(8 * start_byte).cast("bigint")))


def bitop(table: DataFrame, op: str, keys: list[str]) -> DataFrame:
    """AND, OR, XOR over keys in one grouped pass."""
    g = table.where(F.col("key").isin(keys)).groupBy("db", "bit").agg(F.countDistinct("key").alias("_n"))
    want = {"AND": F.col("_n") == len(set(keys)), "OR": F.col("_n") > 0, "XOR": F.col("_n") % 2 == 1}
    if op not in want:
        raise ValueError("op is AND, OR or XOR; use bitnot for NOT")
    return g.where(want[op]).select("db", "bit")


def bitnot(table: DataFrame, key: str) -> DataFrame:
    """Clear bits of one bitmap up to the end of its last byte. Its length is cut into blocks of BLOCK bytes, which are dealt
    out before the positions in them are made."""
    own = table.where(F.col("key") == key)
    size = own.groupBy("db").agg((F.floor(F.max("bit") / 8) + 1).cast("bigint").alias("_bytes"))
    blocks = size.select("db", "_bytes", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_bytes") - 1) / BLOCK))).alias("_block")).repartition("db", "_block")
    each = blocks.select("db", F.explode(F.sequence(F.col("_block") * BLOCK, F.least(F.col("_block") * BLOCK + BLOCK, F.col("_bytes")) - 1)).alias("_byte"))
    every = each.select("db", F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.col("_byte") * 8 + i)).alias("bit"))
    return every.join(own, ["db", "bit"], "left_anti")


def bitfield_get(value: Column, kind: str) -> Column:
    """An integer column read as i<n> or u<n>."""
    bits = int(kind[1:])
    low = value.bitwiseAND(F.lit((1 << bits) - 1))
    return low if kind[0] == "u" else F.when(low >= 1 << (bits - 1), low - (1 << bits)).otherwise(low)


def bitfield_incrby(value: Column, delta: Column, kind: str, overflow: str = "WRAP") -> Column:
    """Sum within a field type of at most 62 bits: WRAP modulo, SAT to the limits, FAIL to NULL."""
    bits = int(kind[1:])
    if not 1 <= bits <= 62:
        raise ValueError("fields have 1 to 62 bits")
    low, high = (0, (1 << bits) - 1) if kind[0] == "u" else (-(1 << (bits - 1)), (1 << (bits - 1)) - 1)
    total = value + delta
    if overflow == "WRAP":
        return F.pmod(total - low, F.lit(1 << bits)) + low
    if overflow == "SAT":
        return F.least(F.greatest(total, F.lit(low)), F.lit(high))
    if overflow == "FAIL":
        return F.when(total.between(low, high), total)
    raise ValueError("overflow is WRAP, SAT or FAIL")


def packed(table: DataFrame) -> DataFrame:
    """Per key and bucket the packed binary form, for storage or bitmap_or_agg."""
    g = table.groupBy(*KEY, F.bitmap_bucket_number("bit").alias("bucket"))
    return g.agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bitmap"))


def packed_count(packs: DataFrame) -> DataFrame:
    return packs.groupBy(*KEY).agg(F.sum(F.bitmap_count("bitmap")).alias("n"))
