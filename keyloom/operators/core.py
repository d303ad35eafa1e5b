"""Building blocks every typed operator shares: folds, upserts, anti joins, cursors, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.text import glob_regex
from keyloom.model import KEY


def live(meta: DataFrame, now: Column) -> DataFrame:
    """Rows that have not expired at `now`; a deadline equal to now counts as expired."""
    return meta.where(F.col("expire_at").isNull() | (F.col("expire_at") > now))


def fold_last(log: DataFrame, by: list[str], order: str = "seq") -> DataFrame:
    """Last write wins per `by`: one max_by, aggregated before the shuffle, so that a hot key is one row a task. Where
    values are strings Spark sorts each task's rows by `by` for that; the log is never sorted as a whole."""
    rest = [c for c in log.columns if c not in by]
    return log.groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*by, *(F.col(f"_r.{c}").alias(c) for c in rest))


def upsert(table: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """`table` with the rows of `new` replacing those of equal `by`; new must be unique in `by`."""
    return table.join(new, by, "left_anti").unionByName(new.select(table.columns))


def insert_absent(table: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """The NX rule: rows of new whose `by` is absent from table."""
    return new.join(table, by, "left_anti")


def update_present(table: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """The XX rule: rows of new whose `by` is present in table."""
    return new.join(table, by, "left_semi")


def remove(table: DataFrame, gone: DataFrame, by: list[str]) -> DataFrame:
    return table.join(gone, by, "left_anti")


def removed_counts(table: DataFrame, gone: DataFrame, by: list[str], key: list[str] = KEY) -> DataFrame:
    return table.join(gone, by, "left_semi").groupBy(*key).agg(F.count("*").alias("removed"))


def lookup(requests: DataFrame, table: DataFrame, on: list[str], value: str, default=None) -> DataFrame:
    """One row per request in request order, `default` where nothing is stored."""
    got = requests.join(table.select(*on, value), on, "left")
    return got.withColumn(value, F.coalesce(F.col(value), F.lit(default)) if default is not None else F.col(value))


def scan(table: DataFrame, order: list[str], cursor: int = 0, count: int = 10, match: tuple[str, str] | None = None, after: tuple | None = None) -> DataFrame:
    """A page over a total order; match: (column, glob), applied before paging.

    after: the `order` values of the last row seen: such a page costs its own rows only, however deep it lies. cursor: a
    number of rows to skip, for which all of them are read.
    """
    if cursor < 0 or count < 1:
        raise ValueError("cursor must be >= 0 and count >= 1")
    if after is not None:
        later, equal = F.lit(False), F.lit(True)
        for c, v in zip(order, after, strict=True):
            later, equal = later | (equal & (F.col(c) > v)), equal & (F.col(c) == v)
        table = table.where(later)
    if match:
        table = table.where(F.col(match[0]).rlike(glob_regex(match[1])))
    return table.orderBy(*order).offset(cursor).limit(count)


def shuffled(seed: int, *columns: str) -> Column:
    """A pseudo-random order of rows, the same for the same seed on any engine: the MD5 of seed and columns."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns)))


def sample_per_key(table: DataFrame, member: str, n: int, seed: int = 0, key: list[str] = KEY) -> DataFrame:
    """n pseudo-random members per key, the same for the same seed: ranks of a seeded hash."""
    w = Window.partitionBy(*key).orderBy(shuffled(seed, *key, member), member)
    return table.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def count_per_key(table: DataFrame, name: str = "n", key: list[str] = KEY) -> DataFrame:
    return table.groupBy(*key).agg(F.count("*").alias(name))
