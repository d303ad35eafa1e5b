"""Snapshots and change logs on shared storage: SAVE BGSAVE LASTSAVE APPENDONLY BGREWRITEAOF."""

from __future__ import annotations

import re
import tempfile
import time
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.model import KEY
from keyloom.operators.core import fold_last


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a temporary one where none is named on a local master."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or getattr(spark, "_keyloom_saved", None)
    if not named:
        if not re.fullmatch(r"local(\[[^,]*(,.*)?\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = spark._keyloom_saved = "file://" + tempfile.mkdtemp(prefix="keyloom-")
    return named


def save(state: DataFrame, path: str, version: int) -> str:
    """Write one immutable snapshot directory per version; readers pick the latest with a success marker."""
    target = f"{path}/version={version:012d}"
    state.write.mode("overwrite").parquet(target)
    spark = state.sparkSession
    spark.createDataFrame([(version, target, int(time.time()))], "version long, path string, saved_at long").coalesce(1).write.mode("append").parquet(f"{path}/_manifest")
    return target


def bgsave(state: DataFrame, path: str, version: int) -> Future:
    """The same in a driver thread; the job itself runs on the executors."""
    pool = ThreadPoolExecutor(1)
    done = pool.submit(save, state, path, version)
    pool.shutdown(wait=False)
    return done


def lastsave(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/_manifest").orderBy(F.col("version").desc()).limit(1)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The latest snapshot."""
    return spark.read.parquet(lastsave(spark, path).first()["path"])


class ChangeLog:
    """Append-only log directory: one Parquet batch per append, every row with db and seq."""

    def __init__(self, path: str, enabled: bool = True):
        self.path, self.enabled = path, enabled

    def append(self, rows: DataFrame) -> None:
        if self.enabled:
            rows.write.mode("append").parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)

    def replay(self, spark: SparkSession) -> DataFrame:
        return fold_last(self.read(spark), KEY).where("op = 'SET'")


def rewrite(log: DataFrame) -> DataFrame:
    """Compaction: the minimal log with the same replay, one SET per surviving key."""
    return fold_last(log, KEY).where("op = 'SET'").select(*log.columns)
