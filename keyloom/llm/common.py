"""What the training-data operators share: scratch tables on shared storage, text helpers, connected components."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators: space and \t \n \v \f \r.
SPACES = "\x20\x09-\x0d"
WORD = f"[^{SPACES}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir. Where none is named, a local master gets a temporary folder; on a
    cluster that is an error, as other machines would not see such a folder."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or getattr(spark, "_keyloom_scratch", None)
    if not named:
        if not re.fullmatch(r"local(\[[^,]*(,.*)?\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = spark._keyloom_scratch = "file://" + tempfile.mkdtemp(prefix="keyloom-")
    return named


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, wherever they run, and Arrow batches of a size that suits texts."""
    context = spark.sparkContext
    records = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(records) == "10000":  # texts are long rows: fewer at a time, unless the session says otherwise
        spark.conf.set(records, "1000")
    if getattr(context, "_keyloom_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    target = Path(os.path.realpath(tempfile.mkdtemp(prefix="keyloom-"))) / "keyloom.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f"{package.name}/{f.relative_to(package)}")
    context.addPyFile(str(target))
    context._keyloom_shipped = True


class Scratch:
    """Tables written once under the shared folder: they cut lineage and survive lost executors.

    Each operator call has its own; drop() removes what is no longer read, the rest goes when the driver exits.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/keyloom-{uuid.uuid4().hex}"
        self.paths: set[str] = set()
        atexit.register(self.close)

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{len(self.paths)}-{uuid.uuid4().hex[:8]}"
        self.paths.add(path)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._keyloom_path = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            self._delete(df._keyloom_path)
            self.paths.discard(df._keyloom_path)

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def close(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None and self.paths:
                self._delete(self.root)
        except Exception:  # the JVM may have gone before; the folder is then left to the cluster's own cleaning
            pass


def row_key() -> list:
    """(_d, _k): names of a row (doc_id, text) by its content, 128 bits of which rows of one doc_id share 64."""
    return [F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0).cast("bigint")).alias("_d"), F.xxhash64("doc_id", "text").alias("_k")]


def clashes(rows: DataFrame, name: str, check: str) -> frozenset:
    """Names (64-bit hashes) that stand for several values of a second, independent hash. Among n values n^2 / 2^65 are
    expected, a few in 10^10; whoever gives names takes another hash for these."""
    seen = rows.where(F.col(name).isNotNull()).groupBy(name).agg(F.min(check).alias("_low"), F.max(check).alias("_high"))
    return frozenset(r[0] for r in seen.where("_low <> _high").select(name).collect())


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def count_words(text):
    """Number of words, on the JVM: a word begins where a non-space follows a space or the start."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node reachable.

    Rounds of minimum hooking and contraction. Each round points every node to its smallest neighbour (a partial
    aggregate, so a hub costs no more than its edges), follows pointers a few steps, and rewrites the edges between
    the nodes reached. All joins are between stored tables, so AQE can split the partition of a hub.
    """
    least, greatest = F.least("a", "b"), F.greatest("a", "b")
    e = scratch.keep(edges.where("a <> b").select(least.alias("a"), greatest.alias("b")).distinct())
    labels = None
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        p = scratch.keep(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        for _ in range(2):
            q = p.select(F.col("a").alias("m"), F.col("m").alias("m2"))
            nxt = scratch.keep(p.join(q, "m").select("a", F.col("m2").alias("m")))
            scratch.drop(p)
            p = nxt
        pa, pb = p.select("a", F.col("m").alias("ra")), p.select(F.col("a").alias("b"), F.col("m").alias("rb"))
        moved = e.join(pa, "a").join(pb, "b").where("ra <> rb")
        e2 = scratch.keep(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        if labels is None:
            labels, done = p, [e]
        else:
            step = p.select(F.col("a").alias("m"), F.col("m").alias("m2"))
            joined = scratch.keep(labels.join(step, "m", "left").select("a", F.coalesce("m2", "m").alias("m")))
            done, labels = [e, labels, p], joined
        scratch.drop(*done)
        e = e2
    if labels is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels.select(F.col("a").alias("node"), F.col("m").alias("root"))
