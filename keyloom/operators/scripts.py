"""Stored scripts: a registry of Spark SQL bodies by SHA-1, with :keys and :argv array parameters."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ScriptRegistry:
    def __init__(self):
        self._bodies: dict[str, str] = {}

    def load(self, body: str) -> str:
        sha = hashlib.sha1(body.encode()).hexdigest()
        self._bodies[sha] = body
        return sha

    def exists(self, *shas: str) -> list[int]:
        return [int(s.lower() in self._bodies) for s in shas]

    def flush(self) -> None:
        self._bodies.clear()

    def show(self, sha: str) -> list[str]:
        return self._bodies[sha].splitlines()

    def eval(self, spark: SparkSession, body: str, keys: list[str] = (), argv: list[str] = (), **tables: DataFrame) -> DataFrame:
        """Run a body over tables named in it as {name}; KEYS and ARGV are :keys and :argv."""
        self.load(body)
        array = lambda xs: F.array(*map(F.lit, xs)) if xs else F.array()
        return spark.sql(body, args={"keys": array(list(keys)), "argv": array(list(argv))}, **tables)

    def evalsha(self, spark: SparkSession, sha: str, keys: list[str] = (), argv: list[str] = (), **tables: DataFrame) -> DataFrame:
        if sha.lower() not in self._bodies:
            raise KeyError("NOSCRIPT No matching script. Please use EVAL.")
        return self.eval(spark, self._bodies[sha.lower()], keys, argv, **tables)
