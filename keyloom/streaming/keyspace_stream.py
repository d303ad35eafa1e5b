"""Structured Streaming forms: log tail, late-id rejection, consumer group, pub/sub delivery."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from keyloom.operators.pubsub import routes

ENTRY = "key string, ms long, seq long, event_id long"


def tail(spark: SparkSession, path: str, schema: str = ENTRY) -> DataFrame:
    """XREAD as a stream: the checkpointed offset plays the last-read id."""
    return spark.readStream.schema(schema).parquet(path)


def counts(stream: DataFrame) -> DataFrame:
    return stream.groupBy("key").agg(F.count("*").alias("length"))


def reject_late(stream: DataFrame) -> DataFrame:
    """Keeps entries whose (ms, seq) exceeds all earlier ids of the key; state is one id per key."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else (-1, -1)
        rows = pd.concat(list(batches)).sort_values(["event_id"])
        ids = np.array([last, *rows[["ms", "seq"]].itertuples(index=False, name=None)], [("ms", "i8"), ("seq", "i8")])
        found, rank = np.unique(ids, return_inverse=True)
        top = np.maximum.accumulate(rank)  # of the ids so far
        state.update(tuple(int(x) for x in found[top[-1]]))
        yield rows[rank[1:] > top[:-1]][["key", "ms", "seq", "event_id"]]

    return stream.groupBy("key").applyInPandasWithState(step, ENTRY, "ms long, seq long", "append", GroupStateTimeout.NoTimeout)


def consumer_group(stream: DataFrame, consumers: int) -> DataFrame:
    """XREADGROUP as a stream: entries are dealt round-robin per key; the state is the number dealt so far."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        dealt = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(["ms", "seq"])
        rows = rows.assign(consumer=(dealt + np.arange(len(rows))) % consumers)
        state.update((dealt + len(rows),))
        yield rows[["key", "ms", "seq", "event_id", "consumer"]]

    return stream.groupBy("key").applyInPandasWithState(step, ENTRY + ", consumer long", "dealt long", "append", GroupStateTimeout.NoTimeout)


def deliver(stream: DataFrame, names: DataFrame, subs: DataFrame) -> DataFrame:
    """Stream-static join of messages (channel, ...) with the routes of the known channel names."""
    return stream.join(routes(names, subs), "channel")


def run_available(stream: DataFrame, checkpoint: str, sink: str, mode: str = "append") -> None:
    """Drain what is there into Parquet (append) or an in-memory table (complete)."""
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = w.format("parquet").option("path", sink).start() if mode == "append" else w.format("memory").queryName(sink).start()
    q.awaitTermination()
