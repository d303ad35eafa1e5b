"""Optimistic transactions over versioned keys, and the serial single-writer commit."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.model import KEY
from keyloom.operators.core import fold_last


def versions(log: DataFrame) -> DataFrame:
    """Version of each key: its number of writes."""
    return log.groupBy(*KEY).agg(F.count("*").alias("version"))


def conflicts(watched: DataFrame, current: DataFrame) -> DataFrame:
    """Batches (batch, db, key, version) of which a watched key has moved on."""
    moved = watched.join(current.select(*KEY, F.col("version").alias("_now")), KEY, "left").where(F.coalesce("_now", F.lit(0)) != F.col("version"))
    return moved.select("batch").distinct()


def exec_(queued: DataFrame, watched: DataFrame, current: DataFrame) -> DataFrame:
    """Queued writes (batch, db, key, seq, ...) of the batches without conflict, folded to one row per key."""
    ok = queued.join(conflicts(watched, current), "batch", "left_anti")
    return fold_last(ok, KEY)


@dataclass
class Transaction:
    """Driver-side MULTI ... EXEC: queue functions state -> state, run them on EXEC unless watched keys moved."""

    watched: dict[str, int] = field(default_factory=dict)
    queue: list | None = None

    def multi(self) -> None:
        if self.queue is not None:
            raise ValueError("MULTI calls can not be nested")
        self.queue = []

    def watch(self, versions_now: dict[str, int]) -> None:
        if self.queue is not None:
            raise ValueError("WATCH inside MULTI is not allowed")
        self.watched |= versions_now

    def unwatch(self) -> None:
        self.watched.clear()

    def discard(self) -> None:
        if self.queue is None:
            raise ValueError("DISCARD without MULTI")
        self.queue = None
        self.watched.clear()

    def add(self, step) -> None:
        if self.queue is None:
            raise ValueError("no MULTI")
        self.queue.append(step)

    def exec(self, state: DataFrame, versions_now: dict[str, int]) -> DataFrame | None:
        """The new state, or None after a conflict."""
        if self.queue is None:
            raise ValueError("EXEC without MULTI")
        steps, self.queue = self.queue, None
        moved = any(versions_now.get(k, 0) != v for k, v in self.watched.items())
        self.watched.clear()
        if moved:
            return None
        for step in steps:
            state = step(state)
        return state
