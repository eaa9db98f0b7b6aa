"""The most recent queries of a log as state of a stream.

Entries are dealt to a fixed number of shards by a hash, each of which keeps its newest ``n``: the newest
``n`` of all are among those. So state is bounded by ``shards * n`` entries however many queries and users
there are, and no user is a hot key. Entries can expire, and a shard that stays silent says so once.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillfin.plans import present

SHARDS = 32
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Ring(StatefulProcessor):
    """Newest entries by ``(order, tie)``; ``entries`` is the list state, newest first."""

    def __init__(self, names: list[str], schema: T.StructType, order: str, tie: str, n: int, keep: timedelta | None, idle: timedelta | None):
        self.names, self.schema, self.n, self.keep, self.idle = names, schema, n, keep, idle
        self.by = (names.index(order), names.index(tie))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        keep = int(self.keep.total_seconds() * 1000) if self.keep else None
        self.entries = handle.getListState("entries", self.schema, keep)

    def _out(self, key: tuple, rows: list[tuple], idle: bool) -> pd.DataFrame:
        # A shard that has become silent says so in a row without an entry.
        rows = rows or [(None,) * len(self.names)]
        return pd.DataFrame([(key[0], idle, *r) for r in rows], columns=["shard", "idle", *self.names]).astype(object)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = list(self.entries.get()) if self.entries.exists() else []
        newest = lambda r: tuple(r[i] for i in self.by)
        for frame in rows:
            some = [tuple(r) for r in frame[self.names].astype(object).itertuples(index=False, name=None)]
            held = sorted([*held, *some], key=newest, reverse=True)[: self.n]
        self.entries.put(held)
        if self.idle:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.idle.total_seconds() * 1000))
        yield self._out(key, held, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._out(key, [], True)

    def close(self) -> None:
        pass


def recent_ring(
    log: DataFrame, order: str, tie: str, n: int = 20, keep: timedelta | None = None, idle: timedelta | None = None, shards: int = SHARDS
) -> DataFrame:
    """``shard, idle`` and the columns of ``log``: each shard's newest entries, all of them whenever one is new.

    ``order`` and ``tie`` must not be null and ``tie`` tells entries apart. An entry expires ``keep`` after it was
    kept last; a shard without entries for ``idle`` gives one row that is ``idle`` and has no entry. Needs the
    RocksDB state store (``PROVIDER``), run in update mode. With ``keep`` or ``idle`` the query looks at the clock
    and never runs out of batches, so an ``availableNow`` trigger would not end.
    """
    out = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("idle", T.BooleanType()), *[T.StructField(f.name, f.dataType) for f in log.schema]])
    sharded = log.withColumn("_shard", F.pmod(F.xxhash64(tie), F.lit(shards)).cast("int"))
    ring = _Ring(log.columns, log.schema, order, tie, n, keep, idle)
    clock = "ProcessingTime" if keep or idle else "None"
    return sharded.groupBy("_shard").transformWithStateInPandas(ring, out, "Update", clock)


def held(spark, checkpoint: str, order: str, tie: str, n: int = 20) -> DataFrame:
    """The newest ``n`` entries of all shards, from the state that a query with this checkpoint has kept."""
    state = spark.read.format("statestore").option("stateVarName", "entries").load(checkpoint)
    return present.recent(state.select("list_element.*"), order, tie, n)
