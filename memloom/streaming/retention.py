"""Retention as a stream: each memory has a timer, which every new observation sets anew."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from memloom.operators.retention import expires_at, tier

EXPIRED = "agent_id string, id string, tier string, expires_at timestamp"
_STATE = "seen_ms long, importance double, tier string, end_ms long"
#: Timers need the state store that keeps them.
STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


class _Timer(StatefulProcessor):
    """State of one memory: its last observation and when it ends."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = tuple(self.held.get()) if self.held.exists() else None
        before = best[3] if best else None
        for frame in rows:
            for row in frame[["seen_ms", "importance", "tier", "end_ms"]].itertuples(index=False):
                new = (int(row[0]), None if pd.isna(row[1]) else float(row[1]), row[2] if isinstance(row[2], str) else None,
                       None if pd.isna(row[3]) else int(row[3]))
                if best is None or _order(new) > _order(best):
                    best = new
        self.held.update(best)
        if before is not None and before != best[3]:
            self.handle.deleteTimer(before)
        if best[3] is not None and before != best[3]:
            self.handle.registerTimer(best[3])
        yield pd.DataFrame({"agent_id": [], "id": [], "tier": [], "expires_at": pd.to_datetime([])}).astype(
            {"agent_id": str, "id": str, "tier": str})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.held.exists():
            return
        _, _, name, end = tuple(self.held.get())
        if end is None or end > expiredTimerInfo.getExpiryTimeInMs():
            return  # observed again since
        self.held.clear()
        yield pd.DataFrame({"agent_id": [key[0]], "id": [key[1]], "tier": [name], "expires_at": [pd.Timestamp(end, unit="ms")]})

    def close(self) -> None:
        pass


def _order(state: tuple) -> tuple:
    """The later observation counts, of equal ones the more important; as in the batch form."""
    return state[0], state[1] is not None, state[1] or 0.0


def stream_expired(observations: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """A row for each memory of a stream of ``observations`` when it expires, by event time.

    The stream has ``agent_id``, ``id``, ``importance`` and ``seen``; the watermark on ``seen``
    drives the timers, and ``delay`` is how late an observation may come.  A memory that is
    observed before it expires goes on; one that expired starts anew when it is seen again.
    State is one small row for each memory that is kept, split by key.  The session needs
    the settings of ``STORE``.
    """
    millis = lambda c: F.unix_millis(c)
    seen, importance = F.col("seen"), F.col("importance")
    rows = observations.where("seen IS NOT NULL").withWatermark("seen", delay).select(
        "agent_id", "id", "seen", importance.cast("double").alias("importance"), millis(seen).alias("seen_ms"),
        tier(importance).alias("tier"), millis(expires_at(importance, seen)).alias("end_ms"))
    return rows.groupBy("agent_id", "id").transformWithStateInPandas(
        statefulProcessor=_Timer(), outputStructType=EXPIRED, outputMode="Append", timeMode="EventTime")
