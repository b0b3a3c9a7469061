"""Streaming per-source token bucket: one small state per source."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from watchhouse.functions import fixed_values as fv
from watchhouse.operators.rate_limit import allowed_at


class _Bucket(StatefulProcessor):
    def __init__(self, rate: float, capacity: float, idle_seconds: float):
        self.rate, self.capacity, self.idle_ms = rate, capacity, int(idle_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("bucket", "at bigint, tokens double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        counts = pd.concat(list(rows)).groupby("at", sort=True)["n"].sum()
        saved = self.state.get()
        last, tokens = (saved[0], saved[1]) if saved else (None, self.capacity)
        allowed = []
        for at, n in counts.items():
            elapsed = 0.0 if last is None else max(0, at - last) / 1e6
            accepted, tokens = allowed_at(tokens, elapsed, int(n), self.rate, self.capacity)
            last = at if last is None else max(at, last)
            allowed.append(accepted)
        self.state.update((int(last), float(tokens)))
        self.handle.registerTimer(last // 1000 + self.idle_ms)
        yield pd.DataFrame({"source_ip": key[0], "at": counts.index, "n": counts.to_numpy(), "allowed": allowed})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        saved = self.state.get()
        if saved and saved[0] // 1000 + self.idle_ms <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def rate_limit_stream(lines: DataFrame, rate: float = fv.RATE_LIMIT_PER_SECOND, capacity: float | None = None,
                      idle_seconds: float = fv.RATE_LIMIT_IDLE_SECONDS, delay: str = "10 minutes") -> DataFrame:
    """Per (source_ip, received_at) of the stream: events seen ``n`` and ``allowed``.

    The bucket of a source that stays silent for ``idle_seconds`` of event time is removed and starts
    full again, so senders seen once do not pile up.  Lines more than ``delay`` late are dropped.
    Needs the RocksDB state store.
    """
    capacity = float(rate * 2 if capacity is None else capacity)
    rows = lines.withWatermark("received_at", delay).select(
        "source_ip", "received_at", F.unix_micros("received_at").alias("at"), F.lit(1).cast("bigint").alias("n"))
    counted = rows.groupBy("source_ip").transformWithStateInPandas(
        _Bucket(float(rate), capacity, idle_seconds), "source_ip string, at bigint, n bigint, allowed bigint",
        "append", "eventTime",
    )
    return counted.select("source_ip", F.timestamp_micros("at").alias("received_at"), "n", "allowed")
