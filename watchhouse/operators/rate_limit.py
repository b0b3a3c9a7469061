"""Per-source token bucket over event time.

A bucket holds ``capacity`` tokens, starts full, gains ``rate`` tokens per second and loses one per
accepted event; events that find less than one token are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchhouse.functions import fixed_values as fv
from watchhouse.operators.running import running_before

_SLICE_SECONDS = 3600


def allowed_at(tokens: float, elapsed: float, arrivals: int, rate: float, capacity: float) -> tuple[int, float]:
    """Events accepted out of ``arrivals`` simultaneous ones, and the tokens left."""
    tokens = min(capacity, tokens + elapsed * rate)
    accepted = min(arrivals, int(tokens))
    return accepted, tokens - accepted


def arrivals(lines: DataFrame) -> DataFrame:
    """Number of events per (source_ip, instant).  Simultaneous events share one bucket state."""
    return lines.groupBy("source_ip", "received_at").agg(F.count(F.lit(1)).alias("n"))


def _bursts(counts: DataFrame, rate: float, capacity: float) -> DataFrame:
    """Cut each source's time line where the bucket is certainly full again.

    After ``capacity / rate`` quiet seconds the state no longer depends on the past, so every burst
    can be replayed on its own; ``burst`` is the time it starts.
    """
    sliced = counts.withColumn(
        "slice", F.call_function("div", F.unix_micros("received_at"), F.lit(_SLICE_SECONDS * 1_000_000).cast("bigint"))
    ).repartition("source_ip", "slice")
    seen = running_before(sliced, ["source_ip"], "slice", "received_at", {
        # reading n as well gives both sides of the scan the same columns, hence one shared shuffle
        "previous": ("max", F.when(F.col("n") > 0, F.col("received_at")))})
    quiet = (F.unix_micros("received_at") - F.unix_micros("previous")) / F.lit(1e6)
    starts = F.coalesce(quiet * F.lit(float(rate)) >= F.lit(float(capacity)), F.lit(True))
    marked = seen.withColumn("start", F.when(starts, F.col("received_at")))
    carried = running_before(
        marked, ["source_ip"], "slice", "received_at", {"last_start": ("max", F.col("start"))})
    return carried.withColumn("burst", F.coalesce("start", "last_start"))


def rate_limit_counts(lines: DataFrame, rate: float = fv.RATE_LIMIT_PER_SECOND, capacity: float | None = None) -> DataFrame:
    """Per (source_ip, received_at): events seen ``n`` and ``allowed``.

    The replay within a burst streams over sorted rows with one number as state; it holds no group
    in memory.  Only the counts per instant go through Python.
    """
    capacity = float(rate * 2 if capacity is None else capacity)
    rate = float(rate)

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, last, tokens = None, None, capacity
        for batch in batches:
            allowed = []
            for source, burst, at, n in zip(batch["source_ip"], batch["burst"], batch["at"], batch["n"]):
                if (source, burst) != current:
                    current, last, tokens = (source, burst), at, capacity
                accepted, tokens = allowed_at(tokens, (at - last) / 1e6, n, rate, capacity)
                last = at
                allowed.append(accepted)
            yield pd.DataFrame({"source_ip": batch["source_ip"], "at": batch["at"], "n": batch["n"], "allowed": allowed})

    rows = _bursts(arrivals(lines), rate, capacity).select(
        "source_ip", F.unix_micros("burst").alias("burst"), F.unix_micros("received_at").alias("at"), "n")
    ordered = rows.repartition("source_ip", "burst").sortWithinPartitions("source_ip", "burst", "at")
    replayed = ordered.mapInPandas(replay, "source_ip string, at bigint, n bigint, allowed bigint")
    return replayed.select("source_ip", F.timestamp_micros("at").alias("received_at"), "n", "allowed")


def rate_limit(lines: DataFrame, order: str, rate: float = fv.RATE_LIMIT_PER_SECOND, capacity: float | None = None) -> DataFrame:
    """Lines with ``allowed``; simultaneous lines of a source are served in ``order``."""
    counts = rate_limit_counts(lines, rate, capacity).select("source_ip", "received_at", F.col("allowed").alias("_quota"))
    place = F.row_number().over(Window.partitionBy("source_ip", "received_at").orderBy(order))
    ranked = lines.withColumn("_place", place)
    joined = ranked.join(counts, ["source_ip", "received_at"])
    return joined.withColumn("allowed", F.col("_place") <= F.col("_quota")).drop("_place", "_quota")


def drops_per_minute(counts: DataFrame) -> DataFrame:
    """Dropped events per source and minute, minutes without drops left out."""
    minute = F.date_trunc("minute", "received_at").alias("minute")
    return counts.groupBy("source_ip", minute).agg(F.sum(F.col("n") - F.col("allowed")).alias("dropped")).filter(
        "dropped > 0")
