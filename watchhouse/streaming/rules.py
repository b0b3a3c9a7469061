"""Streaming rule evaluation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import islice
from operator import add, or_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from watchhouse.functions import columns as c
from watchhouse.operators import filters
from watchhouse.plans.anomaly import anomaly_from_hourly, hourly_counts
from watchhouse.plans.rule_bodies import Rule
from watchhouse.plans.threshold import absence_ticks
from watchhouse.plans.triggers import as_triggers, shown
from watchhouse.streaming.ingest import trigger

REAL_TIME_SECONDS = 30
SEQUENCE_SHARDS = 1024


def blacklist_stream(events: DataFrame, blacklists: DataFrame, rule: Rule) -> DataFrame:
    """One trigger per matching event of the stream; the list is a static table."""
    field, list_name = rule.body["field"], rule.body["list_name"]
    values = blacklists.filter(F.col("list_name") == list_name).select(F.col("value").alias(field)).distinct()
    rows = events.filter(F.col(field).isNotNull()).join(values, field, "left_semi")
    value = shown(F.col(field))
    seen = rows.withColumns({"first_seen": F.col("received_at"), "last_seen": F.col("received_at"),
                             "event_count": F.lit(1)})
    return as_triggers(
        seen, rule_id=rule.id, severity=rule.severity, name=rule.name, group_column=field, group=value,
        key=F.concat(F.lit(f"{rule.id}:{field}:"), value),
        description=F.concat(F.lit(f"{field} value '"), value, F.lit(f"' matched blacklist '{list_name}'")),
    )


# --- sequence --------------------------------------------------------------------------------------


class _SequenceState(StatefulProcessor):
    """Per rule and shard of its groups: instants that wait for the watermark, and per group and step the latest start of a chain that has reached it.

    Rows wait until the watermark has passed the end of their bucket of event time and are then walked in time order, group by
    group, so the order of arrival does not matter.  Steps are strictly ordered in time: an instant extends only chains of earlier
    instants.  A shard holds many groups, as a call costs some milliseconds, many times what the rows of a group do; rows without a
    column ``grp`` are of the one group that the key names.  A shard has a timer for the first bucket that waits: whatever is due by
    then is walked in one go, so calls grow with shards and micro-batches, not with groups or instants.  Chains are dropped a window
    after their latest start.  The number of steps, the window and the bucket come with the rows, so one operator serves rules of
    all kinds; a rule that has got other steps starts anew.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("rule", "steps int, window bigint, bucket bigint, sweep bigint")
        self.waiting = handle.getListState("waiting", "grp array<string>, size array<int>, at array<bigint>, steps array<bigint>")
        self.chains = handle.getListState("chains", "grp array<string>, reached array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        parts = []
        rule = None
        for part in rows:
            if len(part):
                rule = tuple(int(part[name].iloc[-1]) for name in ("n_steps", "window", "bucket"))
                fresh = part[_bucket_end(part["at"], rule[2]) > watermark]
                if len(fresh):
                    names = fresh["grp"].to_numpy(object) if "grp" in fresh else np.full(len(fresh), key[1], object)
                    parts.append((names, fresh["at"].to_numpy(), fresh["steps"].to_numpy()))
        if rule is None:
            return iter([])
        saved = self.state.get()
        if saved is None or tuple(saved[:3]) != rule:
            if saved and saved[0] != rule[0]:
                self.chains.clear()
            self.state.update((*rule, saved[3] if saved else None))
        if parts:
            names, at, steps = map(np.concatenate, zip(*parts))
            for value in _parts(*_by_group(names, at, steps)):
                self.waiting.appendValue(value)
            self.handle.registerTimer(_bucket_end(int(at.min()), rule[2]))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        saved = self.state.get()
        if saved is None:
            return
        watermark = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        count, window, bucket, sweep = saved
        names, at, steps = _instants(self.waiting.get())
        due = _bucket_end(at, bucket) <= watermark
        later = ~due
        chains = {grp: reached[k * count:(k + 1) * count] for groups, reached in self.chains.get() for k, grp in enumerate(groups)}
        before = len(chains)
        found = []
        if due.any():
            groups, sizes, instants, masks = _by_group(names[due], at[due], steps[due])
            marks = zip(instants.tolist(), masks.tolist())
            for grp, size in zip(groups, sizes.tolist()):
                reached = chains.setdefault(grp, [None] * count)
                for moment, mask in islice(marks, size):
                    starts = [moment, *reached[:-1]]
                    for k, start in enumerate(starts):
                        if mask >> k & 1 and start is not None and (k == 0 or start < moment) and moment - start <= window:
                            reached[k] = start if reached[k] is None else max(reached[k], start)
                            if k == count - 1:
                                found.append((key[0], grp, start, moment))
            if later.any():
                self.waiting.put(_parts(*_by_group(names[later], at[later], steps[later])))
            else:
                self.waiting.clear()
        # rows to come lie a bucket before the watermark at most: no chain whose latest start lies a window before that goes on
        chains = {grp: reached for grp, reached in chains.items() if reached[0] is not None and reached[0] + window >= (watermark - bucket) * 1000}
        if due.any() or len(chains) < before:
            if chains:
                self.chains.put(_chain_parts(chains))
            else:
                self.chains.clear()
        if later.any():
            self.handle.registerTimer(_bucket_end(int(at[later].min()), bucket))
        elif not chains:
            self.state.clear()
        elif sweep is None or sweep <= watermark:
            sweep = (max(reached[0] for reached in chains.values()) + window) // 1000 + bucket + 1
            self.handle.registerTimer(sweep)
            self.state.update((count, window, bucket, sweep))
        if found:
            yield pd.DataFrame(found, columns=["rule_id", "grp", "first", "last"])

    def close(self) -> None:
        pass


def _bucket_end(at, bucket: int):
    """End of the bucket of event time, in milliseconds, that an instant (microseconds) lies in."""
    return (at // 1000 // bucket + 1) * bucket


def _by_group(names: np.ndarray, at: np.ndarray, steps: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Rows in the order of group and time, one an instant: the groups, the number of their instants, the instants and their steps."""
    codes, groups = pd.factorize(names)
    order = np.lexsort((at, codes))
    codes, at, steps = codes[order], at[order], steps[order]
    begin = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (at[1:] != at[:-1])]))
    return groups.tolist(), np.bincount(codes[begin]), at[begin], np.bitwise_or.reduceat(steps, begin)


def _parts(groups: list[str], sizes: np.ndarray, at: np.ndarray, steps: np.ndarray, most: int = 65_536) -> list[tuple]:
    """What ``_by_group`` returns as values of a list state; a group may go on in the next one."""
    ends = np.cumsum(sizes)
    cut = []
    for low in range(0, len(at), most):
        high = min(low + most, len(at))
        first, last = np.searchsorted(ends, [low, high - 1], side="right")
        those = slice(first, last + 1)
        inside = np.minimum(ends[those], high) - np.maximum(ends[those] - sizes[those], low)
        cut.append((groups[those], inside.tolist(), at[low:high].tolist(), steps[low:high].tolist()))
    return cut


def _instants(values) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, instant and steps of everything in a list state of ``_parts``."""
    names, at, steps = [np.empty(0, object)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for groups, sizes, instants, masks in values:
        names.append(np.repeat(np.array(groups, object), sizes))
        at.append(np.array(instants, np.int64))
        steps.append(np.array(masks, np.int64))
    return np.concatenate(names), np.concatenate(at), np.concatenate(steps)


def _chain_parts(chains: dict[str, list], most: int = 65_536) -> list[tuple[list[str], list]]:
    """Groups and, one after the other, what each has reached, as values of a list state."""
    items = list(chains.items())
    cut = [items[low:low + most] for low in range(0, len(items), most)]
    return [([grp for grp, _ in part], [start for _, reached in part for start in reached]) for part in cut]


def sequence_streams(events: DataFrame, rules: Sequence[Rule], delay: str = "1 minute", shards: int = SEQUENCE_SHARDS) -> DataFrame:
    """One trigger per completed chain end of every rule, with the latest start that leads to it: one stream for all rules.

    An event is expanded to the rules it matches a step of; state is keyed by rule and shard of its groups.  ``shards`` should be well
    above the number of partitions and stay the same as long as a checkpoint is used.  Rules are read when the query starts: one
    started again from its checkpoint with other rules keeps the state of those it knows, begins new ones and reports no more of
    those that are gone.  A completion is reported when the watermark has passed its bucket (the
    rule cadence); rows more than ``delay`` late are dropped.  Needs the RocksDB state store.
    """
    hits = []
    for rule in rules:
        steps = [filters.step_filter(s) for s in rule.body["steps"]]
        bucket = max(1, min(REAL_TIME_SECONDS, rule.window_seconds))
        hit = F.struct(
            F.lit(rule.id).alias("rule_id"), F.col(rule.group_by).cast("string").alias("grp"),
            reduce(add, [F.when(s, F.lit(1 << k).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for k, s in enumerate(steps)]).alias("steps"),
            F.lit(len(steps)).alias("n_steps"), F.lit(rule.window_seconds * 1_000_000).cast("bigint").alias("window"),
            F.lit(bucket * 1000).cast("bigint").alias("bucket"))
        hits.append(F.when(reduce(or_, steps) & F.col(rule.group_by).isNotNull(), hit))
    # only rows that match a step reach the state, and move the watermark on; one without a time has no place in a sequence
    rows = events.filter(F.coalesce(*hits).isNotNull() & F.col("received_at").isNotNull()).withWatermark("received_at", delay).select(
        "received_at", F.unix_micros("received_at").alias("at"), F.inline(F.array_compact(F.array(*hits))))
    found = rows.withColumn("shard", F.pmod(F.xxhash64("grp"), F.lit(shards)).cast("int")).groupBy("rule_id", "shard").transformWithStateInPandas(
        _SequenceState(), "rule_id string, grp string, first bigint, last bigint", "append", "eventTime")
    params = events.sparkSession.createDataFrame(
        [(r.id, r.name, r.severity, r.group_by, r.window_seconds, len(r.body["steps"])) for r in rules],
        "rule_id string, name string, severity string, group_column string, window_seconds bigint, event_count int")
    # named as the small side: in a batch without new rows the optimizer takes the triggers of all waiting rows for an empty table
    seen = found.join(F.broadcast(params), "rule_id").withColumns({"first_seen": F.timestamp_micros("first"), "last_seen": F.timestamp_micros("last")})
    text = lambda name: F.col(name).cast("string")
    return as_triggers(
        seen, rule_id=F.col("rule_id"), severity=F.col("severity"), name=F.col("name"), group_column=F.col("group_column"), group=shown(F.col("grp")),
        description=F.concat(text("event_count"), F.lit("-step sequence completed within "), text("window_seconds"), F.lit("s")))


def sequence_stream(events: DataFrame, rule: Rule, delay: str = "1 minute") -> DataFrame:
    """``sequence_streams`` of one rule."""
    return sequence_streams(events, [rule], delay)


# --- ticks on stored events -------------------------------------------------------------------------


def start_hourly_rollup(events: DataFrame, rule: Rule, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Keep hourly counts of an anomaly rule up to date, so a tick reads hours instead of events.

    Each batch writes its partial counts to its own partition; readers add them up.
    """
    group = F.col(rule.group_by).cast("string") if rule.group_by else F.lit(None).cast("string")

    def keep(batch: DataFrame, batch_id: int) -> None:
        wanted = filters.event_filter(rule.filters)
        if rule.group_by:
            wanted = wanted & group.isNotNull()
        counts = batch.filter(wanted).groupBy(
            group.alias("grp"), F.date_trunc("hour", "received_at").alias("bucket")
        ).agg(F.count(F.lit(1)).alias("n"))
        counts.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)

    return trigger(events.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint), interval).start()


def anomaly_tick(events: DataFrame, hourly: DataFrame, rule: Rule, as_of) -> DataFrame:
    """Anomaly triggers from the hourly table, plus raw events only where an hour is cut.

    Whole hours of the baseline come from ``hourly(grp, bucket, n)``; the first, partial hour of the
    baseline and the current window are counted from the events.
    """
    baseline = int(rule.body.get("baseline_days", 7)) * 86_400
    start = c.seconds_before(as_of, baseline)
    first_whole = F.date_trunc("hour", start + F.expr("INTERVAL '1' HOUR") - F.expr("INTERVAL '0.000001' SECOND"))
    whole = hourly.filter(F.col("bucket") >= first_whole).select(
        "grp", "bucket", F.col("n").alias("in_baseline"), F.lit(0).cast("bigint").alias("in_window"))
    cut = events.filter((F.col("received_at") >= start) & (F.col("received_at") < first_whole))
    partial = hourly_counts(cut, rule, as_of).select("grp", "bucket", "in_baseline", F.lit(0).cast("bigint").alias("in_window"))
    current = hourly_counts(events.filter(filters.in_window(as_of, rule.window_seconds)), rule, as_of).select(
        "grp", "bucket", F.lit(0).cast("bigint").alias("in_baseline"), "in_window")
    merged = whole.unionByName(partial).unionByName(current).groupBy("grp", "bucket").agg(
        F.sum("in_baseline").alias("in_baseline"), F.sum("in_window").alias("in_window"))
    return anomaly_from_hourly(merged, rule, as_of)


def start_absence(ticks: DataFrame, read_events, rules: list[Rule], path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Evaluate absence rules at every tick of ``ticks(as_of)`` against the stored events.

    Silence produces no rows, so a tick stream (not the event stream) drives the query.  ``read_events()`` returns the stored
    events; ``interval`` is a processing-time trigger, by default all ticks there are.
    """
    def check(batch: DataFrame, batch_id: int) -> None:
        absence_ticks(read_events(), rules, batch).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)

    return trigger(ticks.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint), interval).start()
