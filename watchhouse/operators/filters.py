"""Row predicates as Columns, and the filters built from them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchhouse.functions import columns as c

REAL_TIME_RULES = ("threshold", "blacklist", "sequence")
AGGREGATE_RULES = ("absence", "anomaly")


def all_of(predicates: Iterable[Column]) -> Column:
    result = F.lit(True)
    for p in predicates:
        result = result & p
    return result


def in_window(as_of, seconds: int) -> Column:
    """Received within the last ``seconds`` before ``as_of``; no upper bound."""
    return F.col("received_at") >= c.seconds_before(as_of, seconds)


def event_filter(spec: Mapping) -> Column:
    """A rule's event filter: all given fields must hold.  Unknown keys are ignored."""
    parts = []
    if spec.get("event_id"):
        parts.append(F.col("event_id").isin([str(v) for v in spec["event_id"]]))
    for name in ("category", "source_type", "action"):
        if spec.get(name):
            parts.append(F.col(name) == str(spec[name]))
    for tag in spec.get("tags") or []:
        parts.append(F.array_contains("tags", tag))
    for name in ("user_name", "log_level"):
        if spec.get(name):
            parts.append(F.col(name) == str(spec[name]))
    return all_of(parts)


def step_filter(step: Mapping) -> Column:
    names = ("event_id", "action", "category", "log_level")
    return all_of(F.col(n) == str(step[n]) for n in names if step.get(n))


def outside_hours(moment: Column, start, end) -> Column:
    """UTC hour of ``moment`` lies outside [start, end); the range may wrap midnight."""
    start = start if isinstance(start, Column) else F.lit(start)
    end = end if isinstance(end, Column) else F.lit(end)
    hour = F.hour(moment)
    plain = (hour >= start) & (hour < end)
    wrapped = (hour >= start) | (hour < end)
    return ~F.when(start < end, plain).otherwise(wrapped)


def search_events(
    events: DataFrame, *, time_from=None, time_to=None, source=None, source_type=None, category=None,
    src_ip=None, dst_ip=None, user=None, log_level=None, q=None,
) -> DataFrame:
    """Event search: inclusive time range, partial host/user/message, exact others.

    ``%`` and ``_`` in the partial terms act as wildcards.
    """
    parts = []
    if time_from:
        parts.append(F.col("received_at") >= c.as_timestamp(time_from))
    if time_to:
        parts.append(F.col("received_at") <= c.as_timestamp(time_to))
    for name, term in (("source_host", source), ("user_name", user), ("message", q)):
        if term:
            parts.append(F.col(name).ilike(f"%{term}%"))
    exact = {"source_type": source_type, "category": category, "src_ip": src_ip, "dst_ip": dst_ip,
             "log_level": log_level}
    parts += [F.col(name) == value for name, value in exact.items() if value]
    return events.filter(all_of(parts))


def filter_alerts(alerts: DataFrame, *, severity=None, status=None, rule_id=None, time_from=None,
                  time_to=None) -> DataFrame:
    exact = {"severity": severity, "status": status, "rule_id": rule_id}
    parts = [F.col(name) == value for name, value in exact.items() if value]
    if time_from:
        parts.append(F.col("first_seen") >= c.as_timestamp(time_from))
    if time_to:
        parts.append(F.col("first_seen") <= c.as_timestamp(time_to))
    return alerts.filter(all_of(parts))


def filter_rules(rules: DataFrame, *, rule_type=None, enabled=None) -> DataFrame:
    parts = []
    if rule_type:
        parts.append(F.col("rule_type") == rule_type)
    if enabled is not None:
        parts.append(F.col("enabled") == enabled)
    return rules.filter(all_of(parts))


def filter_sources(sources: DataFrame, *, enabled=None, source_type=None) -> DataFrame:
    parts = []
    if enabled is not None:
        parts.append(F.col("enabled") == enabled)
    if source_type:
        parts.append(F.col("source_type") == source_type)
    return sources.filter(all_of(parts))


def rules_due(rules: DataFrame, rule_types: Iterable[str]) -> DataFrame:
    """Enabled rules of one cadence group."""
    return rules.filter(F.col("enabled") & F.col("rule_type").isin(list(rule_types)))


def by_id(table: DataFrame, key: str, column: str = "id") -> DataFrame:
    return table.filter(F.col(column) == key)
