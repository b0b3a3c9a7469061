"""Blacklist rules: events whose field value is on a named list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchhouse.functions import fixed_values as fv
from watchhouse.operators import filters
from watchhouse.plans.rule_bodies import Rule
from watchhouse.plans.triggers import as_triggers, shown


def listed_events(events: DataFrame, blacklists: DataFrame, field: str, list_name: str) -> DataFrame:
    """Events whose ``field`` is on the list; a semi join, so duplicates on the list do no harm.

    No hint: a small list is broadcast by the optimizer, a large one is shuffled.
    """
    values = blacklists.filter(F.col("list_name") == list_name).select(F.col("value").alias(field))
    return events.filter(F.col(field).isNotNull()).join(values, field, "left_semi")


def blacklist_triggers(events: DataFrame, blacklists: DataFrame, rules: Sequence[Rule], as_of,
                       window_seconds: int = fv.BLACKLIST_WINDOW_SECONDS) -> DataFrame:
    """Triggers of all given rules from one scan: one per rule and matched value over the look-back."""
    asked = [F.struct(F.lit(no).alias("rule_no"), F.lit(r.body["list_name"]).alias("list_name"),
                      F.col(r.body["field"]).cast("string").alias("value")) for no, r in enumerate(rules)]
    recent = events.filter(filters.in_window(as_of, window_seconds)).select("received_at", F.inline(F.array(*asked)))
    listed = recent.filter("value IS NOT NULL").join(
        blacklists.select("list_name", "value"), ["list_name", "value"], "left_semi")
    counted = listed.groupBy("rule_no", "value").agg(
        F.count(F.lit(1)).alias("event_count"), F.min("received_at").alias("first_seen"),
        F.max("received_at").alias("last_seen"),
    )
    params = events.sparkSession.createDataFrame(
        [(no, r.id, r.name, r.severity, r.body["field"], r.body["list_name"]) for no, r in enumerate(rules)],
        "rule_no int, rule_id string, name string, severity string, field string, list_name string")
    df, value, field = counted.join(params, "rule_no"), shown(F.col("value")), F.col("field")
    return as_triggers(
        df, rule_id=F.col("rule_id"), severity=F.col("severity"), name=F.col("name"), group_column=field, group=value,
        key=F.concat_ws(":", "rule_id", field, value),
        description=F.concat(field, F.lit(" value '"), value, F.lit("' matched blacklist '"), F.col("list_name"), F.lit("'")),
    )


def blacklist_rule(events: DataFrame, blacklists: DataFrame, rule: Rule, as_of,
                   window_seconds: int = fv.BLACKLIST_WINDOW_SECONDS) -> DataFrame:
    return blacklist_triggers(events, blacklists, [rule], as_of, window_seconds)
