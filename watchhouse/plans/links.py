"""Links from events to the alerts that they raised."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchhouse.operators import filters
from watchhouse.plans.rule_bodies import Rule
from watchhouse.plans.threshold import threshold_matches
from watchhouse.plans.triggers import shown


def matched_events(events: DataFrame, rules: Sequence[Rule], as_of, blacklists: DataFrame | None = None) -> DataFrame:
    """(event_id, received_at, rule_id, group_key): what threshold, sequence and blacklist rules count, event by event.

    One pass over the events for each of the three types, whatever the number of rules.
    """
    of = {kind: [r for r in rules if r.rule_type == kind] for kind in ("threshold", "sequence", "blacklist")}
    key = lambda rule, group: F.concat(rule, F.lit(":"), group)
    parts = []
    if of["threshold"]:
        rows = threshold_matches(events, of["threshold"], as_of, False, "id", "received_at")
        known = events.sparkSession.createDataFrame([(no, r.id, bool(r.group_by)) for no, r in enumerate(of["threshold"])], "rule_no int, rule_id string, grouped boolean")
        group = F.when(F.col("grouped"), shown(F.col("grp"))).otherwise("global")
        parts.append(rows.join(known, "rule_no").select("id", "received_at", "rule_id", key(F.col("rule_id"), group).alias("group_key")))
    if of["sequence"]:
        hits = []
        for rule in of["sequence"]:
            group, steps = F.col(rule.group_by), [filters.step_filter(s) for s in rule.body["steps"]]
            wanted = filters.in_window(as_of, rule.window_seconds) & reduce(lambda a, b: a | b, steps) & group.isNotNull()
            hits.append(F.when(wanted, F.struct(F.lit(rule.id).alias("rule_id"), key(F.lit(rule.id), shown(group)).alias("group_key"))))
        recent = events.filter(filters.in_window(as_of, max(r.window_seconds for r in of["sequence"])))
        parts.append(recent.select("id", "received_at", F.inline(F.array_compact(F.array(*hits)))))
    if of["blacklist"]:
        hits = []
        for rule in of["blacklist"]:
            field = F.col(rule.body["field"])
            of_rule = F.struct(F.lit(rule.id).alias("rule_id"), F.lit(rule.body["list_name"]).alias("list_name"), field.cast("string").alias("value"),
                               F.concat(F.lit(f"{rule.id}:{rule.body['field']}:"), shown(field)).alias("group_key"))
            hits.append(F.when(field.isNotNull(), of_rule))
        listed = blacklists.select("list_name", "value").distinct()
        rows = events.select("id", "received_at", F.inline(F.array_compact(F.array(*hits))))
        parts.append(rows.join(listed, ["list_name", "value"], "left_semi").select("id", "received_at", "rule_id", "group_key"))
    if not parts:
        return events.select(F.col("id").alias("event_id"), "received_at", F.lit("").alias("rule_id"), F.lit("").alias("group_key")).limit(0)
    return reduce(DataFrame.unionByName, parts).withColumnRenamed("id", "event_id")


def link_events(matched: DataFrame, alerts: DataFrame) -> DataFrame:
    """(event_id, alert_id): every matched event with the alert of its rule and group that spans its time.

    Alerts are listed under the days of their span, so an alert history of many years is an equality join on (group, day); of
    several alerts that span an event the newest counts.
    """
    days = F.sequence(F.to_date("first_seen"), F.to_date("last_seen"))
    spans = alerts.where("first_seen <= last_seen AND group_key IS NOT NULL").select(
        F.col("id").alias("alert_id"), "group_key", "first_seen", "last_seen", "created_at", F.explode(days).alias("day"))
    joined = matched.withColumn("day", F.to_date("received_at")).join(spans, ["group_key", "day"]).where("received_at BETWEEN first_seen AND last_seen")
    newest = F.max(F.struct("created_at", "alert_id"))["alert_id"]
    return joined.groupBy("event_id", "group_key").agg(newest.alias("alert_id")).select("event_id", "alert_id").distinct()


def with_alert_ids(events: DataFrame, links: DataFrame) -> DataFrame:
    """Events with ``alert_id`` set from the links (the smallest of several); events without one keep theirs."""
    one = links.groupBy(F.col("event_id").alias("id")).agg(F.min("alert_id").alias("_alert"))
    return events.join(one, "id", "left").withColumn("alert_id", F.coalesce("_alert", "alert_id")).select(*events.columns)
