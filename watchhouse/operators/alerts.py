"""Alert table maintenance: merging triggers, applying patches, alert detail joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchhouse.functions import columns as c
from watchhouse.schema import ALERT_STATUSES, ALERTS

LINKED_EVENTS = 100


def newest_open(alerts: DataFrame, *keys: str) -> DataFrame:
    """Per key, the id of the newest open alert.  An aggregate, so hot keys shrink before the shuffle."""
    return alerts.filter("status = 'open'").groupBy(*keys).agg(
        F.max(F.struct("created_at", "id"))["id"].alias("open_id")
    )


def combine_triggers(triggers: DataFrame) -> DataFrame:
    """All triggers of one (rule, group) as one: counts add up, the latest description stays."""
    latest = F.max(F.struct("last_seen", "description", "title", "severity", "src_ip", "source_host"))
    grouped = triggers.groupBy("rule_id", "group_key").agg(
        F.sum("event_count").alias("event_count"), F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"), latest.alias("latest"),
        F.max(F.struct(F.col("last_seen").alias("seen"), F.to_json("extra").alias("json")))["json"].alias("extra_json"),
    )
    return grouped.select(
        "rule_id", "group_key", "event_count", "first_seen", "last_seen",
        *[F.col(f"latest.{n}").alias(n) for n in ("description", "title", "severity", "src_ip", "source_host")],
        F.coalesce(F.from_json("extra_json", "map<string,string>"), c.empty_map()).alias("extra"),
    )


def match_open(triggers: DataFrame, alerts: DataFrame) -> DataFrame:
    """Combined triggers with ``open_id``, the alert they update, or NULL for a new alert.

    A trigger without a group key matches the newest open alert of its rule, whatever its key.  So
    every open alert is listed under its key and under its rule as a whole, and one join serves both.
    """
    def place(of_group: Column, key: Column) -> Column:
        return F.struct(of_group.alias("of_group"), F.coalesce(key, F.lit("")).alias("key"))

    listed = F.array(place(F.lit(False), F.lit("")), F.when(F.col("group_key").isNotNull(), place(F.lit(True), F.col("group_key"))))
    places = alerts.select("rule_id", "status", "created_at", "id", F.explode(F.array_compact(listed)).alias("place"))
    wanted = triggers.withColumn("place", place(F.col("group_key").isNotNull(), F.col("group_key")))
    return wanted.join(newest_open(places, "rule_id", "place"), ["rule_id", "place"], "left").drop("place")


def merge_triggers(alerts: DataFrame, triggers: DataFrame, as_of, mode: str = "accumulate") -> DataFrame:
    """The alert table after the triggers: open alerts updated, new ones added, the rest unchanged.

    Closed and acknowledged alerts never match.  ``mode="accumulate"`` adds the trigger counts,
    ``mode="replace"`` overwrites them (for windows that are evaluated repeatedly).  Only open alerts
    are shuffled; the history passes by.
    """
    now = c.as_timestamp(as_of)
    new_id = F.sha2(F.concat_ws("|", "rule_id", F.coalesce("group_key", F.lit("")), now.cast("string")), 256)
    matched = match_open(combine_triggers(triggers), alerts).withColumn("id", F.coalesce("open_id", new_id))
    # one row per alert: a keyless and a keyed trigger may meet in the same one
    latest = F.max(F.struct("last_seen", "description", "title", "severity", "src_ip", "source_host", "rule_id",
                            "group_key", F.to_json("extra").alias("extra")))
    incoming = matched.groupBy("id").agg(
        F.sum("event_count").alias("_n"), F.min("first_seen").alias("_first"), latest.alias("_new"))

    history = alerts.filter(~F.col("status").eqNullSafe("open"))
    joined = alerts.filter("status = 'open'").withColumn("_old", F.lit(True)).join(incoming, "id", "full")
    old, hit = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    before = F.when(old, F.col("event_count")).otherwise(F.lit(0)) if mode == "accumulate" else F.lit(0)
    new_extra = F.from_json(F.col("_new.extra"), "map<string,string>")
    values = {name: F.when(old, F.col(name)).otherwise(F.col(f"_new.{name}"))
              for name in ("rule_id", "severity", "title", "src_ip", "source_host", "group_key")}
    values |= {
        "status": F.when(old, F.col("status")).otherwise("open"),
        "first_seen": F.when(old, F.col("first_seen")).otherwise(F.col("_first")),
        "last_seen": F.when(hit, F.col("_new.last_seen")).otherwise(F.col("last_seen")),
        "description": F.when(hit, F.col("_new.description")).otherwise(F.col("description")),
        "event_count": F.when(hit, before + F.col("_n")).otherwise(F.col("event_count")),
        "extra": F.when(old & (~hit | (F.size(new_extra) == 0)), F.col("extra")).otherwise(new_extra),
        "created_at": F.when(old, F.col("created_at")).otherwise(now),
        "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
    }
    return _shape(joined, values).unionByName(_shape(history, {}))


def latest_alerts(changes: DataFrame) -> DataFrame:
    """The alert table that appended changes (ALERTS columns and ``version``) amount to: the newest version of every alert."""
    names = [f.name for f in ALERTS.fields if f.name != "id"]
    return changes.groupBy("id").agg(F.max_by(F.struct(*names), "version").alias("_a")).select("id", *[f"_a.{n}" for n in names])


def _shape(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    return df.select(*[values.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in ALERTS.fields])


def patch_alerts(alerts: DataFrame, patches: DataFrame, as_of) -> DataFrame:
    """Apply ``patches(alert_id, seq, status, assigned_to)`` in ``seq`` order; NULL leaves a field as is.

    Patches with an unknown status are rejected as a whole (see ``rejected_patches``).
    """
    good = patches.filter(_patch_ok())
    latest = good.groupBy(F.col("alert_id").alias("id")).agg(
        F.max_by("status", F.when(F.col("status").isNotNull(), F.col("seq"))).alias("_status"),
        F.max_by("assigned_to", F.when(F.col("assigned_to").isNotNull(), F.col("seq"))).alias("_assigned"),
        F.lit(True).alias("_hit"),
    )
    joined = alerts.join(latest, "id", "left")
    return _shape(joined, {
        "status": F.coalesce("_status", "status"),
        "assigned_to": F.coalesce("_assigned", "assigned_to"),
        "updated_at": F.when(F.col("_hit"), c.as_timestamp(as_of)).otherwise(F.col("updated_at")),
    })


def _patch_ok() -> Column:
    return F.col("status").isNull() | F.col("status").isin(*ALERT_STATUSES)


def rejected_patches(patches: DataFrame) -> DataFrame:
    return patches.filter(~_patch_ok())


def with_rule_names(alerts: DataFrame, rules: DataFrame) -> DataFrame:
    """Alerts with ``rule_name``; NULL when the rule is gone."""
    names = rules.select(F.col("id").alias("rule_id"), F.col("name").alias("rule_name"))
    return alerts.join(names, "rule_id", "left")


def linked_events(alerts: DataFrame, events: DataFrame, limit: int = LINKED_EVENTS) -> DataFrame:
    """The newest ``limit`` linked events of every alert.

    ``row_number() <= limit`` lets Spark drop all but the newest rows per alert before the shuffle,
    so an alert with very many events stays cheap.
    """
    newest = Window.partitionBy("alert_id").orderBy(F.col("received_at").desc(), F.col("id").desc())
    ranked = events.filter("alert_id IS NOT NULL").withColumn("rank", F.row_number().over(newest))
    keys = alerts.select(F.col("id").alias("alert_id"))
    return ranked.filter(F.col("rank") <= limit).join(keys, "alert_id", "left_semi")
