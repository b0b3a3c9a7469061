"""Dashboard figures over a look-back window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchhouse.operators import filters

_BUCKETS = {"1m": "1 minute", "5m": "5 minutes", "1h": "1 hour"}
TOP_HOSTS, TOP_RULES = 10, 5
_SALTS = 64


def _recent(events: DataFrame, as_of, hours: int) -> DataFrame:
    if hours < 1:
        raise ValueError("hours must be at least 1")
    return events.filter(filters.in_window(as_of, hours * 3600))


def _counts(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def total_events(events: DataFrame, as_of, hours: int = 24) -> DataFrame:
    return _recent(events, as_of, hours).agg(F.count(F.lit(1)).alias("total_events"))


def open_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.filter("status = 'open'").agg(F.count(F.lit(1)).alias("open_alerts"))


def by_level(events: DataFrame, as_of, hours: int = 24) -> DataFrame:
    rows = _recent(events, as_of, hours).filter("log_level IS NOT NULL")
    return _counts(rows, "log_level", "n").orderBy(F.desc("n"), "log_level")


def by_category(events: DataFrame, as_of, hours: int = 24) -> DataFrame:
    rows = _recent(events, as_of, hours).filter("category IS NOT NULL")
    return _counts(rows, "category", "n").orderBy(F.desc("n"), "category")


def top_hosts(events: DataFrame, as_of, hours: int = 24, limit: int = TOP_HOSTS) -> DataFrame:
    counted = _counts(_recent(events, as_of, hours), "source_host", "event_count")
    return counted.orderBy(F.desc("event_count"), "source_host").limit(limit)


def top_rules(alerts: DataFrame, rules: DataFrame, limit: int = TOP_RULES) -> DataFrame:
    """The rules with most open alerts; rules that no longer exist drop out after the cut."""
    counted = _counts(alerts.filter("status = 'open'"), "rule_id", "alert_count")
    top = counted.orderBy(F.desc("alert_count"), "rule_id").limit(limit)
    names = rules.select(F.col("id").alias("rule_id"), F.col("name").alias("rule_name"))
    return top.join(names, "rule_id")


def active_sources(events: DataFrame, as_of, hours: int = 24) -> DataFrame:
    return _recent(events, as_of, hours).agg(F.count_distinct("source_host").alias("active_sources"))


def timeline(events: DataFrame, as_of, hours: int = 24, bucket: str = "1h", source_type: str | None = None) -> DataFrame:
    """Events per time bucket, ascending, without empty buckets."""
    if bucket not in _BUCKETS:
        raise ValueError(f"bucket must be one of {list(_BUCKETS)}")
    rows = _recent(events, as_of, hours)
    if source_type:
        rows = rows.filter(F.col("source_type") == source_type)
    start = F.window("received_at", _BUCKETS[bucket])["start"]
    return rows.groupBy(start.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).orderBy("bucket")


def summary(events: DataFrame, alerts: DataFrame, rules: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """The whole dashboard as rows (section, item, n), with one scan of the events.

    Events are first counted per (host, level, category); all event sections are sums over that
    small table.  Hosts are cut to the top ten in two steps, first within salted parts, so that no
    task ranks all hosts.
    """
    cube = _recent(events, as_of, hours).groupBy("source_host", "log_level", "category").agg(
        F.count(F.lit(1)).alias("n"))
    keys = {"total_events": F.lit(""), "by_level": F.col("log_level"), "by_category": F.col("category"),
            "top_host": F.col("source_host")}
    counted = _sum_by(cube, {name: (key, F.col("n")) for name, key in keys.items()})
    host = F.col("section") == "top_host"
    # every host adds one to the number of active sources
    spread = {"same": (F.col("item"), F.col("n")), "active_sources": (F.when(host, F.lit("")), F.lit(1).cast("bigint"))}
    tagged = counted.select("section", F.inline(_cells(spread)).alias("part", "new_item", "new_n")).select(
        "section", "part", F.col("new_item").alias("item"), F.col("new_n").alias("n"))
    summed = tagged.withColumn("section", F.when(F.col("part") == "same", F.col("section")).otherwise(F.col("part"))).filter(
        "item IS NOT NULL").groupBy("section", "item").agg(F.sum("n").alias("n"))

    def best(df: DataFrame, *parts: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("section", *parts).orderBy(F.desc("n"), "item"))
        return df.withColumn("rank", rank).filter((F.col("section") != "top_host") | (F.col("rank") <= TOP_HOSTS))

    salted = summed.withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(_SALTS)))
    sections = best(best(salted, "salt")).select("section", "item", "n")
    alerts_part = open_alerts(alerts).select(
        F.lit("open_alerts").alias("section"), F.lit("").alias("item"), F.col("open_alerts").alias("n"))
    rules_part = top_rules(alerts, rules).select(
        F.lit("top_rule").alias("section"), F.col("rule_name").alias("item"), F.col("alert_count").alias("n"))
    return sections.unionByName(alerts_part).unionByName(rules_part)


def _cells(parts: dict[str, tuple[Column, Column]]) -> Column:
    return F.array(*[F.struct(F.lit(name).alias("section"), item.alias("item"), n.alias("n"))
                     for name, (item, n) in parts.items()])


def _sum_by(df: DataFrame, parts: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Sum ``n`` per (section, item) over several keys of each row at once."""
    return df.select(F.inline(_cells(parts))).filter("item IS NOT NULL").groupBy("section", "item").agg(
        F.sum("n").alias("n"))
