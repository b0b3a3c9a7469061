"""Anomaly rules: the current count against the mean and deviation of hourly counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchhouse.functions import columns as c
from watchhouse.operators import filters
from watchhouse.plans.rule_bodies import Rule
from watchhouse.plans.triggers import as_triggers

DAY = 86_400


def hourly_counts(events: DataFrame, rule: Rule, as_of) -> DataFrame:
    """Per (group, hour): rows of the baseline period and rows of the current window, in one scan."""
    baseline = int(rule.body.get("baseline_days", 7)) * DAY
    window = rule.window_seconds
    wanted = filters.in_window(as_of, max(baseline, window)) & filters.event_filter(rule.filters)
    group = F.lit(None).cast("string")
    if rule.group_by:
        group = F.col(rule.group_by).cast("string")
        wanted = wanted & group.isNotNull()
    return events.filter(wanted).groupBy(
        group.alias("grp"), F.date_trunc("hour", "received_at").alias("bucket")
    ).agg(
        F.count_if(filters.in_window(as_of, baseline)).alias("in_baseline"),
        F.count_if(filters.in_window(as_of, window)).alias("in_window"),
    )


def anomaly_scores(hourly: DataFrame, as_of, same_hour: bool = False, keys: Sequence[str] = ("grp",)) -> DataFrame:
    """Per key: current count, mean, standard deviation and z-score.

    Only hours with events form the baseline, the current window included.  ``same_hour`` keeps
    only the hours of the day of ``as_of``.
    """
    used = F.col("in_baseline") > 0
    if same_hour:
        used = used & (F.hour("bucket") == F.hour(c.as_timestamp(as_of)))
    sample = F.when(used, F.col("in_baseline"))
    stats = hourly.groupBy(*keys).agg(
        F.sum("in_window").alias("event_count"), F.avg(sample).alias("mean"), F.stddev_pop(sample).alias("stddev"),
    )
    return stats.filter("stddev > 0").withColumn("z_score", (F.col("event_count") - F.col("mean")) / F.col("stddev"))


_PARAMS = ("rule_no int, rule_id string, name string, severity string, group_column string, std_devs double, "
           "baseline_days int")


def _params(rules: Sequence[Rule]) -> list[tuple]:
    return [(no, r.id, r.name, r.severity, r.group_by, float(r.body.get("std_devs", 3.0)), _days(r))
            for no, r in enumerate(rules)]


def _days(rule: Rule) -> int:
    return int(rule.body.get("baseline_days", 7))


def anomaly_triggers(events: DataFrame, rules: Sequence[Rule], as_of, same_hour: bool = False) -> DataFrame:
    """Triggers of all given anomaly rules from one scan of the events."""
    hits = []
    for no, rule in enumerate(rules):
        baseline, window = filters.in_window(as_of, _days(rule) * DAY), filters.in_window(as_of, rule.window_seconds)
        wanted = (baseline | window) & filters.event_filter(rule.filters)
        group = F.lit(None).cast("string")
        if rule.group_by:
            group = F.col(rule.group_by).cast("string")
            wanted = wanted & group.isNotNull()
        hits.append(F.when(wanted, F.struct(F.lit(no).alias("rule_no"), group.alias("grp"), baseline.alias("base"), window.alias("now"))))
    widest = max(max(_days(r) * DAY, r.window_seconds) for r in rules)
    rows = events.filter(filters.in_window(as_of, widest)).select(
        F.date_trunc("hour", "received_at").alias("bucket"), F.inline(F.array_compact(F.array(*hits))))
    hourly = rows.groupBy("rule_no", "grp", "bucket").agg(
        F.count_if("base").alias("in_baseline"), F.count_if("now").alias("in_window"))
    return _fire(anomaly_scores(hourly, as_of, same_hour, ("rule_no", "grp")), rules, as_of)


def anomaly_rule(events: DataFrame, rule: Rule, as_of, same_hour: bool = False) -> DataFrame:
    return anomaly_triggers(events, [rule], as_of, same_hour)


def anomaly_from_hourly(hourly: DataFrame, rule: Rule, as_of, same_hour: bool = False) -> DataFrame:
    """Triggers from an hourly table, e.g. one kept up to date by the streaming job."""
    scored = anomaly_scores(hourly, as_of, same_hour).withColumn("rule_no", F.lit(0))
    return _fire(scored, [rule], as_of)


def _fire(scored: DataFrame, rules: Sequence[Rule], as_of) -> DataFrame:
    """Keep scores above their rule's limit and describe them."""
    params = scored.sparkSession.createDataFrame(_params(rules), _PARAMS)
    grouped = F.col("group_column").isNotNull()
    fired = scored.join(params, "rule_no").filter(
        (F.col("z_score") > F.col("std_devs")) & (~grouped | (F.col("event_count") > 0))
    ).withColumns({"first_seen": c.as_timestamp(as_of), "last_seen": c.as_timestamp(as_of)})
    subject = F.when(grouped, F.concat(F.col("grp"), F.lit(" count "))).otherwise("Event count ")
    description = F.concat(
        subject, F.col("event_count").cast("string"), F.lit(" is "), _one_digit("z_score"), F.lit("σ above "),
        F.col("baseline_days").cast("string"), F.lit("-day baseline (mean="), _one_digit("mean"), F.lit(", σ="),
        _one_digit("stddev"), F.lit(")"),
    )
    extra = F.create_map(*[x for n in ("z_score", "mean", "stddev")
                           for x in (F.lit(n), F.bround(n, 2).cast("string"))])
    return as_triggers(
        fired, rule_id=F.col("rule_id"), severity=F.col("severity"), name=F.col("name"),
        group_column=F.col("group_column"), group=F.when(grouped, F.col("grp")), description=description, extra=extra)


def _one_digit(name: str) -> Column:
    return F.format_string("%.1f", F.col(name))
