"""The common output of all rule evaluators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchhouse.functions import columns as c
from watchhouse.schema import TRIGGERS


def shown(group: Column) -> Column:
    """A group value as text; missing and empty ones read ``unknown``."""
    return F.coalesce(c.blank_to_null(group.cast("string")), F.lit("unknown"))


def as_triggers(
    df: DataFrame, *, rule_id, severity, name, group_column, group: Column | None, description: Column,
    key: Column | None = None, extra: Column | None = None,
) -> DataFrame:
    """Project ``first_seen``, ``last_seen`` and ``event_count`` plus rule data to trigger rows.

    ``rule_id``, ``severity``, ``name`` and ``group_column`` are values or Columns; ``group`` is NULL
    for a rule without grouping.  The dedup key is ``rule:group`` unless ``key`` is given.
    """
    def col(x):
        return x if isinstance(x, Column) else F.lit(x).cast("string")

    rule_id, severity, name, group_column = (col(x) for x in (rule_id, severity, name, group_column))
    group = F.lit(None).cast("string") if group is None else group
    default_key = F.concat(rule_id, F.lit(":"), F.coalesce(group, F.lit("global")))
    values = {
        "rule_id": rule_id,
        "severity": severity,
        "title": F.when(group.isNull(), name).otherwise(F.concat(name, F.lit(": "), group)),
        "description": description,
        "src_ip": F.when(group_column == "src_ip", group),
        "source_host": F.when(group_column == "source_host", group),
        "first_seen": F.col("first_seen"),
        "last_seen": F.col("last_seen"),
        "event_count": F.col("event_count"),
        "group_key": default_key if key is None else key,
        "extra": c.empty_map() if extra is None else extra,
    }
    return df.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in TRIGGERS.fields])
