"""Stored tables: Parquet with explicit schemas, events by month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchhouse import schema
from watchhouse.functions import columns as c

SCHEMAS = {
    "alerts": schema.ALERTS, "alert_rules": schema.RULES, "sources": schema.SOURCES,
    "blacklists": schema.BLACKLISTS, "audit_log": schema.AUDIT_LOG, "errors": schema.ERRORS,
}
_EVENTS = T.StructType([*schema.EVENTS.fields, T.StructField("event_month", T.StringType())])


def month_of(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM")


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The event table including its partition column ``event_month``."""
    return spark.read.schema(_EVENTS).parquet(path)


def events_between(events: DataFrame, time_from, time_to=None) -> DataFrame:
    """Time range on both the partition column and the time, so other months are never listed."""
    start = c.as_timestamp(time_from)
    rows = events.filter((F.col("event_month") >= month_of(start)) & (F.col("received_at") >= start))
    if time_to is not None:
        end = c.as_timestamp(time_to)
        rows = rows.filter((F.col("event_month") <= month_of(end)) & (F.col("received_at") <= end))
    return rows
