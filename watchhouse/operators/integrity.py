"""Tamper checks, archive age planning and archive inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchhouse.functions import columns as c
from watchhouse.functions import fixed_values as fv


def verify_integrity(events: DataFrame) -> DataFrame:
    """Per event: ``intact`` and ``detail``; the hash is recomputed over the whole raw message."""
    stored, raw = c.blank_to_null(F.col("raw_hash")), c.blank_to_null(F.col("raw_message"))
    recomputed = F.sha2(F.col("raw_message"), 256)
    detail = (
        F.when(stored.isNull(), "No raw_hash stored for this event")
        .when(raw.isNull(), "No raw_message stored for this event")
    )
    checked = detail.isNull()
    return events.select(
        "id",
        F.when(checked, recomputed == stored).otherwise(F.lit(False)).alias("intact"),
        detail.alias("detail"),
        F.when(checked, stored).alias("stored_hash"),
        F.when(checked, recomputed).alias("recomputed_hash"),
    )


def integrity_summary(events: DataFrame) -> DataFrame:
    """Number of events per outcome: intact, tampered, or the reason no check was possible."""
    outcome = F.coalesce("detail", F.when(F.col("intact"), "intact").otherwise("tampered"))
    return verify_integrity(events).groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def retention_action(age_days: Column) -> Column:
    return (
        F.when(age_days > fv.DELETE_AFTER_DAYS, "delete")
        .when(age_days > fv.ARCHIVE_AFTER_DAYS, "archive")
        .when(age_days > fv.COOL_AFTER_DAYS, "cool")
        .otherwise("keep")
    )


def retention_plan(files: DataFrame, as_of) -> DataFrame:
    """``files(path, modificationTime, length)`` with age in days and the storage tier they are due for."""
    age = (F.unix_micros(c.as_timestamp(as_of)) - F.unix_micros(F.col("modificationTime").cast("timestamp"))) / F.lit(
        86_400_000_000.0
    )
    return files.withColumn("age_days", age).withColumn("action", retention_action(F.col("age_days")))
