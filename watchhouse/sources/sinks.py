"""Sinks: event table, raw archive, dead letters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from watchhouse.functions import columns as c
from watchhouse.operators.alerts import latest_alerts
from watchhouse.operators.integrity import retention_plan
from watchhouse.schema import ALERTS, EVENTS
from watchhouse.sources.tables import month_of

# about 50 MB of text per archive file
ARCHIVE_LINES_PER_FILE = 100_000


def event_table(events: DataFrame) -> DataFrame:
    return events.select(*EVENTS.fieldNames(), month_of(F.col("received_at")).alias("event_month"))


def write_events(events: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet by month; rows in time order within a file so that time filters skip row groups."""
    event_table(events).sortWithinPartitions("event_month", "received_at").write.mode(mode).partitionBy(
        "event_month").parquet(path)


def archive_rows(lines: DataFrame, as_of) -> DataFrame:
    """``raw`` with its folder columns.  The date is the upload date; empty lines are skipped."""
    now = c.as_timestamp(as_of)
    return lines.filter("raw IS NOT NULL AND raw <> ''").select(
        F.col("raw").alias("value"), F.coalesce("source_type", F.lit("unknown")).alias("source_type"),
        F.date_format(now, "yyyy").alias("year"), F.date_format(now, "MM").alias("month"),
        F.date_format(now, "dd").alias("day"),
    )


def write_archive(lines: DataFrame, path: str, as_of, mode: str = "append") -> None:
    """Gzip text below source_type / year / month / day, written straight from the input tasks."""
    archive_rows(lines, as_of).write.mode(mode).partitionBy("source_type", "year", "month", "day").option(
        "compression", "gzip").option("maxRecordsPerFile", ARCHIVE_LINES_PER_FILE).text(path)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Archived lines with source_type, year, month, day; filters on those prune folders."""
    layout = "value string, source_type string, year string, month string, day string"
    return spark.read.schema(layout).text(path).withColumnRenamed("value", "raw")


def archive_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Name, time and size of every archive file; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "*.gz").load(path)
    return files.select("path", "modificationTime", "length")


def archive_plan(spark: SparkSession, path: str, as_of) -> DataFrame:
    return retention_plan(archive_inventory(spark, path), as_of)


def write_errors(errors: DataFrame, path: str, mode: str = "append") -> None:
    errors.write.mode(mode).parquet(path)


def write_alert_changes(alerts: DataFrame, path: str, as_of) -> None:
    """Append the alerts that a merge or patch at ``as_of`` has touched (all of them when it is None: the first table).

    History is not rewritten; writing the same changes again leaves the table as it is.
    """
    version = F.lit(0).cast("bigint") if as_of is None else F.unix_micros(c.as_timestamp(as_of))
    touched = alerts if as_of is None else alerts.filter(F.col("updated_at") == c.as_timestamp(as_of))
    touched.withColumn("version", version).write.mode("append").parquet(path)


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """The alert table from its changes."""
    schema = StructType([*ALERTS.fields, StructField("version", LongType())])
    return latest_alerts(spark.read.schema(schema).parquet(path))
