"""Streaming ingest: raw lines -> events, archive and dead letters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from watchhouse.functions import columns as c
from watchhouse.operators import enrich
from watchhouse.operators.normalize import bad_lines, good_events, normalize
from watchhouse.sources.sinks import archive_rows, event_table

STORAGE_TRIGGER = "5 seconds"
ARCHIVE_TRIGGER = "60 seconds"


def trigger(writer, interval: str | None):
    """A processing-time trigger, or everything available once when ``interval`` is None."""
    return writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)


def start_storage(events: DataFrame, path: str, checkpoint: str, interval: str | None = STORAGE_TRIGGER,
                  dedupe_within: str | None = None) -> StreamingQuery:
    """Append an event stream to the event table, exactly once.

    ``dedupe_within`` also drops repeated event ids that arrive within that time of each other.
    """
    if dedupe_within:
        events = events.withWatermark("received_at", dedupe_within).dropDuplicatesWithinWatermark(["id"])
    writer = event_table(events).writeStream.format("parquet").partitionBy("event_month").option(
        "checkpointLocation", checkpoint)
    return trigger(writer, interval).start(path)


def start_archive(lines: DataFrame, path: str, checkpoint: str, as_of=None,
                  interval: str | None = ARCHIVE_TRIGGER) -> StreamingQuery:
    """Append raw lines to the gzip archive once a minute.

    The folder date is ``as_of``, or else the row's own ``received_at``, so that a batch run again after midnight goes to the same folder.
    """
    moment = F.col("received_at") if as_of is None else c.as_timestamp(as_of)
    writer = archive_rows(lines, moment).writeStream.format("text").partitionBy(
        "source_type", "year", "month", "day").option("compression", "gzip").option("checkpointLocation", checkpoint)
    return trigger(writer, interval).start(path)


def normalized_stream(lines: DataFrame, sources: DataFrame, geo_ranges: DataFrame | None = None) -> DataFrame:
    """Parsed and enriched events of a line stream, good and bad rows together.

    The same call serves batch frames; ``sources`` and ``geo_ranges`` are static tables.
    """
    events = enrich.add_compliance_tags(normalize(lines, sources))
    return events if geo_ranges is None else enrich.add_geoip(events, geo_ranges)


def start_ingest(lines: DataFrame, sources: DataFrame, out: str, checkpoint: str, as_of=None,
                 geo_ranges: DataFrame | None = None, interval: str | None = STORAGE_TRIGGER) -> StreamingQuery:
    """One pass per micro-batch to three sinks: ``out``/events, ``out``/archive and ``out``/errors.

    Every sink is partitioned by batch and overwritten per partition, so a batch that is run again
    after a failure replaces its own output.
    """
    parsed = normalized_stream(lines, sources, geo_ranges)

    def fan_out(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            moment = F.col("received_at") if as_of is None else c.as_timestamp(as_of)
            good = batch.filter("problem IS NULL")
            _overwrite(event_table(good_events(good)), batch_id, f"{out}/events", "parquet", "event_month")
            raw = archive_rows(good.select(F.col("raw_message").alias("raw"), "source_type", "received_at"), moment)
            _overwrite(raw, batch_id, f"{out}/archive", "text", "source_type", "year", "month", "day")
            _overwrite(bad_lines(batch), batch_id, f"{out}/errors", "parquet")
        finally:
            batch.unpersist()

    writer = parsed.writeStream.foreachBatch(fan_out).option("checkpointLocation", checkpoint)
    return trigger(writer, interval).start()


def _overwrite(df: DataFrame, batch_id: int, path: str, file_format: str, *partitions: str) -> None:
    writer = df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy(*partitions, "batch_id")
    if file_format == "text":
        writer = writer.option("compression", "gzip")
    writer.format(file_format).save(path)
