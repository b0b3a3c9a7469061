"""Raw line sources.  All yield ``raw, source_ip, received_at`` unless noted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchhouse.functions import columns as c
from watchhouse.schema import ERRORS
from watchhouse.sources.frames import CHUNK_BYTES, Captures
from watchhouse.sources.positions import SPLIT_BYTES, positioned_lines

# .../source_ip=10.0.0.1/part.log
_IP_FOLDER = r"source_ip=([^/]+)/"


def syslog_lines(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Text files of syslog lines below ``source_ip=<ip>`` folders.

    Invalid UTF-8 is replaced, lines are trimmed and blank ones dropped.  The receipt time is the
    time the file was written.
    """
    reader = spark.readStream if streaming else spark.read
    files = reader.schema("value string").option("recursiveFileLookup", "true").format("text").load(path)
    return clean_lines(files.select(
        F.col("value").alias("raw"),
        c.group_of(F.url_decode(F.col("_metadata.file_path")), _IP_FOLDER, 1).alias("source_ip"),
        F.col("_metadata.file_modification_time").alias("received_at"),
    ))


def clean_lines(lines: DataFrame) -> DataFrame:
    """Repair the encoding, trim, drop blanks."""
    return lines.withColumn("raw", c.strip(F.make_valid_utf8(F.col("raw")))).filter("length(raw) > 0")


def tail_lines(spark: SparkSession, path: str, starting: dict[str, int] | None = None, ending: dict[str, int] | None = None,
               streaming: bool = False, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The same lines read from known byte offsets on, with ``path``, ``position`` and a ``record_id`` made of both.

    Equal lines thus have ids of their own.  As a stream the query's checkpoint holds the offsets; in batches
    ``positions.line_ends`` gives the offsets to start from next.
    """
    lines = positioned_lines(spark, path, starting, ending, streaming, split_bytes)
    return clean_lines(lines.select(
        "raw", c.group_of(F.url_decode(F.col("path")), _IP_FOLDER, 1).alias("source_ip"), "received_at", "path", "position",
        F.concat_ws(":", "path", F.col("position").cast("string")).alias("record_id"),
    ))


# --- framed captures -------------------------------------------------------------------------------


def framed_errors(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Dead letters of captures in counted frames: what ``framed_captures`` leaves unread after a malformed or cut-off frame.

    One row per such capture and piece of ``chunk_bytes``, with its path and the byte at which it begins in ``detail``; rows fit
    the error table.
    """
    rest = Captures(spark, path, chunk_bytes).unread()
    return rest.select(
        F.lit("framing_error").alias("error"), F.concat(F.lit("unread from byte "), F.col("position").cast("string"), F.lit(" of "), F.col("path")).alias("detail"),
        F.lit(None).cast("string").alias("source_ip"), "raw", "received_at").select(*ERRORS.fieldNames())


def framed_captures(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``path, position, raw, received_at`` of the messages of captured connections, one file per connection.

    The first byte of a capture decides the framing: a digit means octet counting, anything else
    newline-delimited (an unfinished last line is not a message).  Counted frames end at the first malformed
    or cut-off one; ``framed_errors`` has the rest.  Captures of either framing are cut in chunks of ``chunk_bytes`` that are read
    in parallel, see ``frames``.
    """
    return clean_lines(Captures(spark, path, chunk_bytes).messages())


# --- agents ------------------------------------------------------------------------------------------


def agent_events(batches: DataFrame) -> DataFrame:
    """Explode agent batches ``(batch_id, source_type, source_ip, received_at, body)``.

    ``body`` is a JSON array.  Returns one row per element with ``raw`` (its JSON text),
    ``line_type``, ``record_id`` (batch and position) and ``is_object``.  Bodies that are not arrays
    and source types other than windows and linux are refused as a whole: see ``refused_batches``.
    """
    # element texts, and the JSON type of each element
    elements = F.arrays_zip(_texts().alias("raw"), _kinds().alias("kind"))
    rows = batches.filter(_acceptable()).select(
        "batch_id", F.lower("source_type").alias("line_type"), "source_ip", "received_at",
        F.posexplode(elements).alias("position", "element"),
    )
    return rows.select(
        "batch_id", "line_type", "source_ip", "received_at",
        F.concat_ws(":", "batch_id", "position").alias("record_id"),
        F.col("element.raw").alias("raw"),
        F.coalesce(F.col("element.kind").startswith("OBJECT"), F.lit(False)).alias("is_object"),
    )


def _texts() -> Column:
    return F.from_json("body", "array<string>")


def _kinds() -> Column:
    values = F.try_variant_get(F.try_parse_json("body"), "$", "array<variant>")
    return F.transform(values, lambda v: F.schema_of_variant(v))


def _acceptable() -> Column:
    kind = F.schema_of_variant(F.try_parse_json("body"))
    return F.lower("source_type").isin("windows", "linux") & F.coalesce(kind.startswith("ARRAY"), F.lit(False))


def refused_batches(batches: DataFrame) -> DataFrame:
    reason = F.when(~F.lower("source_type").isin("windows", "linux"), "only windows and linux are accepted").otherwise(
        "body must be a JSON array")
    return batches.filter(~_acceptable()).select("batch_id", reason.alias("reason"))


def ingest_summary(elements: DataFrame, parsed_problem: Column) -> DataFrame:
    """Accepted and failed elements per source type."""
    ok = F.col("is_object") & parsed_problem.isNull()
    return elements.groupBy("line_type").agg(
        F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("errors"))


def journald_lines(spark: SparkSession, path: str, units: Sequence[str] = (), streaming: bool = False) -> DataFrame:
    """journald JSON lines: blank and invalid lines skipped, optionally only some units.

    As a stream the query's checkpoint takes the place of the stored cursor; ``journald_after`` resumes batches at cursors.
    """
    lines = syslog_lines(spark, path, streaming)
    return journald_entries(lines, units)


def journald_entries(lines: DataFrame, units: Sequence[str] = ()) -> DataFrame:
    kind = F.schema_of_variant(F.try_parse_json("raw"))
    kept = lines.filter(F.coalesce(kind.startswith("OBJECT"), F.lit(False)))
    if units:
        kept = kept.filter(F.get_json_object("raw", "$._SYSTEMD_UNIT").isin(list(units)))
    return kept


def _at() -> Column:
    """The order of a host's journal: its files by name, each from top to bottom."""
    return F.struct("path", "position")


def journald_after(lines: DataFrame, cursors: DataFrame, first_run: int = 1000) -> DataFrame:
    """Journal entries after the stored cursor of their host: ``tail_lines`` and (source_ip, cursor).

    A host without a stored cursor sends its last ``first_run`` entries; one whose cursor is no longer in the files sends all they hold.
    """
    entries = journald_entries(lines).withColumn("cursor", F.get_json_object("raw", "$.__CURSOR"))
    # one cursor a host: sent to the entries, which a join by host would gather in one task each
    stored = F.broadcast(cursors.select("source_ip", F.col("cursor").alias("_cursor")).where("_cursor IS NOT NULL"))
    same = [entries["source_ip"] == stored["source_ip"], entries["cursor"] == stored["_cursor"]]
    reached = entries.join(stored, same, "left_semi").groupBy("source_ip").agg(F.max(_at()).alias("_reached"))
    known = entries.join(F.broadcast(stored.join(F.broadcast(reached), "source_ip", "left")), "source_ip")
    later = known.where(F.col("_reached").isNull() | (_at() > F.col("_reached"))).select(*entries.columns)
    last = F.row_number().over(Window.partitionBy("source_ip").orderBy(_at().desc()))
    fresh = entries.join(stored, "source_ip", "left_anti").withColumn("_n", last).where(F.col("_n") <= first_run).drop("_n")
    return later.unionByName(fresh)


def new_cursors(entries: DataFrame, cursors: DataFrame) -> DataFrame:
    """The last cursor of every host after reading ``entries`` (of ``journald_after``)."""
    seen = entries.where("cursor IS NOT NULL").groupBy("source_ip").agg(F.max_by("cursor", _at()).alias("_seen"))
    return cursors.join(seen, "source_ip", "full").select("source_ip", F.coalesce("_seen", "cursor").alias("cursor"))


def wrap_syslog(lines: DataFrame, default_host: str = "localhost") -> DataFrame:
    """Plain syslog lines wrapped as ``{timestamp, hostname, program, message}`` JSON.

    ``Mmm dd hh:mm:ss host program: message``; lines with fewer than five parts become the message.
    """
    parts = F.split("raw", " ", 5)
    rest = F.get(parts, F.lit(4))
    full = F.size(parts) >= 5
    named = full & rest.contains(":")
    after = F.substr(rest, F.instr(rest, ":") + 1)
    doc = F.struct(
        F.date_format("received_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("timestamp"),
        F.when(full, F.get(parts, F.lit(3))).otherwise(F.lit(default_host)).alias("hostname"),
        F.when(named, c.strip(F.substring_index(rest, ":", 1))).otherwise(F.lit("syslog")).alias("program"),
        F.when(named, c.strip(after)).when(full, rest).otherwise(F.col("raw")).alias("message"),
    )
    return lines.withColumn("raw", F.to_json(doc))


def windows_records(records: DataFrame, marks: DataFrame, computer: str = "localhost") -> DataFrame:
    """Log records above each channel's high-water mark as event JSON.

    ``records(channel, record_number, event_id, time_generated, event_type, source_name, inserts)``,
    ``marks(channel, record_id)``.  Inserts are keyed by position, missing ones dropped.
    """
    # one mark a channel: sent to the records, which a join by channel would gather in one task each
    newer = records.join(F.broadcast(marks), "channel", "left").filter(
        F.col("record_number") > F.coalesce("record_id", F.lit(0)))
    numbered = F.transform("inserts", lambda x, i: F.struct(i.cast("string").alias("key"), x.alias("value")))
    data = F.map_from_entries(F.filter(numbered, lambda e: e["value"].isNotNull()))
    doc = F.struct(
        F.col("event_id").bitwiseAND(F.lit(0xFFFF)).alias("EventID"),
        F.date_format("time_generated", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("TimeCreated"),
        F.lit(computer).alias("Computer"), F.col("channel").alias("Channel"), F.col("event_type").alias("Level"),
        F.col("record_number").alias("RecordNumber"), F.col("source_name").alias("SourceName"),
        F.coalesce(data, c.empty_map()).alias("EventData"),
    )
    return newer.select("channel", "record_number", F.to_json(doc).alias("raw"))


def new_marks(records: DataFrame, marks: DataFrame) -> DataFrame:
    """High-water mark per channel after reading ``records``."""
    seen = records.groupBy("channel").agg(F.max("record_number").alias("_seen"))
    return marks.join(seen, "channel", "full").select(
        "channel", F.greatest("record_id", "_seen").alias("record_id"))
