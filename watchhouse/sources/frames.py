"""Counted frames, ``<length> <message>``, cut in parallel.

A frame's place is known only when all frames before it are; there is no delimiter to look for.  A capture is cut into chunks, and

1. every chunk follows the frames from each place where one might begin (digits and a space) until they leave the chunk.  Wrong
   beginnings soon fail or run into the right ones, so a chunk has few exits;
2. the exits of all chunks are the only places where a later chunk can be entered; each chunk tells where it is left from these;
3. following these links from byte 0 gives the true entry of every chunk;
4. all chunks are cut at once, from their true entries.

The bytes are read three times, each time in parallel; what is carried between the steps is a few rows a chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchhouse.session import cut_lineage
from watchhouse.sources.positions import file_system, lines_between

CHUNK_BYTES = 8 << 20
DIGITS = 19  # a longer count is malformed
_BATCH = 8 << 20  # message bytes handed over at a time


def read_bytes(path: str, low: int, high: int) -> bytes:
    system, inner = file_system(path)
    with system.open_input_file(inner) as file:
        return file.read_at(high - low, low)


def headers(data: bytes, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Places among the first ``count`` bytes where a frame may begin, and the bytes from there to the frame's end."""
    raw = np.frombuffer(data, np.uint8)
    digit = (raw >= 48) & (raw <= 57)
    stops = np.append(np.flatnonzero(~digit), len(raw))
    at = np.flatnonzero(digit[:count])
    stop = stops[np.searchsorted(stops, at)]
    fits = (stop < len(raw)) & (stop - at <= DIGITS)
    at, stop = at[fits], stop[fits]
    spaced = raw[stop] == 32
    at, stop = at[spaced], stop[spaced]
    value = np.zeros(len(at), np.uint64)
    for k in range(DIGITS):
        more = at + k < stop
        value[more] = value[more] * np.uint64(10) + (raw[at[more] + k] - 48).astype(np.uint64)
    # lengths beyond any file all count as cut off
    return at, (stop + 1 - at) + np.minimum(value, np.uint64(1 << 62)).astype(np.int64)


def ways_out(data: bytes, low: int, high: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries of the chunk ``low`` to ``high``, and where the frames from each come to an end.

    An end at or after ``high`` is where the chunk is left; one before it is the place of a malformed or cut-off frame.
    """
    at, length = headers(data, high - low)
    at = at + low
    after = at + length
    cut_off = after > size
    inside = ~cut_off & (after < high)
    place = np.minimum(np.searchsorted(at, after), max(0, len(at) - 1))
    follows = inside & (at[place] == after) if len(at) else inside
    jump = np.where(follows, place, np.arange(len(at)))
    while True:  # every round doubles the frames passed over
        further = jump[jump]
        if (further == jump).all():
            break
        jump = further
    last = np.where(cut_off, at, after)
    return at, last[jump]


def _chunks(files: DataFrame, chunk: int) -> DataFrame:
    starts = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(chunk).cast("long"))
    rows = files.where("length > 0").select("path", "length", "written", F.explode(starts).alias("low"))
    rows = rows.withColumn("high", F.least(F.col("low") + chunk, F.col("length")))
    # one file may be the whole capture: its chunks are dealt over all tasks
    return rows.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path", "low")


def _files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, written, counted of the captures; only a first byte is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.col("modificationTime").alias("written"))

    def first(batches):
        for batch in batches:
            counted = [length > 0 and read_bytes(p, 0, 1).isdigit() for p, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist())]
            yield batch.append_column("counted", pa.array(counted, pa.bool_()))

    return cut_lineage(found.mapInArrow(first, "path string, length long, written timestamp, counted boolean"), "captures")


def _true_entries(chunks: DataFrame, chunk: int) -> DataFrame:
    """(path, entry, stop, dead): where each chunk of counted frames is entered, and where its frames end."""
    def rows(batch):
        return zip(*(batch.column(c).to_pylist() for c in batch.schema.names))

    def leave(batches):
        for batch in batches:
            for path, length, low, high in rows(batch):
                _, ends = ways_out(read_bytes(path, low, min(high + DIGITS + 1, length)), low, high, length)
                ends = np.unique(ends[(ends >= high) & (ends < length)])
                yield pa.RecordBatch.from_pydict({"path": pa.array([path] * len(ends), pa.string()), "at": pa.array(ends, pa.int64())})

    exits = chunks.select("path", "length", "low", "high").mapInArrow(leave, "path string, at long").unionByName(
        chunks.where("low = 0").select("path", F.lit(0).cast("long").alias("at"))).distinct()
    start = (F.call_function("div", F.col("at"), F.lit(chunk).cast("long")) * chunk).alias("low")
    entries = exits.groupBy("path", start).agg(F.collect_list("at").alias("entries"))

    def cross(batches):
        for batch in batches:
            for path, length, low, high, entries in rows(batch):
                at, ends = ways_out(read_bytes(path, low, min(high + DIGITS + 1, length)), low, high, length)
                asked = np.array(entries, np.int64)
                place = np.minimum(np.searchsorted(at, asked), max(0, len(at) - 1))
                known = at[place] == asked if len(at) else np.zeros(len(asked), bool)
                stop = np.where(known, ends[place] if len(at) else asked, asked)
                yield pa.RecordBatch.from_pydict({"path": pa.array([path] * len(asked), pa.string()), "entry": asked, "stop": stop, "dead": pa.array(stop < high)})

    links = chunks.join(entries, ["path", "low"]).select("path", "length", "low", "high", "entries").mapInArrow(cross, "path string, entry long, stop long, dead boolean")

    def follow(table: pa.Table) -> pa.Table:
        """The chain from byte 0: a few rows a chunk of one file."""
        way = dict(zip(table.column("entry").to_pylist(), zip(table.column("stop").to_pylist(), table.column("dead").to_pylist())))
        at, taken = 0, []
        while at in way:
            stop, dead = way[at]
            taken.append((at, stop, dead))
            if dead:
                break
            at = stop
        entry, stop, dead = zip(*taken)
        return pa.table({"path": pa.array([table.column("path")[0].as_py()] * len(taken), pa.string()), "entry": pa.array(entry, pa.int64()),
                         "stop": pa.array(stop, pa.int64()), "dead": pa.array(dead, pa.bool_())})

    return cut_lineage(links.groupBy("path").applyInArrow(follow, "path string, entry long, stop long, dead boolean"), "entries")


def _emit(path, written, held):
    return pa.RecordBatch.from_arrays(
        [pa.array([path] * len(held), pa.string()), pa.array([p for p, _ in held], pa.int64()),
         pa.array([m.decode("utf-8", "replace") for _, m in held], pa.string()), pa.array([written] * len(held), pa.timestamp("us", tz="UTC"))],
        ["path", "position", "raw", "received_at"])


_MESSAGES = "path string, position long, raw string, received_at timestamp"


def _cut(batches):
    """Messages of the frames between an entry and the stop known for it."""
    for batch in batches:
        for path, written, entry, stop in zip(*(batch.column(c).to_pylist() for c in ("path", "written", "entry", "stop"))):
            data, at, held, size = read_bytes(path, entry, stop), 0, [], 0
            while at < len(data):
                space = data.index(b" ", at)
                end = space + 1 + int(data[at:space])
                held.append((entry + at, data[space + 1:end]))
                size, at = size + end - at, end
                if size >= _BATCH:
                    yield _emit(path, written, held)
                    held, size = [], 0
            if held:
                yield _emit(path, written, held)


def _newline_messages(batches):
    """Whole lines that begin in a chunk."""
    for batch in batches:
        for path, length, low, high, written in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "low", "high", "written"))):
            for starts, lines in lines_between(path, low, high, length):
                held = [(s, line) for s, line in zip(starts, lines) if s + len(line) < length]  # the break of the line is in the file
                if held:
                    yield _emit(path, written, held)


def _character_start(data: bytes, at: int) -> int:
    """The first place from ``at`` on that is not within a UTF-8 character."""
    for place in range(at, min(at + 3, len(data))):
        if data[place] & 0xC0 != 0x80:
            return place
    return min(at + 3, len(data)) if at < len(data) else len(data)


class Captures:
    """Messages and unread rests of captured connections, one file per connection.

    The first byte of a capture decides its framing: a digit means counted frames, anything else lines (an unfinished last line
    is no message).  Counted frames end at the first malformed or cut-off one.
    """

    def __init__(self, spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES):
        files = _files(spark, path)
        self.chunk = chunk_bytes
        self.lines = _chunks(files.where("NOT counted"), chunk_bytes)
        counted = files.where("counted")
        chunks = _chunks(counted, chunk_bytes)
        self.entries = _true_entries(chunks, chunk_bytes).join(counted.select("path", "length", "written"), "path")

    def messages(self) -> DataFrame:
        """path, position, raw, received_at of every message, as it stands in the capture."""
        n = int(self.entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        counted = self.entries.where("stop > entry").repartition(n, "path", "entry").mapInArrow(_cut, _MESSAGES)
        return counted.unionByName(self.lines.mapInArrow(_newline_messages, _MESSAGES))

    def unread(self) -> DataFrame:
        """path, position, raw, received_at of what stands after a malformed or cut-off frame, in pieces of a chunk's size."""
        pieces = F.explode(F.sequence(F.col("stop"), F.col("length") - 1, F.lit(self.chunk).cast("long"))).alias("position")

        chunk = self.chunk

        def rest(batches):
            for batch in batches:
                for path, length, written, stop, at in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "written", "stop", "position"))):
                    data = read_bytes(path, at, min(at + chunk + 3, length))
                    # a character that lies across two pieces goes to the first
                    begin = 0 if at == stop else _character_start(data, 0)
                    yield _emit(path, written, [(at + begin, data[begin:_character_start(data, chunk)])])

        n = int(self.entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        left = self.entries.where("dead AND stop < length").select("path", "length", "written", "stop", pieces)
        return left.repartition(n, "path", "position").mapInArrow(rest, _MESSAGES)
