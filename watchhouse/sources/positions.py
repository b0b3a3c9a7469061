"""Lines of growing files by position: a data source whose offset is the byte reached in every file.

``spark.read`` and ``spark.readStream`` of the format ``positioned_lines`` give ``path, position, raw, received_at``: the byte at which
a line starts names it, also among equal lines.  Files are cut into byte ranges that are read in parallel; a line belongs to the range
it starts in.  A task reads ranges that follow each other, so there are some TASKS tasks (more where one would take over
``SPLIT_BYTES``) however small the ranges, and little more than a range's own bytes are read for it.  A stream's checkpoint holds the offsets, so a query that is started again goes on after the last line it has
written.  Only whole lines are taken: an unfinished last line waits for its end.

Offsets are JSON, ``{"<path>": byte, ...}``, one entry a file: the source is for the logs of a host or a relay; folders of very many
finished files belong to the text format.  A file that has become shorter than its offset was started anew and is read from its
beginning.  ``startingOffsets`` and ``endingOffsets`` bound a read; files they do not name are read from the start, to the end.
Paths may be URIs of any file system pyarrow knows, and have to be within reach of the executors.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FORMAT = "positioned_lines"
SPLIT_BYTES = 64 << 20
TASKS = 64
_READ = 4 << 20
_LOOK = 4096  # first look for the end of a line beyond a range; doubled until it is found
_SCHEMA = pa.schema([("path", pa.string()), ("position", pa.int64()), ("raw", pa.string()), ("received_at", pa.timestamp("us", tz="UTC"))])


def file_system(path: str):
    """The file system of a path or URI, and the path within it."""
    from pyarrow import fs

    if path.startswith("file:"):
        from urllib.parse import unquote

        path = "/" + unquote(path[5:]).lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(path: str) -> dict[str, tuple[int, int]]:
    """Size and time of writing (microseconds) of every file at or below a path; hidden files are passed over."""
    from pyarrow import fs

    system, inner = file_system(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        return {}
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True))
    hidden = lambda p: any(part[:1] in "._" for part in p[len(inner):].split("/") if part)
    return {f.path: (f.size, (f.mtime_ns or 0) // 1000) for f in found if f.type == fs.FileType.File and not hidden(f.path)}


def line_end(path: str, size: int) -> int:
    """The byte after the last line break before ``size``; read backwards, so only the unfinished line is gone through."""
    system, inner = file_system(path)
    with system.open_input_file(inner) as file:
        high = size
        while high > 0:
            low = max(0, high - 65536)
            at = file.read_at(high - low, low).rfind(b"\n")
            if at >= 0:
                return low + at + 1
            high = low
    return 0


def lines_between(path: str, low: int, high: int, end: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """Starts and bytes of the lines that begin in ``low`` to ``high``; ``end`` is where the file ends for this read."""
    system, inner = file_system(path)
    with system.open_input_file(inner) as file:
        yield from lines_of(file, low, high, end)


def lines_of(file, low: int, high: int, end: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """``lines_between`` of an open file.  What lies beyond ``high`` is read only as far as its last line goes, by growing looks."""
    at, look = low, _LOOK
    if low > 0:  # a line that began before is the business of the range before
        at = low - 1
        while at < end:
            block = file.read_at(min(look, _READ, end - at), at)
            found = block.find(b"\n")
            if found >= 0:
                at += found + 1
                break
            at += len(block)
            look *= 2
    start, begun, look = at, [], _LOOK  # where the open line starts, and its blocks so far
    while start < high:
        if at < high:
            wanted = min(_READ, high - at)
        else:
            wanted, look = min(_READ, look), look * 2
        block = file.read_at(min(wanted, end - at), at) if at < end else b""
        at += len(block)
        if block and b"\n" not in block:
            begun.append(block)
            continue
        pieces = b"".join([*begun, block]).split(b"\n")
        begun = [pieces.pop()]
        if not block and begun[0]:  # the file ends without a line break
            pieces = begun
        starts, lines = [], []
        for piece in pieces:
            if start >= high:
                break
            starts.append(start)
            lines.append(piece)
            start += len(piece) + 1
        if starts:
            yield starts, lines
        if not block:
            return


class Range(InputPartition):
    """A byte range of one file."""

    def __init__(self, path: str, low: int, high: int, end: int, written: int):
        self.path, self.low, self.high, self.end, self.written = path, low, high, end, written


class Task(InputPartition):
    """Byte ranges of ``split`` bytes that one task reads: spans of files, each to be cut into ranges."""

    def __init__(self, spans: list[Range], split: int):
        self.spans, self.split = spans, split

    def ranges(self) -> Iterator[Range]:
        for span in self.spans:
            for low in range(span.low, span.high, self.split):
                yield Range(span.path, low, min(low + self.split, span.high), span.end, span.written)


class _Ranges:
    """What batch and stream have in common."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        self.starting = json.loads(options.get("startingOffsets", "{}"))
        self.ending = json.loads(options.get("endingOffsets", "{}"))

    def ends(self) -> dict[str, dict]:
        """How far each file can be read, and when it was written."""
        out = {}
        for path, (size, written) in listed(self.path).items():
            out[path] = {"at": line_end(path, min(size, self.ending.get(path, size))), "written": written}
        return out

    def tasks(self, starts: dict[str, int], ends: dict[str, dict]) -> list[Task]:
        """Ranges of ``split`` bytes dealt to tasks in the order of the files, by spans of whole ranges."""
        lows = {path: starts.get(path, 0) for path in ends}
        lows = {path: 0 if low > ends[path]["at"] else low for path, low in lows.items()}
        total = sum(end["at"] - lows[path] for path, end in ends.items())
        size = max(1, min(SPLIT_BYTES, total // TASKS) // self.split) * self.split
        out, room = [], 0
        for path, end in sorted(ends.items()):
            low = lows[path]
            while low < end["at"]:
                if room < self.split:
                    out.append(Task([], self.split))
                    room = size
                high = min(low + room // self.split * self.split, end["at"])
                out[-1].spans.append(Range(path, low, high, end["at"], end["written"]))
                room -= high - low
                low = high
        return out

    def read(self, partition: Task | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing to read is one task without a range
            return
        path, file, found, size = None, None, [], 0
        try:
            for part in partition.ranges():
                if part.path != path:
                    if file is not None:
                        file.close()
                    system, inner = file_system(part.path)
                    path, file = part.path, system.open_input_file(inner)
                for starts, lines in lines_of(file, part.low, part.high, part.end):
                    found.append((part, starts, lines))
                    size += sum(map(len, lines)) + len(lines)
                    if size >= _READ:
                        yield _batch(found)
                        found, size = [], 0
            if found:
                yield _batch(found)
        finally:
            if file is not None:
                file.close()


def _batch(found: list[tuple[Range, list[int], list[bytes]]]) -> pa.RecordBatch:
    """One batch of the lines of several ranges."""
    paths, positions, lines, written = [], [], [], []
    for part, starts, raw in found:
        paths += [part.path] * len(starts)
        positions += starts
        lines += [x.decode("utf-8", "replace") for x in raw]
        written += [part.written] * len(starts)
    return pa.RecordBatch.from_arrays(
        [pa.array(paths, pa.string()), pa.array(positions, pa.int64()), pa.array(lines, pa.string()), pa.array(written, pa.int64()).cast(_SCHEMA.field(3).type)], schema=_SCHEMA)


class _BatchReader(_Ranges, DataSourceReader):
    def partitions(self):
        return self.tasks(self.starting, self.ends())


class _StreamReader(_Ranges, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {path: {"at": at, "written": 0} for path, at in self.starting.items()}

    def latestOffset(self) -> dict:
        return self.ends()

    def partitions(self, start: dict, end: dict):
        return self.tasks({path: s["at"] for path, s in start.items()}, end)


class PositionedLines(DataSource):
    """The data source; see the module."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, position long, raw string, received_at timestamp"

    def reader(self, schema):
        return _BatchReader(self.options)

    def streamReader(self, schema):
        return _StreamReader(self.options)


def positioned_lines(spark: SparkSession, path: str, starting: dict[str, int] | None = None, ending: dict[str, int] | None = None,
                     streaming: bool = False, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``path, position, raw, received_at`` of the whole lines below ``path``, from and up to the given offsets."""
    spark.dataSource.register(PositionedLines)
    reader = (spark.readStream if streaming else spark.read).format(FORMAT).option("splitBytes", split_bytes)
    return reader.option("startingOffsets", json.dumps(starting or {})).option("endingOffsets", json.dumps(ending or {})).load(path)


def line_ends(path: str, ending: dict[str, int] | None = None) -> dict[str, int]:
    """The offsets a read up to ``ending`` comes to: what the next read starts from."""
    options = {"path": path, "endingOffsets": json.dumps(ending or {})}
    return {name: end["at"] for name, end in _Ranges(options).ends().items()}
