"""Framing, agent batches, rate limiting and files."""

import io
import random
import re
from datetime import datetime, timedelta

import pytest

from watchhouse.operators import integrity, rate_limit
from watchhouse.sources import frames, lines, positions


def _plain_frames(content: bytes):
    """Messages with their places, and where the unread rest begins (None: nothing left)."""
    at, out = 0, []
    while at < len(content):
        head = re.match(rb"[0-9]{1,19} ", content[at:at + 20])
        if not head or at + head.end() + int(head[0]) > len(content):
            return out, at
        end = at + head.end() + int(head[0])
        out.append((at, content[at + head.end():end]))
        at = end
    return out, None


@pytest.mark.parametrize("content, messages", [
    (b"5 hello3 abc", [b"hello", b"abc"]), (b"5 hello9 cut", [b"hello"]), (b"1234567 x", []), (b"12345678", []), (b"5x hello", []), (b"", []),
    ("4 né!".encode(), ["né!".encode()]), (b"3 a\nb2 cd", [b"a\nb", b"cd"]),
])
def test_counted_frames(content, messages):
    assert [m for _, m in _plain_frames(content)[0]] == messages
    for chunk in (1, 3, 100):
        at, left = 0, []
        while at < len(content):  # from chunk to chunk by the ways out
            low = at // chunk * chunk
            high = min(low + chunk, len(content))
            entries, stops = frames.ways_out(content[low:high + frames.DIGITS + 1], low, high, len(content))
            way = dict(zip(entries.tolist(), stops.tolist()))
            stop = way.get(at, at)
            left.append(stop)
            if stop < high:
                break
            at = stop
        assert (left[-1] if left and left[-1] < len(content) else None) == _plain_frames(content)[1]


@pytest.mark.parametrize("chunk", [64, 1000, 1 << 20])
def test_captures_cut_in_parallel(spark, tmp_path, chunk):
    """Frames full of numbers that look like counts, frames of many chunks, broken and cut-off ones, at every chunk size."""
    rng = random.Random(chunk)
    contents = {}
    for name in range(12):
        parts = []
        for _ in range(rng.randrange(1, 60)):
            size = rng.choice([0, 1, 7, 30, 200, 3000])
            body = "".join(rng.choice(["12 ", "3 abc", "7", " ", "é", "100 x", "0 ", "text "]) for _ in range(size)).encode()
            parts.append(b"%d %s" % (len(body), body))
        if name % 3 == 1:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice([b"x", b"5x hello", b"99999 cut", b"1" * 25 + b" "]))
        contents[f"c{name}"] = b"".join(parts)
        (tmp_path / f"c{name}").write_bytes(contents[f"c{name}"])
    captures = frames.Captures(spark, str(tmp_path), chunk)
    of = lambda r: r["path"].rsplit("/", 1)[1]
    counted = {n: c for n, c in contents.items() if c[:1].isdigit()}
    got = sorted((of(r), r["position"], r["raw"]) for r in captures.messages().collect() if of(r) in counted)
    assert got == sorted((n, at, m.decode("utf-8", "replace")) for n, c in counted.items() for at, m in _plain_frames(c)[0])
    rests = {}
    for r in sorted(captures.unread().collect(), key=lambda r: r["position"]):
        rests.setdefault(of(r), []).append((r["position"], r["raw"]))
    want = {n: _plain_frames(c)[1] for n, c in counted.items()}
    assert {n: r[0][0] for n, r in rests.items()} == {n: at for n, at in want.items() if at is not None}
    for n, pieces in rests.items():
        if "�" not in "".join(raw for _, raw in pieces):
            assert "".join(raw for _, raw in pieces).encode() == contents[n][want[n]:]


@pytest.mark.parametrize("split", [13, 97, 1 << 20])
def test_lines_between_offsets(spark, tmp_path, split):
    rng = random.Random(split)
    whole = {}
    for name in ("a.log", "sub/b.log"):
        text = b"".join(bytes(rng.choice(b"xy\xff \r") for _ in range(rng.choice([0, 1, 5, 40]))) + b"\n" for _ in range(60)) + b"unfinished"
        whole[name] = text
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text)
    (tmp_path / ".hidden").write_bytes(b"no\n")
    read = lambda **bounds: positions.positioned_lines(spark, str(tmp_path), split_bytes=split, **bounds)
    rows = lambda df: sorted((r["path"][len(str(tmp_path)) + 1:], r["position"], r["raw"]) for r in df.collect())
    want = []
    for name, text in whole.items():
        at = 0
        for line in text.split(b"\n")[:-1]:
            want.append((name, at, line.decode("utf-8", "replace")))
            at += len(line) + 1
    assert rows(read()) == sorted(want)
    bound = {str(tmp_path / name): rng.randrange(len(text)) for name, text in whole.items()}
    reached = positions.line_ends(str(tmp_path), bound)
    first, second = rows(read(ending=bound)), rows(read(starting=reached))
    assert first and second and sorted(first + second) == sorted(want)
    assert rows(read(starting={str(tmp_path / "a.log"): 10**9})) == sorted(want)  # a file started anew
    assert positions.listed(str(tmp_path / "none")) == {} and positions.positioned_lines(spark, str(tmp_path / "none")).count() == 0


def test_small_ranges_share_tasks_and_reads(spark, tmp_path):
    """Ranges of 4 KB: some TASKS tasks, each byte read once or a little more often, the same lines."""
    text = b"".join(b"line %d\n" % i for i in range(200_000))
    (tmp_path / "log").write_bytes(text)
    (tmp_path / "small").write_bytes(b"x\ny\n")
    df = positions.positioned_lines(spark, str(tmp_path), split_bytes=4096)
    assert df.rdd.getNumPartitions() <= positions.TASKS + 8 < len(text) // 4096
    whole = df.where("path LIKE '%/log'").selectExpr("count(*) n", "count(DISTINCT position) p", "sum(length(raw) + 1) size").first()
    assert tuple(whole) == (200_000, 200_000, len(text)) and df.where("path LIKE '%/small'").count() == 2

    class Counted(io.BytesIO):
        taken = 0

        def read_at(self, n, at):
            self.seek(at)
            block = self.read(n)
            self.taken += len(block)
            return block

    file = Counted(text)
    found = [s for low in range(0, len(text), 65536) for starts, _ in positions.lines_of(file, low, min(low + 65536, len(text)), len(text)) for s in starts]
    assert len(found) == 200_000 and found == sorted(set(found)) and file.taken < 1.2 * len(text)


def test_cursors_are_sent_to_the_entries(spark, tmp_path):
    """A join by host would gather all entries of a host in one task."""
    folder = tmp_path / "source_ip=10.0.0.1"
    folder.mkdir()
    (folder / "j").write_text('{"__CURSOR": "a"}\n{"__CURSOR": "b"}\n')
    cursors = spark.createDataFrame([("10.0.0.1", "a")], "source_ip string, cursor string")
    read = lines.journald_after(lines.tail_lines(spark, str(tmp_path)), cursors)
    assert [r["cursor"] for r in read.collect()] == ["b"]
    assert "SortMergeJoin" not in read._jdf.queryExecution().sparkPlan().toString()


def test_marks_are_sent_to_the_records(spark):
    """A join by channel would gather all records of a channel in one task."""
    marks = spark.createDataFrame([("A", 1)], "channel string, record_id bigint")
    records = spark.range(4).selectExpr("CASE WHEN id < 3 THEN 'A' ELSE 'B' END channel", "id record_number", "1L event_id", "TIMESTAMP '2024-01-01 00:00:00' time_generated",
                                        "4 event_type", "'s' source_name", "array('x') inserts")
    newer = lines.windows_records(records, marks)
    assert sorted(r["record_number"] for r in newer.collect()) == [2, 3]
    assert "SortMergeJoin" not in newer._jdf.queryExecution().sparkPlan().toString()


def test_middle_event(spark):
    from watchhouse.workload.files import _middle

    rng = random.Random(3)
    for ids in ([rng.randrange(40) for _ in range(101)], [7] * 10, [5, 1], [4], []):
        df = spark.createDataFrame([(i,) for i in ids], "event_id bigint")
        assert [r[0] for r in _middle(df).collect()] == (sorted(ids)[len(ids) // 2 - 1:len(ids) // 2] if len(ids) > 1 else [])


def test_stream_stopped_and_resumed(spark, tmp_path):
    """A file that grows between two runs: each line once, an unfinished line when it is finished."""
    logs = tmp_path / "in" / "source_ip=10.0.0.9"
    logs.mkdir(parents=True)
    file = logs / "syslog"

    def run():
        stream = lines.tail_lines(spark, str(tmp_path / "in"), streaming=True, split_bytes=16)
        writer = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True)
        writer.start(str(tmp_path / "out")).awaitTermination()
        return sorted((r["position"], r["raw"], r["source_ip"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    file.write_text("one line\nsame\nsame\n\nunfin")
    assert [r[1] for r in run()] == ["one line", "same", "same"]
    assert len(run()) == 3  # nothing new
    with file.open("a") as more:
        more.write("ished\nsame\n")
    (logs / "second").write_text("other file\n")
    got = run()
    assert [r[1] for r in got] == ["one line", "other file", "same", "same", "unfinished", "same"] or sorted(r[1] for r in got) == sorted(
        ["one line", "other file", "same", "same", "unfinished", "same"])
    records = [r["record_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert len(set(records)) == len(records) == 6 and {r[2] for r in got} == {"10.0.0.9"}


def test_journal_resumed_at_cursor(spark, tmp_path):
    for host, files in (("1", 2), ("2", 1), ("3", 1)):
        folder = tmp_path / f"source_ip=10.0.0.{host}"
        folder.mkdir()
        for f in range(files):
            (folder / f"j{f}").write_text("".join(f'{{"__CURSOR": "c{host}-{f}-{i}", "n": "{f}{i}"}}\n{{bad\n' for i in range(5)) + '{"no": "cursor"}\n')
    journal = lines.tail_lines(spark, str(tmp_path), split_bytes=50)
    cursors = spark.createDataFrame([("10.0.0.1", "c1-0-3"), ("10.0.0.2", "c2-0-9"), ("10.0.0.4", "kept")], "source_ip string, cursor string")
    read = lines.journald_after(journal, cursors, first_run=2)
    got = {}
    for r in read.collect():
        got.setdefault(r["source_ip"][-1], []).append(r["cursor"])
    assert sorted(got["1"], key=str) == sorted(["c1-0-4", None, *[f"c1-1-{i}" for i in range(5)], None], key=str)
    assert len(got["2"]) == 6 and sorted(got["3"], key=str) == sorted(["c3-0-4", None], key=str)
    assert {r[0]: r[1] for r in lines.new_cursors(read, cursors).collect()} == {
        "10.0.0.1": "c1-1-4", "10.0.0.2": "c2-0-4", "10.0.0.3": "c3-0-4", "10.0.0.4": "kept"}


def test_captures(spark, tmp_path):
    (tmp_path / "lines").write_bytes(b"first line\n  \nsecond \xff line\nunfinished")
    (tmp_path / "counted").write_bytes(b"7  padded6 line\n2")
    got = sorted(r["raw"] for r in lines.framed_captures(spark, str(tmp_path)).collect())
    assert got == sorted(["first line", "second � line", "padded", "line\n2"])


def test_unread_rest_of_a_capture_is_a_dead_letter(spark, tmp_path):
    large = b"x" * 1_200_000
    start = b"3 abc1200000 " + large + b"02 de"
    (tmp_path / "bad").write_bytes(start + b"7x broken" + b"2 no")
    (tmp_path / "long").write_bytes(b"3 abc" + b"9" * 5000 + b" x")
    (tmp_path / "good").write_bytes(b"2 ok")
    got = sorted(r["raw"] for r in lines.framed_captures(spark, str(tmp_path)).collect())
    assert got == sorted(["abc", "abc", "de", "ok", large.decode()])
    errors = {r["detail"].rsplit("/", 1)[1]: r for r in lines.framed_errors(spark, str(tmp_path)).collect()}
    assert set(errors) == {"bad", "long"} and all(r["received_at"] for r in errors.values())
    assert errors["bad"]["detail"].startswith(f"unread from byte {len(start)} of ") and errors["bad"]["raw"] == "7x broken2 no"
    assert errors["long"]["detail"].startswith("unread from byte 5 of ") and errors["long"]["raw"] == "9" * 5000 + " x"


def test_syslog_wrapping(spark):
    df = spark.createDataFrame([(0, "Jan 15 10:23:45 myhost sshd[123]: Login from 10.0.0.1"), (1, "short")], "i int, raw string").selectExpr(
        "*", "TIMESTAMP '2024-01-15 00:00:00' received_at")
    wrapped = lines.wrap_syslog(df, "here").selectExpr("i", "from_json(raw, 'map<string,string>') d").orderBy("i").collect()
    assert [{k: v for k, v in r["d"].items() if k != "timestamp"} for r in wrapped] == [
        {"hostname": "myhost", "program": "sshd[123]", "message": "Login from 10.0.0.1"}, {"hostname": "here", "program": "syslog", "message": "short"}]


def test_agent_batches(spark):
    bodies = [("ok", "Linux", '[{"a": 1}, 5, "{}", null, [1]]'), ("object", "linux", '{"a": 1}'), ("broken", "linux", "[1"), ("type", "fortigate", "[]"), ("empty", "windows", "[]")]
    df = spark.createDataFrame(bodies, "batch_id string, source_type string, body string").selectExpr("*", "'1.1.1.1' source_ip", "current_timestamp() received_at")
    assert [(r["batch_id"], r["is_object"]) for r in lines.agent_events(df).collect()] == [("ok", True)] + [("ok", False)] * 4
    assert {r["batch_id"] for r in lines.refused_batches(df).collect()} == {"object", "broken", "type"}


def _simulate(times, rate, capacity):
    tokens, last, allowed = capacity, None, []
    for now in times:
        tokens = min(capacity, tokens + (0 if last is None else (now - last).total_seconds()) * rate)
        last = now
        allowed.append(tokens >= 1)
        tokens -= allowed[-1]
    return allowed


@pytest.mark.parametrize("rate, capacity", [(1.0, 1.0), (0.5, 3.0), (2.0, 5.0)])
def test_token_bucket_against_simulation(spark, rate, capacity):
    rng, start = random.Random(7), datetime(2024, 1, 1)
    rows = []
    for ip, spread in (("hot", 60), ("warm", 400), ("cold", 40_000)):
        times = sorted(start + timedelta(milliseconds=250 * rng.randrange(spread * 4)) for _ in range(150))
        rows += [(ip, t, i, ok) for i, (t, ok) in enumerate(zip(times, _simulate(times, rate, capacity)))]
    df = spark.createDataFrame(rows, "source_ip string, received_at timestamp, i int, expected boolean")
    wrong = rate_limit.rate_limit(df, "i", rate, capacity).filter("allowed <> expected")
    assert wrong.count() == 0
    dropped = sum(r["dropped"] for r in rate_limit.drops_per_minute(rate_limit.rate_limit_counts(df, rate, capacity)).collect())
    assert dropped == sum(not r[3] for r in rows) > 0


def test_integrity_details(spark):
    digest = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    df = spark.createDataFrame([("1", "x", None), ("2", None, "h"), ("3", "x", "h"), ("4", "", digest), ("5", "x", "")], "id string, raw_message string, raw_hash string")
    df = df.unionByName(spark.sql("SELECT '6' id, '<134>line' raw_message, sha2('<134>line', 256) raw_hash"))
    got = {r["id"]: (r["intact"], (r["detail"] or "")[:14]) for r in integrity.verify_integrity(df).collect()}
    assert got == {"1": (False, "No raw_hash st"), "2": (False, "No raw_message"), "3": (False, ""), "4": (False, "No raw_message"),
                   "5": (False, "No raw_hash st"), "6": (True, "")}
    assert spark.sql("SELECT sha2('', 256)").first()[0] == digest


@pytest.mark.parametrize("days, action", [(365, "keep"), (366, "cool"), (730, "cool"), (731, "archive"), (2192, "archive"), (2193, "delete")])
def test_retention(spark, days, action):
    files = spark.createDataFrame([("f", datetime(2024, 1, 1) - timedelta(days=days), 1)], "path string, modificationTime timestamp, length bigint")
    assert integrity.retention_plan(files, "2024-01-01 00:00:00").first()["action"] == action
