"""Streams that stop and continue."""

import os
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from watchhouse.plans.rule_bodies import make_rule
from watchhouse.sources.lines import syslog_lines
from watchhouse.streaming import ingest, rules
from watchhouse.streaming.rate_limit import rate_limit_stream

T0 = datetime(2024, 1, 1)


def _append(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def _run(stream, out, checkpoint):
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()


def test_ingest_continues_where_it_stopped(spark, tmp_path):
    folder = tmp_path / "in" / "source_ip=10.0.0.7"
    folder.mkdir(parents=True)
    sources = spark.createDataFrame([], "ip_address string, source_type string, label string, enabled boolean, pci_env boolean")
    out = str(tmp_path / "out")
    for number, text in enumerate(["type=event user=a\n\nfree text\n", "type=event user=b\n%ASA-6-302014: bye\n"]):
        (folder / f"{number}.log").write_text(text)
        stream = syslog_lines(spark, str(tmp_path / "in"), streaming=True)
        ingest.start_ingest(stream, sources, out, f"{out}-checkpoint", "2024-01-02 00:00:00", interval=None).awaitTermination()
    events = spark.read.parquet(f"{out}/events")
    assert {(r["source_type"], r["user_name"]) for r in events.collect()} == {
        ("cisco_asa", None), ("fortigate", "a"), ("fortigate", "b")}
    assert events.count() == 3 and {r["source_ip"] for r in spark.read.parquet(f"{out}/errors").collect()} == {"10.0.0.7"}
    assert spark.read.text(f"{out}/archive").filter("day = 2 AND value LIKE 'type=%'").count() == 2
    # without a given time a line lies under the day of its own receipt, whenever the batch runs
    long_ago = datetime(2023, 5, 6, 12, tzinfo=timezone.utc).timestamp()
    os.utime(folder / "0.log", (long_ago, long_ago))
    dated = str(tmp_path / "dated")
    stream = syslog_lines(spark, str(tmp_path / "in"), streaming=True)
    ingest.start_ingest(stream, sources, dated, f"{dated}-checkpoint", interval=None).awaitTermination()
    assert spark.read.text(f"{dated}/archive").filter("year = 2023 AND month = 5 AND day = 6").count() == 1


def _second(seconds):
    return T0 + timedelta(seconds=seconds)


def _sequence(spark, tmp_path, rule, batches):
    """Completions after each batch has been run as its own micro-batch, then one row that moves the watermark on."""
    schema = "src_ip string, event_id string, received_at timestamp"
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in [*batches, [("end", rule.body["steps"][0]["event_id"], _second(100_000))]]:
        _append(spark, path, rows, schema)
        events = spark.readStream.schema(schema).parquet(path).selectExpr("*", "'h' AS source_host")
        _run(rules.sequence_stream(events, rule), out, f"{out}-checkpoint")
    return sorted((r["src_ip"], r["first_seen"], r["last_seen"]) for r in spark.read.parquet(out).collect())


def _ab():
    return make_rule("s", "S", "sequence", "low", {"steps": [{"event_id": "a"}, {"event_id": "b"}], "group_by": "src_ip", "window_seconds": 100})


def test_sequence_state_spans_batches(spark, tmp_path):
    batches = [[("x", "a", T0), ("x", "a", _second(10)), ("y", "a", T0)],
               [("x", "b", _second(10)), ("x", "b", _second(20)), ("y", "b", _second(101))]]
    # a start of the same instant does not count, nor one outside the window
    assert _sequence(spark, tmp_path, _ab(), batches) == [("x", T0, _second(10)), ("x", _second(10), _second(20))]


def test_sequence_ignores_the_order_of_arrival(spark, tmp_path):
    # the start of y comes after a completion that lies before it; that of x, late but in time, before its completion
    batches = [[("y", "a", _second(50)), ("x", "b", _second(55))], [("y", "b", _second(40)), ("x", "a", _second(45))]]
    assert _sequence(spark, tmp_path, _ab(), batches) == [("x", _second(45), _second(55))]


def test_sequence_rows_without_a_time(spark, tmp_path):
    batches = [[("x", "a", T0), ("x", "a", None), ("x", "b", None), ("y", "b", None)], [("x", "b", _second(10)), (None, "b", None)]]
    assert _sequence(spark, tmp_path, _ab(), batches) == [("x", T0, _second(10))]


def test_rules_come_and_go_between_runs(spark, tmp_path):
    """Three rules of different windows in one stream; one is added and one taken away before the second run."""
    schema = "src_ip string, event_id string, received_at timestamp"
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    make = lambda name, steps, window: make_rule(name, name, "sequence", "low", {"steps": [{"event_id": s} for s in steps], "group_by": "src_ip", "window_seconds": window})
    short, long, three, new = make("short", "ab", 10), make("long", "ab", 1000), make("three", "abc", 1000), make("new", "cd", 1000)

    def run(rows, wanted):
        _append(spark, path, rows, schema)
        events = spark.readStream.schema(schema).parquet(path).selectExpr("*", "'h' AS source_host")
        _run(rules.sequence_streams(events, wanted), out, f"{out}-checkpoint")

    run([("x", "a", T0), ("x", "b", _second(50)), ("y", "a", _second(51)), ("y", "b", _second(55))], [short, long, three])
    run([("x", "c", _second(60)), ("y", "b", _second(200))], [long, three, new])
    run([("x", "d", _second(300)), ("end", "a", _second(100_000))], [long, three, new])
    got = sorted((r["rule_id"], r["src_ip"], int((r["first_seen"] - T0).total_seconds()), int((r["last_seen"] - T0).total_seconds())) for r in spark.read.parquet(out).collect())
    # 'short' of y ends after the first run's watermark, when the rule is gone
    assert got == [("long", "x", 0, 50), ("long", "y", 51, 55), ("long", "y", 51, 200), ("new", "x", 60, 300), ("three", "x", 0, 60)]


def test_sequence_triggers_are_not_broadcast(spark, tmp_path):
    """The last batch has no new rows and finds the chains of all that waited: the rules go to them, not they to the rules."""
    schema = "src_ip string, event_id string, received_at timestamp"
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    _append(spark, path, [("x", "a", T0), ("x", "b", _second(10)), ("end", "a", _second(100_000))], schema)
    events = spark.readStream.schema(schema).parquet(path).selectExpr("*", "'h' AS source_host")
    started = rules.sequence_stream(events, _ab()).writeStream.format("parquet").option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start(out)
    started.awaitTermination()
    plan = started._jsq.explainInternal(False)
    assert started.lastProgress["numInputRows"] == 0 and "BuildRight" in plan and "BuildLeft" not in plan, plan
    assert [(r["src_ip"], r["last_seen"]) for r in spark.read.parquet(out).collect()] == [("x", _second(10))]


def test_sequence_calls_grow_with_groups():
    """1 200 instants of one group, each in a bucket of its own: a timer for the first bucket and one for the cleanup."""
    from types import SimpleNamespace

    import pandas as pd

    calls = []

    class Value:
        value = None

        def get(self):
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

        def clear(self):
            self.value = None

    class Listed:
        def __init__(self):
            self.values = []

        def get(self):
            return iter(self.values)

        def appendValue(self, value):
            calls.append("append")
            self.values.append(value)

        def put(self, values):
            calls.append("put")
            self.values = list(values)

        def clear(self):
            self.values = []

    timers = set()
    state = rules._SequenceState()
    state.init(SimpleNamespace(getValueState=lambda *a: Value(), getListState=lambda *a: Listed(), registerTimer=timers.add))
    part = pd.DataFrame({"at": [(60 * i + 1) * 1_000_000 for i in range(1200)], "steps": [1 + i % 2 for i in range(1200)]}).assign(n_steps=2, window=3600 * 1_000_000, bucket=30_000)
    at = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    assert not list(state.handleInputRows(("r", "g"), iter([part.iloc[:0], part.iloc[::-1]]), at(0))) and timers == {30_000}
    found = []
    for watermark in (3_630_000, 10**9):  # part of them, then all that is left
        fired = sorted(t for t in timers if t <= watermark)
        timers.difference_update(fired)
        for t in fired:
            found += [tuple(r) for f in state.handleExpiredTimer(("r", "g"), at(watermark), SimpleNamespace(getExpiryTimeInMs=lambda t=t: t)) for r in f[["first", "last"]].values.tolist()]
        if watermark < 10**9:
            assert len(found) == 30 and len(timers) == 1
    assert found == [((60 * i - 59) * 1_000_000, (60 * i + 1) * 1_000_000) for i in range(1, 1200, 2)]
    assert not timers and state.state.get() is None and not state.waiting.values and len(calls) < 12


def test_sequence_calls_do_not_grow_with_groups():
    """300 groups of one shard in random micro-batches, each late row in time: the chains of a walk over all rows, a few calls a batch, nothing kept."""
    import random
    from types import SimpleNamespace

    import pandas as pd

    calls, timers, bucket, window = [], set(), 30_000, 500 * 1_000_000

    class Stored:
        def __init__(self, empty):
            self.value, self.empty = empty(), empty

        def get(self):
            return self.value if self.empty is not list else iter(self.value)

        def put(self, value):
            calls.append("put")
            self.value = value

        def appendValue(self, value):
            self.put([*self.value, value])

        def clear(self):
            self.put(self.empty())

        update = put

    state = rules._SequenceState()
    state.init(SimpleNamespace(getValueState=lambda *a: Stored(lambda: None), getListState=lambda *a: Stored(list), registerTimer=timers.add))
    draw = random.Random(4)
    rows = [(f"g{draw.randrange(300)}", draw.randrange(4000) * 1_000_000, 1 << draw.randrange(3)) for _ in range(6000)]
    rows.sort(key=lambda r: r[1] + draw.randrange(60_000_000))  # up to a minute late
    found = []
    at = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)

    def batch(part, watermark):
        frame = pd.DataFrame(part, columns=["grp", "at", "steps"]).assign(n_steps=3, window=window, bucket=bucket)
        list(state.handleInputRows(("r", 7), iter([frame[:100], frame[100:]]), at(watermark)))
        for t in sorted(t for t in timers if t <= watermark):
            timers.discard(t)
            for f in state.handleExpiredTimer(("r", 7), at(watermark), SimpleNamespace(getExpiryTimeInMs=lambda t=t: t)):
                assert set(f["rule_id"]) == {"r"}
                found.extend(f[["grp", "first", "last"]].itertuples(index=False, name=None))

    for low in range(0, len(rows), 300):
        batch(rows[low:low + 300], max(0, max([r[1] for r in rows[:low]], default=0) // 1000 - 60_000))
    for watermark in (4_100_000, 10_000_000):  # the rest, then the chains that are kept
        batch([], watermark)
    wanted = []
    for grp in {r[0] for r in rows}:
        reached = [None] * 3
        marks = {}
        for _, moment, step in (r for r in rows if r[0] == grp):
            marks[moment] = marks.get(moment, 0) | step
        for moment in sorted(marks):
            starts = [moment, *reached[:2]]
            for k in range(3):
                if marks[moment] >> k & 1 and starts[k] is not None and moment - starts[k] <= window:
                    reached[k] = starts[k]
                    wanted += [(grp, starts[k], moment)] * (k == 2)
    assert sorted(found) == sorted(wanted) and len(wanted) > 200
    assert len(calls) < 200 and not timers and state.state.value is None and not state.waiting.value and not state.chains.value


def test_sequence_state_in_parts():
    """Values of a bounded size; a group may go on in the next one."""
    names, at, steps = ["b", "a", "b", "b", "c", "b"], [3, 1, 1, 3, 9, 2], [1, 2, 4, 2, 1, 8]
    grouped = rules._by_group(np.array(names, object), np.array(at), np.array(steps))
    for most in (1, 2, 3, 5, 100):
        parts = rules._parts(*grouped, most)
        assert all(len(p[2]) <= most and sum(p[1]) == len(p[2]) and min(p[1]) > 0 for p in parts)
        back = [x.tolist() for x in rules._instants(parts)]
        assert list(zip(*back)) == [("b", 1, 4), ("b", 2, 8), ("b", 3, 3), ("a", 1, 2), ("c", 9, 1)]
    assert rules._chain_parts({"a": [1, None], "b": [2, 1]}, 1) == [(["a"], [1, None]), (["b"], [2, 1])]


def test_absence_reports_every_silent_tick(spark):
    from watchhouse.plans.threshold import absence_ticks

    events = spark.createDataFrame([("a", _second(s)) for s in (0, 95, 300)], "event_id string, received_at timestamp").withColumn("src_ip", F.lit("x")).withColumn(
        "extra", F.create_map().cast("map<string,string>"))
    every, other = (make_rule(name, name, "absence", "low", {"filters": {"event_id": [wanted]}, "window_seconds": 60}) for name, wanted in (("e", "a"), ("o", "z")))
    ticks = spark.createDataFrame([(_second(s),) for s in (60, 61, 94, 95, 155, 156, 299, 360, 360)] + [(None,)], "as_of timestamp")
    got = sorted((r["rule_id"], int((r["last_seen"] - T0).total_seconds())) for r in absence_ticks(events, [every, other], ticks).collect())
    assert got == [("e", s) for s in (61, 94, 156, 299)] + [("o", s) for s in (60, 61, 94, 95, 155, 156, 299, 360)]
    assert absence_ticks(events, [every], ticks.limit(0)).count() == 0


def test_bucket_state_spans_batches(spark, tmp_path):
    schema = "source_ip string, received_at timestamp"
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in ([("x", T0)] * 3, [("x", T0 + timedelta(milliseconds=500)), ("x", T0 + timedelta(seconds=1))]):
        _append(spark, path, rows, schema)
        _run(rate_limit_stream(spark.readStream.schema(schema).parquet(path), 1.0, 2.0), out, f"{out}-checkpoint")
    got = [(r["n"], r["allowed"]) for r in spark.read.parquet(out).orderBy("received_at").collect()]
    assert got == [(3, 2), (1, 0), (1, 1)]


def test_alert_changes_written_twice(spark, tmp_path):
    """The table after a merge does not change when its changes are appended again, and the history stays as it was written."""
    from watchhouse.operators.alerts import merge_triggers
    from watchhouse.schema import ALERTS, TRIGGERS
    from watchhouse.sources import sinks

    path, now = str(tmp_path / "alerts"), "2024-01-02 00:00:00"
    fired = spark.createDataFrame([("r", "low", "t", "d", None, None, T0, T0, 2, "r:a", {})], TRIGGERS)
    sinks.write_alert_changes(merge_triggers(spark.createDataFrame([], ALERTS), fired, "2024-01-01 12:00:00"), path, None)
    merged = merge_triggers(sinks.read_alerts(spark, path), fired, now)
    for _ in range(2):
        sinks.write_alert_changes(merged, path, now)
    assert [r["event_count"] for r in sinks.read_alerts(spark, path).collect()] == [4]
    assert sorted(r["event_count"] for r in spark.read.parquet(path).collect()) == [2, 4, 4]


@pytest.mark.parametrize("mode", ["accumulate", "replace"])
def test_alerts_as_state(spark, tmp_path, mode):
    """Triggers and patches over several micro-batches: as merge_triggers and patch_alerts would have it."""
    from watchhouse.operators.alerts import latest_alerts
    from watchhouse.schema import TRIGGERS
    from watchhouse.streaming import alert_state

    fires, patches, out = (str(tmp_path / n) for n in ("fires", "patches", "out"))
    patch_schema = "alert_id string, rule_id string, group_key string, at timestamp, status string, assigned_to string"
    spark.createDataFrame([], TRIGGERS).write.parquet(fires)
    spark.createDataFrame([], patch_schema).write.parquet(patches)

    def fire(second, count, key="r:a", text="d", extra=None):
        return ("r", "low", "t", text, "a", None, _second(second - 5), _second(second), count, key, extra or {})

    def run(triggers, patched=()):
        spark.createDataFrame(triggers, TRIGGERS).write.mode("append").parquet(fires)
        spark.createDataFrame(list(patched), patch_schema).write.mode("append").parquet(patches)
        rows = alert_state.trigger_rows(spark.readStream.schema(TRIGGERS).parquet(fires)).unionByName(
            alert_state.patch_rows(spark.readStream.schema(patch_schema).parquet(patches)))
        _run(alert_state.alert_changes(rows, mode), out, f"{out}-checkpoint")
        return {r["group_key"]: r for r in latest_alerts(spark.read.parquet(out)).where("status = 'open'").collect()}

    first = run([fire(10, 2), fire(20, 3, text="later", extra={"k": "1"}), fire(7, 1, "r:b"), fire(9, 4, None)])
    a = first["r:a"]
    assert (a["event_count"], a["first_seen"], a["last_seen"], a["description"], a["extra"], a["src_ip"]) == (5, _second(5), _second(20), "later", {"k": "1"}, "a")
    assert set(first) == {"r:a", "r:b", None} and first[None]["event_count"] == 4
    second = run([fire(40, 6)], [(a["id"], "r", "r:a", _second(41), None, "analyst"), (a["id"], "r", "r:a", _second(41), "bogus", None)])["r:a"]
    assert (second["event_count"], second["first_seen"], second["assigned_to"], second["extra"]) == (11 if mode == "accumulate" else 6, _second(5), "analyst", {"k": "1"})
    assert second["id"] == a["id"] and second["created_at"] == a["created_at"]
    run([], [(a["id"], "r", "r:a", _second(50), "closed", None)])
    third = run([fire(60, 1)])["r:a"]
    assert third["id"] != a["id"] and third["event_count"] == 1
    table = latest_alerts(spark.read.parquet(out)).collect()
    assert sorted((r["group_key"] or "", r["status"]) for r in table) == [("", "open"), ("r:a", "closed"), ("r:a", "open"), ("r:b", "open")]
    changes = spark.read.parquet(out).where(f"id = '{a['id']}'").orderBy("version").collect()
    assert [r["version"] for r in changes] == list(range(1, len(changes) + 1))
