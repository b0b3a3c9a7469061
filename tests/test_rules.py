"""Rule evaluation on small fixtures, against brute force where the logic is involved."""

import itertools
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from watchhouse.operators import filters
from watchhouse.plans import anomaly, blacklist, run_rules, sequence, threshold
from watchhouse.plans.rule_bodies import SEEDED_RULES, make_rule, valid_rules, validate_rules
from watchhouse.schema import EVENTS, RULES

NOW = "2024-01-31 00:00:00"
T0 = datetime(2024, 1, 30)


@pytest.fixture(scope="module")
def events(spark):
    def make(rows):
        """Rows of field dictionaries; the rest of the event is empty."""
        names = EVENTS.fieldNames()
        full = [tuple({"id": str(i), "source_host": "h", "message": "m", **r}.get(n) for n in names) for i, r in enumerate(rows)]
        return spark.createDataFrame(full, EVENTS)

    return make


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def test_validation(spark):
    bodies = [
        ("threshold", '{"group_by": "message", "window_seconds": 5}', ["bad group_by"]),
        ("threshold", '{"group_by": "raw_message", "window_seconds": 5}', ["bad group_by"]),
        ("threshold", '{"group_by": "src_ip", "count": 0, "window_seconds": 5}', ["bad count"]),
        ("threshold", '{"window_seconds": 60, "outside_hours": {"start": 24, "end": 1}}', ["bad outside_hours"]),
        ("threshold", '{"window_seconds": 60, "aggregate": {"field": "x", "op": "ne", "value": 1}}', ["bad aggregate"]),
        ("sequence", '{"steps": [{"event_id": "1"}], "group_by": "src_ip", "window_seconds": 5}', ["fewer than two steps"]),
        ("sequence", '{"steps": [{"event_id": "1"}, {}], "group_by": "src_ip", "window_seconds": 5}',
         ["step without event_id, action or category"]),
        ("anomaly", "{}", []), ("absence", "{}", ["bad window_seconds"]), ("nonsense", "{}", ["unknown rule type"]),
        ("blacklist", '{"field": "message", "list_name": "x"}', ["bad field"]),
    ]
    df = spark.createDataFrame([(i, k, b) for i, (k, b, _) in enumerate(bodies)], "id int, rule_type string, body string")
    got = {r["id"]: r["problems"] for r in validate_rules(df).collect()}
    assert got == {i: p for i, (_, _, p) in enumerate(bodies)}


def test_seeded_rules_are_valid(spark):
    rows = [(str(i), n, d, k, s, True, b, T0, T0) for i, (n, d, k, s, b) in enumerate(SEEDED_RULES)]
    assert valid_rules(spark.createDataFrame(rows, RULES)).count() == 12


@pytest.mark.parametrize("start, end, kept", [(9, 17, [3, 8, 17, 22]), (20, 6, [8, 9, 16, 17]), (9, 9, [])])
def test_outside_hours(spark, start, end, kept):
    hours = [3, 8, 9, 16, 17, 22]
    df = spark.createDataFrame([(T0.replace(hour=h),) for h in hours], "t timestamp")
    got = [r[0].hour for r in df.filter(filters.outside_hours(F.col("t"), start, end)).collect()]
    assert sorted(got) == [h for h in kept if (start, end) != (20, 6) or 6 <= h < 20]


def test_null_tags_do_not_match(events):
    df = events([{"received_at": at(1), "tags": None}, {"received_at": at(1), "tags": ["a", "b"]}, {"received_at": at(1), "tags": ["a"]}])
    assert df.filter(filters.event_filter({"tags": ["a", "b"]})).count() == 1


def test_ungrouped_aggregate_and_compat(events):
    df = events([{"received_at": at(1), "source_type": "fortigate", "extra": {"sentbyte": "5"}},
                 {"received_at": at(2), "source_type": "fortigate", "extra": {"sentbyte": "oops"}}])
    rule = make_rule("x", "Exfil", "threshold", "high", {"filters": {"source_type": "fortigate"}, "window_seconds": 999999,
                                                         "aggregate": {"field": "sentbyte", "op": "gt", "value": 100}})
    assert threshold.threshold_rule(df, rule, NOW).count() == 0
    assert threshold.threshold_rule(df, rule, NOW, compat=True).first()["event_count"] == 2


@pytest.mark.parametrize("op, fires", [("gt", False), ("gte", True), ("lt", False), ("lte", True), ("eq", True)])
def test_aggregate_operators(events, op, fires):
    df = events([{"received_at": at(1), "src_ip": "a", "extra": {"v": "10"}}, {"received_at": at(1), "src_ip": "a", "extra": {"v": "9.5"}}])
    rule = make_rule("x", "n", "threshold", "low", {"group_by": "src_ip", "window_seconds": 999999, "aggregate": {"field": "v", "op": op, "value": 10}})
    assert (threshold.threshold_rule(df, rule, NOW).count() == 1) is fires


def _random_rows(n, seed, users=4):
    rng = random.Random(seed)
    kinds = ["a", "b", "c", "d"]
    # one address holds about half of the rows; times repeat
    return [{"received_at": at(rng.randrange(0, 600)), "src_ip": rng.choice(["hot", "hot", "hot", "x", "y", None]),
             "event_id": rng.choice(kinds), "user_name": rng.choice(["u1", "u2", "", None])} for _ in range(n)]


def test_one_pass_equals_rule_by_rule(events):
    df = events(_random_rows(200, 1)).cache()
    month = {"window_seconds": 40 * 86400}
    rules = [
        make_rule("1", "a", "threshold", "low", {"filters": {"event_id": ["a"]}, "group_by": "src_ip", "count": 3, **month}),
        make_rule("2", "b", "threshold", "low", {"filters": {"event_id": ["a", "b"]}, "group_by": "user_name", "distinct_users": 1, **month}),
        make_rule("3", "c", "threshold", "low", {"count": 150, **month}),
        make_rule("4", "d", "threshold", "low", {"filters": {"event_id": ["c"]}, "distinct_users": 2, **month}),
    ]
    together = {(r["rule_id"], r["title"], r["event_count"], r["first_seen"], r["group_key"])
                for r in threshold.threshold_triggers(df, rules, NOW).collect()}
    apart = {(r["rule_id"], r["title"], r["event_count"], r["first_seen"], r["group_key"])
             for rule in rules for r in threshold.threshold_rule(df, rule, NOW).collect()}
    assert together == apart and len(together) > 4


def _brute_pairs(rows, steps):
    """Distinct (group, first, last) over all chains, by enumeration."""
    found = set()
    for group in {r["src_ip"] for r in rows} - {None}:
        times = [sorted({r["received_at"] for r in rows if r["src_ip"] == group and r["event_id"] == s}) for s in steps]
        for combo in itertools.product(*times):
            if all(a < b for a, b in zip(combo, combo[1:])):
                found.add((group, combo[0], combo[-1]))
    return found


@pytest.mark.parametrize("steps", [["a", "b"], ["a", "a"], ["a", "b", "c"], ["b", "a", "b"], ["a", "b", "c", "d"]])
@pytest.mark.parametrize("slices", [1, 7, 4096])  # rows of a slice
def test_sequence_against_enumeration(events, steps, slices):
    rows = _random_rows(60, len(steps))
    pairs = _brute_pairs(rows, steps)
    rule = make_rule("s", "Seq", "sequence", "high", {"steps": [{"event_id": s} for s in steps], "group_by": "src_ip", "window_seconds": 86400})
    df = events(rows)
    starts = {(r["grp"], r["ts"]): (r["n"], r["nearest"], r["farthest"]) for r in sequence.chains(df, rule, NOW, "start", slices).collect()}
    ends = {(r["grp"], r["ts"]): (r["n"], r["nearest"], r["farthest"]) for r in sequence.chains(df, rule, NOW, "completion", slices).collect()}
    want_starts, want_ends = {}, {}
    for g, a, b in pairs:
        want_starts.setdefault((g, a), []).append(b)
        want_ends.setdefault((g, b), []).append(a)
    assert starts == {k: (len(v), min(v), max(v)) for k, v in want_starts.items()}
    assert ends == {k: (len(v), max(v), min(v)) for k, v in want_ends.items()}
    fired = {r["src_ip"]: (r["event_count"], r["first_seen"], r["last_seen"]) for r in sequence.sequence_rule(df, rule, NOW, slices).collect()}
    groups = {g for g, _, _ in pairs}
    assert fired == {g: (len(steps) * sum(p[0] == g for p in pairs), min(p[1] for p in pairs if p[0] == g),
                         max(p[2] for p in pairs if p[0] == g)) for g in groups}


def test_anomaly(events):
    rows = [{"received_at": T0 - timedelta(hours=h, minutes=m), "src_ip": "a"} for h in range(1, 40) for m in range(2 + h % 2)]
    quiet = make_rule("n", "Quiet", "anomaly", "low", {"window_seconds": 86400 + 3600, "std_devs": 300, "group_by": "src_ip"})
    loud = make_rule("n", "Loud", "anomaly", "low", {"window_seconds": 86400 + 3600, "group_by": "src_ip"})
    df = events(rows)
    assert anomaly.anomaly_rule(df, quiet, "2024-01-30 00:00:00").count() == 0
    row = anomaly.anomaly_rule(df, loud, "2024-01-30 00:00:00").first()
    assert row["title"] == "Loud: a" and "σ above 7-day baseline" in row["description"] and set(row["extra"]) == {"z_score", "mean", "stddev"}
    flat = events([{"received_at": T0 - timedelta(hours=h)} for h in range(1, 10)])
    assert anomaly.anomaly_rule(flat, make_rule("n", "Flat", "anomaly", "low", {}), "2024-01-30 00:00:00").count() == 0


def test_anomaly_and_blacklist_rules_share_a_pass(spark, events):
    rows = _random_rows(300, 5) + [{"received_at": T0 - timedelta(hours=h), "src_ip": "x", "event_id": "a"} for h in range(1, 50)]
    df = events(rows).cache()
    body = {"std_devs": 0.5, "window_seconds": 86400}
    odd = [make_rule("1", "one", "anomaly", "low", {**body, "group_by": "src_ip"}), make_rule("2", "two", "anomaly", "low", body),
           make_rule("3", "three", "anomaly", "low", {**body, "group_by": "user_name", "baseline_days": 1, "filters": {"event_id": ["a", "b"]}})]
    together = {tuple(map(str, r)) for r in anomaly.anomaly_triggers(df, odd, "2024-01-30 00:20:00").collect()}
    apart = {tuple(map(str, r)) for rule in odd for r in anomaly.anomaly_rule(df, rule, "2024-01-30 00:20:00").collect()}
    assert together == apart and {r[0] for r in together} >= {"1", "2"}

    lists = spark.createDataFrame([("l", "hot"), ("l", "hot"), ("l", "a"), ("m", "x"), ("m", "a")], "list_name string, value string")
    bad = [make_rule(i, f"b{i}", "blacklist", "low", {"field": f, "list_name": n}) for i, f, n in (("1", "src_ip", "l"), ("2", "src_ip", "m"), ("3", "event_id", "l"))]
    got = {(r["group_key"], r["event_count"]) for r in blacklist.blacklist_triggers(df, lists, bad, "2024-01-30 00:20:00").collect()}
    recent = [r for r in rows if r["received_at"] >= T0 - timedelta(minutes=10)]
    want = {(f"1:src_ip:hot", sum(r["src_ip"] == "hot" for r in recent)), ("2:src_ip:x", sum(r["src_ip"] == "x" for r in recent)),
            ("3:event_id:a", sum(r["event_id"] == "a" for r in recent))}
    assert got == want


def test_run_all_skips_bad_rules(spark, events):
    rows = [("1", "ok", "", "absence", "low", True, '{"window_seconds": 60}', T0, T0), ("2", "bad", "", "absence", "low", True, "{}", T0, T0),
            ("3", "off", "", "absence", "low", False, '{"window_seconds": 60}', T0, T0)]
    rules = spark.createDataFrame(rows, RULES)
    lists = spark.createDataFrame([], "list_name string, value string")
    got = run_rules.run_all(events([{"received_at": at(0)}]), lists, rules, NOW).collect()
    assert [(r["rule_id"], r["group_key"], r["event_count"]) for r in got] == [("1", "1:absent", 0)]
    assert run_rules.run_all(events([]), lists, rules, NOW, ["threshold"]).count() == 0


def test_ill_typed_steps_are_reported(spark):
    from pyspark.sql import functions as F

    from watchhouse.plans.rule_bodies import rule_problems

    def body(steps):
        return f'{{"steps": {steps}, "group_by": "src_ip", "window_seconds": 60}}'

    cases = {
        '[{"event_id": "1"}, {"event_id": "2", "action": null}]': [],
        '[{"event_id": 4625}, {"event_id": "2"}]': ["step field is not text"],
        '[{"event_id": {"x": "1"}}, {"event_id": "2"}]': ["step field is not text"],
        '[{"event_id": "1", "log_level": 3}, {"event_id": "2"}]': ["step field is not text"],
        '[{"event_id": "1"}, null]': ["step field is not text", "step without event_id, action or category"],
        '[{"event_id": "1"}, {"log_level": "x"}]': ["step without event_id, action or category"],
    }
    rows = spark.createDataFrame([(steps, body(steps)) for steps in cases], "steps string, body string")
    got = {r["steps"]: r["p"] for r in rows.select("steps", rule_problems(F.lit("sequence"), F.col("body")).alias("p")).collect()}
    assert {k: [p for p in v if p] for k, v in got.items()} == cases


def test_many_sequence_rules_in_one_pass(events, monkeypatch):
    """Rules of two to five steps, groups and windows of their own: as each by itself; the events are read once."""
    rows = _random_rows(300, 9)
    df = events(rows)
    rng = random.Random(4)
    rules = [make_rule(str(i), f"n{i}", "sequence", "low", {"steps": [{"event_id": rng.choice("abcd")} for _ in range(2 + i % 4)],
                                                           "group_by": ["src_ip", "user_name"][i % 2], "window_seconds": 86400 * (i % 3 + 1)}) for i in range(12)]
    shown = lambda out: sorted((r["rule_id"], r["title"], r["description"], r["event_count"], r["first_seen"], r["last_seen"], r["extra"]["chains"]) for r in out.collect())
    together = shown(sequence.sequence_triggers(df, rules, NOW, 5))
    assert together == sorted(x for rule in rules for x in shown(sequence.sequence_rule(df, rule, NOW))) and len(together) > 20
    written = []
    cut = sequence.cut_lineage
    monkeypatch.setattr(sequence, "cut_lineage", lambda frame, purpose: written.append(purpose) or cut(frame, purpose))
    sequence.sequence_triggers(df, rules, NOW)
    assert written == ["sequence-steps", "sequence-slices"]


def test_plan_does_not_grow_with_steps(events):
    df = events(_random_rows(40, 2))

    def plan(n):
        rule = make_rule("s", "n", "sequence", "low", {"steps": [{"event_id": "abcd"[i % 4]} for i in range(n)], "group_by": "src_ip", "window_seconds": 86400})
        return len(sequence.sequence_rule(df, rule, NOW)._jdf.queryExecution().optimizedPlan().toString().splitlines())

    assert plan(2) == plan(20)


def test_a_hot_minute_is_cut(events):
    """One address, thousands of instants within seconds: slices by rows, equal to counting."""
    rows = [{"received_at": T0 + timedelta(microseconds=i * 100), "src_ip": "hot", "event_id": "ab"[i % 2]} for i in range(3000)]
    rule = make_rule("s", "n", "sequence", "low", {"steps": [{"event_id": "a"}, {"event_id": "b"}], "group_by": "src_ip", "window_seconds": 86400})
    got = sequence.sequence_rule(events(rows), rule, NOW, 64).first()
    assert got["event_count"] == 2 * sum(range(1, 1501)) and got["first_seen"] == rows[0]["received_at"] and got["last_seen"] == rows[-1]["received_at"]


def test_sketched_users(spark, events):
    """Panes with sketches: one row a group and pane, numbers within five standard errors and one user."""
    rows = [{"received_at": at(i % 600), "src_ip": ip, "event_id": "a", "user_name": f"u{i * 7 % users}"} for ip, users in (("few", 90), ("many", 20_000)) for i in range(max(200, users))]
    df = events(rows)
    rule = make_rule("d", "n", "threshold", "low", {"group_by": "src_ip", "distinct_users": 10, "window_seconds": 86400})
    exact = threshold.threshold_panes(df, [rule])
    sketched = threshold.threshold_panes(df, [rule], sketches=True)
    assert exact.count() > 20_000 and sketched.count() == 20 + 7
    got = {r["src_ip"]: r["event_count"] for r in threshold.threshold_tick(sketched, df, [rule], "2024-01-30 00:09:45", sketches=True).collect()}
    want = {r["src_ip"]: r["event_count"] for r in threshold.threshold_tick(exact, df, [rule], "2024-01-30 00:09:45").collect()}
    assert set(got) == set(want) == {"few", "many"} and want["few"] == 90 and abs(got["few"] - 90) <= 1
    assert abs(got["many"] / want["many"] - 1) < 5 * 1.04 / 2 ** (threshold.SKETCH_BITS / 2)
