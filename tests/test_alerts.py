"""Alert merging and table changes on small fixtures."""

import random
from datetime import datetime
from ipaddress import ip_address, ip_network

import pytest

from watchhouse.operators import alerts, catalog, enrich, paging
from watchhouse.schema import ALERTS, EVENTS, RULES, SOURCES, TRIGGERS

NOW = "2024-02-01 00:00:00"
D = [datetime(2024, 1, day) for day in range(1, 20)]


def alert(id, key, status="open", created=D[0], count=10, rule="r"):
    return (id, rule, "high", status, "t", "old", None, None, D[0], D[1], count, None, {"z": "1"}, key, created, created)


def trigger(key, count, last=D[5], description="new", rule="r", extra=None):
    return (rule, "low", "title", description, None, None, D[3], last, count, key, extra or {})


@pytest.fixture(scope="module")
def merge(spark):
    def run(old, new, mode="accumulate"):
        merged = alerts.merge_triggers(spark.createDataFrame(old, ALERTS), spark.createDataFrame(new, TRIGGERS), NOW, mode)
        return {(r["id"] if len(r["id"]) < 5 else "new", r["group_key"]): r for r in merged.collect()}

    return run


def test_update_keeps_title_and_first_seen(merge):
    got = merge([alert("1", "r:a")], [trigger("r:a", 3), trigger("r:a", 4, D[6], "newer")])
    row = got["1", "r:a"]
    assert (row["event_count"], row["last_seen"], row["description"]) == (17, D[6], "newer")
    assert (row["title"], row["severity"], row["first_seen"], row["updated_at"]) == ("t", "high", D[0], datetime(2024, 2, 1))
    assert row["extra"] == {"z": "1"} and len(got) == 1


def test_newest_open_alert_is_updated(merge):
    got = merge([alert("1", "r:a", created=D[1]), alert("2", "r:a", created=D[2]), alert("3", "r:a", "closed", D[3])], [trigger("r:a", 1)])
    assert {k[0]: r["event_count"] for k, r in got.items()} == {"1": 10, "2": 11, "3": 10}


def test_closed_alerts_never_match(merge):
    got = merge([alert("1", "r:a", "closed"), alert("2", "r:a", "acknowledged")], [trigger("r:a", 2, extra={"n": "5"})])
    row = got["new", "r:a"]
    assert len(got) == 3 and (row["status"], row["event_count"], row["first_seen"], row["extra"]) == ("open", 2, D[3], {"n": "5"})


def test_trigger_without_key_matches_any_of_its_rule(merge):
    got = merge([alert("1", "r:a", created=D[1]), alert("2", "r:b", created=D[2])], [trigger(None, 5), trigger("r:b", 1), trigger(None, 1, rule="q")])
    assert got["2", "r:b"]["event_count"] == 16 and got["1", "r:a"]["event_count"] == 10
    assert got["new", None]["rule_id"] == "q"


def test_replace_mode(merge):
    assert merge([alert("1", "r:a")], [trigger("r:a", 3)], "replace")["1", "r:a"]["event_count"] == 3


def test_patches(spark):
    old = spark.createDataFrame([alert("1", "a"), alert("2", "b")], ALERTS)
    patches = spark.createDataFrame([("1", 1, "closed", None), ("1", 2, None, "ann"), ("1", 3, "bogus", "eve"), ("9", 1, "open", None)],
                                    "alert_id string, seq bigint, status string, assigned_to string")
    got = {r["id"]: (r["status"], r["assigned_to"], r["updated_at"]) for r in alerts.patch_alerts(old, patches, NOW).collect()}
    assert got == {"1": ("closed", "ann", datetime(2024, 2, 1)), "2": ("open", None, D[0])}
    assert alerts.rejected_patches(patches).count() == 1


def test_rule_changes(spark):
    rules = spark.createDataFrame([(i, f"name {i}", None, "absence", "low", True, "{}", D[0], D[0]) for i in "abc"], RULES)
    changes = spark.createDataFrame([
        ("a", 1, "update", "renamed", None), ("a", 2, "update", None, False), ("b", 1, "delete", None, None), ("b", 2, "update", "ghost", None),
        ("d", 1, "create", "fresh", None), ("d", 2, "update", None, False), ("e", 1, "update", "nobody", None), ("f", 1, "create", "x", None), ("f", 2, "delete", None, None),
    ], "id string, seq bigint, op string, name string, enabled boolean").selectExpr(
        "*", "CAST(NULL AS STRING) description", "CASE op WHEN 'create' THEN 'absence' END rule_type", "CASE op WHEN 'create' THEN 'low' END severity",
        "CASE op WHEN 'create' THEN '{}' END body")
    got = {r["id"]: (r["name"], r["enabled"]) for r in catalog.apply_rule_changes(rules, changes, NOW).collect()}
    assert got == {"a": ("renamed", False), "c": ("name c", True), "d": ("fresh", False)}


def test_register_sources(spark):
    sources = spark.createDataFrame([("1", "10.0.0.1", None, "linux", None, True, False, None, 0, D[0])], SOURCES)
    requests = spark.createDataFrame([(1, "10.0.0.1"), (2, "10.0.0.2"), (3, "10.0.0.2")], "seq bigint, ip_address string").selectExpr(
        "*", "'h' hostname", "'linux' source_type", "'l' label", "CAST(NULL AS BOOLEAN) enabled", "false pci_env")
    accepted, rejected = catalog.register_sources(sources, requests, NOW)
    assert sorted(r["ip_address"] for r in accepted.collect()) == ["10.0.0.1", "10.0.0.2"]
    assert sorted(r["seq"] for r in rejected.collect()) == [1, 3]


def test_geoip_wide_and_narrow_ranges(spark):
    number = lambda ip: sum(int(p) << s for p, s in zip(ip.split("."), (24, 16, 8, 0)))
    ranges = [("1.0.0.0", "1.2.255.255", "aligned"), ("2.0.0.200", "2.5.0.10", "ragged"), ("3.0.0.1", "3.0.0.1", "single"), ("3.0.0.2", "3.0.1.7", "two")]
    table = spark.createDataFrame([(number(a), number(b), n, f"city {n}") for a, b, n in ranges], "start_ip bigint, end_ip bigint, country string, city string")
    ips = ["0.255.255.255", "1.0.0.0", "1.1.9.9", "1.2.255.255", "1.3.0.0", "2.0.0.199", "2.0.0.200", "2.0.255.255", "2.3.1.1", "2.5.0.10", "2.5.0.11",
           "3.0.0.0", "3.0.0.1", "3.0.0.2", "3.0.1.7", "3.0.1.8", "300.1.1.1", "::1", None]
    names = EVENTS.fieldNames()
    events = spark.createDataFrame([tuple({"id": str(i), "src_ip": ip}.get(n) for n in names) for i, ip in enumerate(ips)], EVENTS)

    def expected(ip):
        if ip is None or ":" in ip or ip.startswith("300"):
            return None
        return next((n for a, b, n in ranges if number(a) <= number(ip) <= number(b)), None)

    got = {r["id"]: r["geo_country"] for r in enrich.add_geoip(events, table).collect()}
    assert got == {str(i): expected(ip) for i, ip in enumerate(ips)}


def test_location_by_the_longest_network(spark):
    """Random nested networks and addresses of both families against the standard library."""
    rng = random.Random(5)
    nets = [("0.0.0.0/0", "all four"), ("::/0", "all six"), ("2001:db8::/29", "odd"), ("10.0.0.0/13", "odd four"), ("::ffff:10.1.0.0/112", "mapped"), ("1.2.3.4", "host"), ("broken/8", "x"), ("1.1.1.1/40", "x")]
    for n in range(300):
        six = n % 2
        bits = rng.choice([8, 9, 14, 16, 22, 24, 31, 32] if not six else [12, 32, 33, 47, 48, 61, 64, 127, 128])
        base = (rng.choice([10, 11]) << 24 | rng.getrandbits(10) << 14 | rng.getrandbits(4)) if not six else (0x20010DB8 << 96 | rng.getrandbits(6) << 80 | rng.getrandbits(3))
        nets.append((str(ip_network((base, bits), strict=False)), f"n{n:03d}"))
    table = spark.createDataFrame([(n, c, f"city {c}") for n, c in nets], "network string, country string, city string")
    parsed = []
    for n, c in nets:
        try:
            net = ip_network(n)
        except ValueError:
            continue
        if n.startswith("::ffff:"):
            net = ip_network("10.1.0.0/16")
        parsed.append((net, c))
    ips = [None, "", "nothing", "1.2.3.4", "1.2.3", "256.1.1.1", "::", "::1", ":::", "1::2::3", "2001:db8:1", "2001:DB8::A", "fe80::1%eth0", "::ffff:10.1.2.3", "::10.1.2.3", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "1:2:3:4:5:6:7:8::",
           "12345::", "g::1", "::ffff:300.1.1.1", "2001:db8:0:0:0:0:10.0.0.1"]
    ips += [str(ip_address(rng.choice([10, 11]) << 24 | rng.getrandbits(24))) for _ in range(150)] + [str(ip_address(0x20010DB8 << 96 | rng.getrandbits(7) << 80 | rng.getrandbits(4))) for _ in range(150)]

    def expected(ip):
        try:
            a = ip_address((ip or "").split("%")[0])
        except ValueError:
            return None
        a = getattr(a, "ipv4_mapped", None) or a
        inside = [(net.prefixlen, c) for net, c in parsed if net.version == a.version and a in net]
        return max(inside, default=(0, None))[1]

    names = EVENTS.fieldNames()
    events = spark.createDataFrame([tuple({"id": str(i), "src_ip": ip, "geo_country": "known" if i == 3 else None}.get(n) for n in names) for i, ip in enumerate(ips)], EVENTS)
    located = enrich.add_location(events, table)
    assert located.columns == events.columns
    got = {r["id"]: r["geo_country"] for r in located.collect()}
    assert got == {str(i): "known" if i == 3 else expected(ip) for i, ip in enumerate(ips)}
    assert enrich.add_location(events, table.limit(0)).where("geo_country IS NOT NULL").count() == 1


def test_ranges_become_networks(spark):
    rows = [("1.0.0.1", "1.0.0.6", "a"), (str(2 << 24), str((2 << 24) + 255), "b"), ("2001:db8::", "2001:db8:0:1::", "c"), ("5.0.0.2", "5.0.0.1", "x"), (None, "1.1.1.1", "x")]
    df = spark.createDataFrame([(*r, "") for r in rows], "start_ip string, end_ip string, country string, city string")
    got = sorted((r["country"], r["network"]) for r in enrich.networks_of_ranges(df).collect())
    assert got == [("a", "1.0.0.1/32"), ("a", "1.0.0.2/31"), ("a", "1.0.0.4/31"), ("a", "1.0.0.6/32"), ("b", "2.0.0.0/24"), ("c", "2001:db8:0:1::/128"), ("c", "2001:db8::/64")]


@pytest.mark.parametrize("newest_first, id_ascending", [(True, False), (True, True), (False, False)])
def test_pages_by_counts(spark, newest_first, id_ascending):
    """Every page of a table with ties, rows without a time and a crowded second, however few rows may be sorted."""
    rng = random.Random(3)
    times = [D[0].replace(hour=rng.randrange(3), minute=rng.choice([0, 5]), second=rng.choice([0, 0, 1]), microsecond=rng.choice([0, 0, 7])) for _ in range(140)] + [None] * 9
    rows = [(f"{i:03d}", t) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "id string, received_at timestamp").cache()
    sign = -1 if newest_first else 1
    epoch = lambda t: (t - D[0]).total_seconds()
    order = sorted(rows, key=lambda r: r[0], reverse=newest_first and not id_ascending)
    order.sort(key=lambda r: (r[1] is None, sign * epoch(r[1]) if r[1] else 0))
    for number, most in ((1, 1), (2, 5), (5, 1), (8, 10_000), (15, 1), (99, 1)):
        got = paging.page_by_counts(df, number, 10, newest_first=newest_first, id_ascending=id_ascending, sorted_rows=most)
        assert [r["id"] for r in got.items.collect()] == [r[0] for r in order[(number - 1) * 10:number * 10]]
        assert tuple(got.totals.first()) == (149, number, 10, 15)
    assert paging.page_by_counts(df.limit(0), 1, 10).items.count() == 0


def test_a_deep_page_sorts_one_hour(spark):
    df = spark.range(200_000).selectExpr("CAST(id AS STRING) id", "timestamp_micros(1704067200000000 + id * 1000000) received_at")
    page = paging.page_by_counts(df, 3000, 50)
    assert [r["id"] for r in page.items.collect()][0] == str(199_999 - 2999 * 50)
    filtered = page.items._jdf.queryExecution().optimizedPlan().toString()
    assert filtered.count(">=") == 1 and page.items.count() == 50
