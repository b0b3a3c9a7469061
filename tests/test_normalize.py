"""Single lines with known fields."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from watchhouse.functions import columns as c
from watchhouse.operators import normalize

RECEIVED = "2024-01-15 10:23:45"


@pytest.fixture(scope="module")
def parse(spark):
    def run(kind, raw, received=RECEIVED):
        raw = json.dumps(raw) if isinstance(raw, dict) else raw
        df = spark.createDataFrame([(raw, "192.0.2.9")], "raw string, source_ip string").withColumn(
            "received_at", F.lit(received).cast("timestamp"))
        return normalize.parse_as(df, kind).first()

    return run


def check(row, **expected):
    assert {k: row[k] for k in expected} == expected


# --- firewall key=value ---------------------------------------------------------------------------


def test_fortigate_traffic(parse):
    row = parse("fortigate", '<190>date=2020-02-02 time=01:02:03 devname="EDGE" logid="0000000013" type="traffic" '
                'subtype="forward" level="notice" eventtime=1705311825 srcip=192.168.1.7 srcport=4321 dstip=9.9.9.9 '
                'dstport=53 proto=17 action="accept" sentbyte=600000000 user="ann" msg="ok"')
    check(row, source_host="EDGE", category="network", action="allow", protocol="udp", log_level="notice",
          src_ip="192.168.1.7", src_port=4321, dst_port=53, user_name="ann", event_id="0000000013", message="ok",
          event_time=datetime(2024, 1, 15, 9, 43, 45))
    assert row["extra"]["sentbyte"] == "600000000" and row["raw_message"].startswith("<190>")


@pytest.mark.parametrize("stamp, expected", [
    ("eventtime=1705311825123456", datetime(2024, 1, 15, 9, 43, 45)),
    ("eventtime=1705311825123456789 date=2024-01-15 time=10:00:00", datetime(2024, 1, 15, 10)),
    ("eventtime=soon date=2024-01-15 time=10:00:00", datetime(2024, 1, 15, 10)),
    ("date=2024-01-15", None), ("date=2024-13-15 time=10:00:00", None),
])
def test_fortigate_times(parse, stamp, expected):
    assert parse("fortigate", f"type=event {stamp}")["event_time"] == expected


def test_fortigate_fallbacks(parse):
    row = parse("fortigate", '<188>type="utm" subtype="ips" level="odd" action="blocked" srcport=x proto=99 unauthuser="bob" user=""')
    check(row, log_level="warning", category="threat", action="deny", src_port=None, protocol="99", user_name="bob",
          source_host="192.0.2.9", message="utm/ips action=blocked", event_time=None)


def test_key_values_edge_cases(spark):
    lines = ['a=1 b="" c="x y" a=2 ', "no pairs", 'k="open bare=3', 'm="line\nbreak" n=1 tail', "x=1\x02\x03y=2", ""]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "i int, s string")
    got = [r["kv"] for r in c.with_key_values(df, "kv", F.col("s"), F.lit(True)).orderBy("i").collect()]
    assert got == [{"a": "2", "b": "", "c": "x y"}, {}, {"k": '"open', "bare": "3"}, {"m": "line\nbreak", "n": "1"},
                   {"x": "1\x02\x03y=2"}, {}]


# --- Cisco ---------------------------------------------------------------------------------------------


def test_cisco_connection(parse):
    row = parse("cisco_asa", "<134>Jan  5 10:23:45 edge.example %ASA-6-302013: Built outbound TCP connection 9 for "
                "outside:8.8.8.8/53 (8.8.8.8/53) to inside:192.168.1.9/12345 (10.0.0.1/12345)")
    check(row, source_host="edge.example", category="network", action="allow", protocol="tcp", log_level="info", event_id="302013",
          src_ip="10.0.0.1", src_port=12345, dst_ip="8.8.8.8", dst_port=53, event_time=datetime(2024, 1, 5, 10, 23, 45))
    assert row["message"].startswith("Built TCP connection: Built outbound")


@pytest.mark.parametrize("tail, expected", [
    ("%ASA-6-302014: Teardown TCP connection 9", {"action": "close", "event_id": "302014"}),
    ("%ASA-5-106023: Deny tcp src a:1.2.3.4/5 dst b:6.7.8.9/10", {"action": "deny", "src_ip": "6.7.8.9", "dst_ip": "1.2.3.4"}),
    ("%ASA-5-713172: Group = G, Username = joe, IP = 1.2.3.4", {"category": "auth", "user_name": "joe", "action": None}),
    ("%ASA-6-611101: ok: Uname: joe", {"action": "logon", "user_name": None}),
    ("%ASA-3-733100: rate exceeded", {"category": "threat", "log_level": "error"}),
    ("%FTD-4-999999: odd", {"category": "system", "message": "ASA-4-999999: odd"}),
    ("%ASA-4-400000:", {"message": "IPS alert triggered"}),
    ("just text", {"event_id": None, "category": None, "message": "just text", "log_level": "info"}),
])
def test_cisco_lines(parse, tail, expected):
    check(parse("cisco_asa", f"<134>Jan 15 10:23:45 fw {tail}"), source_type="cisco_asa", **expected)


@pytest.mark.parametrize("stamp", ["Feb 29 10:00:00", "Feb 30 10:00:00", "Foo 15 10:00:00"])
def test_cisco_bad_dates(parse, stamp):
    assert parse("cisco_asa", f"<134>{stamp} fw hello", "2024-03-01 00:00:00")["event_time"] is None


# --- Windows --------------------------------------------------------------------------------------------------


def windows(event_id, data, **top):
    return {"EventID": event_id, "TimeCreated": "2024-01-15T10:23:45.123456Z", "Computer": "PC-1", "Channel": "Security", "Level": 0,
            "EventData": data, **top}


def test_windows_logon(parse):
    row = parse("windows", windows(4624, {"TargetUserName": "ann", "IpAddress": "192.168.1.5", "IpPort": "4000", "LogonType": "3"}))
    check(row, category="auth", action="logon", user_name="ann", src_ip="192.168.1.5", src_port=4000, tags=["hipaa:auth"],
          source_host="PC-1", message="Successful account logon: ann", event_time=datetime(2024, 1, 15, 10, 23, 45, 123456))
    assert row["extra"] == {"Channel": "Security", "LogonType": "Network"}


@pytest.mark.parametrize("event_id, data, expected", [
    (4625, {"TargetUserName": "eve"}, {"action": "logon_failed", "user_name": "eve"}),
    (4672, {"SubjectUserName": "root"}, {"action": "privileged_logon", "user_name": "root"}),
    (4688, {"NewProcessName": "C:\\Windows\\System32\\cmd.exe"}, {"category": "endpoint", "process_name": "cmd.exe"}),
    (1102, {"SubjectUserName": "eve"}, {"category": "compliance", "tags": ["hipaa:integrity", "pci_dss"], "message": "Audit log was cleared by eve"}),
    (7045, {"ServiceName": "svc", "ImagePath": ""}, {"message": "New service installed: svc (-)"}),
    (4624, {"TargetUserName": "PC-1$", "SubjectUserName": "x", "IpAddress": "-"}, {"user_name": None, "src_ip": None}),
    (4624, {}, {"message": "Successful account logon: TargetUserName"}),
    (31337, {}, {"category": "system", "event_id": "31337", "message": "Windows Event 31337 (Security)"}),
])
def test_windows_events(parse, event_id, data, expected):
    check(parse("windows", windows(event_id, data)), problem=None, **expected)


@pytest.mark.parametrize("raw, problem", [
    ("text", "not a JSON object"), ('{"EventID": "x"}', "EventID is not a number"), ('{"EventID": null}', "EventID is not a number"),
    ('{"Level": "high"}', "Level is not a number"), ('{"EventData": null}', "EventData is not an object"),
    ('{"Computer": null}', "Computer is null"), ("{}", None),
])
def test_windows_problems(parse, raw, problem):
    assert parse("windows", raw)["problem"] == problem


# --- Linux ---------------------------------------------------------------------------------------------------------


def journald(program, message, **top):
    return {"__REALTIME_TIMESTAMP": "1705311825000000", "_HOSTNAME": "web-1", "SYSLOG_IDENTIFIER": program, "PRIORITY": "6",
            "MESSAGE": message, "_PID": "77", **top}


@pytest.mark.parametrize("program, message, expected", [
    ("sshd", "Accepted publickey for ann from 192.168.1.5 port 4000 ssh2",
     {"category": "auth", "action": "logon", "user_name": "ann", "src_ip": "192.168.1.5", "src_port": 4000, "tags": ["hipaa:auth"]}),
    ("sshd", "Failed password for ann from 1.2.3.4 port 5 ssh2", {"action": "logon_failed", "user_name": "ann"}),
    ("sshd", "Invalid user admin from 1.2.3.4 port 5", {"action": "logon_failed", "src_ip": "1.2.3.4"}),
    ("sshd", "Failed password for invalid user x from 1.2.3.4 port 5 ssh2", {"category": "auth", "action": None, "src_ip": None}),
    ("sshd", "Disconnected from user ann 1.2.3.4 port 5", {"action": "logoff", "user_name": "ann"}),
    ("pam_unix", "Authentication failure for bob", {"action": "logon_failed", "user_name": "bob"}),
    ("pam", "Accepted password for bob", {"action": "logon", "user_name": "bob"}),
    ("auditd", 'type=USER_AUTH msg=audit(1:2): acct="ann" exe="x" addr=1.2.3.4 res=success',
     {"category": "compliance", "user_name": "ann", "src_ip": "1.2.3.4", "tags": ["hipaa:audit"]}),
    ("kernel", "Out of memory: Kill process 1 (x)", {"category": "system"}),
    ("CRON", "session opened", {"category": "system"}), ("useradd", "new user", {"category": "auth"}),
    ("systemd", "Started.", {"category": "system", "src_ip": None, "tags": []}),
])
def test_linux_messages(parse, program, message, expected):
    check(parse("linux", journald(program, message)), source_host="web-1", process_name=program,
          event_time=datetime(2024, 1, 15, 9, 43, 45), **expected)


def test_linux_rsyslog(parse):
    row = parse("linux", {"timestamp": "2024-01-15T10:30:00Z", "hostname": "db-1", "program": "sudo", "severity": 13, "facility": 1,
                          "pid": 9, "message": "ann : TTY=pts/1 ; PWD=/ ; USER=root ; COMMAND=/bin/sh"})
    check(row, action="privileged_exec", user_name="ann", source_host="db-1", log_level="notice", event_time=datetime(2024, 1, 15, 10, 30))
    assert row["extra"] == {"facility": "1", "pid": "9"}


@pytest.mark.parametrize("raw, problem", [
    ("[1]", "not a JSON object"), ('{"severity": "x"}', "severity is not a number"), ('{"message": null}', "message is null"),
    ('{"program": null}', "program is null"), ('{"hostname": null}', "hostname is null"),
])
def test_linux_problems(parse, raw, problem):
    assert parse("linux", raw)["problem"] == problem


def test_time_formats(spark):
    texts = ["2024-01-15T10:23:45.5Z", "2024-01-15T10:23:45Z", "2024-01-15T10:23:45", "2024-01-15T10:23:45+00:00", "x", None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i int, s string")
    got = [r[0] for r in df.orderBy("i").select(c.iso_time(F.col("s"))).collect()]
    assert got == [datetime(2024, 1, 15, 10, 23, 45, 500000)] + [datetime(2024, 1, 15, 10, 23, 45)] * 2 + [None] * 3


def test_registry_and_dead_letters(spark):
    lines = spark.createDataFrame([
        ("10.0.0.1", "hello %ASA-6-302014: x"), ("10.0.0.2", "type=event"), ("10.0.0.3", "free text"), ("10.0.0.4", "type=event"),
    ], "source_ip string, raw string").withColumn("received_at", F.lit(RECEIVED).cast("timestamp"))
    sources = spark.createDataFrame([
        ("10.0.0.1", "cisco_ios", "", True, True), ("10.0.0.2", "windows", "W", True, False), ("10.0.0.4", "windows", "off", False, True),
    ], "ip_address string, source_type string, label string, enabled boolean, pci_env boolean")
    resolved = {r["source_ip"]: (r["line_type"], r["label"], r["is_pci_env"], r["registered"])
                for r in normalize.resolve_sources(lines, sources).collect()}
    assert resolved == {
        "10.0.0.1": ("cisco_ios", "10.0.0.1", True, True), "10.0.0.2": ("windows", "W", False, True),
        "10.0.0.3": ("linux", "10.0.0.3", False, False), "10.0.0.4": ("fortigate", "10.0.0.4", False, False)}
    parsed = normalize.normalize(lines, sources)
    assert {r["source_type"] for r in normalize.good_events(parsed).collect()} == {"cisco_asa", "fortigate"}
    assert {(r["source_ip"], r["detail"]) for r in normalize.bad_lines(parsed).collect()} == {
        ("10.0.0.2", "not a JSON object"), ("10.0.0.3", "not a JSON object")}
