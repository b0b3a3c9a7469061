"""Filters, joins and rule evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchhouse.operators import alerts as alert_ops
from watchhouse.operators import filters
from watchhouse.plans import anomaly, blacklist, dashboard, links, run_rules, sequence, threshold
from watchhouse.plans.rule_bodies import SEEDED_RULES, make_rule, validate_rules
from watchhouse.session import shared_dir
from watchhouse.sources import tables
from watchhouse.workload.registry import query
from watchhouse.workload.tables import AS_OF, DAY, MONTH, Tables, duck_ip, ts, with_tables

NOW = f"TIMESTAMP '{AS_OF}'"
SIEM = with_tables("siem")
_TRIGGER = ("rule_id", "severity", "title", "description", "src_ip", "source_host", "first_seen", "last_seen",
            "event_count", "group_key")


def triggers(df: DataFrame) -> DataFrame:
    return df.select(*_TRIGGER)


def trigger_sql(body: str, ctes: str = SIEM) -> str:
    """Wrap a select of the ten trigger columns: times as text."""
    return f"""{ctes}, t AS ({body}) SELECT rule_id, severity, title, description, src_ip, source_host,
      {ts('first_seen')}, {ts('last_seen')}, event_count, group_key FROM t"""


def grouped_sql(rule: str, name: str, severity: str, column: str, where: str, having: str, window: int = MONTH,
                count: str = "count(*)") -> str:
    shown = "coalesce(nullif(g, ''), 'unknown')"
    src = shown if column == "src_ip" else "CAST(NULL AS VARCHAR)"
    host = shown if column == "source_host" else "CAST(NULL AS VARCHAR)"
    return trigger_sql(f"""
      SELECT '{rule}' AS rule_id, '{severity}' AS severity, concat('{name}: ', {shown}) AS title,
        concat('Triggered ', n, ' event(s) within {window}s') AS description, {src} AS src_ip, {host} AS source_host,
        first_seen, last_seen, n AS event_count, concat('{rule}:', {shown}) AS group_key
      FROM (SELECT {column} AS g, {count} AS n, min(received_at) AS first_seen, max(received_at) AS last_seen
            FROM siem WHERE received_at >= {NOW} - INTERVAL {window} SECOND AND {where} GROUP BY {column} HAVING {having}) s""")


def global_sql(rule: str, name: str, severity: str, where: str, having: str, window: int = MONTH,
               count: str = "count(*)") -> str:
    return trigger_sql(f"""
      SELECT '{rule}' AS rule_id, '{severity}' AS severity, '{name}' AS title,
        concat('Triggered ', n, ' event(s) within {window}s') AS description, CAST(NULL AS VARCHAR) AS src_ip,
        CAST(NULL AS VARCHAR) AS source_host, first_seen, last_seen, n AS event_count, '{rule}:global' AS group_key
      FROM (SELECT {count} AS n, min(received_at) AS first_seen, max(received_at) AS last_seen FROM siem
            WHERE received_at >= {NOW} - INTERVAL {window} SECOND AND {where} HAVING {having}) s""")


# --- filters -------------------------------------------------------------------------------------------


@query(f"{SIEM} SELECT count(*) AS n, {ts('min(received_at)', 'first_seen')} FROM siem WHERE received_at >= {NOW} - INTERVAL 604800 SECOND")
def flt_window(t: Tables):
    return t.siem.filter(filters.in_window(AS_OF, 7 * DAY)).agg(
        F.count(F.lit(1)).alias("n"), F.min("received_at").alias("first_seen"))


@query(f"""{SIEM} SELECT id, {ts('received_at')}, user_name FROM siem WHERE event_id IN ('4672', '4624') AND category = 'auth'
    AND list_contains(tags, 'hipaa:auth') AND list_contains(tags, 'admin') AND log_level = 'info'""")
def flt_event(t: Tables):
    spec = {"event_id": ["4672", "4624"], "category": "auth", "tags": ["hipaa:auth", "admin"], "log_level": "info"}
    return t.siem.filter(filters.event_filter(spec)).select("id", "received_at", "user_name")


@query(f"{SIEM} SELECT id, {ts('received_at')} FROM siem WHERE NOT (hour(received_at) >= 20 OR hour(received_at) < 6)")
def flt_outside_hours(t: Tables):
    return t.siem.filter(filters.outside_hours(F.col("received_at"), 20, 6)).select("id", "received_at")


@query(f"""{SIEM} SELECT id, {ts('received_at')}, source_host, message FROM siem WHERE received_at >= TIMESTAMP '2024-01-05 00:00:00'
    AND received_at <= TIMESTAMP '2024-01-25 12:00:00' AND source_host ILIKE '%OST-1%' AND source_type = 'linux'
    AND category = 'auth' AND user_name ILIKE '%user_%' AND log_level = 'info' AND message ILIKE '%click from%'""")
def flt_event_search(t: Tables):
    found = filters.search_events(
        t.siem, time_from="2024-01-05 00:00:00", time_to="2024-01-25 12:00:00", source="OST-1", source_type="linux",
        category="auth", user="user_", log_level="info", q="click from")
    return found.select("id", "received_at", "source_host", "message")


@query(f"""{with_tables('alerts')} SELECT id, rule_id, {ts('first_seen')} FROM alerts WHERE severity = 'high' AND status = 'open'
    AND first_seen >= TIMESTAMP '1995-01-01 00:00:00' AND first_seen <= TIMESTAMP '2001-01-01 00:00:00'""")
def flt_alerts(t: Tables):
    found = filters.filter_alerts(t.alerts, severity="high", status="open", time_from="1995-01-01 00:00:00",
                                  time_to="2001-01-01 00:00:00")
    return found.select("id", "rule_id", "first_seen")


@query(f"{with_tables('rules')} SELECT id, name, severity FROM rules WHERE rule_type = 'sequence' AND enabled")
def flt_rules(t: Tables):
    return filters.filter_rules(t.rules, rule_type="sequence", enabled=True).select("id", "name", "severity")


@query(f"{with_tables('sources')} SELECT id, ip_address, label FROM sources WHERE NOT enabled AND source_type = 'linux'")
def flt_sources(t: Tables):
    return filters.filter_sources(t.sources, enabled=False, source_type="linux").select("id", "ip_address", "label")


@query(f"{with_tables('rules')} SELECT id, rule_type FROM rules WHERE enabled AND rule_type IN ('absence', 'anomaly')")
def flt_rules_due(t: Tables):
    return filters.rules_due(t.rules, filters.AGGREGATE_RULES).select("id", "rule_type")


@query(f"{SIEM} SELECT id, {ts('received_at')}, message, src_ip FROM siem WHERE id = '77'")
def flt_by_id(t: Tables):
    return filters.by_id(t.siem, "77").select("id", "received_at", "message", "src_ip")


# --- threshold -------------------------------------------------------------------------------------------

_BRUTE = {"filters": {"event_id": ["4625", "ssh_auth_fail"]}, "group_by": "src_ip", "count": 5, "window_seconds": MONTH}
_FAILED = "event_id IN ('4625', 'ssh_auth_fail')"


@query(grouped_sql("r1", "Brute Force Login", "critical", "src_ip", _FAILED, "count(*) >= 5"))
def rule_threshold_grouped(t: Tables):
    rule = make_rule("r1", "Brute Force Login", "threshold", "critical", _BRUTE)
    return triggers(threshold.threshold_rule(t.siem, rule, AS_OF))


@query(grouped_sql("r2", "Many", "high", "user_name", "category = 'auth'", "count(*) >= 1"))
def rule_threshold_unknown_group(t: Tables):
    """Missing and empty users form two groups, both shown as unknown."""
    rule = make_rule("r2", "Many", "threshold", "high",
                     {"filters": {"category": "auth"}, "group_by": "user_name", "window_seconds": MONTH})
    return triggers(threshold.threshold_rule(t.siem, rule, AS_OF))


@query(grouped_sql("r3", "Users", "high", "source_host", "category = 'auth'", "count(DISTINCT user_name) >= 3",
                   count="count(DISTINCT user_name)"))
def rule_threshold_distinct(t: Tables):
    rule = make_rule("r3", "Users", "threshold", "high",
                     {"filters": {"category": "auth"}, "group_by": "source_host", "distinct_users": 3, "count": 99999,
                      "window_seconds": MONTH})
    return triggers(threshold.threshold_rule(t.siem, rule, AS_OF))


_SENT_DUCK = "TRY_CAST(extra['sentbyte'] AS DECIMAL(38,6))"


@query(grouped_sql("r4", "Exfil", "high", "src_ip", "source_type = 'fortigate' AND extra['sentbyte'] IS NOT NULL",
                   f"max({_SENT_DUCK}) > 400000000"))
def rule_threshold_aggregate(t: Tables):
    rule = make_rule("r4", "Exfil", "threshold", "high",
                     {"filters": {"source_type": "fortigate"}, "group_by": "src_ip", "window_seconds": MONTH,
                      "aggregate": {"field": "sentbyte", "op": "gt", "value": 400000000}})
    return triggers(threshold.threshold_rule(t.siem, rule, AS_OF))


@query(global_sql("r5", "Privileged", "high", "event_id IN ('4672')", "count(*) >= 10"))
def rule_threshold_global(t: Tables):
    rule = make_rule("r5", "Privileged", "threshold", "high",
                     {"filters": {"event_id": ["4672"]}, "count": 10, "window_seconds": MONTH})
    return triggers(threshold.threshold_rule(t.siem, rule, AS_OF))


@query(global_sql("r5b", "Privileged users", "high", "event_id IN ('4672')", "count(DISTINCT user_name) >= 3",
                  count="count(DISTINCT user_name)"))
def rule_threshold_global_distinct(t: Tables):
    rule = make_rule("r5b", "Privileged users", "threshold", "high",
                     {"filters": {"event_id": ["4672"]}, "distinct_users": 3, "window_seconds": MONTH})
    return triggers(threshold.threshold_rule(t.siem, rule, AS_OF))


@query(grouped_sql("r6", "Night", "medium", "src_ip", "category = 'auth'",
                   "count(*) >= 1 AND NOT (hour(max(received_at)) >= 6 AND hour(max(received_at)) < 20)"))
def rule_threshold_hours(t: Tables):
    rule = make_rule("r6", "Night", "threshold", "medium",
                     {"filters": {"category": "auth"}, "group_by": "src_ip", "window_seconds": MONTH,
                      "outside_hours": {"start": 6, "end": 20}})
    return triggers(threshold.threshold_rule(t.siem, rule, AS_OF))


# --- sequence ----------------------------------------------------------------------------------------------

_STEPS2 = [{"event_id": "4625"}, {"event_id": "4624"}]
_STEPS3 = [{"event_id": "4625"}, {"event_id": "4624"}, {"action": "privileged_logon"}]
_STEP_ROWS = f"""{SIEM}, a AS (SELECT src_ip AS grp, received_at AS ts, event_id AS e FROM siem
    WHERE received_at >= {NOW} - INTERVAL {MONTH} SECOND)"""
_PAIRS2 = f"""{_STEP_ROWS}, pairs AS (SELECT DISTINCT x.grp, x.ts AS ts0, y.ts AS ts1 FROM a x JOIN a y
    ON y.grp = x.grp AND y.ts > x.ts WHERE x.e = '4625' AND y.e = '4624')"""
# every start with the first time its first two steps are done, then all later third steps
_PAIRS3 = f"""{_STEP_ROWS}, half AS (SELECT x.grp, x.ts AS ts0, min(y.ts) AS mid FROM a x JOIN a y ON y.grp = x.grp AND y.ts > x.ts
    WHERE x.e = '4625' AND y.e = '4624' GROUP BY x.grp, x.ts),
    pairs AS (SELECT DISTINCT h.grp, h.ts0, z.ts AS ts1 FROM half h JOIN a z ON z.grp = h.grp AND z.ts > h.mid AND z.e = '4672')"""


def _sequence(steps: list) -> object:
    return make_rule("r7", "Lateral", "sequence", "high", {"steps": steps, "group_by": "src_ip", "window_seconds": MONTH})


@query(f"""{_PAIRS2} SELECT grp, {ts('ts0', 'ts')}, count(*) AS n, {ts('min(ts1)', 'nearest')}, {ts('max(ts1)', 'farthest')}
    FROM pairs GROUP BY grp, ts0""")
def join_sequence(t: Tables):
    """Every first step with the later second steps of its source: how many, the next and the last one."""
    return sequence.chains(t.siem, _sequence(_STEPS2), AS_OF, "start")


def _sequence_sql(pairs: str, steps: int) -> str:
    return trigger_sql(f"""
      SELECT 'r7' AS rule_id, 'high' AS severity, concat('Lateral: ', grp) AS title,
        '{steps}-step sequence completed within {MONTH}s' AS description, grp AS src_ip, CAST(NULL AS VARCHAR) AS source_host,
        min(ts0) AS first_seen, max(ts1) AS last_seen, CAST({steps} * count(*) AS BIGINT) AS event_count, concat('r7:', grp) AS group_key
      FROM pairs GROUP BY grp""", pairs)


@query(_sequence_sql(_PAIRS2, 2))
def rule_sequence(t: Tables):
    return triggers(sequence.sequence_rule(t.siem, _sequence(_STEPS2), AS_OF))


@query(_sequence_sql(_PAIRS3, 3))
def rule_sequence_three_steps(t: Tables):
    return triggers(sequence.sequence_rule(t.siem, _sequence(_STEPS3), AS_OF))


@query(f"""{_PAIRS3} SELECT grp, {ts('ts1', 'ts')}, count(*) AS n, {ts('max(ts0)', 'nearest')}, {ts('min(ts0)', 'farthest')}
    FROM pairs GROUP BY grp, ts1""")
def rule_sequence_earliest(t: Tables):
    """Every completed chain end with its earliest and latest start."""
    return sequence.chains(t.siem, _sequence(_STEPS3), AS_OF, "completion")


# --- absence, blacklist, anomaly --------------------------------------------------------------------------------


@query(trigger_sql(f"""
    SELECT r AS rule_id, 'high' AS severity, concat('Silence ', r) AS title, 'No matching events in the last {MONTH}s' AS description,
      CAST(NULL AS VARCHAR) AS src_ip, CAST(NULL AS VARCHAR) AS source_host, {NOW} AS first_seen, {NOW} AS last_seen,
      CAST(0 AS BIGINT) AS event_count, concat(r, ':absent') AS group_key
    FROM (SELECT 'r8' AS r, count(*) AS n FROM siem WHERE list_contains(tags, 'no:such:tag')
          UNION ALL SELECT 'r9' AS r, count(*) AS n FROM siem WHERE list_contains(tags, 'pci:cardholder_env')) s WHERE n = 0"""))
def rule_absence(t: Tables):
    """Two rules in one pass; only the one whose tag never occurs fires."""
    rules = [make_rule(i, f"Silence {i}", "absence", "high", {"filters": {"tags": [tag]}, "window_seconds": MONTH})
             for i, tag in (("r8", "no:such:tag"), ("r9", "pci:cardholder_env"))]
    return triggers(threshold.absence_triggers(t.siem, rules, AS_OF))


_LISTED = f"""{with_tables('siem', 'blacklists')}, b AS (SELECT DISTINCT value FROM blacklists WHERE list_name = 'threat_intel_blocklist')"""


@query(f"{_LISTED} SELECT s.id, s.src_ip FROM siem s JOIN b ON b.value = s.src_ip")
def join_blacklist(t: Tables):
    return blacklist.listed_events(t.siem, t.blacklists, "src_ip", "threat_intel_blocklist").select("id", "src_ip")


@query(trigger_sql(f"""
    SELECT 'r10' AS rule_id, 'critical' AS severity, concat('Known Bad IP: ', src_ip) AS title,
      concat('src_ip value ''', src_ip, ''' matched blacklist ''threat_intel_blocklist''') AS description,
      src_ip, CAST(NULL AS VARCHAR) AS source_host, min(received_at) AS first_seen, max(received_at) AS last_seen,
      count(*) AS event_count, concat('r10:src_ip:', src_ip) AS group_key
    FROM siem JOIN b ON b.value = src_ip WHERE received_at >= {NOW} - INTERVAL {MONTH} SECOND GROUP BY src_ip""", _LISTED))
def rule_blacklist(t: Tables):
    rule = make_rule("r10", "Known Bad IP", "blacklist", "critical",
                     {"field": "src_ip", "list_name": "threat_intel_blocklist"})
    return triggers(blacklist.blacklist_rule(t.siem, t.blacklists, rule, AS_OF, window_seconds=MONTH))


def _anomaly_sql(column: str | None, days: int, window: int) -> str:
    grp = column or "CAST(NULL AS VARCHAR)"
    return f"""{SIEM}, h AS (SELECT {grp} AS grp, date_trunc('hour', received_at) AS b, count(*) AS n,
        count(*) FILTER (received_at >= {NOW} - INTERVAL {window} SECOND) AS w FROM siem
        WHERE category = 'auth' AND received_at >= {NOW} - INTERVAL {days * DAY} SECOND GROUP BY 1, 2),
      s AS (SELECT grp, CAST(sum(w) AS BIGINT) AS event_count, avg(n) AS mean, stddev_pop(n) AS sd FROM h GROUP BY grp),
      z AS (SELECT *, (event_count - mean) / sd AS z FROM s WHERE sd > 0)
      SELECT grp, event_count, round(mean, 6) AS mean, round(sd, 6) AS stddev, round(z, 6) AS z_score FROM z"""


def _scores(t: Tables, column: str | None, days: int, window: int) -> DataFrame:
    body = {"filters": {"category": "auth"}, "group_by": column, "baseline_days": days, "window_seconds": window}
    rule = make_rule("r11", "Burst", "anomaly", "high", body)
    scored = anomaly.anomaly_scores(anomaly.hourly_counts(t.siem, rule, AS_OF), AS_OF)
    return scored.select("grp", "event_count", *[F.round(n, 6).alias(n) for n in ("mean", "stddev", "z_score")])


@query(_anomaly_sql("src_ip", 30, 7 * DAY))
def join_anomaly_baseline(t: Tables):
    """Current count of every source next to its baseline."""
    return _scores(t, "src_ip", 30, 7 * DAY)


def _anomaly_triggers_sql(column: str | None, days: int, window: int, limit: float) -> str:
    base = _anomaly_sql(column, days, window)
    named = "concat('Burst: ', grp)" if column else "'Burst'"
    key = "concat('r11:', grp)" if column else "'r11:global'"
    return base[:base.rindex("SELECT")] + f"""SELECT 'r11' AS rule_id, {named} AS title, {key} AS group_key, event_count,
      round_even(mean, 2) AS mean, round_even(sd, 2) AS stddev, round_even(z, 2) AS z_score FROM z
      WHERE z > {limit} AND event_count > 0"""


def _anomaly_triggers(t: Tables, column: str | None, days: int, window: int, limit: float) -> DataFrame:
    body = {"filters": {"category": "auth"}, "group_by": column, "std_devs": limit, "baseline_days": days,
            "window_seconds": window}
    fired = anomaly.anomaly_rule(t.siem, make_rule("r11", "Burst", "anomaly", "high", body), AS_OF)
    figures = [F.col("extra")[n].cast("double").alias(n) for n in ("mean", "stddev", "z_score")]
    return fired.select("rule_id", "title", "group_key", "event_count", *figures)


@query(_anomaly_triggers_sql("src_ip", 30, 7 * DAY, 3))
def rule_anomaly_grouped(t: Tables):
    return _anomaly_triggers(t, "src_ip", 30, 7 * DAY, 3)


@query(_anomaly_triggers_sql(None, 30, 7 * DAY, 3))
def rule_anomaly_global(t: Tables):
    return _anomaly_triggers(t, None, 30, 7 * DAY, 3)


_BAD_IPS = f"""b AS (SELECT DISTINCT {duck_ip('s_suppkey * 2')} AS value FROM supplier WHERE s_nationkey % 3 <> 0)"""


@query(f"""{_PAIRS2}, {_BAD_IPS}, shown AS (
      SELECT 'Threshold: ' || src_ip AS title, 'Triggered ' || count(*) || ' event(s) within {MONTH}s' AS description, src_ip, 'k:' || src_ip AS group_key
        FROM siem WHERE event_id = '4625' GROUP BY src_ip HAVING count(*) >= 5
      UNION ALL SELECT 'Sequence: ' || grp, '2-step sequence completed within {MONTH}s', grp, 'q:' || grp FROM pairs GROUP BY grp
      UNION ALL SELECT 'Blacklist: ' || src_ip, 'src_ip value ''' || src_ip || ''' matched blacklist ''threat_intel_blocklist''', src_ip, 'b:src_ip:' || src_ip
        FROM siem JOIN b ON b.value = src_ip GROUP BY src_ip)
    SELECT * FROM shown""")
def trig_format(t: Tables):
    """Titles, descriptions, keys and address columns of three kinds of triggers."""
    month = {"window_seconds": MONTH}
    parts = [
        threshold.threshold_rule(t.siem, make_rule("k", "Threshold", "threshold", "high", {
            "filters": {"event_id": ["4625"]}, "group_by": "src_ip", "count": 5, **month}), AS_OF),
        sequence.sequence_rule(t.siem, make_rule("q", "Sequence", "sequence", "high", {
            "steps": _STEPS2, "group_by": "src_ip", **month}), AS_OF),
        blacklist.blacklist_rule(t.siem, t.blacklists, make_rule("b", "Blacklist", "blacklist", "high", {
            "field": "src_ip", "list_name": "threat_intel_blocklist"}), AS_OF, window_seconds=MONTH),
    ]
    columns = ("title", "description", "src_ip", "group_key")
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select(*columns)


# --- all rules ------------------------------------------------------------------------------------------------------


def _wide(body: str, window: int) -> str:
    import re

    return re.sub(r'"window_seconds": \d+', f'"window_seconds": {window}', body)


def seeded(t: Tables, window: int = MONTH) -> DataFrame:
    """The seeded rules with a window as long as the data."""
    rows = [(f"s{i:02d}", n, d, k, s, True, _wide(b, window)) for i, (n, d, k, s, b) in enumerate(SEEDED_RULES)]
    rows.append(("s98", "broken", "", "threshold", "low", True, "{}"))
    rows.append(("s99", "off", "", "threshold", "low", False, '{"window_seconds": 60}'))
    return t.spark.createDataFrame(
        rows, "id string, name string, description string, rule_type string, severity string, enabled boolean, body string")


_SEEDED_SQL = f"""{_PAIRS2}, {_BAD_IPS}, w AS (SELECT * FROM siem WHERE received_at >= {NOW} - INTERVAL {MONTH} SECOND)
  SELECT 's00' AS rule_id, concat('s00:', src_ip) AS group_key, count(*) AS event_count FROM w WHERE event_id = '4625' GROUP BY src_ip HAVING count(*) >= 5
  UNION ALL SELECT 's01', 's01:global', n FROM (SELECT count(*) AS n, hour(max(received_at)) AS h FROM w WHERE event_id = '4672') x WHERE n >= 1 AND NOT (h >= 6 AND h < 20)
  UNION ALL SELECT 's04', concat('s04:', src_ip), count(*) FROM w WHERE action = 'deny' AND source_type = 'fortigate' GROUP BY src_ip HAVING count(*) >= 100
  UNION ALL SELECT 's05', 's05:global', n FROM (SELECT count(*) AS n, hour(max(received_at)) AS h FROM w WHERE category = 'auth' AND list_contains(tags, 'admin')) x WHERE n >= 1 AND NOT (h >= 6 AND h < 20)
  UNION ALL SELECT 's06', concat('s06:', grp), CAST(2 * count(*) AS BIGINT) FROM pairs GROUP BY grp
  UNION ALL SELECT 's08', concat('s08:src_ip:', src_ip), count(*) FROM siem JOIN b ON b.value = src_ip WHERE received_at >= {NOW} - INTERVAL 1800 SECOND GROUP BY src_ip
  UNION ALL SELECT 's09', 's09:global', n FROM (SELECT count(*) AS n, max({_SENT_DUCK}) AS m FROM w WHERE source_type = 'fortigate') x WHERE m > 524288000"""


@query(_SEEDED_SQL)
def rules_run_all(t: Tables):
    """The twelve seeded rules over the whole table; an invalid and a disabled rule are skipped."""
    return run_rules.run_all(t.siem, t.blacklists, seeded(t), AS_OF).select("rule_id", "group_key", "event_count")


@query(_SEEDED_SQL.replace("UNION ALL SELECT 's06', concat('s06:', grp), CAST(2 * count(*) AS BIGINT) FROM pairs GROUP BY grp", ""))
def set_union_triggers(t: Tables):
    """Triggers of the threshold rules appended to those of the absence and blacklist rules."""
    parts = [run_rules.run_all(t.siem, t.blacklists, seeded(t), AS_OF, [kind])
             for kind in ("threshold", "absence", "blacklist")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("rule_id", "group_key", "event_count")


@query(f"""{with_tables('rules')}, p AS (SELECT p_partkey AS k, p_size AS z FROM part),
    bad AS (
      SELECT k, 'bad group_by' AS reason FROM p WHERE k % 6 = 0 AND z % 3 = 1
      UNION ALL SELECT k, 'bad count' FROM p WHERE k % 6 = 0 AND z % 5 = 0
      UNION ALL SELECT k, 'fewer than two steps' FROM p WHERE k % 6 = 1 AND z % 3 = 0
      UNION ALL SELECT k, 'step without event_id, action or category' FROM p WHERE k % 6 = 1 AND z % 3 = 2
      UNION ALL SELECT k, 'bad window_seconds' FROM p WHERE k % 6 = 1 AND z % 4 = 0
      UNION ALL SELECT k, 'bad filters' FROM p WHERE k % 6 = 2 AND z % 2 = 1
      UNION ALL SELECT k, 'bad field' FROM p WHERE k % 6 = 3 AND z % 2 = 1
      UNION ALL SELECT k, 'bad list_name' FROM p WHERE k % 6 = 3 AND z % 5 = 0
      UNION ALL SELECT k, 'bad std_devs' FROM p WHERE k % 6 = 4 AND z % 10 < 5
      UNION ALL SELECT k, 'bad baseline_days' FROM p WHERE k % 6 = 4 AND (z * 2 > 90 OR z < 1)
      UNION ALL SELECT k, 'unknown rule type' FROM p WHERE k % 6 = 5)
    SELECT r.id, r.rule_type, coalesce(string_agg(b.reason, ',' ORDER BY b.reason), '') AS problems
    FROM rules r LEFT JOIN bad b ON CAST(b.k AS STRING) = r.id GROUP BY r.id, r.rule_type""")
def rule_validate(t: Tables):
    checked = validate_rules(t.rules)
    return checked.select("id", "rule_type", F.array_sort("problems").alias("problems"))


# --- alert joins and sets -----------------------------------------------------------------------------------------------


@query(f"""{with_tables('alerts')} SELECT rule_id, group_key, id AS open_id FROM (SELECT *, row_number() OVER (PARTITION BY rule_id, group_key
    ORDER BY created_at DESC, id DESC) AS rn FROM alerts WHERE status = 'open') x WHERE rn = 1""")
def join_alert_open(t: Tables):
    return alert_ops.newest_open(t.alerts, "rule_id", "group_key")


@query(f"""{with_tables('alerts', 'rules')} SELECT a.id, a.rule_id, r.name AS rule_name FROM alerts a LEFT JOIN rules r ON r.id = a.rule_id""")
def join_alert_rule(t: Tables):
    return alert_ops.with_rule_names(t.alerts, t.rules).select("id", "rule_id", "rule_name")


_LINKED = f"""{with_tables('siem', 'alerts')}, r AS (SELECT alert_id, id, received_at, row_number() OVER (PARTITION BY alert_id
    ORDER BY received_at DESC, id DESC) AS rank FROM siem WHERE alert_id IN (SELECT id FROM alerts))"""


@query(f"{_LINKED} SELECT alert_id, id, {ts('received_at')} FROM r WHERE rank <= 100")
def join_alert_events(t: Tables):
    return alert_ops.linked_events(t.alerts, t.siem).select("alert_id", "id", "received_at")


@query(f"{_LINKED} SELECT alert_id, count(*) AS n, {ts('min(received_at)', 'oldest')} FROM r WHERE rank <= 100 GROUP BY alert_id")
def limit_linked(t: Tables):
    linked = alert_ops.linked_events(t.alerts, t.siem)
    return linked.groupBy("alert_id").agg(F.count(F.lit(1)).alias("n"), F.min("received_at").alias("oldest"))


_TOP_RULES = f"""{with_tables('alerts', 'rules')}, c AS (SELECT rule_id, count(*) AS alert_count FROM alerts WHERE status = 'open'
    GROUP BY rule_id ORDER BY alert_count DESC, rule_id LIMIT 5)
    SELECT c.rule_id, c.alert_count, r.name AS rule_name FROM c JOIN rules r ON r.id = c.rule_id"""


@query(_TOP_RULES)
def join_toprule_name(t: Tables):
    return dashboard.top_rules(t.alerts, t.rules)


@query(f"{_PAIRS2} SELECT DISTINCT grp, CAST(CAST(ts0 AS DATE) AS STRING) AS day FROM pairs")
def set_distinct(t: Tables):
    """Distinct days on which a source starts a completed chain."""
    found = sequence.chains(t.siem, _sequence(_STEPS2), AS_OF, "start")
    return found.select("grp", F.col("ts").cast("date").cast("string").alias("day")).distinct()


# --- links the library makes itself --------------------------------------------------------------------------------


def _linking_rules():
    return [make_rule("t1", "Failures", "threshold", "high", {"filters": {"event_id": ["4625"]}, "group_by": "src_ip", "count": 5, "window_seconds": MONTH}),
            make_rule("t2", "Denied", "threshold", "low", {"filters": {"action": "deny"}, "count": 1, "window_seconds": MONTH}),
            make_rule("s1", "Lateral", "sequence", "high", {"steps": _STEPS2, "group_by": "src_ip", "window_seconds": MONTH}),
            make_rule("b1", "Known", "blacklist", "critical", {"field": "src_ip", "list_name": "threat_intel_blocklist"})]


_LINKS_SQL = f"""{_PAIRS2}, {_BAD_IPS}, w AS (SELECT * FROM siem WHERE received_at >= {NOW} - INTERVAL {MONTH} SECOND),
    k AS (SELECT id, received_at, concat('t1:', src_ip) AS group_key FROM w WHERE event_id = '4625' AND src_ip IN (SELECT src_ip FROM w WHERE event_id = '4625' GROUP BY 1 HAVING count(*) >= 5)
      UNION ALL SELECT id, received_at, 't2:global' FROM w WHERE action = 'deny'
      UNION ALL SELECT id, received_at, concat('s1:', src_ip) FROM w JOIN (SELECT grp, min(ts0) AS lo, max(ts1) AS hi FROM pairs GROUP BY grp) p
        ON p.grp = src_ip AND received_at BETWEEN lo AND hi WHERE event_id IN ('4625', '4624')
      UNION ALL SELECT id, received_at, concat('b1:src_ip:', src_ip) FROM siem JOIN b ON b.value = src_ip WHERE received_at >= {NOW} - INTERVAL 1800 SECOND),
    l AS (SELECT id, received_at, group_key, sha256(concat(split_part(group_key, ':', 1), '|', group_key, '|{AS_OF}')) AS alert_id FROM k)"""


def _own_links(t: Tables):
    wanted = _linking_rules()
    fired = run_rules.evaluate(t.siem, t.blacklists, wanted, AS_OF)
    raised = alert_ops.merge_triggers(t.alerts.limit(0), fired, AS_OF)
    return raised, links.link_events(links.matched_events(t.siem, wanted, AS_OF, t.blacklists), raised)


@query(f"{_LINKS_SQL} SELECT id AS event_id, alert_id FROM l")
def link_alert_events(t: Tables):
    """Events linked to the alerts that rules of three types have just raised from them."""
    return _own_links(t)[1].select("event_id", "alert_id")


@query(f"""{_LINKS_SQL}, o AS (SELECT id, any_value(received_at) AS received_at, min(alert_id) AS alert_id FROM l GROUP BY id)
    SELECT alert_id, id, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY alert_id ORDER BY received_at DESC, id DESC) AS INTEGER) AS rank FROM o) x WHERE rank <= 5""")
def limit_own_links(t: Tables):
    """The five newest events of every alert, by links the library made."""
    raised, found = _own_links(t)
    unlinked = t.siem.withColumn("alert_id", F.lit(None).cast("string"))
    return alert_ops.linked_events(raised, links.with_alert_ids(unlinked, found), 5).select("alert_id", "id", "rank")


# --- the stored rule table -------------------------------------------------------------------------------------------

_EVENT_IDS = ("4625", "4624", "4672")
_RULE_ROWS = """SELECT concat('n', n_nationkey) AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'threshold' ELSE 'sequence' END AS rule_type, n_nationkey % 7 <> 6 AS enabled,
    CASE n_nationkey % 3 WHEN 0 THEN '4625' WHEN 1 THEN '4624' ELSE '4672' END AS a, CASE n_regionkey % 3 WHEN 0 THEN '4624' WHEN 1 THEN '4672' ELSE '4625' END AS b,
    n_regionkey + 2 AS least FROM nation"""


@query(f"""{_STEP_ROWS}, r AS ({_RULE_ROWS}), d AS (SELECT DISTINCT a, b FROM r WHERE enabled AND rule_type = 'sequence'),
    q AS (SELECT DISTINCT d.a, d.b, x.grp, x.ts AS ts0, y.ts AS ts1 FROM d JOIN a x ON x.e = d.a JOIN a y ON y.grp = x.grp AND y.ts > x.ts AND y.e = d.b)
    SELECT id AS rule_id, concat(id, ':', grp) AS group_key, count(*) AS event_count, {ts('min(ts)', 'first_seen')}, {ts('max(ts)', 'last_seen')}
      FROM r JOIN a ON a.e = r.a WHERE enabled AND rule_type = 'threshold' GROUP BY id, grp, least HAVING count(*) >= least
    UNION ALL SELECT id, concat(id, ':', grp), CAST(2 * count(*) AS BIGINT), {ts('min(ts0)', 'first_seen')}, {ts('max(ts1)', 'last_seen')}
      FROM r JOIN q ON q.a = r.a AND q.b = r.b WHERE enabled AND rule_type = 'sequence' GROUP BY id, grp""")
def rules_run_table(t: Tables):
    """A rule table written to storage, read back and evaluated: two scans of the events for all its rules."""
    rows = t.nation.selectExpr("*", "CAST(n_nationkey AS BIGINT) AS k", "CAST(n_regionkey AS BIGINT) AS z")
    pick = lambda n, *ids: F.when(n == 0, ids[0]).when(n == 1, ids[1]).otherwise(ids[2])
    a, b = pick(F.col("k") % 3, *_EVENT_IDS), pick(F.col("z") % 3, "4624", "4672", "4625")
    body = F.when(F.col("k") % 2 == 0, F.concat(F.lit('{"filters": {"event_id": ["'), a, F.lit('"]}, "count": '), (F.col("z") + 2).cast("string"))).otherwise(
        F.concat(F.lit('{"steps": [{"event_id": "'), a, F.lit('"}, {"event_id": "'), b, F.lit('"}]')))
    stored = rows.select(
        F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("").alias("description"),
        F.when(F.col("k") % 2 == 0, "threshold").otherwise("sequence").alias("rule_type"), F.lit("high").alias("severity"), (F.col("k") % 7 != 6).alias("enabled"),
        F.concat(body, F.lit(f', "group_by": "src_ip", "window_seconds": {MONTH}}}')).alias("body"),
        F.lit(AS_OF).cast("timestamp").alias("created_at"), F.lit(AS_OF).cast("timestamp").alias("updated_at"))
    path = shared_dir(t.spark, "rules")
    stored.write.parquet(path)
    table = tables.read_table(t.spark, path, "alert_rules")
    return run_rules.run_all(t.siem, t.blacklists, table, AS_OF).select("rule_id", "group_key", "event_count", "first_seen", "last_seen")
