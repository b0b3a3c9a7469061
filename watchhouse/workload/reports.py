"""Dashboard, compliance, paging, integrity."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchhouse.operators import integrity, paging
from watchhouse.operators.catalog import source_activity
from watchhouse.plans import compliance, dashboard
from watchhouse.workload.registry import query
from watchhouse.workload.tables import AS_OF, Tables, ts, with_tables

NOW = f"TIMESTAMP '{AS_OF}'"
SIEM = with_tables("siem")
WEEK = 168
_RECENT = f"received_at >= {NOW} - INTERVAL {WEEK} HOUR"
FROM, TO = "2024-01-01 06:00:00", "2024-01-28 18:00:00"
_PERIOD = f"received_at BETWEEN TIMESTAMP '{FROM}' AND TIMESTAMP '{TO}'"


# --- dashboard ------------------------------------------------------------------------------------------


@query(f"{SIEM} SELECT count(*) AS total_events FROM siem WHERE {_RECENT}")
def dash_total(t: Tables):
    return dashboard.total_events(t.siem, AS_OF, WEEK)


@query(f"{with_tables('alerts')} SELECT count(*) AS open_alerts FROM alerts WHERE status = 'open'")
def dash_open_alerts(t: Tables):
    return dashboard.open_alerts(t.alerts)


@query(f"{SIEM} SELECT log_level, count(*) AS n FROM siem WHERE {_RECENT} AND log_level IS NOT NULL GROUP BY log_level")
def dash_by_level(t: Tables):
    return dashboard.by_level(t.siem, AS_OF, WEEK)


@query(f"{SIEM} SELECT category, count(*) AS n FROM siem WHERE {_RECENT} AND category IS NOT NULL GROUP BY category")
def dash_by_category(t: Tables):
    return dashboard.by_category(t.siem, AS_OF, WEEK)


_TOP_HOSTS = f"SELECT source_host, count(*) AS event_count FROM siem WHERE {_RECENT} GROUP BY source_host ORDER BY event_count DESC, source_host LIMIT 10"


@query(f"{SIEM} {_TOP_HOSTS}")
def dash_top_hosts(t: Tables):
    return dashboard.top_hosts(t.siem, AS_OF, WEEK)


@query(f"{SIEM} {_TOP_HOSTS.replace('source_host', 'src_ip')}")
def topk_hosts(t: Tables):
    """The ten busiest source addresses: a key with many values."""
    renamed = t.siem.withColumn("source_host", F.col("src_ip"))
    return dashboard.top_hosts(renamed, AS_OF, WEEK).withColumnRenamed("source_host", "src_ip")


_TOP_RULES = """SELECT c.rule_id, c.alert_count, r.name AS rule_name FROM (SELECT rule_id, count(*) AS alert_count FROM alerts
    WHERE status = 'open' GROUP BY rule_id ORDER BY alert_count DESC, rule_id LIMIT 5) c JOIN rules r ON r.id = c.rule_id"""


@query(f"{with_tables('alerts', 'rules')} {_TOP_RULES}")
def dash_top_rules(t: Tables):
    return dashboard.top_rules(t.alerts, t.rules)


@query(f"{with_tables('alerts', 'rules')} {_TOP_RULES.replace('JOIN rules r', 'JOIN (SELECT * FROM rules WHERE enabled) r')}")
def topk_rules(t: Tables):
    """Rules missing from the rule table drop out after the cut to five."""
    return dashboard.top_rules(t.alerts, t.rules.filter("enabled"))


@query(f"{SIEM} SELECT count(DISTINCT source_host) AS active_sources FROM siem WHERE {_RECENT}")
def dash_active_sources(t: Tables):
    return dashboard.active_sources(t.siem, AS_OF, WEEK)


def _timeline_sql(bucket: str, where: str = "TRUE") -> str:
    return f"{SIEM} SELECT {ts('b', 'bucket')}, n FROM (SELECT {bucket} AS b, count(*) AS n FROM siem WHERE {_RECENT} AND {where} GROUP BY 1) x"


@query(_timeline_sql("date_trunc('hour', received_at)"))
def dash_timeline(t: Tables):
    return dashboard.timeline(t.siem, AS_OF, WEEK, "1h")


@query(_timeline_sql("date_trunc('hour', received_at) + INTERVAL 5 MINUTE * (minute(received_at) // 5)", "source_type = 'linux'"))
def dash_timeline_5m(t: Tables):
    return dashboard.timeline(t.siem, AS_OF, WEEK, "5m", "linux")


@query(_timeline_sql("date_trunc('minute', received_at)"))
def dash_timeline_1m(t: Tables):
    return dashboard.timeline(t.siem, AS_OF, WEEK, "1m")


@query(f"""{with_tables('siem', 'alerts', 'rules')}, w AS (SELECT * FROM siem WHERE {_RECENT}), tr AS ({_TOP_RULES})
    SELECT 'total_events' AS section, '' AS item, count(*) AS n FROM w
    UNION ALL SELECT 'by_level', log_level, count(*) FROM w GROUP BY log_level
    UNION ALL SELECT 'by_category', category, count(*) FROM w GROUP BY category
    UNION ALL SELECT 'top_host', source_host, event_count FROM ({_TOP_HOSTS}) h
    UNION ALL SELECT 'active_sources', '', count(DISTINCT source_host) FROM w
    UNION ALL SELECT 'open_alerts', '', count(*) FROM alerts WHERE status = 'open'
    UNION ALL SELECT 'top_rule', rule_name, alert_count FROM tr""")
def dash_summary(t: Tables):
    return dashboard.summary(t.siem, t.alerts, t.rules, AS_OF, WEEK)


# --- compliance ---------------------------------------------------------------------------------------------


_TOTALS = """count(*) AS total_events, count(*) FILTER (event_id = '4625' OR action = 'logon_failed') AS failed_logins,
    count(*) FILTER (event_id = '4672' OR action = 'privileged_logon') AS privilege_escalations,
    count(*) FILTER (event_id = '1102' OR event_id = '0100044546') AS audit_log_clears"""


@query(f"{SIEM} SELECT {_TOTALS} FROM siem WHERE {_PERIOD}")
def comp_totals(t: Tables):
    return compliance.totals(t.siem, FROM, TO)


@query(f"{SIEM} SELECT category, count(*) AS n FROM siem WHERE {_PERIOD} AND category IS NOT NULL GROUP BY category")
def comp_by_category(t: Tables):
    return compliance.by_category(t.siem, FROM, TO)


_GAP = f"round_even((epoch_us({NOW}) - epoch_us(last_seen)) / 3600000000.0, 1)"
_GAPS = f"""SELECT * FROM (SELECT src_ip AS source_host, max(received_at) AS last_seen FROM siem WHERE {_PERIOD} GROUP BY src_ip) g
    WHERE last_seen < {NOW} - INTERVAL 24 HOUR"""


@query(f"{SIEM} SELECT source_host, {ts('last_seen')}, {_GAP} AS gap_hours FROM ({_GAPS}) g")
def comp_log_gaps(t: Tables):
    """Addresses stand in for hosts here, as they fall silent at different times."""
    by_address = t.siem.withColumn("source_host", F.col("src_ip"))
    return compliance.log_gaps(by_address, FROM, TO, AS_OF)


def _retention_sql(years: int, now: str) -> str:
    return f"""{SIEM} SELECT {ts('o', 'oldest_event')}, CAST({years} AS INTEGER) AS required_retention_years, CAST(12 AS INTEGER) AS hot_storage_months,
      coalesce(((epoch_us({now}) - epoch_us(o)) // 86400000000) / 365.25 >= {years}, false) AS compliant
      FROM (SELECT min(received_at) AS o FROM siem) x"""


@query(_retention_sql(6, NOW))
def comp_retention(t: Tables):
    return compliance.retention_posture(t.siem, "hipaa", AS_OF)


@query(_retention_sql(2, "TIMESTAMP '2026-01-02 00:00:00'"))
def comp_retention_pci(t: Tables):
    """Two years and a day later the table satisfies the two-year rule."""
    return compliance.retention_posture(t.siem, "pci_dss", "2026-01-02 00:00:00")


@query(f"{SIEM} SELECT count(*) AS cardholder_env_events FROM siem WHERE {_PERIOD} AND list_contains(tags, 'pci_dss')")
def comp_cardholder(t: Tables):
    return compliance.cardholder_events(t.siem, FROM, TO)


# a longer period than the data, so that silent days exist at both ends
_WIDE = ("2023-12-20 06:00:00", "2024-02-10 03:00:00")
_DAYS = f"""SELECT CAST(TIMESTAMP '{_WIDE[0]}' + to_days(CAST(i AS INTEGER)) AS DATE) AS day FROM range(0,
    (epoch_us(TIMESTAMP '{_WIDE[1]}') - epoch_us(TIMESTAMP '{_WIDE[0]}')) // 86400000000 + 1) r(i)"""
_SILENT = f"""SELECT CAST(day AS STRING) AS day FROM ({_DAYS}) d WHERE day NOT IN (SELECT CAST(received_at AS DATE) FROM siem
    WHERE received_at BETWEEN TIMESTAMP '{_WIDE[0]}' AND TIMESTAMP '{_WIDE[1]}')"""


@query(f"{SIEM} {_SILENT}")
def comp_daily_gaps(t: Tables):
    return compliance.daily_gaps(t.siem, *_WIDE)


_NO_ADMIN = f"""SELECT CAST(day AS STRING) AS day FROM ({_DAYS}) d WHERE day NOT IN (SELECT CAST(received_at AS DATE) FROM siem
    WHERE src_ip = '10.0.0.3' AND received_at BETWEEN TIMESTAMP '{_WIDE[0]}' AND TIMESTAMP '{_WIDE[1]}')"""


@query(f"{SIEM} {_NO_ADMIN}")
def join_gap_dates(t: Tables):
    """Silent days of one address, which also lie within the data."""
    return compliance.daily_gaps(t.siem.filter("src_ip = '10.0.0.3'"), *_WIDE)


@query(f"{SIEM} SELECT c.src_ip, CAST(d.day AS STRING) AS day FROM (SELECT DISTINCT src_ip FROM siem) c, ({_DAYS}) d "
       "EXCEPT SELECT src_ip, CAST(CAST(received_at AS DATE) AS STRING) FROM siem")
def set_gap_dates(t: Tables):
    """Calendar minus active days, for every address at once."""
    addresses = t.siem.select("src_ip").distinct()
    days = addresses.select("src_ip", F.explode(compliance.calendar_dates(*_WIDE)).alias("day"))
    calendar = days.withColumn("day", F.col("day").cast("string"))
    active = t.siem.select("src_ip", F.col("received_at").cast("date").cast("string").alias("day")).distinct()
    return calendar.join(active, ["src_ip", "day"], "left_anti")


def _report_sql(pci: bool, years: int) -> str:
    extra = f"""UNION ALL SELECT 'cardholder_env_events', '', CAST(count(*) AS STRING) FROM p WHERE list_contains(tags, 'pci_dss')
      UNION ALL SELECT 'daily_review_gap', CAST(CAST(d AS DATE) AS STRING), '' FROM (SELECT TIMESTAMP '{FROM}' + to_days(CAST(i AS INTEGER)) AS d
        FROM range(0, (epoch_us(TIMESTAMP '{TO}') - epoch_us(TIMESTAMP '{FROM}')) // 86400000000 + 1) r(i)) c
        WHERE CAST(d AS DATE) NOT IN (SELECT CAST(received_at AS DATE) FROM p)""" if pci else ""
    return f"""{SIEM}, p AS (SELECT * FROM siem WHERE {_PERIOD}), c AS (SELECT {_TOTALS} FROM p)
      SELECT 'total_events' AS section, '' AS item, CAST(total_events AS STRING) AS value FROM c
      UNION ALL SELECT 'failed_logins', '', CAST(failed_logins AS STRING) FROM c
      UNION ALL SELECT 'privilege_escalations', '', CAST(privilege_escalations AS STRING) FROM c
      UNION ALL SELECT 'audit_log_clears', '', CAST(audit_log_clears AS STRING) FROM c
      UNION ALL SELECT 'category', category, CAST(count(*) AS STRING) FROM p GROUP BY category
      UNION ALL SELECT 'log_gap', source_host, CAST(round_even((epoch_us({NOW}) - epoch_us(max(received_at))) / 3600000000.0, 1) AS STRING)
        FROM p GROUP BY source_host HAVING max(received_at) < {NOW} - INTERVAL 24 HOUR
      UNION ALL SELECT 'oldest_event', '', CAST(min(received_at) AS STRING) FROM siem
      UNION ALL SELECT 'required_retention_years', '', '{years}'
      UNION ALL SELECT 'hot_storage_months', '', '12'
      UNION ALL SELECT 'compliant', '', 'false' {extra}"""


@query(_report_sql(False, 6))
def comp_report(t: Tables):
    return compliance.report(t.siem, "hipaa", FROM, TO, AS_OF)


@query(_report_sql(True, 2))
def comp_report_pci(t: Tables):
    return compliance.report(t.siem, "pci_dss", FROM, TO, AS_OF)


@query(f"""{with_tables('siem', 'sources')} SELECT s.id, s.ip_address, {ts('e.seen', 'last_seen')}, CAST(coalesce(e.rate, 0) AS INTEGER) AS event_rate_1m
    FROM sources s LEFT JOIN (SELECT src_ip, max(received_at) AS seen, count(*) FILTER (received_at > TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 60 SECOND) AS rate
      FROM siem GROUP BY src_ip) e ON e.src_ip = s.ip_address""")
def source_rollup(t: Tables):
    return source_activity(t.siem, t.sources, "2024-01-30 12:00:00").select("id", "ip_address", "last_seen", "event_rate_1m")


# --- pages ------------------------------------------------------------------------------------------------------


def _page_sql(tables: str, table: str, columns: str, order: str, number: int, size: int, where: str = "TRUE") -> str:
    return f"""{with_tables(tables)}, x AS (SELECT * FROM {table} WHERE {where}), n AS (SELECT count(*) AS total FROM x)
      SELECT {columns}, total, CAST(greatest(1, ceil(total / {size}.0)) AS BIGINT) AS pages FROM
      (SELECT * FROM x ORDER BY {order} LIMIT {size} OFFSET {(number - 1) * size}) i, n"""


def _with_totals(page: paging.Page, *columns: str):
    """Page rows next to the totals; the totals are one row, taken as scalars."""
    total = page.totals.select("total").scalar()
    pages = page.totals.select("pages").scalar()
    return page.items.select(*columns, total.alias("total"), pages.alias("pages"))


@query(_page_sql("siem", "siem", f"id, {ts('received_at')}, source_host, message", "received_at DESC, id DESC", 3, 50, "category = 'auth'"))
def page_events(t: Tables):
    rows = t.siem.filter("category = 'auth'")
    return _with_totals(paging.page_events(rows, 3, 50), "id", "received_at", "source_host", "message")


@query(f"""{SIEM} SELECT id, {ts('received_at')} FROM siem WHERE received_at < TIMESTAMP '2024-01-20 00:00:00' ORDER BY siem.received_at DESC, id DESC LIMIT 500""")
def page_events_keyset(t: Tables):
    return paging.next_events(t.siem, "2024-01-20 00:00:00", "", 500).select("id", "received_at")


@query(_page_sql("alerts", "alerts", f"id, rule_id, status, {ts('last_seen')}", "last_seen DESC, id", 2, 200, "status = 'open'"))
def page_alerts(t: Tables):
    return _with_totals(paging.page_alerts(t.alerts.filter("status = 'open'"), 2, 200), "id", "rule_id", "status", "last_seen")


@query(_page_sql("siem", "siem", f"id, {ts('received_at')}, source_host", "received_at DESC, id DESC", 17, 50))
def page_events_deep(t: Tables):
    """A page found by counts: only the hours it lies in are sorted."""
    return _with_totals(paging.page_by_counts(t.siem, 17, 50), "id", "received_at", "source_host")


@query(_page_sql("alerts", "alerts", f"id, rule_id, {ts('last_seen')}", "last_seen DESC, id", 6, 200))
def page_alerts_deep(t: Tables):
    """Alerts of whole days share one time, so a page is cut within ties."""
    page = paging.page_by_counts(t.alerts, 6, 200, "last_seen", id_ascending=True, sorted_rows=50)
    return _with_totals(page, "id", "rule_id", "last_seen")


@query(_page_sql("rules", "rules", "id, name", "name, id", 2, 50, "enabled"))
def page_rules(t: Tables):
    return _with_totals(paging.page_rules(t.rules.filter("enabled"), 2, 50), "id", "name")


@query(_page_sql("sources", "sources", "id, label, ip_address", "label ASC NULLS LAST, ip_address", 6, 200))
def page_sources(t: Tables):
    return _with_totals(paging.page_sources(t.sources, 6, 200), "id", "label", "ip_address")


# --- integrity ------------------------------------------------------------------------------------------------------


_CHECK = """SELECT id, CASE WHEN coalesce(raw_hash, '') = '' THEN 'No raw_hash stored for this event'
    WHEN coalesce(raw_message, '') = '' THEN 'No raw_message stored for this event' END AS detail, raw_hash, sha256(raw_message) AS h FROM siem"""


@query(f"""{SIEM}, c AS ({_CHECK}) SELECT id, detail IS NULL AND raw_hash = h AS intact, detail,
    CASE WHEN detail IS NULL THEN raw_hash END AS stored_hash, CASE WHEN detail IS NULL THEN h END AS recomputed_hash FROM c""")
def verify_integrity(t: Tables):
    return integrity.verify_integrity(t.siem)


@query("""WITH c AS (SELECT doc_id, n_chars % 10 AS m FROM documents)
    SELECT CASE WHEN m = 0 THEN 'No raw_hash stored for this event' WHEN m = 1 THEN 'tampered' ELSE 'intact' END AS outcome, count(*) AS n FROM c GROUP BY 1""")
def verify_integrity_documents(t: Tables):
    """Hashes over whole texts; a tenth lost its hash, a tenth was changed after hashing."""
    kind = F.col("n_chars") % 10
    events = t.documents.select(
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("raw_message"),
        F.when(kind == 1, F.sha2(F.concat("text", F.lit("!")), 256)).when(kind > 1, F.sha2("text", 256)).alias("raw_hash"))
    return integrity.integrity_summary(events)


@query("""SELECT CAST(o_orderkey AS STRING) AS path, CASE WHEN d > 2192 THEN 'delete' WHEN d > 730 THEN 'archive' WHEN d > 365 THEN 'cool' ELSE 'keep' END AS action
    FROM (SELECT o_orderkey, (epoch_us(TIMESTAMP '2001-01-01 00:00:00') - epoch_us(o_orderdate)) / 86400000000.0 AS d FROM orders) x""")
def retention_plan(t: Tables):
    files = t.orders.select(F.col("o_orderkey").cast("string").alias("path"),
                            F.col("o_orderdate").cast("timestamp").alias("modificationTime"),
                            F.col("o_custkey").alias("length"))
    return integrity.retention_plan(files, "2001-01-01 00:00:00").select("path", "action")
