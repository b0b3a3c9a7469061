"""Table maintenance: alert merge and patches, rule, source and blacklist changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchhouse.operators import alerts as alert_ops
from watchhouse.operators import catalog
from watchhouse.plans import threshold
from watchhouse.plans.rule_bodies import make_rule
from watchhouse.session import shared_dir
from watchhouse.sources import sinks
from watchhouse.workload.registry import query
from watchhouse.workload.tables import AS_OF, MONTH, Tables, duck_ip, ts, with_tables

NOW = f"TIMESTAMP '{AS_OF}'"

_COLUMNS = ("rule_id", "severity", "status", "title", "description", "src_ip", "first_seen", "last_seen", "event_count",
            "group_key", "created_at", "updated_at")


def _rules():
    """Rules 0..11, the ids the alert table uses; every one counts logon failures by address."""
    return [make_rule(str(i), f"rule {i}", "threshold", "high", {
        "filters": {"event_id": ["4625"] if i % 2 else ["4624"]}, "group_by": "src_ip", "count": 3,
        "window_seconds": MONTH}) for i in range(12)]


_MERGE = f"""{with_tables('siem', 'alerts')}, r AS (SELECT CAST(i AS STRING) AS rule_id, i FROM range(0, 12) x(i)),
    trig AS (SELECT rule_id, src_ip, count(*) AS n, min(received_at) AS first_seen, max(received_at) AS last_seen, concat(rule_id, ':', src_ip) AS group_key
      FROM r JOIN siem ON siem.event_id = CASE WHEN i % 2 = 1 THEN '4625' ELSE '4624' END GROUP BY rule_id, src_ip HAVING count(*) >= 3),
    o AS (SELECT rule_id, group_key, id FROM (SELECT *, row_number() OVER (PARTITION BY rule_id, group_key ORDER BY created_at DESC, id DESC) AS rn
      FROM alerts WHERE status = 'open') y WHERE rn = 1),
    m AS (SELECT trig.*, o.id AS open_id FROM trig LEFT JOIN o ON o.rule_id = trig.rule_id AND o.group_key = trig.group_key),
    merged AS (
      SELECT a.rule_id, a.severity, a.status, a.title, CASE WHEN m.open_id IS NULL THEN a.description ELSE concat('Triggered ', m.n, ' event(s) within {MONTH}s') END AS description,
        a.src_ip, a.first_seen, coalesce(m.last_seen, a.last_seen) AS last_seen, CAST(a.event_count + coalesce(m.n, 0) AS BIGINT) AS event_count, a.group_key,
        a.created_at, CASE WHEN m.open_id IS NULL THEN a.updated_at ELSE {NOW} END AS updated_at
      FROM alerts a LEFT JOIN m ON m.open_id = a.id
      UNION ALL SELECT rule_id, 'high', 'open', concat('rule ', rule_id, ': ', src_ip), concat('Triggered ', n, ' event(s) within {MONTH}s'), src_ip,
        first_seen, last_seen, n, group_key, {NOW}, {NOW} FROM m WHERE open_id IS NULL)"""
_MERGED = f"""SELECT rule_id, severity, status, title, description, src_ip, {ts('first_seen')}, {ts('last_seen')}, event_count, group_key,
    {ts('created_at')}, {ts('updated_at')} FROM merged"""


@query(f"{_MERGE} {_MERGED}")
def alert_merge(t: Tables):
    fired = threshold.threshold_triggers(t.siem, _rules(), AS_OF)
    return alert_ops.merge_triggers(t.alerts, fired, AS_OF).select(*_COLUMNS)


@query(f"""{_MERGE} SELECT CASE WHEN created_at = {NOW} THEN 'inserted' WHEN updated_at = {NOW} THEN 'updated' ELSE 'unchanged' END AS change,
    status, count(*) AS n, CAST(sum(event_count) AS BIGINT) AS events FROM merged GROUP BY 1, 2""")
def sink_alerts(t: Tables):
    """The changes of a merge appended to the stored alerts, twice over as after a failure, and the table read back."""
    path = shared_dir(t.spark, "alerts")
    sinks.write_alert_changes(t.alerts, path, None)
    fired = threshold.threshold_triggers(t.siem, _rules(), AS_OF)
    merged = alert_ops.merge_triggers(t.alerts, fired, AS_OF)
    for _ in range(2):
        sinks.write_alert_changes(merged, path, AS_OF)
    now = F.lit(AS_OF).cast("timestamp")
    change = F.when(F.col("created_at") == now, "inserted").when(F.col("updated_at") == now, "updated").otherwise("unchanged")
    return sinks.read_alerts(t.spark, path).groupBy(change.alias("change"), "status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("event_count").alias("events"))


# patches: every line item patches the alert of its order
_PATCHES = """SELECT CAST(l_orderkey AS STRING) AS alert_id, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 10000 + l_suppkey AS seq,
    CASE l_returnflag WHEN 'R' THEN 'closed' WHEN 'A' THEN 'acknowledged' WHEN 'N' THEN CASE WHEN l_linestatus = 'O' THEN 'bogus' END END AS status,
    CASE WHEN l_linenumber % 2 = 0 THEN concat('analyst-', CAST(l_suppkey AS STRING)) END AS assigned_to FROM lineitem"""


@query(f"""{with_tables('alerts')}, p AS ({_PATCHES}), g AS (SELECT alert_id, arg_max(status, seq) FILTER (status IS NOT NULL) AS s,
      arg_max(assigned_to, seq) FILTER (assigned_to IS NOT NULL) AS a FROM p WHERE status IS NULL OR status <> 'bogus' GROUP BY alert_id)
    SELECT id, coalesce(g.s, status) AS status, coalesce(g.a, assigned_to) AS assigned_to,
      {ts(f"CASE WHEN g.alert_id IS NULL THEN updated_at ELSE {NOW} END", 'updated_at')} FROM alerts LEFT JOIN g ON g.alert_id = id""")
def alert_patch(t: Tables):
    t.lineitem.createOrReplaceTempView("watchhouse_input")
    patches = t.spark.sql(_PATCHES.replace("FROM lineitem", "FROM watchhouse_input"))
    patched = alert_ops.patch_alerts(t.alerts, patches, AS_OF)
    return patched.select("id", "status", "assigned_to", "updated_at")


# rule changes: line items create, update and delete rules by part; some parts beyond the rule table
_CHANGES = """SELECT CAST(l_partkey + 500 AS STRING) AS id, l_orderkey * 100 + l_linenumber * 10 + l_suppkey % 10 AS seq,
    CASE WHEN l_quantity = 1 THEN 'delete' WHEN l_quantity = 2 THEN 'create' ELSE 'update' END AS op,
    CASE WHEN l_linenumber % 3 = 0 THEN concat('name ', CAST(l_suppkey AS STRING)) END AS name, CAST(NULL AS STRING) AS description,
    CASE WHEN l_quantity = 2 THEN 'threshold' END AS rule_type, CASE WHEN l_linenumber % 3 = 1 THEN 'low' END AS severity,
    CASE WHEN l_linenumber % 3 = 2 THEN l_suppkey % 2 = 0 END AS enabled, CAST(NULL AS STRING) AS body FROM lineitem"""


@query(f"""{with_tables('rules')}, c AS (SELECT id, seq, max(op) AS op, max(name) AS name, max(severity) AS severity, max(enabled) AS enabled FROM ({_CHANGES}) q GROUP BY id, seq),
    turn AS (SELECT id, max(seq) AS rs, arg_max(op, seq) AS ro FROM c WHERE op <> 'update' GROUP BY id),
    live AS (SELECT c.* FROM c LEFT JOIN turn ON turn.id = c.id WHERE turn.id IS NULL OR (ro = 'create' AND seq >= rs)),
    n AS (SELECT id, arg_max(name, seq) FILTER (name IS NOT NULL) AS name, arg_max(severity, seq) FILTER (severity IS NOT NULL) AS severity,
      arg_max(enabled, seq) FILTER (enabled IS NOT NULL) AS enabled, bool_or(op = 'create') AS made FROM live GROUP BY id)
    SELECT coalesce(r.id, n.id) AS id, CASE WHEN coalesce(n.made, false) THEN n.name ELSE coalesce(n.name, r.name) END AS name,
      CASE WHEN coalesce(n.made, false) THEN n.severity ELSE coalesce(n.severity, r.severity) END AS severity,
      CASE WHEN coalesce(n.made, false) THEN coalesce(n.enabled, true) ELSE coalesce(n.enabled, r.enabled) END AS enabled,
      coalesce(n.made, false) AS created, n.id IS NOT NULL AS touched
    FROM rules r FULL JOIN n ON n.id = r.id LEFT JOIN turn ON turn.id = coalesce(r.id, n.id)
    WHERE coalesce(turn.ro, '') <> 'delete' AND (coalesce(n.made, false) OR r.id IS NOT NULL)""")
def rule_changes(t: Tables):
    t.lineitem.createOrReplaceTempView("watchhouse_input")
    changes = t.spark.sql(_CHANGES.replace("FROM lineitem", "FROM watchhouse_input"))
    # one change per rule and moment
    changes = changes.groupBy("id", "seq").agg(
        *[F.max(n).alias(n) for n in ("op", "name", "description", "rule_type", "severity", "enabled", "body")])
    result = catalog.apply_rule_changes(t.rules, changes, AS_OF)
    now = F.lit(AS_OF).cast("timestamp")
    return result.select("id", "name", "severity", "enabled", (F.col("created_at") == now).alias("created"),
                         (F.col("updated_at") == now).alias("touched"))


_REQUESTS = f"""SELECT o_orderkey AS seq, {{ip}} AS ip_address, concat('new-', CAST(o_orderkey AS STRING)) AS hostname, 'linux' AS source_type,
    o_orderpriority AS label, CASE WHEN o_orderkey % 4 = 0 THEN false END AS enabled, false AS pci_env FROM orders"""


@query(f"""{with_tables('sources')}, q AS ({_REQUESTS.format(ip=duck_ip('o_custkey * 2'))}),
    ok AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ip_address ORDER BY seq) AS rn FROM q) x
      WHERE rn = 1 AND ip_address NOT IN (SELECT ip_address FROM sources))
    SELECT 'source' AS kind, ip_address, hostname, enabled FROM sources UNION ALL
    SELECT 'source', ip_address, hostname, coalesce(enabled, true) FROM ok UNION ALL
    SELECT 'rejected', ip_address, hostname, enabled FROM q WHERE seq NOT IN (SELECT seq FROM ok)""")
def source_changes(t: Tables):
    from watchhouse.workload.tables import ip

    sources = t.sources
    t.orders.createOrReplaceTempView("watchhouse_input")
    text = _REQUESTS.format(ip=ip("o_custkey * 2").replace("[div]", "div")).replace("FROM orders", "FROM watchhouse_input")
    accepted, rejected = catalog.register_sources(sources, t.spark.sql(text), AS_OF)
    columns = ("ip_address", "hostname", "enabled")
    return accepted.select(F.lit("source").alias("kind"), *columns).unionByName(
        rejected.select(F.lit("rejected").alias("kind"), *columns))


@query(f"""{with_tables('sources')}, s AS (SELECT CAST(o_custkey AS STRING) AS id, arg_max(o_orderstatus = 'O', o_orderkey) AS e FROM orders GROUP BY o_custkey)
    SELECT sources.id, coalesce(s.e, enabled) AS enabled FROM sources LEFT JOIN s ON s.id = sources.id""")
def source_switches(t: Tables):
    switches = t.orders.select(F.col("o_custkey").cast("string").alias("id"), F.col("o_orderkey").alias("seq"),
                               (F.col("o_orderstatus") == "O").alias("enabled"))
    return catalog.switch_sources(t.sources, switches).select("id", "enabled")


@query("""SELECT DISTINCT CASE WHEN l_suppkey % 2 = 0 THEN 'a' ELSE 'b' END AS list_name, CAST(l_partkey AS STRING) AS value FROM lineitem""")
def blacklist_load(t: Tables):
    entries = t.lineitem.select(
        F.when(F.col("l_suppkey") % 2 == 0, "a").otherwise("b").alias("list_name"),
        F.col("l_partkey").cast("string").alias("value"))
    return catalog.load_blacklist(entries)
