"""Streaming queries: run to the end of the input, then read what they wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchhouse.operators import rate_limit as buckets
from watchhouse.operators.alerts import latest_alerts
from watchhouse.plans.rule_bodies import make_rule
from watchhouse.plans.threshold import threshold_panes, threshold_tick
from watchhouse.session import shared_dir
from watchhouse.sources import sinks, tables
from watchhouse.streaming import alert_state, ingest, rules
from watchhouse.streaming.rate_limit import rate_limit_stream
from watchhouse.workload.files import FANNED_OUT, counted_lines
from watchhouse.workload.registry import query
from watchhouse.workload.tables import AS_OF, DAY, Tables, duck_ip, ts, with_tables

SIEM = with_tables("siem")
_BAD_IPS = f"b AS (SELECT DISTINCT {duck_ip('s_suppkey * 2')} AS value FROM supplier WHERE s_nationkey % 3 <> 0)"


def _collect(stream: DataFrame, purpose: str, mode: str = "append") -> DataFrame:
    """Run a stream over all available input into Parquet files and read them."""
    path = shared_dir(stream.sparkSession, purpose)
    writer = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}/checkpoint")
    writer.trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


@query(FANNED_OUT, streaming=True)
def st_normalize(t: Tables):
    """Raw lines of registered and other senders through one micro-batch job into events, archive and dead letters."""
    path = shared_dir(t.spark, "ingest")
    registry = Tables(t.spark, t.folder).sources
    ingest.start_ingest(t.mixed_lines, registry, path, f"{path}/checkpoint", AS_OF, interval=None).awaitTermination()
    read = t.spark.read
    events = counted_lines("events", read.parquet(f"{path}/events"), "source_type", "raw_message")
    archive = counted_lines("archive", read.text(f"{path}/archive"), "source_type", "value")
    return events.unionByName(archive).unionByName(counted_lines("errors", read.parquet(f"{path}/errors"), "detail", "raw"))


@query(f"""{SIEM} SELECT id, {ts('received_at')}, message, strftime(received_at, '%Y-%m') AS event_month FROM siem""", streaming=True)
def st_storage(t: Tables):
    """Event stream into the month-partitioned table, duplicates of an id dropped."""
    path = shared_dir(t.spark, "storage")
    twice = t.siem.union(t.siem)
    ingest.start_storage(twice, f"{path}/events", f"{path}/checkpoint", interval=None, dedupe_within="40 days").awaitTermination()
    return tables.read_events(t.spark, f"{path}/events").select("id", "received_at", "message", "event_month")


@query(f"{SIEM} SELECT source_type, '2024' AS year, '31' AS day, message AS raw, count(*) AS n FROM siem GROUP BY source_type, message", streaming=True)
def st_archive(t: Tables):
    path = shared_dir(t.spark, "stream-archive")
    lines = t.siem.select(F.col("message").alias("raw"), "source_type")
    ingest.start_archive(lines, f"{path}/raw", f"{path}/checkpoint", AS_OF, interval=None).awaitTermination()
    archived = sinks.read_archive(t.spark, f"{path}/raw")
    return archived.groupBy("source_type", "year", "day", "raw").agg(F.count(F.lit(1)).alias("n"))


_TICKS = ("2024-01-15 00:00:00", "2024-01-22 12:00:07", "2024-01-29 06:00:30")


def _threshold_sql(rule: str, group: str, days: int, wanted: str, count: str, having: str) -> str:
    return (f"SELECT tick, concat('{rule}:', {group}) AS group_key, {count} AS event_count, {ts('min(received_at)', 'first_seen')}, {ts('max(received_at)', 'last_seen')} "
            f"FROM siem, k WHERE {wanted} AND received_at >= moment - INTERVAL {days * DAY} SECOND AND received_at < moment GROUP BY tick, {group} HAVING {having}")


_SENT = "TRY_CAST(extra['sentbyte'] AS DECIMAL(38,6))"


_THRESHOLDS_SQL = f"""{SIEM}, k AS (SELECT tick, CAST(tick AS TIMESTAMP) AS moment FROM (SELECT unnest({list(_TICKS)}) AS tick)),
    t AS ({_threshold_sql('c', 'src_ip', 10, "event_id = '4625'", 'count(*)', 'count(*) >= 5')}
      UNION ALL {_threshold_sql('u', 'source_host', 7, "category = 'auth'", 'count(DISTINCT user_name)', 'count(DISTINCT user_name) >= 20')}
      UNION ALL {_threshold_sql('s', 'src_ip', 3, "source_type = 'fortigate' AND extra['sentbyte'] IS NOT NULL", 'count(*)', f'CAST(max({_SENT}) AS DOUBLE) > 400000000')})
    SELECT * FROM t"""


def _threshold_rules():
    return [
        make_rule("c", "Count", "threshold", "high", {"filters": {"event_id": ["4625"]}, "group_by": "src_ip", "count": 5, "window_seconds": 10 * DAY}),
        make_rule("u", "Users", "threshold", "high", {"filters": {"category": "auth"}, "group_by": "source_host", "distinct_users": 20, "window_seconds": 7 * DAY}),
        make_rule("s", "Sent", "threshold", "high", {"filters": {"source_type": "fortigate"}, "group_by": "src_ip", "window_seconds": 3 * DAY,
                                                     "aggregate": {"field": "sentbyte", "op": "gt", "value": 400000000}})]


def _threshold_ticks(t: Tables, sketches: bool):
    wanted = _threshold_rules()
    panes = _collect(threshold_panes(t.siem, wanted, sketches=sketches), "threshold")
    stored = Tables(t.spark, t.folder).siem
    fired = [threshold_tick(panes, stored, wanted, tick, sketches=sketches).withColumn("tick", F.lit(tick)) for tick in _TICKS]
    return fired[0].unionByName(fired[1]).unionByName(fired[2]).select("tick", "group_key", "event_count", "first_seen", "last_seen")


@query(_THRESHOLDS_SQL, streaming=True)
def st_threshold(t: Tables):
    """Counting, distinct-user and aggregate rules kept as panes by one stream; each tick equals the batch form."""
    return _threshold_ticks(t, False)


@query(_THRESHOLDS_SQL.replace("SELECT * FROM t", "SELECT * REPLACE (CASE WHEN group_key NOT LIKE 'u:%' THEN event_count END AS event_count) FROM t"), streaming=True)
def st_threshold_sketch(t: Tables):
    """The same with a sketch of the users per pane: the same groups fire; the number of their users is an estimate and left out here."""
    counted = ~F.col("group_key").startswith("u:")
    return _threshold_ticks(t, True).withColumn("event_count", F.when(counted, F.col("event_count")))


@query(f"""{SIEM}, a AS (SELECT src_ip AS g, received_at AS ts, event_id AS e FROM siem WHERE event_id IN ('4625', '4624', '4672')),
    m AS (SELECT x.g, y.ts AS t1, max(x.ts) AS t0 FROM a x JOIN a y ON y.g = x.g AND y.ts > x.ts WHERE x.e = '4625' AND y.e = '4624' GROUP BY x.g, y.ts),
    z AS (SELECT m.g, z.ts AS t2, max(t0) AS t0 FROM m JOIN a z ON z.g = m.g AND z.ts > m.t1 WHERE z.e = '4672' GROUP BY m.g, z.ts)
    SELECT concat('q:', g) AS group_key, {ts('t0', 'first_seen')}, {ts('t2', 'last_seen')} FROM z WHERE epoch_us(t2) - epoch_us(t0) <= {5 * DAY * 1_000_000}
      AND (floor(epoch(t2) / 30) + 1) * 30 <= (SELECT epoch(max(ts)) - 60 FROM a)""", streaming=True)
def st_sequence(t: Tables):
    """Three steps within five days: every completion the watermark has passed, with the latest start that leads to it."""
    rule = make_rule("q", "Chain", "sequence", "high", {
        "steps": [{"event_id": "4625"}, {"event_id": "4624"}, {"event_id": "4672"}], "group_by": "src_ip", "window_seconds": 5 * DAY})
    return _collect(rules.sequence_stream(t.siem, rule), "sequence").select("group_key", "first_seen", "last_seen")


def _two_steps(rule: str, first: str, second: str, days: int) -> str:
    pairs = f"SELECT x.g, y.ts AS t1, max(x.ts) AS t0 FROM a x JOIN a y ON y.g = x.g AND y.ts > x.ts WHERE x.e = '{first}' AND y.e = '{second}' GROUP BY x.g, y.ts"
    return (f"SELECT concat('{rule}:', g) AS group_key, {ts('t0', 'first_seen')}, {ts('t1', 'last_seen')} FROM ({pairs}) p "
            f"WHERE epoch_us(t1) - epoch_us(t0) <= {days * DAY * 1_000_000} AND (floor(epoch(t1) / 30) + 1) * 30 <= (SELECT epoch(max(ts)) - 60 FROM a)")


@query(f"""{SIEM}, a AS (SELECT src_ip AS g, received_at AS ts, event_id AS e FROM siem WHERE event_id IN ('4625', '4624', '4672')) {_two_steps('a', '4625', '4624', 2)}
    UNION ALL {_two_steps('b', '4624', '4625', 9)} UNION ALL {_two_steps('c', '4672', '4672', 1)}""", streaming=True)
def st_sequences(t: Tables):
    """Three rules of different steps and windows in one stateful stream."""
    wanted = [make_rule(i, i, "sequence", "high", {"steps": [{"event_id": x}, {"event_id": y}], "group_by": "src_ip", "window_seconds": days * DAY})
              for i, x, y, days in (("a", "4625", "4624", 2), ("b", "4624", "4625", 9), ("c", "4672", "4672", 1))]
    return _collect(rules.sequence_streams(t.siem, wanted), "sequences").select("group_key", "first_seen", "last_seen")


def _blacklist_rule():
    return make_rule("b", "Known Bad IP", "blacklist", "critical", {"field": "src_ip", "list_name": "threat_intel_blocklist"})


@query(f"""{SIEM}, {_BAD_IPS} SELECT concat('b:src_ip:', src_ip) AS group_key, {ts('received_at', 'last_seen')} FROM siem JOIN b ON b.value = src_ip""", streaming=True)
def st_blacklist(t: Tables):
    found = _collect(rules.blacklist_stream(t.siem, t.blacklists, _blacklist_rule()), "blacklist")
    return found.select("group_key", "last_seen")


@query(f"""{SIEM}, k AS (SELECT DISTINCT date_trunc('day', received_at) AS tick FROM siem),
    r AS (SELECT tick, unnest(['silent:absent', 'quiet:absent', 'busy:absent']) AS group_key FROM k)
    SELECT group_key, {ts('tick', 'last_seen')} FROM r WHERE NOT EXISTS (SELECT 1 FROM siem WHERE received_at <= tick AND CASE group_key
      WHEN 'silent:absent' THEN received_at >= tick - INTERVAL 604800 SECOND AND list_contains(tags, 'no:such:tag')
      WHEN 'quiet:absent' THEN received_at >= tick - INTERVAL 7200 SECOND AND action = 'logon' AND log_level = 'info' AND user_name = 'user7'
      ELSE received_at >= tick - INTERVAL 604800 SECOND END)""", streaming=True)
def st_absence(t: Tables):
    """Ticks derived from the event stream; each one looks back over the stored events, silent or not."""
    path = shared_dir(t.spark, "absence")
    window = {"window_seconds": 7 * DAY}
    wanted = [make_rule("silent", "Silent", "absence", "high", {"filters": {"tags": ["no:such:tag"]}, **window}),
              make_rule("quiet", "Quiet", "absence", "high", {
                  "filters": {"action": "logon", "log_level": "info", "user_name": "user7"}, "window_seconds": 7200}),
              make_rule("busy", "Busy", "absence", "high", window)]
    stored = Tables(t.spark, t.folder).siem
    ticks = t.siem.select(F.date_trunc("day", "received_at").alias("as_of"))
    rules.start_absence(ticks, lambda: stored, wanted, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{path}/out").select("group_key", "last_seen")


_TICK = "2024-01-30 12:30:00"
_ANOMALY = {"filters": {"category": "auth"}, "group_by": "src_ip", "std_devs": 3.0, "baseline_days": 20, "window_seconds": 7 * DAY}


@query(f"""{SIEM}, h AS (SELECT src_ip AS grp, date_trunc('hour', received_at) AS b, count(*) AS n, count(*) FILTER (received_at >= TIMESTAMP '{_TICK}' - INTERVAL {7 * DAY} SECOND) AS w
      FROM siem WHERE category = 'auth' AND received_at >= TIMESTAMP '{_TICK}' - INTERVAL {20 * DAY} SECOND GROUP BY 1, 2),
    s AS (SELECT grp, CAST(sum(w) AS BIGINT) AS event_count, avg(n) AS mean, stddev_pop(n) AS sd FROM h GROUP BY grp)
    SELECT concat('a:', grp) AS group_key, event_count FROM s WHERE sd > 0 AND event_count > 0 AND (event_count - mean) / sd > 3""", streaming=True)
def st_anomaly(t: Tables):
    """Hourly counts kept by a stream; the tick adds only the cut first hour and the current window."""
    rule = make_rule("a", "Burst", "anomaly", "high", _ANOMALY)
    path = shared_dir(t.spark, "hourly")
    rules.start_hourly_rollup(t.siem, rule, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    hourly = t.spark.read.parquet(f"{path}/out")
    fired = rules.anomaly_tick(Tables(t.spark, t.folder).siem, hourly, rule, _TICK)
    return fired.select("group_key", "event_count")


@query(f"""{SIEM}, {_BAD_IPS} SELECT concat('b:src_ip:', src_ip) AS group_key, 'open' AS status, count(*) AS event_count, {ts('min(received_at)', 'first_seen')},
    {ts('max(received_at)', 'last_seen')} FROM siem JOIN b ON b.value = src_ip GROUP BY src_ip""", streaming=True)
def st_alert_merge(t: Tables):
    """A trigger stream into alerts kept as state; the table is what the appended changes amount to."""
    found = rules.blacklist_stream(t.siem, t.blacklists, _blacklist_rule())
    changes = _collect(alert_state.alert_changes(alert_state.trigger_rows(found)), "alert-changes")
    return latest_alerts(changes).select("group_key", "status", "event_count", "first_seen", "last_seen")


# one token in 20 000 seconds, two at most: sparse data still meets an empty bucket
_RATE, _CAPACITY = 5e-5, 2.0
_BUCKET = f"""WITH RECURSIVE a AS (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY us) AS i FROM
      (SELECT {duck_ip('user_id')} AS ip, epoch_us(ts) AS us, count(*) AS n FROM events GROUP BY 1, 2) x),
    r AS (SELECT ip, i, us, n, least(n, CAST({_CAPACITY} AS BIGINT)) AS allowed, CAST({_CAPACITY} AS DOUBLE) - least(n, CAST({_CAPACITY} AS BIGINT)) AS tokens FROM a WHERE i = 1
      UNION ALL SELECT q.ip, q.i, q.us, q.n, least(q.n, CAST(floor(q.t) AS BIGINT)), q.t - least(q.n, CAST(floor(q.t) AS BIGINT)) FROM
        (SELECT a.ip, a.i, a.us, a.n, least(CAST({_CAPACITY} AS DOUBLE), r.tokens + (a.us - r.us) / 1e6 * {_RATE:e}) AS t FROM r JOIN a ON a.ip = r.ip AND a.i = r.i + 1) q)"""
_BUCKET_ROWS = f"{_BUCKET} SELECT ip AS source_ip, us, n, CAST(allowed AS BIGINT) AS allowed FROM r"


def _lines(t: Tables) -> DataFrame:
    return t.siem.select(F.col("src_ip").alias("source_ip"), "received_at", "id")


def _micros(df: DataFrame) -> DataFrame:
    return df.select("source_ip", F.unix_micros("received_at").alias("us"), "n", "allowed")


@query(_BUCKET_ROWS, streaming=True)
def st_rate_limit(t: Tables):
    """Token buckets held as state, one per source."""
    return _micros(_collect(rate_limit_stream(_lines(t), _RATE, _CAPACITY, idle_seconds=40 * DAY), "rate"))


@query(_BUCKET_ROWS)
def rate_limit_counts(t: Tables):
    """The same buckets in batch: bursts replayed independently."""
    return _micros(buckets.rate_limit_counts(_lines(t), _RATE, _CAPACITY))


@query(f"""{_BUCKET} SELECT ip AS source_ip, CAST(sum(allowed) AS BIGINT) AS allowed, CAST(sum(n - allowed) AS BIGINT) AS dropped FROM r GROUP BY ip""")
def rate_limit_events(t: Tables):
    """Every event marked as allowed or dropped."""
    marked = buckets.rate_limit(_lines(t), "id", _RATE, _CAPACITY)
    return marked.groupBy("source_ip").agg(F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("dropped"))


@query(f"""{_BUCKET} SELECT ip AS source_ip, strftime(date_trunc('minute', make_timestamp(us)), '%Y-%m-%d %H:%M:%S.%f') AS minute, CAST(sum(n - allowed) AS BIGINT) AS dropped
    FROM r GROUP BY 1, 2 HAVING sum(n - allowed) > 0""")
def rate_limit_drops(t: Tables):
    return buckets.drops_per_minute(buckets.rate_limit_counts(_lines(t), _RATE, _CAPACITY))
