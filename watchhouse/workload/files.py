"""Sources and sinks: files written from the given tables, read back by the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchhouse.operators import normalize
from watchhouse.operators.integrity import retention_plan
from watchhouse.session import cut_lineage, shared_dir
from watchhouse.sources import lines as src
from watchhouse.sources import positions, sinks, tables
from watchhouse.workload.registry import query
from watchhouse.workload.tables import AS_OF, Tables, duck_ip, ip, ts, with_tables

_U, _E = "CAST(user_id AS STRING)", "CAST(event_id AS STRING)"
_IP = duck_ip("user_id")
_BLANKS = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13), chr(28), chr(29), chr(30), chr(31), chr(133), chr(160))"


def _write_lines(df, path: str) -> None:
    df.write.partitionBy("source_ip").text(path)


# --- sources -----------------------------------------------------------------------------------------


_PADDED_SQL = f"""{with_tables('cisco_lines')}, l AS (SELECT concat('10.9.0.', CAST(record_id AS BIGINT) % 20) AS source_ip, raw FROM cisco_lines
    UNION ALL SELECT concat('10.9.0.', CAST(record_id AS BIGINT) % 20), concat('ligne é ', CAST(record_id AS BIGINT) % 50) FROM cisco_lines)
    SELECT source_ip, raw, count(*) AS n, count(*) AS ids FROM l GROUP BY source_ip, raw"""


def _padded(t: Tables) -> str:
    """Folder of files with padding, blank lines, repeated lines and non-ASCII text, one folder per sender."""
    n = F.col("record_id").cast("bigint")
    padded = F.concat(F.lit(" \t"), F.col("raw"), F.lit(" \n   \nligne é "), (n % 50).cast("string"), F.lit("\t"))
    path = shared_dir(t.spark, "syslog")
    _write_lines(t.cisco_lines.select(padded.alias("value"), F.concat(F.lit("10.9.0."), n % 20).alias("source_ip")), path)
    return path


def _halves(path: str) -> dict[str, int]:
    """Half the bytes of every file, which is mostly within a line."""
    return {name: size // 2 for name, (size, _) in positions.listed(path).items()}


def _named_once(lines: DataFrame) -> DataFrame:
    return lines.groupBy("source_ip", "raw").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("record_id").alias("ids"))


@query(f"""{with_tables('cisco_lines')} SELECT concat('10.9.0.', CAST(record_id AS BIGINT) % 20) AS source_ip, raw FROM cisco_lines
    UNION ALL SELECT concat('10.9.0.', CAST(record_id AS BIGINT) % 20), concat('ligne é ', CAST(record_id AS BIGINT) % 50) FROM cisco_lines""")
def src_syslog_text(t: Tables):
    """Lines with padding, blank lines and non-ASCII text, one folder per sender."""
    return src.syslog_lines(t.spark, _padded(t)).select("source_ip", "raw")


@query(_PADDED_SQL)
def src_syslog_positions(t: Tables):
    """The same lines from byte ranges of 4 KB: equal lines have ids of their own."""
    return _named_once(src.tail_lines(t.spark, _padded(t), split_bytes=4096))


@query(_PADDED_SQL)
def st_checkpoint(t: Tables):
    """A stream over the first half of every file's bytes, stopped, and started again from its checkpoint for the rest."""
    path, out = _padded(t), shared_dir(t.spark, "resumed")

    def run(ending):
        lines = src.tail_lines(t.spark, path, ending=ending, streaming=True, split_bytes=4096)
        writer = lines.writeStream.format("parquet").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True)
        writer.start(f"{out}/lines").awaitTermination()

    run(_halves(path))
    run(None)
    return _named_once(t.spark.read.parquet(f"{out}/lines"))


# Documents dealt to seven captures in the order of their ids; some are a megabyte long, and in six captures one count is broken
_CAPTURES = """d AS (SELECT doc_id, doc_id % 7 AS capture, CASE WHEN doc_id % 211 = 7 THEN repeat(concat(text, ' 12 '), CAST(ceil(1000000.0 / (octet_length(encode(text)) + 4)) AS INTEGER)) ELSE text END AS body
      FROM documents WHERE text IS NOT NULL),
    f AS (SELECT *, octet_length(encode(body)) + 1 AS size, doc_id % 7 <> 3 AND doc_id % 97 = 50 AS broken FROM d),
    g AS (SELECT *, length(CAST(size AS VARCHAR)) + 1 + size AS whole FROM f),
    p AS (SELECT *, sum(CASE WHEN broken THEN 1 ELSE 0 END) OVER w AS failed, sum(whole) OVER w - whole AS position FROM g WINDOW w AS (PARTITION BY capture ORDER BY doc_id))"""


@query(f"""WITH {_CAPTURES}, m AS (SELECT capture, position, trim(body, {_BLANKS}) AS raw FROM p WHERE failed = 0)
    SELECT 'counted' AS framing, CAST(capture AS VARCHAR) AS capture, CAST(position AS BIGINT) AS position, sha256(raw) AS digest, CAST(1 AS BIGINT) AS n FROM m WHERE raw <> ''
    UNION ALL SELECT 'unread', CAST(capture AS VARCHAR), CAST(min(position) AS BIGINT), NULL, CAST(max(total) - min(position) AS BIGINT)
      FROM (SELECT *, sum(whole) OVER (PARTITION BY capture) AS total FROM p) q WHERE failed > 0 GROUP BY capture
    UNION ALL SELECT 'newline', NULL, NULL, sha256(concat('message ', {_E}, ' of user ', {_U})), count(*) FROM events GROUP BY 4""")
def src_framed_capture(t: Tables):
    """Whole documents in counted frames (they contain line breaks), short messages in lines, both cut in chunks of 64 KB.

    Frames of a megabyte span many chunks; a broken count ends six of the seven captures, whose rest is reported with its offset.
    """
    path = shared_dir(t.spark, "captures")
    docs = t.documents.where("text IS NOT NULL").withColumn("capture", F.col("doc_id") % 7)
    longer = F.repeat(F.concat("text", F.lit(" 12 ")), F.ceil(F.lit(1_000_000.0) / (F.octet_length("text") + 4)).cast("int"))
    body = F.when(F.col("doc_id") % 211 == 7, longer).otherwise(F.col("text"))
    size = (F.octet_length("body") + 1).cast("string")
    broken = (F.col("capture") != 3) & (F.col("doc_id") % 97 == 50)
    # as many bytes, but no number
    count = F.when(broken, F.concat(F.substr(size, F.lit(1), F.length(size) - 1), F.lit("x"))).otherwise(size)
    framed = docs.withColumn("body", body).select("doc_id", "capture", F.concat(count, F.lit(" "), "body").alias("value"))
    framed.repartition("capture").sortWithinPartitions("capture", "doc_id").select("capture", "value").write.partitionBy("capture").text(f"{path}/counted")
    short = F.concat(F.lit("message "), F.col("event_id").cast("string"), F.lit(" of user "), F.col("user_id").cast("string"))
    t.events.select(short.alias("value")).write.text(f"{path}/newline")
    of = F.regexp_extract("path", "/capture=([0-9]+)/", 1).alias("capture")
    none = lambda kind: F.lit(None).cast(kind)
    read = src.framed_captures(t.spark, path, 65536)
    counted = read.where(F.col("path").contains("/counted/")).groupBy(of, "position", F.sha2("raw", 256).alias("digest")).agg(F.count(F.lit(1)).alias("n"))
    lines = read.where(~F.col("path").contains("/counted/")).groupBy(F.sha2("raw", 256).alias("digest")).agg(F.count(F.lit(1)).alias("n"))
    unread = src.Captures(t.spark, path, 65536).unread().groupBy(of).agg(F.min("position").alias("position"), F.sum(F.octet_length("raw")).alias("n"))
    columns = ["framing", "capture", "position", "digest", "n"]
    return (counted.withColumn("framing", F.lit("counted")).select(*columns)
            .unionByName(unread.select(F.lit("unread").alias("framing"), "capture", "position", none("string").alias("digest"), "n"))
            .unionByName(lines.select(F.lit("newline").alias("framing"), none("string").alias("capture"), none("bigint").alias("position"), "digest", "n")))


def _batches(t: Tables):
    """One agent batch per event: two events, a number, a text and a broken event."""
    windows = t.windows_lines.select("record_id", "source_ip", "received_at", F.col("raw").alias("w"))
    body = F.concat(F.lit("["), F.col("w"), F.lit(', 7, "text {", {"EventID": "none"}, '), F.col("w"), F.lit("]"))
    n = F.col("record_id").cast("bigint") % 4
    return windows.select(
        F.col("record_id").alias("batch_id"), "source_ip", "received_at",
        F.when(n == 0, "Windows").when(n == 1, "linux").when(n == 2, "fortigate").otherwise("windows").alias("source_type"),
        F.when(n == 3, F.concat(F.lit("{"), F.lit('"a": 1}'))).otherwise(body).alias("body"),
    )


@query(f"""SELECT {_E} AS batch_id, CASE event_id % 4 WHEN 0 THEN 'windows' ELSE 'linux' END AS line_type, CAST(5 AS BIGINT) AS elements, CAST(3 AS BIGINT) AS objects
    FROM events WHERE event_id % 4 < 2""")
def src_agent_json(t: Tables):
    rows = src.agent_events(_batches(t))
    return rows.groupBy("batch_id", "line_type").agg(
        F.count(F.lit(1)).alias("elements"), F.count_if("is_object").alias("objects"))


@query(f"""SELECT 'windows' AS kind, CAST(2 * count(*) AS BIGINT) AS accepted, CAST(3 * count(*) AS BIGINT) AS errors FROM events WHERE event_id % 4 = 0
    UNION ALL SELECT 'linux', CAST(3 * count(*) AS BIGINT), CAST(2 * count(*) AS BIGINT) FROM events WHERE event_id % 4 = 1
    UNION ALL SELECT 'body must be a JSON array', CAST(0 AS BIGINT), count(*) FROM events WHERE event_id % 4 = 3
    UNION ALL SELECT 'only windows and linux are accepted', CAST(0 AS BIGINT), count(*) FROM events WHERE event_id % 4 = 2""")
def ingest_summary(t: Tables):
    """Accepted and failed elements of agent batches; refused batches by reason."""
    batches = _batches(t)
    rows = src.agent_events(batches)
    parsed = normalize.parse_lines(rows, formats=("windows", "linux"), keep=("line_type", "is_object"))
    summary = src.ingest_summary(parsed, F.col("problem")).withColumnRenamed("line_type", "kind")
    refused = src.refused_batches(batches).groupBy(F.col("reason").alias("kind")).agg(F.count(F.lit(1)).alias("errors"))
    return summary.unionByName(refused.withColumn("accepted", F.lit(0).cast("bigint")))


_UNITS = "CASE event_type WHEN 'view' THEN 'ssh.service' WHEN 'click' THEN 'cron.service' ELSE 'other.service' END"


def _journal(t: Tables):
    """JSON lines of several units with broken and blank lines in between; a host's files follow each other in the order of event_id."""
    entry = F.to_json(F.struct(F.expr(_UNITS).alias("_SYSTEMD_UNIT"), F.col("event_id").cast("string").alias("_PID"), F.concat(F.lit("s="), "event_id").alias("__CURSOR")))
    noisy = F.concat(entry, F.lit("\n{broken\n\n[1]\n"))
    path = shared_dir(t.spark, "journald")
    rows = t.events.select(noisy.alias("value"), F.concat(F.lit("10.9.0."), F.col("event_id") % 4).alias("source_ip"), "event_id")
    # ranges of event_id, whose order the numbers in the names of the files keep
    _write_lines(rows.repartitionByRange("source_ip", "event_id").sortWithinPartitions("source_ip", "event_id").select("value", "source_ip"), path)
    return path


@query(f"""SELECT {_E} AS pid, {_UNITS} AS unit FROM events WHERE event_type IN ('view', 'click')""")
def src_journald_json(t: Tables):
    """Two units kept of several."""
    kept = src.journald_lines(t.spark, _journal(t), ["ssh.service", "cron.service"])
    return kept.select(F.get_json_object("raw", "$._PID").alias("pid"), F.get_json_object("raw", "$._SYSTEMD_UNIT").alias("unit"))


# host 0 has read half its journal, host 1 all of it, host 2 up to an entry that is gone, host 3 nothing
_CURSORS_SQL = """h AS (SELECT event_id % 4 AS host, count(*) AS n FROM events GROUP BY 1),
    e AS (SELECT event_id, event_id % 4 AS host, row_number() OVER (PARTITION BY event_id % 4 ORDER BY event_id) AS nth FROM events),
    r AS (SELECT e.* FROM e JOIN h USING (host) WHERE (host = 0 AND nth > n // 2) OR host = 2 OR (host = 3 AND nth > n - 100))"""


def _middle(ids: DataFrame) -> DataFrame:
    """The event_id of row ``n div 2`` of ``n`` in their order (no row below two): by counts per range first, then within one range."""
    ranges = ids.groupBy("event_id").agg(F.count(F.lit(1)).alias("n")).repartitionByRange("event_id").withColumn("part", F.spark_partition_id())
    counted = cut_lineage(ranges, "ranges")
    parts = counted.groupBy("part").agg(F.sum("n").alias("_m"))
    parts = parts.select("part", "_m", (F.sum("_m").over(Window.orderBy("part")) - F.col("_m")).alias("_before"), F.expr("sum(_m) OVER () div 2").alias("_half"))
    wanted = parts.where("_before < _half AND _half <= _before + _m").drop("_m")
    upto = F.col("_before") + F.sum("n").over(Window.partitionBy("part").orderBy("event_id"))
    return counted.join(F.broadcast(wanted), "part").withColumn("_upto", upto).where("_upto - n < _half AND _half <= _upto").select("event_id")


def _read_on(t: Tables):
    lines = src.tail_lines(t.spark, _journal(t), split_bytes=8192)
    half = _middle(t.events.where("event_id % 4 = 0")).select(F.lit("10.9.0.0").alias("source_ip"), F.concat(F.lit("s="), "event_id").alias("cursor"))
    full = t.events.where("event_id % 4 = 1").agg(F.concat(F.lit("s="), F.max("event_id")).alias("cursor")).select(F.lit("10.9.0.1").alias("source_ip"), "cursor")
    gone = t.spark.createDataFrame([("10.9.0.2", "s=gone")], "source_ip string, cursor string")
    cursors = half.unionByName(full).unionByName(gone)
    return src.journald_after(lines, cursors, first_run=100), cursors


@query(f"WITH {_CURSORS_SQL} SELECT concat('10.9.0.', host) AS source_ip, CAST(event_id AS VARCHAR) AS pid FROM r")
def src_journald_cursor(t: Tables):
    """Journals read on from stored cursors."""
    return _read_on(t)[0].select("source_ip", F.get_json_object("raw", "$._PID").alias("pid"))


@query(f"WITH {_CURSORS_SQL} SELECT concat('10.9.0.', event_id % 4) AS source_ip, concat('s=', max(event_id)) AS cursor FROM events GROUP BY 1")
def src_journald_cursors(t: Tables):
    """The cursors to store after that."""
    return src.new_cursors(*_read_on(t))


@query(f"""SELECT concat('10.9.1.', event_id % 3) AS source_ip, CASE WHEN event_id % 4 = 3 THEN 'fallback' ELSE concat('host-', event_id % 20) END AS hostname,
    CASE event_id % 4 WHEN 0 THEN concat('sshd[', event_id, ']') WHEN 1 THEN concat('sshd[', event_id, ']') ELSE 'syslog' END AS program,
    CASE event_id % 4 WHEN 0 THEN concat('Login: from  ', {_IP}) WHEN 1 THEN '' WHEN 2 THEN concat('no colon ', {_U}) ELSE concat('short ', {_U}) END AS message FROM events""")
def src_syslog_tail(t: Tables):
    """Program and message, a program only, no program, and a line of too few words; each file read in two goes, up to half its bytes and on."""
    head = F.concat(F.lit("Jan 15 10:23:45 host-"), (F.col("event_id") % 20).cast("string"), F.lit(" "))
    program = F.concat(F.lit("sshd["), F.col("event_id").cast("string"), F.lit("]:"))
    n, user = F.col("event_id") % 4, F.col("user_id").cast("string")
    address = F.col("src_ip")
    line = (F.when(n == 0, F.concat(head, program, F.lit(" Login: from  "), address)).when(n == 1, F.concat(head, program))
            .when(n == 2, F.concat(head, F.lit("no colon "), user)).otherwise(F.concat(F.lit("short "), user)))
    events = t.events.withColumn("src_ip", F.expr(duck_ip("user_id").replace("//", "div")))
    path = shared_dir(t.spark, "syslog-tail")
    _write_lines(events.select(line.alias("value"), F.concat(F.lit("10.9.1."), F.col("event_id") % 3).alias("source_ip")), path)
    half = _halves(path)
    first = src.tail_lines(t.spark, path, ending=half, split_bytes=4096)
    second = src.tail_lines(t.spark, path, starting=positions.line_ends(path, half), split_bytes=4096)
    wrapped = src.wrap_syslog(first.unionByName(second), "fallback")
    return wrapped.select("source_ip", *[F.get_json_object("raw", f"$.{k}").alias(k) for k in ("hostname", "program", "message")])


_MARKS = [("A", 20_000), ("N", 100_000)]
_RECORDS = "SELECT l_returnflag AS channel, l_orderkey * 10 + l_linenumber AS record_number, l_suppkey * 65536 + l_partkey AS event_id, l_shipdate, l_linestatus, l_quantity FROM lineitem"


def _records(t: Tables):
    quantity = F.when(F.col("l_quantity") > 25, F.col("l_quantity").cast("int").cast("string"))
    return t.lineitem.select(
        F.col("l_returnflag").alias("channel"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("record_number"),
        (F.col("l_suppkey") * 65536 + F.col("l_partkey")).alias("event_id"), F.col("l_shipdate").cast("timestamp").alias("time_generated"),
        F.lit(4).alias("event_type"), F.lit("src").alias("source_name"),
        F.array(F.col("l_linestatus"), quantity, F.lit("last")).alias("inserts"))


def _marks(t: Tables):
    return t.spark.createDataFrame(_MARKS, "channel string, record_id bigint")


_NEWER = f"({_RECORDS}) r WHERE record_number > CASE channel WHEN 'A' THEN 20000 WHEN 'N' THEN 100000 ELSE 0 END"


@query(f"""SELECT channel, record_number, CAST(event_id % 65536 AS INTEGER) AS event_id, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S+00:00') AS time_created, l_linestatus AS first,
    CASE WHEN l_quantity > 25 THEN CAST(CAST(floor(l_quantity) AS INTEGER) AS STRING) END AS second, 'last' AS third FROM {_NEWER}""")
def src_winlog_records(t: Tables):
    out = src.windows_records(_records(t), _marks(t), "WS")
    get = lambda p: F.get_json_object("raw", p)
    return out.select("channel", "record_number", get("$.EventID").cast("int").alias("event_id"), get("$.TimeCreated").alias("time_created"),
                      get("$.EventData.0").alias("first"), get("$.EventData.1").alias("second"), get("$.EventData.2").alias("third"))


@query(f"""SELECT channel, greatest(max(record_number), CASE channel WHEN 'A' THEN 20000 WHEN 'N' THEN 100000 ELSE 0 END) AS record_id FROM ({_RECORDS}) r GROUP BY channel""")
def src_winlog_marks(t: Tables):
    """High-water marks after a read."""
    return src.new_marks(_records(t), _marks(t))


@query(f"""{with_tables('siem', 'alerts', 'sources')} SELECT 'events' AS name, count(*) AS n, count(DISTINCT id) AS keys FROM siem
    UNION ALL SELECT 'alerts', count(*), count(DISTINCT id) FROM alerts UNION ALL SELECT 'sources', count(*), count(DISTINCT id) FROM sources""")
def src_tables(t: Tables):
    """Stored tables read back with their explicit schemas."""
    path = shared_dir(t.spark, "tables")
    sinks.write_events(t.siem, f"{path}/events")
    t.alerts.write.parquet(f"{path}/alerts")
    t.sources.write.parquet(f"{path}/sources")
    frames = {"events": tables.read_events(t.spark, f"{path}/events")}
    frames |= {n: tables.read_table(t.spark, f"{path}/{n}", n) for n in ("alerts", "sources")}
    counts = [df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("keys")).select(F.lit(n).alias("name"), "n", "keys")
              for n, df in frames.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


# --- sinks ---------------------------------------------------------------------------------------------


@query(f"""{with_tables('siem')} SELECT id, {ts('received_at')}, source_host, message, array_to_string(tags, ',') AS tags, extra['k'] AS k, strftime(received_at, '%Y-%m') AS event_month
    FROM siem WHERE received_at >= TIMESTAMP '2024-01-10 00:00:00' AND received_at <= TIMESTAMP '2024-01-20 00:00:00'""")
def sink_events(t: Tables):
    """The month-partitioned event table, read back by time range."""
    path = shared_dir(t.spark, "events")
    sinks.write_events(t.siem, path)
    rows = tables.events_between(tables.read_events(t.spark, path), "2024-01-10 00:00:00", "2024-01-20 00:00:00")
    return rows.select("id", "received_at", "source_host", "message", "tags", F.col("extra")["k"].alias("k"), "event_month")


def _archive(t: Tables) -> str:
    """Archive of one line per event; some lines lack a type, some are empty."""
    path = shared_dir(t.spark, "archive")
    kind = F.when(F.col("id").cast("bigint") % 6 != 0, F.col("source_type"))
    raw = F.when(F.col("id").cast("bigint") % 10 == 0, "").otherwise(F.col("message"))
    sinks.write_archive(t.siem.select(raw.alias("raw"), kind.alias("source_type")), path, AS_OF)
    return path


_ARCHIVED = f"""{with_tables('siem')}, a AS (SELECT CASE WHEN CAST(id AS BIGINT) % 6 = 0 THEN 'unknown' ELSE source_type END AS source_type, message AS raw
    FROM siem WHERE CAST(id AS BIGINT) % 10 <> 0)"""


@query(f"{_ARCHIVED} SELECT source_type, '2024' AS year, '01' AS month, '31' AS day, raw, count(*) AS n FROM a GROUP BY source_type, raw")
def sink_archive(t: Tables):
    archived = sinks.read_archive(t.spark, _archive(t))
    return archived.groupBy("source_type", "year", "month", "day", "raw").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_ARCHIVED} SELECT raw, count(*) AS n FROM a WHERE source_type = 'linux' GROUP BY raw")
def archive_replay(t: Tables):
    """One type and day of the archive; the other folders are not read."""
    archived = sinks.read_archive(t.spark, _archive(t))
    wanted = archived.filter("source_type = 'linux' AND year = '2024' AND month = '01' AND day = '31'")
    return wanted.groupBy("raw").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_ARCHIVED} SELECT source_type, true AS has_files, true AS has_bytes, 'delete' AS action FROM a GROUP BY source_type")
def archive_inventory(t: Tables):
    """Files and bytes per type, and what is due for files that old in 2040."""
    files = sinks.archive_inventory(t.spark, _archive(t))
    plan = retention_plan(files, "2040-01-01 00:00:00")
    kind = F.regexp_extract("path", "source_type=([^/]+)/", 1)
    return plan.groupBy(kind.alias("source_type"), "action").agg(
        (F.count(F.lit(1)) > 0).alias("has_files"), (F.sum("length") > 0).alias("has_bytes"))


# Mixed lines with what becomes of them: registered senders are parsed by their registered type, others by content; auditd texts contain
# "type=", which is taken for the firewall format; Windows and Linux lines must be JSON objects, as two of five lines are.
MIXED = f"""{with_tables('sources', 'mixed_lines')}, resolved AS (SELECT m.raw, e.event_id, s.id IS NOT NULL AS registered, coalesce(s.source_type,
      CASE WHEN e.event_id % 5 = 0 OR (e.event_id % 5 = 3 AND e.event_type = 'purchase') THEN 'fortigate'
        WHEN e.event_id % 5 = 1 AND e.event_id % 11 <> 0 THEN 'cisco_asa' WHEN e.event_id % 5 = 2 THEN 'windows' ELSE 'linux' END) AS kind
      FROM events e JOIN mixed_lines m ON m.record_id = CAST(e.event_id AS VARCHAR) LEFT JOIN sources s ON s.ip_address = m.source_ip AND s.enabled),
    k AS (SELECT raw, sha256(raw) AS digest, registered, CASE WHEN kind = 'cisco_ios' THEN 'cisco_asa'
      WHEN kind IN ('windows', 'linux') AND event_id % 5 NOT IN (2, 3) THEN NULL ELSE kind END AS what FROM resolved)"""
_EVENTS_AND_ARCHIVE = f"""{MIXED} SELECT 'events' AS sink, what AS kind, digest, count(*) AS n FROM k WHERE what IS NOT NULL GROUP BY what, digest
    UNION ALL SELECT 'archive', what, digest, count(*) FROM k WHERE what IS NOT NULL GROUP BY what, digest"""
FANNED_OUT = f"""{_EVENTS_AND_ARCHIVE}
    UNION ALL SELECT 'errors', 'not a JSON object', digest, count(*) FROM k WHERE what IS NULL GROUP BY digest"""


def counted_lines(sink: str, df: DataFrame, kind: str, raw: str) -> DataFrame:
    """Every line of a sink by its digest, with its number of copies."""
    return df.groupBy(F.lit(sink).alias("sink"), F.col(kind).alias("kind"), F.sha2(raw, 256).alias("digest")).agg(F.count(F.lit(1)).alias("n"))


@query(_EVENTS_AND_ARCHIVE)
def sink_fanout(t: Tables):
    """Parsed once, stored as events and as raw archive."""
    parsed = cut_lineage(normalize.normalize(t.mixed_lines, t.sources), "parsed")
    path = shared_dir(t.spark, "fanout")
    good = normalize.good_events(parsed)
    sinks.write_events(good, f"{path}/events")
    sinks.write_archive(good.select(F.col("raw_message").alias("raw"), "source_type"), f"{path}/archive", AS_OF)
    events, archive = tables.read_events(t.spark, f"{path}/events"), sinks.read_archive(t.spark, f"{path}/archive")
    return counted_lines("events", events, "source_type", "raw_message").unionByName(counted_lines("archive", archive, "source_type", "raw"))


@query(f"""{with_tables('sources')}, k AS (SELECT d.text, coalesce(s.source_type, CASE WHEN regexp_matches(d.text, 'type=|devname=|logid=') THEN 'fortigate' ELSE 'linux' END) AS kind
      FROM documents d LEFT JOIN sources s ON s.ip_address = {duck_ip('doc_id')} AND s.enabled)
    SELECT 'parse_error' AS error, 'not a JSON object' AS detail, sha256(text) AS digest, count(*) AS n FROM k WHERE kind IN ('windows', 'linux') GROUP BY 3""")
def sink_errors(t: Tables):
    """Documents are no JSON: from senders taken for Windows or Linux each becomes a dead letter, whole."""
    lines = t.documents.select(
        F.col("text").alias("raw"), F.expr(ip("doc_id").replace("[div]", "div")).alias("source_ip"), F.lit(AS_OF).cast("timestamp").alias("received_at"),
        F.col("doc_id").cast("string").alias("record_id"))
    path = shared_dir(t.spark, "errors")
    sinks.write_errors(normalize.bad_lines(normalize.normalize(lines, t.sources)), path)
    stored = tables.read_table(t.spark, path, "errors")
    return stored.groupBy("error", "detail", F.sha2("raw", 256).alias("digest")).agg(F.count(F.lit(1)).alias("n"))
