"""Security-log tables derived from the given tables.

The given tables have no security columns, so each log table is a projection of one of them.  The
projection text is shared by Spark and the checking SQL; only a few function names differ.  What the
queries then compute is written twice: with the library, and as SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchhouse import configure

AS_OF = "2024-01-31 00:00:00"
DAY, MONTH = 86_400, 30 * 86_400

_SPARK = {
    "div": "div", "arr": "array", "map": "map_from_arrays", "sha": "sha2", "sha_end": ", 256)",
    "hours": "make_dt_interval(0, ", "us": "unix_micros", "text_len": "octet_length",
}
_DUCK = {
    "div": "//", "arr": "list_value", "map": "map", "sha": "sha256", "sha_end": ")",
    "hours": "to_hours(", "us": "epoch_us", "text_len": "strlen",
}


def ip(n: str) -> str:
    """SQL text of the address derived from a key."""
    part = lambda e: f"CAST({e} AS STRING)"
    return (f"concat('10.', {part(f'({n} [div] 64000) % 256')}, '.', {part(f'({n} [div] 250) % 256')}, '.', "
            f"{part(f'{n} % 250 + 1')})")


_RAW = ("concat(event_type, ' ', props, ' by user', CAST(user_id AS STRING), ' value ', "
        "CAST(CAST(floor(value * 100) AS BIGINT) AS STRING), ' #', CAST(event_id AS STRING))")

_STAMP = "substr(CAST(ts AS STRING), 1, 19)"
_US = "[us](CAST(ts AS TIMESTAMP))"
_U = "CAST(user_id AS STRING)"
_E = "CAST(event_id AS STRING)"

TEMPLATES = {
    "siem": f"""
        SELECT {_E} AS id, CAST(ts AS TIMESTAMP) AS received_at, CAST(ts AS TIMESTAMP) AS event_time,
          concat('host-', CAST(event_id % 20 AS STRING)) AS source_host,
          CASE event_id % 4 WHEN 0 THEN 'fortigate' WHEN 1 THEN 'cisco_asa' WHEN 2 THEN 'windows' ELSE 'linux' END AS source_type,
          CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'warning' ELSE 'info' END AS log_level,
          CASE WHEN event_type IN ('error', 'signup', 'click') THEN 'auth' ELSE 'network' END AS category,
          CASE event_type WHEN 'error' THEN 'logon_failed' WHEN 'signup' THEN 'logon' WHEN 'click' THEN 'privileged_logon'
            WHEN 'purchase' THEN 'allow' ELSE 'deny' END AS action,
          {ip('user_id')} AS src_ip, CAST(1024 + event_id % 60000 AS INT) AS src_port,
          concat('198.51.100.', CAST(event_id % 200 + 1 AS STRING)) AS dst_ip,
          CAST(CASE event_id % 3 WHEN 0 THEN 22 WHEN 1 THEN 443 ELSE 53 END AS INT) AS dst_port,
          CASE event_id % 3 WHEN 2 THEN 'udp' ELSE 'tcp' END AS protocol,
          CASE WHEN event_id % 31 = 0 THEN CAST(NULL AS STRING) WHEN event_id % 37 = 0 THEN '' ELSE concat('user', {_U}) END AS user_name,
          CASE WHEN event_id % 4 = 3 THEN 'sshd' END AS process_name,
          CASE event_type WHEN 'error' THEN '4625' WHEN 'signup' THEN '4624' WHEN 'click' THEN '4672'
            WHEN 'purchase' THEN '302013' ELSE '106023' END AS event_id,
          concat(event_type, ' from user', {_U}, ' on host-', CAST(event_id % 20 AS STRING)) AS message,
          CASE WHEN event_id % 83 <> 0 THEN {_RAW} END AS raw_message,
          CASE WHEN event_type = 'click' THEN [arr]('admin', 'hipaa:auth') WHEN event_type = 'signup' THEN [arr]('hipaa:auth')
            WHEN event_type = 'purchase' THEN CASE WHEN event_id % 5 = 0 THEN [arr]('pci:cardholder_env', 'pci_dss') ELSE [arr]('plain') END
            WHEN event_type = 'error' THEN [arr]('plain') END AS tags,
          CAST(NULL AS STRING) AS geo_country, CAST(NULL AS STRING) AS geo_city,
          CASE WHEN event_type <> 'view' THEN CAST(user_id % 50 AS STRING) END AS alert_id,
          'worker-01' AS ingest_node,
          CASE WHEN event_id % 89 = 0 THEN CAST(NULL AS STRING) WHEN event_id % 97 = 0 THEN [sha](concat('x', {_RAW})[sha_end]
            ELSE [sha]({_RAW}[sha_end] END AS raw_hash,
          [map]([arr]('k', 'sentbyte'), [arr](regexp_extract(props, '([0-9]+)', 1),
            CASE WHEN event_id % 41 = 0 THEN 'n/a' ELSE CAST(CAST(floor(value * 2000000) AS BIGINT) AS STRING) END)) AS extra
        FROM events""",
    "alerts": f"""
        SELECT CAST(o_orderkey AS STRING) AS id, CAST(o_custkey % 12 AS STRING) AS rule_id,
          CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium'
            WHEN '4' THEN 'low' ELSE 'info' END AS severity,
          CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'closed' ELSE 'acknowledged' END AS status,
          concat('alert ', o_orderpriority) AS title, concat('order ', CAST(o_orderkey AS STRING)) AS description,
          {ip('o_custkey % 200')} AS src_ip, concat('host-', CAST(o_custkey % 20 AS STRING)) AS source_host,
          CAST(o_orderdate AS TIMESTAMP) AS first_seen,
          CAST(o_orderdate AS TIMESTAMP) + [hours]CAST(o_orderkey % 48 AS INT)) AS last_seen,
          CAST(floor(o_totalprice) AS BIGINT) AS event_count, CAST(NULL AS STRING) AS assigned_to,
          [map]([arr]('k'), [arr](o_orderpriority)) AS extra,
          concat(CAST(o_custkey % 12 AS STRING), ':', {ip('o_custkey % 200')}) AS group_key,
          CAST(o_orderdate AS TIMESTAMP) + [hours]CAST(o_orderkey % 24 AS INT)) AS created_at,
          CAST(o_orderdate AS TIMESTAMP) + [hours]CAST(o_orderkey % 24 AS INT)) AS updated_at
        FROM orders""",
    "rules": """
        SELECT CAST(p_partkey AS STRING) AS id, concat(p_name, ' ', CAST(p_partkey AS STRING)) AS name, p_type AS description,
          CASE p_partkey % 6 WHEN 0 THEN 'threshold' WHEN 1 THEN 'sequence' WHEN 2 THEN 'absence' WHEN 3 THEN 'blacklist'
            WHEN 4 THEN 'anomaly' ELSE 'typo' END AS rule_type,
          CASE p_size % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'info' END AS severity,
          p_size % 4 <> 0 AS enabled,
          CASE p_partkey % 6
            WHEN 0 THEN concat('{"filters": {"event_id": ["4625"]}, "group_by": "', CASE p_size % 3 WHEN 0 THEN 'src_ip' WHEN 1 THEN
              'message' ELSE 'source_host' END, '", "count": ', CAST(p_size % 5 AS STRING), ', "window_seconds": 2592000}')
            WHEN 1 THEN concat('{"steps": [{"event_id": "4625"}', CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN ', {"event_id": "4624"}'
              ELSE ', {"log_level": "info"}' END, '], "group_by": "src_ip", "window_seconds": ', CAST(p_size % 4 AS STRING), '}')
            WHEN 2 THEN concat('{"filters": {"tags": ', CASE WHEN p_size % 2 = 0 THEN '["t"]' ELSE '"t"' END, '}, "window_seconds": 3600}')
            WHEN 3 THEN concat('{"field": "', CASE WHEN p_size % 2 = 0 THEN 'src_ip' ELSE 'raw_message' END, '", "list_name": "',
              CASE WHEN p_size % 5 = 0 THEN '' ELSE 'threat_intel_blocklist' END, '"}')
            WHEN 4 THEN concat('{"group_by": "src_ip", "std_devs": 0.', CAST(p_size % 10 AS STRING), ', "baseline_days": ',
              CAST(p_size * 2 AS STRING), ', "window_seconds": 86400}')
            ELSE '{}' END AS body,
          CAST('2024-01-01 00:00:00' AS TIMESTAMP) AS created_at, CAST('2024-01-01 00:00:00' AS TIMESTAMP) AS updated_at
        FROM part""",
    "sources": f"""
        SELECT CAST(c_custkey AS STRING) AS id, {ip('c_custkey')} AS ip_address,
          concat('host-', CAST(c_custkey % 20 AS STRING)) AS hostname,
          CASE c_nationkey % 5 WHEN 0 THEN 'fortigate' WHEN 1 THEN 'cisco_asa' WHEN 2 THEN 'cisco_ios' WHEN 3 THEN 'windows'
            ELSE 'linux' END AS source_type,
          CASE c_custkey % 3 WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN '' ELSE c_name END AS label,
          c_custkey % 7 <> 0 AS enabled, c_mktsegment = 'BUILDING' AS pci_env, CAST(NULL AS TIMESTAMP) AS last_seen,
          CAST(0 AS INT) AS event_rate_1m, CAST('2024-01-01 00:00:00' AS TIMESTAMP) AS created_at
        FROM customer""",
    "blacklists": f"""
        SELECT CASE WHEN s_nationkey % 3 = 0 THEN 'other' ELSE 'threat_intel_blocklist' END AS list_name,
          {ip('s_suppkey * 2')} AS value
        FROM supplier""",
    "geo_ranges": """
        SELECT CAST(167772160 + c_custkey * 4 AS BIGINT) AS start_ip, CAST(167772160 + c_custkey * 4 + 2 AS BIGINT) AS end_ip,
          concat('country-', CAST(c_nationkey AS STRING)) AS country, concat('city of ', c_name) AS city
        FROM customer""",
}

# --- raw lines: one per event, in each of the formats ---
RAW = {
    "fortigate": f"""concat('<', CAST(event_id % 192 AS STRING), '>date=', substr({_STAMP}, 1, 10), ' time=', substr({_STAMP}, 12, 8),
            CASE WHEN event_id % 9 = 0 THEN '' ELSE concat(' devname="FGT-', CAST(event_id % 20 AS STRING), '"') END,
            ' logid="', {_E}, '" type="', CASE event_type WHEN 'purchase' THEN 'traffic' WHEN 'view' THEN 'utm' ELSE 'event' END,
            '" subtype="', CASE event_type WHEN 'error' THEN 'admin' WHEN 'signup' THEN 'user' WHEN 'click' THEN 'wanopt'
              WHEN 'purchase' THEN 'forward' ELSE 'ips' END, '"',
            CASE event_id % 4 WHEN 0 THEN ' level="notice"' WHEN 1 THEN ' level=warning' WHEN 2 THEN ' level="Information"' ELSE ' level="x"' END,
            CASE event_id % 4 WHEN 0 THEN concat(' eventtime=', CAST({_US} [div] 1000000 AS STRING))
              WHEN 1 THEN concat(' eventtime=', CAST({_US} AS STRING))
              WHEN 2 THEN concat(' eventtime=', CAST({_US} AS STRING), '000') ELSE '' END,
            ' srcip=', {ip('user_id')}, ' srcport=', CASE WHEN event_id % 13 = 0 THEN 'n/a' ELSE CAST(1024 + event_id % 60000 AS STRING) END,
            ' dstip=198.51.100.7 dstport=443 proto=', CASE event_id % 5 WHEN 0 THEN '6' WHEN 1 THEN '17' WHEN 2 THEN '1' WHEN 3 THEN 'SCTP' ELSE '99' END,
            ' action="', CASE event_type WHEN 'error' THEN 'blocked' WHEN 'signup' THEN 'Accept' WHEN 'click' THEN 'server-rst'
              WHEN 'purchase' THEN 'accept' ELSE 'dropped' END, '" sentbyte=', CAST(CAST(floor(value * 1000) AS BIGINT) AS STRING),
            CASE WHEN event_id % 7 = 0 THEN concat(' user="" unauthuser="guest', {_U}, '"') ELSE concat(' user="user', {_U}, '"') END,
            CASE WHEN event_id % 5 = 0 THEN ' msg=""' ELSE concat(' msg="seen ', {_E}, ' times = many"') END, ' sentbyte=1')""",
    "cisco": f"""concat(CASE WHEN event_id % 17 = 0 THEN '' ELSE concat('<', CAST(event_id % 192 AS STRING), '>') END,
            'Jan ', lpad(CAST(CAST(substr({_STAMP}, 9, 2) AS INT) AS STRING), 2, ' '), ' ', substr({_STAMP}, 12, 8),
            ' asa-', CAST(event_id % 20 AS STRING), ' ',
            CASE WHEN event_id % 11 = 0 THEN concat('plain text ', {_E}) ELSE concat('%ASA-', CAST(event_id % 8 AS STRING), '-',
              CASE event_type WHEN 'error' THEN concat('611102: User authentication failed: Uname: user', {_U})
                WHEN 'signup' THEN concat('713172: Group = G, Username = user', {_U}, ', IP = 203.0.113.5, memory freed')
                WHEN 'click' THEN concat('302013: Built outbound TCP connection ', {_E}, ' for outside:8.8.8.8/53 (8.8.8.8/53) to inside:',
                  {ip('user_id')}, '/', CAST(1024 + event_id % 60000 AS STRING), ' (', {ip('user_id')}, '/', CAST(1024 + event_id % 60000 AS STRING), ')')
                WHEN 'purchase' THEN concat('106006: Deny inbound UDP from ', {ip('user_id')}, '/', CAST(event_id % 60000 AS STRING), ' on outside')
                ELSE '999999:' END) END)""",
    "windows": f"""concat('{{"EventID": ', CASE event_type WHEN 'error' THEN '4625' WHEN 'signup' THEN '"4624"' WHEN 'click' THEN '4672'
              WHEN 'purchase' THEN '4688' ELSE '9999' END,
            ', "TimeCreated": "', substr({_STAMP}, 1, 10), 'T', substr({_STAMP}, 12, 8),
            CASE event_id % 4 WHEN 0 THEN '.25Z' WHEN 1 THEN 'Z' WHEN 2 THEN '' ELSE '+00:00' END, '"',
            CASE WHEN event_id % 9 = 0 THEN '' ELSE concat(', "Computer": "WS-', CAST(event_id % 20 AS STRING), '"') END,
            ', "Channel": "Security", "Level": ', CAST(event_id % 8 AS STRING), ', "EventData": {{"SubjectUserName": "sys', {_U}, '"',
            CASE WHEN event_type IN ('error', 'signup') THEN concat(', "TargetUserName": "user', {_U},
              CASE WHEN event_id % 7 = 0 THEN '$' ELSE '' END, '"') ELSE '' END,
            CASE WHEN event_type = 'purchase' THEN concat(', "NewProcessName": "C:', chr(92), chr(92), 'Windows', chr(92), chr(92), 'p', {_U}, '.exe"') ELSE '' END,
            ', "IpAddress": "', CASE event_id % 5 WHEN 0 THEN '-' WHEN 1 THEN '::1' ELSE {ip('user_id')} END,
            '", "IpPort": "', CASE WHEN event_id % 6 = 0 THEN '-' ELSE CAST(1024 + event_id % 60000 AS STRING) END,
            '", "LogonType": "', CAST(event_id % 12 AS STRING), '", "Note": "n', {_E}, '"}}}}')""",
    "linux": f"""CASE WHEN event_type = 'click' THEN concat('{{"timestamp": "', substr({_STAMP}, 1, 10), 'T', substr({_STAMP}, 12, 8), 'Z"',
              CASE WHEN event_id % 9 = 0 THEN '' ELSE concat(', "hostname": "db-', CAST(event_id % 20 AS STRING), '"') END,
              ', "program": "sudo", "pid": ', {_E}, ', "severity": ', CAST(event_id % 10 AS STRING), ', "facility": 1, "message": "user', {_U},
              ' : TTY=pts/1 ; PWD=/home/u ; USER=root ; COMMAND=/bin/bash"}}')
            ELSE concat('{{"__REALTIME_TIMESTAMP": "', CAST({_US} AS STRING), '", "_HOSTNAME": "web-', CAST(event_id % 20 AS STRING),
              '", "PRIORITY": "', CAST(event_id % 8 AS STRING), '", "_PID": "', {_E}, '", "_TRANSPORT": "syslog", ',
              CASE event_type WHEN 'error' THEN concat('"SYSLOG_IDENTIFIER": "sshd", "MESSAGE": "Failed password for ',
                  CASE WHEN event_id % 3 = 0 THEN 'invalid user ' ELSE '' END, 'user', {_U}, ' from ', {ip('user_id')}, ' port ', CAST(1024 + event_id % 60000 AS STRING), ' ssh2"')
                WHEN 'signup' THEN concat('"SYSLOG_IDENTIFIER": "", "_COMM": "sshd", "MESSAGE": "Accepted publickey for user', {_U}, ' from ', {ip('user_id')}, ' port 22 ssh2"')
                WHEN 'purchase' THEN concat('"SYSLOG_IDENTIFIER": "auditd", "MESSAGE": "type=USER_AUTH msg=audit(1.0:1): acct=', chr(92), '"user', {_U}, chr(92), '" addr=', {ip('user_id')}, ' res=success"')
                ELSE '"_COMM": "systemd", "MESSAGE": "Started Daily Cleanup."' END, '}}') END""",
}


def _lines(raw: str) -> str:
    return f"""SELECT {_E} AS record_id, {ip('user_id')} AS source_ip, CAST(ts AS TIMESTAMP) AS received_at, {raw} AS raw
        FROM events"""


TEMPLATES |= {f"{name}_lines": _lines(raw) for name, raw in RAW.items()}
# the four formats in turn; every fifth line is free text
TEMPLATES["mixed_lines"] = _lines(
    f"""CASE event_id % 5 WHEN 0 THEN {RAW['fortigate']} WHEN 1 THEN {RAW['cisco']} WHEN 2 THEN {RAW['windows']}
          WHEN 3 THEN {RAW['linux']} ELSE concat('free text ', {_E}) END""")
GIVEN = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
         "embeddings", "pages", "benchmark", "labels", "conversations")


def _render(name: str, dialect: dict[str, str]) -> str:
    text = TEMPLATES[name]
    for key, value in dialect.items():
        text = text.replace(f"[{key}]", value)
    return text


def with_tables(*names: str) -> str:
    """``WITH siem AS (...), ...`` for the checking SQL."""
    return "WITH " + ", ".join(f"{n} AS ({_render(n, _DUCK)})" for n in names) + " "


class Tables:
    """Given and derived tables of one data folder as DataFrames: ``t.events``, ``t.siem``, ..."""

    def __init__(self, spark: SparkSession, folder: str, streaming: bool = False):
        self.spark, self.folder, self.streaming = configure(spark), folder, streaming

    def __getattr__(self, name: str) -> DataFrame:
        if name in GIVEN:
            return self._given(name)
        if name not in TEMPLATES:
            raise AttributeError(name)
        source = TEMPLATES[name].rsplit("FROM ", 1)[1].strip()
        self._given(source).createOrReplaceTempView("watchhouse_input")
        return self.spark.sql(_render(name, _SPARK).replace(f"FROM {source}", "FROM watchhouse_input"))

    def _given(self, name: str) -> DataFrame:
        path = f"{self.folder.rstrip('/')}/{name}.parquet"
        batch = self.spark.read.parquet(path)
        if not self.streaming or name != "events":
            return batch
        return self.spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(self.folder)


def flat(df: DataFrame) -> DataFrame:
    """Times as text with microseconds, arrays joined by commas: comparable across engines."""
    def plain(field):
        col = F.col(f"`{field.name}`")
        kind = field.dataType.typeName()
        if kind in ("timestamp", "timestamp_ntz"):
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif kind == "date":
            col = F.date_format(col, "yyyy-MM-dd")
        elif kind == "array":
            col = F.array_join(col, ",")
        return col.alias(field.name)

    return df.select(*[plain(f) for f in df.schema.fields])


def ts(expr: str, alias: str | None = None) -> str:
    """SQL text of a time column in the form ``flat`` gives it."""
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f') AS {alias or expr}"


def duck_ip(n: str) -> str:
    return ip(n).replace("[div]", "//")
