"""Normalisation and enrichment over raw lines made from the event table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchhouse.functions import columns as c
from watchhouse.operators import enrich, normalize, normalize_cisco, normalize_windows
from watchhouse.sources.lines import clean_lines
from watchhouse.workload.files import MIXED
from watchhouse.workload.registry import query
from watchhouse.workload.tables import Tables, duck_ip, ts, with_tables

# names for the checking SQL: one row per event with the values the lines were made of
_U, _E = "CAST(user_id AS STRING)", "CAST(event_id AS STRING)"
_IP = duck_ip("user_id")
_SECOND = "date_trunc('second', ts)"
_SEVERITY = """CASE {} WHEN 0 THEN 'emergency' WHEN 1 THEN 'alert' WHEN 2 THEN 'critical' WHEN 3 THEN 'error' WHEN 4 THEN 'warning'
  WHEN 5 THEN 'notice' WHEN 6 THEN 'info' ELSE 'debug' END"""


def _id(df: DataFrame, *columns) -> DataFrame:
    return df.select(F.col("record_id").alias("id"), *columns)


def _parsed(lines: DataFrame, kind: str, *columns: str) -> DataFrame:
    """Parse and return the named fields next to the line's record id."""
    return normalize.parse_as(lines, kind, keep=("record_id",)).select("record_id", *columns)


# auditd texts contain "type=", which is taken for the firewall format
_FORTI_LIKE = "(event_id % 5 = 0 OR (event_id % 5 = 3 AND event_type = 'purchase'))"


# --- pieces ---------------------------------------------------------------------------------------------


@query(f"""SELECT {_E} AS id, CASE WHEN {_FORTI_LIKE} THEN 'fortigate' WHEN event_id % 5 = 1 AND event_id % 11 <> 0 THEN 'cisco_asa'
    WHEN event_id % 5 = 2 THEN 'windows' ELSE 'linux' END AS detected FROM events""")
def norm_autodetect(t: Tables):
    return _id(t.mixed_lines, normalize.autodetect(F.col("raw")).alias("detected"))


_REGISTRY = f"""{with_tables('sources')}, l AS (SELECT {_E} AS id, event_id AS n, event_id, event_type, {_IP} AS source_ip FROM events)
    SELECT l.id, coalesce(s.source_type, CASE WHEN {_FORTI_LIKE} THEN 'fortigate' WHEN n % 5 = 1 AND n % 11 <> 0 THEN 'cisco_asa'
      WHEN n % 5 = 2 THEN 'windows' ELSE 'linux' END) AS line_type, coalesce(nullif(s.label, ''), l.source_ip) AS label,
      s.id IS NOT NULL AS registered, coalesce(s.pci_env, false) AS is_pci_env
    FROM l LEFT JOIN sources s ON s.ip_address = l.source_ip AND s.enabled"""


@query(_REGISTRY)
def norm_registry(t: Tables):
    resolved = normalize.resolve_sources(t.mixed_lines, t.sources)
    return _id(resolved, "line_type", "label", "registered", "is_pci_env")


@query(_REGISTRY.replace("SELECT l.id, coalesce(s.source_type", "SELECT l.source_ip AS ip, CAST(count(*) AS BIGINT) AS n, bool_or(s.id IS NOT NULL) AS registered, max(coalesce(s.source_type")
       .replace("'linux' END) AS line_type", "'linux' END)) AS top_type").replace(
    ", coalesce(nullif(s.label, ''), l.source_ip) AS label,\n      s.id IS NOT NULL AS registered, coalesce(s.pci_env, false) AS is_pci_env", "")
       + " GROUP BY l.source_ip")
def join_registry(t: Tables):
    resolved = normalize.resolve_sources(t.mixed_lines, t.sources)
    return resolved.groupBy(F.col("source_ip").alias("ip")).agg(
        F.count(F.lit(1)).alias("n"), F.bool_or("registered").alias("registered"), F.max("line_type").alias("top_type"))


@query(f"""SELECT {_E} AS id, CAST(date_part('epoch', ts) >= 0 AND event_id % 9 <> 0 AS BOOLEAN) AS has_devname, '1' AS sentbyte,
    CASE WHEN event_id % 7 = 0 THEN '' ELSE concat('user', {_U}) END AS user_name,
    CASE WHEN event_id % 5 = 0 THEN '' ELSE concat('seen ', {_E}, ' times = many') END AS msg,
    CAST(18 - CASE WHEN event_id % 9 = 0 THEN 1 ELSE 0 END - CASE WHEN event_id % 4 = 3 THEN 1 ELSE 0 END
      - CASE WHEN event_id % 7 = 0 THEN 0 ELSE 1 END AS INTEGER) AS pairs FROM events""")
def norm_kv(t: Tables):
    """All pairs of a line: the last of two sentbyte values counts, empty quotes stay empty."""
    pairs = c.with_key_values(t.fortigate_lines, "kv", F.col("raw"), F.lit(True))
    return _id(pairs, F.map_contains_key("kv", "devname").alias("has_devname"), F.col("kv")["sentbyte"].alias("sentbyte"),
               F.col("kv")["user"].alias("user_name"), F.col("kv")["msg"].alias("msg"), F.size("kv").alias("pairs"))


@query(f"""SELECT {_E} AS id, CASE WHEN event_id % 17 <> 0 THEN event_id % 192 END AS priority,
    CASE WHEN event_id % 17 <> 0 THEN {_SEVERITY.format('(event_id % 192) % 8')} END AS level FROM events""")
def norm_priority(t: Tables):
    number = c.priority(F.col("raw"))
    return _id(t.cisco_lines, number.alias("priority"), c.level_of_priority(number).alias("level"))


# --- whole formats ------------------------------------------------------------------------------------------


_FORTI_TYPE = "CASE event_type WHEN 'purchase' THEN 'traffic' WHEN 'view' THEN 'utm' ELSE 'event' END"
_FORTI_SUB = "CASE event_type WHEN 'error' THEN 'admin' WHEN 'signup' THEN 'user' WHEN 'click' THEN 'wanopt' WHEN 'purchase' THEN 'forward' ELSE 'ips' END"
_FORTI_ACTION = "CASE event_type WHEN 'error' THEN 'blocked' WHEN 'signup' THEN 'Accept' WHEN 'click' THEN 'server-rst' WHEN 'purchase' THEN 'accept' ELSE 'dropped' END"
# a count with three more digits is beyond the year 9999: date and time are used
_FORTI_TIME = f"{_SECOND}"


@query(f"""SELECT {_E} AS record_id, {ts(_FORTI_TIME, 'event_time')}, CASE WHEN event_id % 9 = 0 THEN {_IP} ELSE concat('FGT-', event_id % 20) END AS source_host,
    'fortigate' AS source_type, CASE event_id % 4 WHEN 0 THEN 'notice' WHEN 1 THEN 'warning' WHEN 2 THEN 'info' ELSE {_SEVERITY.format('(event_id % 192) % 8')} END AS log_level,
    CASE event_type WHEN 'error' THEN 'auth' WHEN 'signup' THEN 'auth' WHEN 'purchase' THEN 'network' WHEN 'view' THEN 'threat' END AS category,
    CASE event_type WHEN 'error' THEN 'deny' WHEN 'click' THEN 'reset' WHEN 'view' THEN 'dropped' ELSE 'allow' END AS action,
    {_IP} AS src_ip, CASE WHEN event_id % 13 <> 0 THEN CAST(1024 + event_id % 60000 AS INTEGER) END AS src_port, '198.51.100.7' AS dst_ip,
    CAST(443 AS INTEGER) AS dst_port, CASE event_id % 5 WHEN 0 THEN 'tcp' WHEN 1 THEN 'udp' WHEN 2 THEN 'icmp' WHEN 3 THEN 'sctp' ELSE '99' END AS protocol,
    CASE WHEN event_id % 7 = 0 THEN 'guest' ELSE 'user' END || {_U} AS user_name, {_E} AS event_id,
    CASE WHEN event_id % 5 = 0 THEN concat({_FORTI_TYPE}, '/', {_FORTI_SUB}, ' action=', {_FORTI_ACTION}) ELSE concat('seen ', {_E}, ' times = many') END AS message,
    {_FORTI_SUB} AS subtype, '1' AS sentbyte, CAST(CASE WHEN event_id % 9 = 0 THEN 4 ELSE 5 END AS INTEGER) AS extra_keys FROM events""")
def norm_fortigate(t: Tables):
    parsed = _parsed(t.fortigate_lines, "fortigate", "event_time", "source_host", "source_type", "log_level", "category", "action",
                     "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "user_name", "event_id", "message", "extra")
    return parsed.withColumns({"subtype": F.col("extra")["subtype"], "sentbyte": F.col("extra")["sentbyte"],
                               "extra_keys": F.size("extra")}).drop("extra")


@query(f"""SELECT {_E} AS record_id, {ts(_FORTI_TIME, 'event_time')} FROM events""")
def norm_fortigate_time(t: Tables):
    """Seconds, microseconds, an overflowing count, and date plus time."""
    return _parsed(t.fortigate_lines, "fortigate", "event_time")


_CODE = "CASE event_type WHEN 'error' THEN '611102' WHEN 'signup' THEN '713172' WHEN 'click' THEN '302013' WHEN 'purchase' THEN '106006' ELSE '999999' END"
_TAGGED = "event_id % 11 <> 0"
_CISCO_PORT = "CASE WHEN event_type = 'click' THEN 1024 + event_id % 60000 ELSE event_id % 60000 END"


@query(f"""SELECT {_E} AS record_id, {ts(_SECOND, 'event_time')}, concat('asa-', event_id % 20) AS source_host, 'cisco_asa' AS source_type,
    CASE WHEN {_TAGGED} THEN {_SEVERITY.format('event_id % 8')} WHEN event_id % 17 <> 0 THEN {_SEVERITY.format('(event_id % 192) % 8')} END AS log_level,
    CASE WHEN {_TAGGED} THEN CASE event_type WHEN 'error' THEN 'auth' WHEN 'signup' THEN 'auth' WHEN 'click' THEN 'network' WHEN 'purchase' THEN 'network' ELSE 'system' END END AS category,
    CASE WHEN {_TAGGED} THEN CASE event_type WHEN 'error' THEN 'logon_failed' WHEN 'click' THEN 'allow' WHEN 'purchase' THEN 'deny' END END AS action,
    CASE WHEN {_TAGGED} AND event_type IN ('click', 'purchase') THEN {_IP} END AS src_ip,
    CASE WHEN {_TAGGED} AND event_type IN ('click', 'purchase') THEN CAST({_CISCO_PORT} AS INTEGER) END AS src_port,
    CASE WHEN {_TAGGED} AND event_type = 'click' THEN '8.8.8.8' END AS dst_ip, CASE WHEN {_TAGGED} AND event_type = 'click' THEN CAST(53 AS INTEGER) END AS dst_port,
    CASE WHEN {_TAGGED} AND event_type = 'click' THEN 'tcp' END AS protocol, CASE WHEN {_TAGGED} AND event_type = 'signup' THEN concat('user', {_U}) END AS user_name,
    CASE WHEN {_TAGGED} THEN {_CODE} END AS event_id,
    CASE WHEN NOT ({_TAGGED}) THEN concat('plain text ', {_E}) ELSE CASE event_type
      WHEN 'error' THEN concat('AAA user authentication failed: User authentication failed: Uname: user', {_U})
      WHEN 'signup' THEN concat('VPN session event: Group = G, Username = user', {_U}, ', IP = 203.0.113.5, memory freed')
      WHEN 'click' THEN concat('Built TCP connection: Built outbound TCP connection ', {_E}, ' for outside:8.8.8.8/53 (8.8.8.8/53) to inside:', {_IP}, '/', 1024 + event_id % 60000, ' (', {_IP}, '/', 1024 + event_id % 60000, ')')
      WHEN 'purchase' THEN concat('ACL deny (outbound): Deny inbound UDP from ', {_IP}, '/', event_id % 60000, ' on outside')
      ELSE concat('ASA-', event_id % 8, '-999999') END END AS message,
    CASE WHEN {_TAGGED} THEN CAST(event_id % 8 AS STRING) END AS severity_digit FROM events""")
def norm_cisco(t: Tables):
    parsed = _parsed(t.cisco_lines, "cisco_asa", "event_time", "source_host", "source_type", "log_level", "category", "action",
                     "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "user_name", "event_id", "message", "extra")
    return parsed.withColumn("severity_digit", F.col("extra")["severity_digit"]).drop("extra")


@query(f"SELECT {_E} AS record_id, {ts(_SECOND, 'event_time')} FROM events")
def norm_cisco_time(t: Tables):
    """Year-less times take the year of receipt; days below ten are padded with a blank."""
    return _parsed(t.cisco_lines, "cisco_asa", "event_time")


@query(f"""SELECT {_E} AS record_id, CASE WHEN event_type IN ('click', 'purchase') AND {_TAGGED} THEN concat({_IP}, '/', {_CISCO_PORT}) END AS source,
    CASE WHEN event_type = 'click' AND {_TAGGED} THEN '8.8.8.8/53' END AS destination FROM events""")
def norm_cisco_ips(t: Tables):
    """Four, one or no address/port pairs in a line."""
    staged = normalize_cisco.prepare(t.cisco_lines, F.lit(True))
    source, destination = normalize_cisco.endpoints()
    return staged.select("record_id", source.alias("source"), destination.alias("destination"))


_WIN_ID = "CASE event_type WHEN 'error' THEN '4625' WHEN 'signup' THEN '4624' WHEN 'click' THEN '4672' WHEN 'purchase' THEN '4688' ELSE '9999' END"
_LOGON = """CASE event_id % 12 WHEN 2 THEN 'Interactive' WHEN 3 THEN 'Network' WHEN 4 THEN 'Batch' WHEN 5 THEN 'Service' WHEN 7 THEN 'Unlock'
    WHEN 8 THEN 'NetworkCleartext' WHEN 9 THEN 'NewCredentials' WHEN 10 THEN 'RemoteInteractive' WHEN 11 THEN 'CachedInteractive' ELSE CAST(event_id % 12 AS STRING) END"""
_TARGET = f"concat('user', {_U}, CASE WHEN event_id % 7 = 0 THEN '$' ELSE '' END)"
_WIN_TIME = f"CASE event_id % 4 WHEN 0 THEN {_SECOND} + INTERVAL 250 MILLISECOND WHEN 3 THEN CAST(NULL AS TIMESTAMP) ELSE {_SECOND} END"
_WIN_MESSAGE = f"""CASE event_type WHEN 'error' THEN concat('Failed account logon: ', {_TARGET}, ' (Logon type ', event_id % 12, ')')
    WHEN 'signup' THEN concat('Successful account logon: ', {_TARGET}) WHEN 'click' THEN concat('Special privileges assigned to new logon: sys', {_U})
    WHEN 'purchase' THEN concat('Process created: C:', chr(92), 'Windows', chr(92), 'p', {_U}, '.exe by sys', {_U}) ELSE 'Windows Event 9999 (Security)' END"""


@query(f"""SELECT {_E} AS record_id, {ts(_WIN_TIME, 'event_time')}, CASE WHEN event_id % 9 = 0 THEN {_IP} ELSE concat('WS-', event_id % 20) END AS source_host,
    CASE event_id % 8 WHEN 1 THEN 'critical' WHEN 2 THEN 'error' WHEN 3 THEN 'warning' WHEN 5 THEN 'debug' ELSE 'info' END AS log_level,
    CASE event_type WHEN 'purchase' THEN 'endpoint' WHEN 'view' THEN 'system' ELSE 'auth' END AS category,
    CASE event_type WHEN 'error' THEN 'logon_failed' WHEN 'signup' THEN 'logon' WHEN 'click' THEN 'privileged_logon' END AS action,
    CASE WHEN event_id % 5 > 1 THEN {_IP} END AS src_ip, CASE WHEN event_id % 6 <> 0 THEN CAST(1024 + event_id % 60000 AS INTEGER) END AS src_port,
    CASE WHEN event_type NOT IN ('error', 'signup') THEN concat('sys', {_U}) WHEN event_id % 7 <> 0 THEN concat('user', {_U}) END AS user_name,
    CASE WHEN event_type = 'purchase' THEN concat('p', {_U}, '.exe') END AS process_name, {_WIN_ID} AS event_id, {_WIN_MESSAGE} AS message,
    CASE WHEN event_type IN ('error', 'signup', 'click') THEN 'hipaa:auth' ELSE '' END AS tags, {_LOGON} AS logon_type, concat('n', {_E}) AS note,
    CAST(3 AS INTEGER) AS extra_keys FROM events""")
def norm_windows(t: Tables):
    parsed = _parsed(t.windows_lines, "windows", "event_time", "source_host", "log_level", "category", "action", "src_ip", "src_port",
                     "user_name", "process_name", "event_id", "message", "tags", "extra")
    return parsed.withColumns({"logon_type": F.col("extra")["LogonType"], "note": F.col("extra")["Note"],
                               "extra_keys": F.size("extra")}).drop("extra")


@query(f"SELECT {_E} AS record_id, {_WIN_MESSAGE} AS message FROM events")
def norm_windows_msg(t: Tables):
    """Template fill alone."""
    staged = normalize_windows.prepare(t.windows_lines, F.lit(True))
    return staged.select("record_id", normalize_windows.fields()["message"].alias("message"))


_INVALID = "(event_type = 'error' AND event_id % 3 = 0)"
_LX_MESSAGE = f"""CASE event_type WHEN 'error' THEN concat('Failed password for ', CASE WHEN event_id % 3 = 0 THEN 'invalid user ' ELSE '' END, 'user', {_U}, ' from ', {_IP}, ' port ', 1024 + event_id % 60000, ' ssh2')
    WHEN 'signup' THEN concat('Accepted publickey for user', {_U}, ' from ', {_IP}, ' port 22 ssh2') WHEN 'click' THEN concat('user', {_U}, ' : TTY=pts/1 ; PWD=/home/u ; USER=root ; COMMAND=/bin/bash')
    WHEN 'purchase' THEN concat('type=USER_AUTH msg=audit(1.0:1): acct="user', {_U}, '" addr=', {_IP}, ' res=success') ELSE 'Started Daily Cleanup.' END"""
_LX_CLASS = f"""CASE event_type WHEN 'purchase' THEN 'compliance' WHEN 'view' THEN 'system' ELSE 'auth' END AS category,
    CASE WHEN event_type = 'error' AND NOT {_INVALID} THEN 'logon_failed' WHEN event_type = 'signup' THEN 'logon' WHEN event_type = 'click' THEN 'privileged_exec' END AS action,
    CASE WHEN event_type IN ('error', 'signup', 'purchase') AND NOT {_INVALID} THEN {_IP} END AS src_ip,
    CASE WHEN event_type = 'error' AND NOT {_INVALID} THEN CAST(1024 + event_id % 60000 AS INTEGER) WHEN event_type = 'signup' THEN CAST(22 AS INTEGER) END AS src_port,
    CASE WHEN event_type <> 'view' AND NOT {_INVALID} THEN concat('user', {_U}) END AS user_name"""


@query(f"""SELECT {_E} AS record_id, {ts(f"CASE WHEN event_type = 'click' THEN {_SECOND} ELSE ts END", 'event_time')},
    CASE WHEN event_type <> 'click' THEN concat('web-', event_id % 20) WHEN event_id % 9 = 0 THEN {_IP} ELSE concat('db-', event_id % 20) END AS source_host,
    CASE WHEN event_type = 'click' THEN {_SEVERITY.format('(event_id % 10) % 8')} ELSE {_SEVERITY.format('event_id % 8')} END AS log_level, {_LX_CLASS},
    CASE event_type WHEN 'click' THEN 'sudo' WHEN 'purchase' THEN 'auditd' WHEN 'view' THEN 'systemd' ELSE 'sshd' END AS process_name, {_LX_MESSAGE} AS message,
    CASE event_type WHEN 'purchase' THEN 'hipaa:audit' WHEN 'view' THEN '' ELSE 'hipaa:auth' END AS tags, {_E} AS pid,
    CASE WHEN event_type <> 'click' THEN 'syslog' END AS transport, CASE WHEN event_type = 'click' THEN '1' END AS facility FROM events""")
def norm_linux(t: Tables):
    parsed = _parsed(t.linux_lines, "linux", "event_time", "source_host", "log_level", "category", "action", "src_ip", "src_port",
                     "user_name", "process_name", "message", "tags", "extra")
    kept = {"pid": "pid", "transport": "_TRANSPORT", "facility": "facility"}
    return parsed.withColumns({name: F.col("extra")[key] for name, key in kept.items()}).drop("extra")


@query(f"SELECT {_E} AS record_id, {_LX_CLASS} FROM events")
def norm_linux_classify(t: Tables):
    return _parsed(t.linux_lines, "linux", "category", "action", "src_ip", "src_port", "user_name")


@query(f"""SELECT {_E} AS record_id, {ts(_WIN_TIME, 'iso')}, {ts('ts', 'micros')} FROM events""")
def norm_time_formats(t: Tables):
    """ISO text with fraction, without, without zone, with an offset (not accepted); microsecond counts."""
    iso = F.get_json_object("raw", "$.TimeCreated")
    stamps = t.windows_lines.select("record_id", c.iso_time(iso).alias("iso"),
                                    c.epoch_micros_time(F.unix_micros("received_at").cast("string")).alias("micros"))
    return stamps


@query(f"""{with_tables('fortigate_lines')} SELECT record_id, 'worker-01' AS ingest_node, sha256(raw) AS raw_hash, length(raw) = length(raw) AS kept FROM fortigate_lines""")
def norm_stamp(t: Tables):
    parsed = normalize.parse_as(t.fortigate_lines, "fortigate", keep=("record_id", "raw"))
    return parsed.select("record_id", "ingest_node", "raw_hash", (F.col("raw") == F.col("raw_message")).alias("kept"))


# --- projections -----------------------------------------------------------------------------------------------


SIEM = with_tables("siem")
_SUMMARY = f"""id, {ts('received_at')}, {ts('event_time')}, source_host, source_type, log_level, category, action, src_ip, src_port, dst_ip, dst_port,
    protocol, user_name, event_id, message, coalesce(array_to_string(tags, ','), '') AS tags"""
_REST = "process_name, raw_message, raw_hash, geo_country, geo_city, alert_id, ingest_node"


@query(f"""{SIEM} SELECT {_SUMMARY.replace("coalesce(array_to_string(tags, ','), '') AS tags", "array_to_string(tags, ',') AS tags")}, {_REST},
    concat('{{"k":"', extra['k'], '","sentbyte":"', extra['sentbyte'], '"}}') AS extra FROM siem""")
def proj_event_row(t: Tables):
    return enrich.event_rows(t.siem)


@query(f"{SIEM} SELECT {_SUMMARY} FROM siem")
def proj_event_summary(t: Tables):
    return enrich.event_summaries(t.siem)


@query(f"{SIEM} SELECT {_SUMMARY}, {_REST}, extra['k'] AS k FROM siem")
def proj_event_detail(t: Tables):
    return enrich.event_details(t.siem).withColumn("k", F.col("extra")["k"]).drop("extra")


# --- enrichment ----------------------------------------------------------------------------------------------------


_TAGS = """array_to_string(list_sort(list_distinct(list_concat(coalesce(tags, []), list_filter([
    CASE WHEN category = 'auth' THEN 'hipaa:auth' END, CASE WHEN event_id IN ('4634', '4647') THEN 'hipaa:session' END,
    CASE WHEN integrity THEN 'hipaa:integrity' END, CASE WHEN integrity OR pci THEN 'pci_dss' END, CASE WHEN pci THEN 'pci:cardholder_env' END], lambda x: x IS NOT NULL)))), ',')"""


@query(f"""{with_tables('siem', 'sources')}, s AS (SELECT siem.id, tags, category, src_ip, CASE CAST(id AS BIGINT) % 5 WHEN 0 THEN '4634' WHEN 1 THEN '1102' WHEN 2 THEN '0100044546' WHEN 3 THEN '4625' END AS event_id FROM siem),
    f AS (SELECT s.*, coalesce(s.event_id IN ('1102', '0100044546'), false) AS integrity, src_ip IN (SELECT ip_address FROM sources WHERE enabled AND pci_env) AS pci FROM s)
    SELECT id, {_TAGS} AS tags FROM f""")
def enrich_compliance_tags(t: Tables):
    ids = F.when(F.col("n") == 0, "4634").when(F.col("n") == 1, "1102").when(F.col("n") == 2, "0100044546").when(F.col("n") == 3, "4625")
    events = t.siem.withColumn("n", F.col("id").cast("bigint") % 5).withColumn("event_id", ids)
    return enrich.add_compliance_tags(enrich.pci_flag(events, t.sources)).select("id", "tags")


@query(f"""{SIEM} SELECT id, array_to_string(list_sort(list_distinct(list_concat(coalesce(tags, []), list_filter([CASE WHEN category = 'auth' THEN 'hipaa:auth' END], lambda x: x IS NOT NULL)))), ',') AS tags FROM siem""")
def set_tags(t: Tables):
    """Existing and earned tags as one sorted set."""
    return enrich.add_compliance_tags(t.siem).select("id", "tags")


@query(f"""{with_tables('siem', 'sources')} SELECT id, src_ip IN (SELECT ip_address FROM sources WHERE enabled AND pci_env) AS is_pci_env FROM siem""")
def enrich_pci_source(t: Tables):
    return enrich.pci_flag(t.siem, t.sources).select("id", "is_pci_env")


_NUMBER = "list_reduce(list_transform(string_split(src_ip, '.'), lambda x: CAST(x AS BIGINT)), lambda a, b: a * 256 + b)"
_GEO = f"""{with_tables('siem', 'geo_ranges')}, n AS (SELECT id, src_ip, {_NUMBER} AS ip FROM siem)
    SELECT n.id, g.country AS geo_country, g.city AS geo_city FROM n LEFT JOIN geo_ranges g ON n.ip BETWEEN g.start_ip AND g.end_ip"""


@query(_GEO)
def enrich_geoip(t: Tables):
    """Integer ranges of IPv4."""
    return enrich.add_geoip(t.siem, t.geo_ranges).select("id", "geo_country", "geo_city")


@query(_GEO.replace("SELECT n.id, g.country AS geo_country, g.city AS geo_city", "SELECT g.country AS geo_country, count(*) AS n")
       + " GROUP BY g.country")
def join_geoip(t: Tables):
    return enrich.add_geoip(t.siem, t.geo_ranges).groupBy("geo_country").agg(F.count(F.lit(1)).alias("n"))


# The same addresses in both families: 10.a.b.c is also 2001:db8:<10 a>:<b c>::<id>.  Networks of customers (/31 and /64) lie in those
# of nations (/16 and /48), and these in one of the whole block (/8 and /31).
_BOTH = f"""{with_tables('siem', 'geo_ranges')}, n AS (SELECT id, CAST(id AS BIGINT) % 13 AS k, {_NUMBER} AS ip FROM siem),
    c AS (SELECT start_ip // 2 AS pair, start_ip, country, city FROM geo_ranges),
    f AS (SELECT id, k, ip, CASE WHEN k IN (3, 4, 5) THEN '6' ELSE '4' END AS family FROM n),
    l AS (SELECT f.id, CASE WHEN k IN (1, 2) THEN NULL WHEN k = 0 THEN 'kept' WHEN c.country IS NOT NULL THEN concat(family, ' ', c.country)
        WHEN na.n_name IS NOT NULL THEN concat(family, ' ', na.n_name) ELSE concat(family, ' block') END AS geo_country,
        CASE WHEN k IN (0, 1, 2) THEN NULL ELSE c.city END AS geo_city
      FROM f LEFT JOIN c ON (family = '4' AND f.ip // 2 = c.pair) OR (family = '6' AND f.ip = c.start_ip)
        LEFT JOIN nation na ON (f.ip >> 16) = 2560 + na.n_nationkey)"""


def _both_families(t: Tables):
    number = F.expr("aggregate(split(src_ip, '[.]'), 0L, (a, x) -> a * 256 + CAST(x AS BIGINT))")
    group = lambda name, at, n: F.conv(F.call_function("mod", F.call_function("shiftright", F.col(name), F.lit(at)), F.lit(1 << n)), 10, 16)
    six = lambda name: F.concat(F.lit("2001:DB8:"), group(name, 16, 16), F.lit(":"), group(name, 0, 16), F.lit("::"))
    k = F.col("id").cast("bigint") % 13
    spelled = (F.when(k == 1, F.lit(None)).when(k == 2, "no address").when(k == 3, F.concat(six("_n"), k.cast("string")))
               .when(k == 4, F.lower(F.concat(six("_n"), F.lit("%eth0")))).when(k == 5, F.concat(six("_n"), F.lit("10.0.0.1")))
               .when(k == 6, F.concat(F.lit("::ffff:"), F.col("src_ip"))).otherwise(F.col("src_ip")))
    events = t.siem.withColumn("_n", number).withColumn("src_ip", spelled).withColumn("geo_country", F.when(k == 0, "kept")).drop("_n")
    dotted = lambda name: F.concat_ws(".", *[F.call_function("mod", F.call_function("shiftright", F.col(name), F.lit(at)), F.lit(256)) for at in (24, 16, 8, 0)])
    of = lambda df, network, country, city: df.select(network.alias("network"), country.alias("country"), city.alias("city"))
    named = lambda family, name: F.concat(F.lit(f"{family} "), name)
    customers = t.geo_ranges.withColumn("_p", F.call_function("div", F.col("start_ip"), F.lit(2).cast("long")) * 2)
    nations = t.nation.withColumn("_b", (F.col("n_nationkey") + 2560) * 65536)
    none = F.lit(None).cast("string")
    blocks = t.spark.createDataFrame([("10.0.0.0/8", "4 block"), ("2001:db8::/31", "6 block")], "network string, country string")
    networks = [
        of(customers, F.concat(dotted("_p"), F.lit("/31")), named(4, F.col("country")), F.col("city")),
        of(customers, F.concat(six("start_ip"), F.lit("/64")), named(6, F.col("country")), F.col("city")),
        of(nations, F.concat(dotted("_b"), F.lit("/16")), named(4, F.col("n_name")), none),
        of(nations, F.concat(F.lit("2001:db8:"), group("_b", 16, 16), F.lit("::/48")), named(6, F.col("n_name")), none),
        of(blocks, F.col("network"), F.col("country"), none)]
    return events, reduce(DataFrame.unionByName, networks)


@query(f"{_BOTH} SELECT id, geo_country, geo_city FROM l")
def enrich_location(t: Tables):
    """Addresses of both families in several spellings, missing and broken ones, in nested networks."""
    return enrich.add_location(*_both_families(t)).select("id", "geo_country", "geo_city")


@query(f"{_BOTH} SELECT geo_country, count(*) AS n FROM l GROUP BY geo_country")
def join_location(t: Tables):
    """Events per country, by the longest network."""
    return enrich.add_location(*_both_families(t)).groupBy("geo_country").agg(F.count(F.lit(1)).alias("n"))


@query(_GEO)
def enrich_location_ranges(t: Tables):
    """Ranges of numbers cut into networks."""
    return enrich.add_location(t.siem, enrich.networks_of_ranges(t.geo_ranges)).select("id", "geo_country", "geo_city")


# --- the whole path --------------------------------------------------------------------------------------------------


@query(f"""{MIXED} SELECT digest, CASE WHEN what IS NULL THEN 'error' ELSE 'event' END AS kind, coalesce(what, 'not a JSON object') AS what, count(*) AS n FROM k GROUP BY ALL""")
def norm_mixed(t: Tables):
    """Registered senders by their type, others by content; what a parser refuses becomes a dead letter."""
    parsed = normalize.normalize(t.mixed_lines, t.sources)
    kind = F.when(F.col("problem").isNull(), "event").otherwise("error")
    what = F.when(F.col("problem").isNull(), F.col("source_type")).otherwise(F.col("problem"))
    return parsed.groupBy(F.col("raw_hash").alias("digest"), kind.alias("kind"), what.alias("what")).agg(F.count(F.lit(1)).alias("n"))


_BLANKS = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13), chr(28), chr(29), chr(30), chr(31), chr(133), chr(160))"


@query(f"""SELECT doc_id, sha256(trim(text, {_BLANKS})) AS digest FROM documents WHERE trim(text, {_BLANKS}) <> ''""")
def norm_clean_lines(t: Tables):
    """Whole texts trimmed of all kinds of whitespace, blank ones dropped."""
    lines = t.documents.select("doc_id", F.col("text").alias("raw"))
    return clean_lines(lines).select("doc_id", F.sha2("raw", 256).alias("digest"))
