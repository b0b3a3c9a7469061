"""Table schemas and value domains."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


_S, _TS, _I, _L, _B = T.StringType(), T.TimestampType(), T.IntegerType(), T.LongType(), T.BooleanType()
_MAP = T.MapType(_S, _S)

EVENTS = _struct(
    id=_S, received_at=_TS, event_time=_TS, source_host=_S, source_type=_S, log_level=_S,
    category=_S, action=_S, src_ip=_S, src_port=_I, dst_ip=_S, dst_port=_I, protocol=_S,
    user_name=_S, process_name=_S, event_id=_S, message=_S, raw_message=_S,
    tags=T.ArrayType(_S), geo_country=_S, geo_city=_S, alert_id=_S, ingest_node=_S,
    raw_hash=_S, extra=_MAP,
)
EVENT_COLUMNS = EVENTS.fieldNames()

EVENT_SUMMARY_COLUMNS = [
    "id", "received_at", "event_time", "source_host", "source_type", "log_level", "category",
    "action", "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "user_name", "event_id",
    "message", "tags",
]

# one rule firing for one group
TRIGGERS = _struct(
    rule_id=_S, severity=_S, title=_S, description=_S, src_ip=_S, source_host=_S,
    first_seen=_TS, last_seen=_TS, event_count=_L, group_key=_S, extra=_MAP,
)
TRIGGER_COLUMNS = TRIGGERS.fieldNames()

ALERTS = _struct(
    id=_S, rule_id=_S, severity=_S, status=_S, title=_S, description=_S, src_ip=_S,
    source_host=_S, first_seen=_TS, last_seen=_TS, event_count=_L, assigned_to=_S,
    extra=_MAP, group_key=_S, created_at=_TS, updated_at=_TS,
)
ALERT_COLUMNS = ALERTS.fieldNames()

RULES = _struct(
    id=_S, name=_S, description=_S, rule_type=_S, severity=_S, enabled=_B, body=_S,
    created_at=_TS, updated_at=_TS,
)
SOURCES = _struct(
    id=_S, ip_address=_S, hostname=_S, source_type=_S, label=_S, enabled=_B, pci_env=_B,
    last_seen=_TS, event_rate_1m=_I, created_at=_TS,
)
BLACKLISTS = _struct(list_name=_S, value=_S)
AUDIT_LOG = _struct(
    id=_S, user_email=_S, action=_S, resource_type=_S, resource_id=_S, source_ip=_S,
    request_body=_S, response_status=_I, created_at=_TS,
)
ERRORS = _struct(error=_S, detail=_S, source_ip=_S, raw=_S, received_at=_TS)

# what a collector hands to the normaliser
RAW_LINES = _struct(raw=_S, source_ip=_S, received_at=_TS)

# Enumerated domains.
SOURCE_TYPES = ("fortigate", "cisco_asa", "cisco_ios", "windows", "linux")
LOG_LEVELS = ("emergency", "alert", "critical", "error", "warning", "notice", "info", "debug")
CATEGORIES = ("auth", "network", "endpoint", "system", "threat", "compliance")
SEVERITIES = ("critical", "high", "medium", "low", "info")
ALERT_STATUSES = ("open", "acknowledged", "closed")
RULE_TYPES = ("threshold", "sequence", "absence", "blacklist", "anomaly")

# columns a rule may group by or match against a blacklist
GROUPABLE = ("src_ip", "dst_ip", "source_host", "user_name", "protocol", "event_id", "process_name")
