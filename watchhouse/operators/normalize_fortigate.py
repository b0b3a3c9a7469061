"""FortiGate key=value lines -> event fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchhouse.functions import columns as c
from watchhouse.functions import fixed_values as fv

KV = "_fg"


def prepare(df: DataFrame, applies: Column) -> DataFrame:
    """Parse the pairs of each applicable line once."""
    return c.with_key_values(df, KV, F.col("raw"), applies)


def _field(name: str) -> Column:
    return F.try_element_at(F.col(KV), F.lit(name))


def _text(name: str) -> Column:
    return F.coalesce(_field(name), F.lit(""))


def event_time() -> Column:
    number = c.strip(_field("eventtime")).try_cast("bigint")
    # integer division keeps microsecond counts exact
    seconds = F.when(number > 10_000_000_000, F.call_function("div", number, F.lit(1_000_000).cast("bigint")))
    seconds = F.coalesce(seconds, number)
    stamp = F.concat_ws(" ", _field("date"), _field("time"))
    both = _field("date").isNotNull() & _field("time").isNotNull()
    return F.coalesce(
        c.epoch_seconds_time(seconds),
        F.when(both, F.try_to_timestamp(stamp, F.lit(fv.FORTIGATE_TIME_FORMAT))),
    )


def fields() -> dict[str, Column]:
    kind, subtype = F.lower(_text("type")), F.lower(_text("subtype"))
    action = F.lower(_text("action"))
    proto = _text("proto")
    summary = F.concat(kind, F.lit("/"), subtype, F.lit(" action="), F.coalesce(_field("action"), F.lit("unknown")))
    return {
        "event_time": event_time(),
        "source_host": F.coalesce(c.blank_to_null(_field("devname")), F.col("source_ip")),
        "source_type": F.lit("fortigate"),
        "log_level": F.coalesce(
            c.lookup(fv.FORTIGATE_LEVELS, F.lower(_text("level"))),
            c.level_of_priority(c.priority(F.col("raw"))),
        ),
        "category": c.lookup(fv.FORTIGATE_CATEGORIES, F.concat(kind, F.lit("/"), subtype)),
        "action": F.coalesce(c.lookup(fv.FORTIGATE_ACTIONS, action), c.blank_to_null(action)),
        "src_ip": _field("srcip"),
        "src_port": c.digits_to_int(_field("srcport")),
        "dst_ip": _field("dstip"),
        "dst_port": c.digits_to_int(_field("dstport")),
        "protocol": F.coalesce(c.lookup(fv.IP_PROTOCOLS, proto), c.blank_to_null(F.lower(proto))),
        "user_name": F.coalesce(c.blank_to_null(_field("user")), c.blank_to_null(_field("unauthuser"))),
        "event_id": _field("logid"),
        "message": F.coalesce(c.blank_to_null(_field("msg")), summary),
        "extra": F.map_filter(F.col(KV), lambda k, _: k.isin(*fv.FORTIGATE_EXTRA_KEYS)),
    }
