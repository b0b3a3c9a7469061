"""Cisco ASA / IOS syslog lines -> event fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchhouse.functions import columns as c
from watchhouse.functions import fixed_values as fv

REST, SEV, CODE, BODY, IPS = "_ci_rest", "_ci_sev", "_ci_code", "_ci_body", "_ci_ips"


def prepare(df: DataFrame, applies: Column) -> DataFrame:
    raw, rest = F.col("raw"), F.col(REST)
    df = df.withColumn(REST, F.when(applies, F.regexp_replace(raw, fv.CISCO_HEADER, "")))
    df = df.withColumns({
        SEV: c.group_of(rest, fv.CISCO_TAG, 1),
        CODE: c.group_of(rest, fv.CISCO_TAG, 2),
        BODY: c.strip(F.regexp_extract(rest, fv.CISCO_TAG, 3)),
    })
    found = F.regexp_extract_all(F.col(BODY), F.lit(fv.IP_PORT), F.lit(0))
    return df.withColumn(IPS, F.when(F.col(CODE).isNotNull(), found))


def endpoints() -> tuple[Column, Column]:
    """(source, destination) ``ip/port`` texts: last and first of the line; a single one is the source."""
    ips = F.col(IPS)
    count = F.size(ips)
    return F.get(ips, count - 1), F.when(count >= 2, F.get(ips, F.lit(0)))


def fields() -> dict[str, Column]:
    raw, rest, sev, code, body = (F.col(n) for n in ("raw", REST, SEV, CODE, BODY))
    tagged = code.isNotNull()
    known = {k: F.struct(*[F.lit(x).cast("string").alias(n) for x, n in zip(v, ("category", "text", "action"))])
             for k, v in fv.CISCO_MNEMONICS.items()}
    pairs: list[Column] = []
    for k, v in known.items():
        pairs += [F.lit(k), v]
    info = F.try_element_at(F.create_map(*pairs), code)
    text = F.coalesce(info["text"], F.concat(F.lit("ASA-"), sev, F.lit("-"), code))
    src, dst = endpoints()
    stamp = c.group_of(raw, fv.CISCO_HEADER, 2)
    untagged = F.coalesce(c.blank_to_null(c.strip(rest)), raw)
    return {
        "event_time": c.year_less_time(stamp, F.col("received_at")),
        "source_host": F.coalesce(c.group_of(raw, fv.CISCO_HEADER, 3), F.col("source_ip")),
        "source_type": F.lit("cisco_asa"),
        "log_level": F.when(tagged, c.lookup(fv.SYSLOG_LEVELS, sev.try_cast("int")))
        .otherwise(c.level_of_priority(c.priority(raw))),
        "category": F.when(tagged, F.coalesce(info["category"], F.lit("system"))),
        "action": info["action"],
        "src_ip": F.substring_index(src, "/", 1),
        "src_port": F.substring_index(src, "/", -1).try_cast("int"),
        "dst_ip": F.substring_index(dst, "/", 1),
        "dst_port": F.substring_index(dst, "/", -1).try_cast("int"),
        "protocol": c.lookup(fv.CISCO_PROTOCOLS, code),
        # trailing commas belong to the sentence, not to the name
        "user_name": F.when(tagged, F.rtrim(c.group_of(body, fv.CISCO_USER, 1), F.lit(","))),
        "event_id": code,
        "message": F.when(~tagged, untagged).when(body == "", text).otherwise(F.concat(text, F.lit(": "), body)),
        "extra": F.when(
            tagged,
            F.create_map(F.lit("mnemonic"), code, F.lit("severity_digit"), sev),
        ).otherwise(c.empty_map()),
    }
