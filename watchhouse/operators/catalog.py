"""Rule, source and blacklist tables: batches of changes, first come first served where it matters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchhouse.functions import columns as c
from watchhouse.schema import RULES, SOURCES

_RULE_FIELDS = ("name", "description", "rule_type", "severity", "enabled", "body")


def apply_rule_changes(rules: DataFrame, changes: DataFrame, as_of) -> DataFrame:
    """Apply ``changes(id, seq, op, <rule fields>)`` with op create | update | delete, in ``seq`` order.

    An update sets the non-NULL fields of an existing rule and is ignored when there is none at that
    point.  Everything is aggregated per rule; no rule's change list is gathered in one place.
    """
    reset = F.col("op").isin("create", "delete")
    turning = changes.filter(reset).groupBy("id").agg(
        F.max(F.struct("seq", "op"))["seq"].alias("_reset_seq"),
        F.max(F.struct("seq", "op"))["op"].alias("_reset_op"),
    )
    live = changes.join(turning, "id", "left").filter(
        F.col("_reset_seq").isNull()
        | ((F.col("_reset_op") == "create") & (F.col("seq") >= F.col("_reset_seq")))
    )
    newest = live.groupBy("id").agg(
        *[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f"_{f}") for f in _RULE_FIELDS],
        F.bool_or(F.col("op") == "create").alias("_created"),
    )
    base = rules.withColumn("_existing", F.lit(True)).join(turning, "id", "full").join(newest, "id", "full")
    created = F.coalesce(F.col("_created"), F.lit(False))
    deleted = F.coalesce(F.col("_reset_op") == "delete", F.lit(False))
    kept = base.filter(~deleted & (created | F.coalesce(F.col("_existing"), F.lit(False))))
    touched = F.col("_created").isNotNull()
    now = c.as_timestamp(as_of)
    values = {f: F.when(created, F.col(f"_{f}")).otherwise(F.coalesce(f"_{f}", f)) for f in _RULE_FIELDS}
    values["enabled"] = F.when(created, F.coalesce(F.col("_enabled"), F.lit(True))).otherwise(
        F.coalesce("_enabled", "enabled"))
    values["created_at"] = F.when(created, now).otherwise(F.col("created_at"))
    values["updated_at"] = F.when(touched, now).otherwise(F.col("updated_at"))
    return _shape(kept, RULES, values)


def register_sources(sources: DataFrame, requests: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """Split ``requests(seq, ip_address, hostname, source_type, label, enabled, pci_env)``.

    Returns (sources with the accepted ones added, rejected requests).  An address is registered
    once: known addresses and all but the first request for an address are rejected.
    """
    first = requests.groupBy("ip_address").agg(F.min("seq").alias("seq"))
    accepted = requests.join(first, ["ip_address", "seq"], "left_semi").join(
        sources.select("ip_address"), "ip_address", "left_anti"
    )
    rejected = requests.join(accepted.select("seq"), "seq", "left_anti")
    added = _shape(accepted, SOURCES, {
        "id": F.sha2(F.concat_ws("|", F.lit("source"), "ip_address"), 256),
        "enabled": F.coalesce("enabled", F.lit(True)),
        "last_seen": F.lit(None), "event_rate_1m": F.lit(0), "created_at": c.as_timestamp(as_of),
    })
    return sources.select(*SOURCES.fieldNames()).unionByName(added), rejected


def switch_sources(sources: DataFrame, switches: DataFrame) -> DataFrame:
    """Apply ``switches(id, seq, enabled)``; the last one per source wins."""
    last = switches.groupBy("id").agg(F.max_by("enabled", "seq").alias("_enabled"))
    joined = sources.join(last, "id", "left")
    return _shape(joined, SOURCES, {"enabled": F.coalesce("_enabled", "enabled")})


def load_blacklist(entries: DataFrame) -> DataFrame:
    """Distinct (list_name, value) pairs; incomplete ones are dropped as the table forbids them."""
    return entries.select("list_name", "value").filter("list_name IS NOT NULL AND value IS NOT NULL").distinct()


def source_activity(events: DataFrame, sources: DataFrame, as_of, ip_column: str = "src_ip") -> DataFrame:
    """Sources with ``last_seen`` and the number of events of the last minute filled in."""
    seen = events.groupBy(F.col(ip_column).alias("ip_address")).agg(
        F.max("received_at").alias("_seen"),
        F.count_if(F.col("received_at") > c.seconds_before(as_of, 60)).alias("_rate"),
    )
    joined = sources.join(seen, "ip_address", "left")
    return _shape(joined, SOURCES, {
        "last_seen": F.greatest("_seen", "last_seen"), "event_rate_1m": F.coalesce("_rate", F.lit(0)),
    })


def _shape(df: DataFrame, schema, values: dict[str, Column]) -> DataFrame:
    return df.select(*[values.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in schema.fields])
