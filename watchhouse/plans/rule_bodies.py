"""Rule definitions: the seeded rules, body validation, loading for evaluation."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchhouse.functions import columns as c
from watchhouse.schema import GROUPABLE, RULE_TYPES

# The default rule set (name, description, type, severity, body).
SEEDED_RULES = [
    ("Brute Force Login", "Five or more failed logins from the same source IP within 10 minutes",
     "threshold", "critical",
     '{"filters": {"event_id": ["4625", "ssh_auth_fail"]}, "group_by": "src_ip", "count": 5, "window_seconds": 600}'),
    ("Privilege Escalation", "Privileged logon (Win 4672) outside business hours", "threshold", "high",
     '{"filters": {"event_id": ["4672"], "category": "auth", "action": "privileged_logon"}, "count": 1, '
     '"window_seconds": 86400, "outside_hours": {"start": 6, "end": 20}}'),
    ("Audit Log Cleared", "Windows audit log cleared (1102) or FortiGate audit clear event", "threshold", "critical",
     '{"filters": {"event_id": ["1102", "0100044546"]}, "count": 1, "window_seconds": 86400}'),
    ("New Service Installed", "New Windows service installed (Event ID 7045)", "threshold", "high",
     '{"filters": {"event_id": ["7045"]}, "count": 1, "window_seconds": 86400}'),
    ("Mass Firewall Denies", "More than 100 firewall deny events from same source IP within 5 minutes",
     "threshold", "high",
     '{"filters": {"action": "deny", "source_type": "fortigate"}, "group_by": "src_ip", "count": 100, '
     '"window_seconds": 300}'),
    ("Admin Login After Hours", "Admin-group authentication event between 8pm and 6am local time",
     "threshold", "medium",
     '{"filters": {"category": "auth", "tags": ["admin"]}, "count": 1, "window_seconds": 86400, '
     '"outside_hours": {"start": 6, "end": 20}}'),
    ("Lateral Movement Sequence",
     "Failed login followed by successful login from same source IP within 2 minutes", "sequence", "high",
     '{"steps": [{"event_id": "4625"}, {"event_id": "4624"}], "group_by": "src_ip", "window_seconds": 120}'),
    ("PCI Source Silence", "No events received from any PCI cardholder-environment source within 24 hours",
     "absence", "high", '{"filters": {"tags": ["pci:cardholder_env"]}, "window_seconds": 86400}'),
    ("Known Bad IP", "Any event from an IP in the threat intelligence blocklist", "blacklist", "critical",
     '{"field": "src_ip", "list_name": "threat_intel_blocklist"}'),
    ("Outbound Data Exfil", "Single FortiGate session with more than 500MB of outbound bytes", "threshold", "high",
     '{"filters": {"source_type": "fortigate"}, "aggregate": {"field": "sentbyte", "op": "gt", "value": 524288000}, '
     '"window_seconds": 3600}'),
    ("Multiple Account Lockouts", "Three or more different users locked out (4740) within 30 minutes",
     "threshold", "high", '{"filters": {"event_id": ["4740"]}, "distinct_users": 3, "window_seconds": 1800}'),
    ("SSH Root Login", "Successful SSH login as root on any Linux host", "threshold", "critical",
     '{"filters": {"source_type": "linux", "user_name": "root", "action": "logon"}, "count": 1, '
     '"window_seconds": 86400}'),
]

AGGREGATE_OPS = ("gt", "lt", "gte", "lte", "eq")

# rules planned together in one pass over the events
RULES_PER_PASS = 200


@dataclass(frozen=True)
class Rule:
    """One valid rule with its body, defaults filled in."""

    id: str
    name: str
    rule_type: str
    severity: str
    body: dict = field(default_factory=dict)

    @property
    def filters(self) -> dict:
        return self.body.get("filters") or {}

    @property
    def group_by(self) -> str | None:
        return self.body.get("group_by") or None

    @property
    def window_seconds(self) -> int:
        return int(self.body.get("window_seconds", 3600))


def make_rule(id: str, name: str, rule_type: str, severity: str, body: str | dict) -> Rule:
    return Rule(id, name, rule_type, severity, json.loads(body) if isinstance(body, str) else dict(body))


# --- validation -------------------------------------------------------------------------------


class _Body:
    """Typed access to a JSON body held as a variant."""

    def __init__(self, document: Column):
        self.document = document

    def at(self, path: str) -> Column:
        return F.try_variant_get(self.document, f"$.{path}", "variant")

    def kind(self, path: str) -> Column:
        """JSON type name; VOID for an explicit null, NULL when missing."""
        return F.schema_of_variant(self.at(path))

    def given(self, path: str) -> Column:
        kind = self.kind(path)
        return kind.isNotNull() & (kind != "VOID")

    def text(self, path: str) -> Column:
        return F.try_variant_get(self.document, f"$.{path}", "string")

    def number(self, path: str) -> Column:
        return F.try_variant_get(self.document, f"$.{path}", "double")


def _not_text(b: _Body, path: str) -> Column:
    return b.given(path) & (b.kind(path) != "STRING")


def _bad_integer(b: _Body, path: str, low: int, high: int | None, required: bool, nullable: bool = False) -> Column:
    n = b.number(path)
    in_range = (n >= low) if high is None else n.between(low, high)
    fits = F.coalesce((n == F.floor(n)) & in_range, F.lit(False))
    missing = b.kind(path).isNull()
    null = F.coalesce(b.kind(path) == "VOID", F.lit(False))
    ok = fits if required else (fits | missing)
    return ~(ok | null) if nullable else ~ok


def _bad_text_list(b: _Body, path: str) -> Column:
    kind = b.kind(path)
    return b.given(path) & ~kind.isin("ARRAY<STRING>", "ARRAY<VOID>")


def _bad_filters(b: _Body) -> Column:
    bad = b.kind("filters").isNotNull() & ~b.kind("filters").startswith("OBJECT")
    for name in ("event_id", "tags"):
        bad = bad | _bad_text_list(b, f"filters.{name}")
    for name in ("category", "source_type", "action", "user_name", "log_level"):
        bad = bad | _not_text(b, f"filters.{name}")
    return bad


def _bad_group(b: _Body, path: str, required: bool) -> Column:
    name = b.text(path)
    listed = F.coalesce(name.isin(*GROUPABLE), F.lit(False))
    if required:
        return ~listed
    return ~(listed | ~b.given(path) | F.coalesce(name == "", F.lit(False)))


def rule_problems(rule_type: Column, body: Column) -> Column:
    """Array of reasons why a rule body does not fit its type; empty for a valid rule."""
    b = _Body(F.try_parse_json(body))
    is_type = {t: rule_type == t for t in RULE_TYPES}

    def reason(condition: Column, text: str) -> Column:
        return F.when(condition, F.lit(text))

    steps = F.try_variant_get(b.document, "$.steps", "array<variant>")

    def step_typed(step: Column) -> Column:
        """An object whose known fields are texts or null."""
        ok = F.coalesce(F.schema_of_variant(step).startswith("OBJECT"), F.lit(False))
        for name in ("event_id", "action", "category", "log_level"):
            kind = F.schema_of_variant(F.try_variant_get(step, f"$.{name}", "variant"))
            ok = ok & F.coalesce(kind.isin("STRING", "VOID"), F.lit(True))
        return ok

    def step_ok(step: Column) -> Column:
        present = [c.blank_to_null(F.try_variant_get(step, f"$.{n}", "string")).isNotNull()
                   for n in ("event_id", "action", "category")]
        return present[0] | present[1] | present[2]

    hours_bad = b.given("outside_hours") & (
        _bad_integer(b, "outside_hours.start", 0, 23, True) | _bad_integer(b, "outside_hours.end", 0, 23, True)
    )
    aggregate_bad = b.given("aggregate") & (
        F.coalesce(b.kind("aggregate.field") != "STRING", F.lit(True))
        | b.number("aggregate.value").isNull()
        | (b.kind("aggregate.op").isNotNull() & ~F.coalesce(b.text("aggregate.op").isin(*AGGREGATE_OPS), F.lit(False)))
    )
    std_devs_bad = b.kind("std_devs").isNotNull() & ~F.coalesce(b.number("std_devs") >= 0.5, F.lit(False))
    metric_bad = b.kind("metric").isNotNull() & ~F.coalesce(b.text("metric") == "event_count", F.lit(False))
    filtered = rule_type.isin("threshold", "absence", "anomaly")
    windowed = rule_type.isin("threshold", "sequence", "absence")
    reasons = [
        reason(~rule_type.isin(*RULE_TYPES), "unknown rule type"),
        reason(~F.coalesce(F.schema_of_variant(b.document).startswith("OBJECT"), F.lit(False)), "body is not a JSON object"),
        reason(filtered & _bad_filters(b), "bad filters"),
        reason(windowed & _bad_integer(b, "window_seconds", 1, None, True), "bad window_seconds"),
        reason(is_type["anomaly"] & _bad_integer(b, "window_seconds", 60, None, False), "bad window_seconds"),
        reason(rule_type.isin("threshold", "anomaly") & _bad_group(b, "group_by", False), "bad group_by"),
        reason(is_type["sequence"] & _bad_group(b, "group_by", True), "bad group_by"),
        reason(is_type["threshold"] & _bad_integer(b, "count", 1, None, False), "bad count"),
        reason(is_type["threshold"] & hours_bad, "bad outside_hours"),
        reason(is_type["threshold"] & aggregate_bad, "bad aggregate"),
        reason(is_type["threshold"] & _bad_integer(b, "distinct_users", -(2**31), None, False, True), "bad distinct_users"),
        reason(is_type["sequence"] & ~F.coalesce(F.size(steps) >= 2, F.lit(False)), "fewer than two steps"),
        reason(is_type["sequence"] & ~F.coalesce(F.forall(steps, step_typed), F.lit(False)), "step field is not text"),
        reason(is_type["sequence"] & ~F.coalesce(F.forall(steps, step_ok), F.lit(False)),
               "step without event_id, action or category"),
        reason(is_type["blacklist"] & _bad_group(b, "field", True), "bad field"),
        reason(is_type["blacklist"] & ~F.coalesce(F.length(b.text("list_name")) >= 1, F.lit(False)), "bad list_name"),
        reason(is_type["anomaly"] & metric_bad, "bad metric"),
        reason(is_type["anomaly"] & std_devs_bad, "bad std_devs"),
        reason(is_type["anomaly"] & _bad_integer(b, "baseline_days", 1, 90, False), "bad baseline_days"),
    ]
    return F.array_compact(F.array(*reasons))


def validate_rules(rules: DataFrame) -> DataFrame:
    """Rules with a ``problems`` column; rules with problems are reported, not run."""
    return rules.withColumn("problems", rule_problems(F.col("rule_type"), F.col("body")))


def valid_rules(rules: DataFrame) -> DataFrame:
    return validate_rules(rules).filter(F.size("problems") == 0).drop("problems")


def rule_batches(rules: DataFrame) -> Iterator[list[Rule]]:
    """Valid rules, a bounded number at a time: rule text is plan input, not data."""
    checked = valid_rules(rules).select("id", "name", "rule_type", "severity", "body")
    batch: list[Rule] = []
    for row in checked.toLocalIterator(prefetchPartitions=True):
        batch.append(make_rule(*row))
        if len(batch) == RULES_PER_PASS:
            yield batch
            batch = []
    if batch:
        yield batch
