"""Evaluate all due rules of a rule table."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame

from watchhouse.operators.filters import AGGREGATE_RULES, REAL_TIME_RULES, rules_due
from watchhouse.plans.anomaly import anomaly_triggers
from watchhouse.plans.blacklist import blacklist_triggers
from watchhouse.plans.rule_bodies import Rule, rule_batches
from watchhouse.plans.sequence import sequence_triggers
from watchhouse.plans.threshold import absence_triggers, threshold_triggers
from watchhouse.schema import TRIGGERS


def evaluate(events: DataFrame, blacklists: DataFrame, rules: Sequence[Rule], as_of, compat: bool = False) -> DataFrame:
    """Triggers of the given rules: one pass over the events per rule type."""
    of = {t: [r for r in rules if r.rule_type == t] for t in {r.rule_type for r in rules}}
    parts = []
    if "threshold" in of:
        parts.append(threshold_triggers(events, of["threshold"], as_of, compat))
    if "absence" in of:
        parts.append(absence_triggers(events, of["absence"], as_of))
    if "blacklist" in of:
        parts.append(blacklist_triggers(events, blacklists, of["blacklist"], as_of))
    if "anomaly" in of:
        parts.append(anomaly_triggers(events, of["anomaly"], as_of))
    if "sequence" in of:
        parts.append(sequence_triggers(events, of["sequence"], as_of))
    if not parts:
        return events.sparkSession.createDataFrame([], TRIGGERS)
    return reduce(DataFrame.unionByName, parts)


def run_all(
    events: DataFrame, blacklists: DataFrame, rules: DataFrame, as_of,
    rule_types: Iterable[str] = REAL_TIME_RULES + AGGREGATE_RULES, compat: bool = False,
) -> DataFrame:
    """Triggers of every enabled, valid rule of the table.  Invalid rules are skipped."""
    batches = [evaluate(events, blacklists, batch, as_of, compat)
               for batch in rule_batches(rules_due(rules, rule_types))]
    if not batches:
        return events.sparkSession.createDataFrame([], TRIGGERS)
    return reduce(DataFrame.unionByName, batches)
