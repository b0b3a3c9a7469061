"""Alerts as keyed state: one stream of triggers and patches in, one stream of alert changes out.

The open alert of a (rule, group) is state.  A trigger updates it or opens one, a patch changes it, and every change is one appended
row with the alert's columns and its ``version``; history is never rewritten.  ``operators.alerts.latest_alerts`` gives the table that
the changes amount to.  Times come from the rows, not from a clock, so a batch that is run again gives the same changes.  As in the batch
form, a closed or acknowledged alert meets no trigger: the next one opens a new alert.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from watchhouse.schema import ALERT_STATUSES, ALERTS

_TEXTS = ("id", "status", "severity", "title", "description", "src_ip", "source_host", "assigned_to", "extra")
_STATE = ", ".join([*(f"{n} string" for n in _TEXTS), "first bigint, last bigint, created bigint, updated bigint, n bigint, version bigint"])
_OUT = "rule_id string, group_key string, " + _STATE
_RANKED = ["description", "title", "severity"]  # of triggers of one time the greatest is the latest


def _text(value):
    """None for what pandas calls missing."""
    return None if value is None or value != value else value


_NAMES = [part.split()[0] for part in _STATE.split(", ")]


def trigger_rows(triggers: DataFrame) -> DataFrame:
    """Triggers in the form ``alert_changes`` reads."""
    return triggers.select(
        F.lit("trigger").alias("kind"), "rule_id", F.coalesce("group_key", F.lit("")).alias("group_key"), F.unix_micros("last_seen").alias("seq"),
        F.unix_micros("first_seen").alias("first"), F.col("event_count").alias("n"), "severity", "title", "description", "src_ip", "source_host",
        F.to_json("extra").alias("extra"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("status"),
        F.lit(None).cast("string").alias("assigned_to"))


def patch_rows(patches: DataFrame) -> DataFrame:
    """Patches (alert_id, rule_id, group_key, at, status, assigned_to); those with an unknown status are left out as a whole."""
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    good = patches.where(F.col("status").isNull() | F.col("status").isin(*ALERT_STATUSES))
    return good.select(
        F.lit("patch").alias("kind"), "rule_id", F.coalesce("group_key", F.lit("")).alias("group_key"), F.unix_micros("at").alias("seq"),
        *none("bigint", "first", "n"), *none("string", "severity", "title", "description", "src_ip", "source_host", "extra"),
        F.col("alert_id").alias("id"), "status", "assigned_to")


class _AlertState(StatefulProcessor):
    """The triggers of a micro-batch count as one, then its patches follow in the order of their time."""

    def __init__(self, accumulate: bool):
        self.accumulate = accumulate

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        total, first, latest, patches = 0, None, None, []
        for part in rows:
            patches += [r for r in part[part["kind"] == "patch"].to_dict("records")]
            fired = part[part["kind"] == "trigger"]
            if len(fired):
                total += int(fired["n"].sum())
                first = int(fired["first"].min()) if first is None else min(first, int(fired["first"].min()))
                newest = fired.sort_values(["seq", *_RANKED], na_position="first").iloc[-1].to_dict()
                if latest is None or self._rank(newest) > self._rank(latest):
                    latest = newest
        saved = self.open.get()
        alert = dict(zip(_NAMES, saved)) if saved else None
        changes = []

        def change(values: dict) -> None:
            alert.update(values)
            alert["version"] += 1
            changes.append((*key, *(alert[n] for n in _NAMES)))

        if latest is not None:
            seq = int(latest["seq"])
            if alert is None:
                mark = hashlib.sha256("|".join((*key, str(seq))).encode()).hexdigest()
                alert = {n: _text(latest.get(n)) for n in _NAMES} | {
                    "id": mark, "status": "open", "assigned_to": None, "first": first, "created": seq, "n": 0, "version": 0}
            extra = _text(latest["extra"])
            change({"n": (alert["n"] if self.accumulate else 0) + total, "last": seq, "updated": seq, "description": _text(latest["description"]),
                    "extra": alert["extra"] if extra in (None, "{}") else extra})
        for patch in sorted(patches, key=lambda r: (r["seq"], str(r["status"]), str(r["assigned_to"]))):
            if alert is not None and alert["id"] == patch["id"]:
                change({"status": _text(patch["status"]) or alert["status"], "assigned_to": _text(patch["assigned_to"]) or alert["assigned_to"], "updated": int(patch["seq"])})
                if alert["status"] != "open":  # no trigger meets it any more
                    alert = None
        if alert is None:
            self.open.clear()
        else:
            self.open.update(tuple(alert[n] for n in _NAMES))
        yield pd.DataFrame(changes, columns=["rule_id", "group_key", *_NAMES])

    @staticmethod
    def _rank(row: dict) -> tuple:
        return (int(row["seq"]), *(_text(row[n]) or "" for n in _RANKED))

    def close(self) -> None:
        pass


def alert_changes(rows: DataFrame, mode: str = "accumulate") -> DataFrame:
    """ALERTS columns and ``version`` of every change, from a stream of ``trigger_rows`` and ``patch_rows`` (united).

    ``mode="accumulate"`` adds the trigger counts, ``"replace"`` takes those of the newest micro-batch.  Triggers without a group key form
    a group of their own rule.  Needs the RocksDB state store.
    """
    found = rows.groupBy("rule_id", "group_key").transformWithStateInPandas(_AlertState(mode == "accumulate"), _OUT, "append", "none")
    moment = lambda name: F.timestamp_micros(name)
    values: dict[str, Column] = {
        "first_seen": moment("first"), "last_seen": moment("last"), "created_at": moment("created"), "updated_at": moment("updated"), "event_count": F.col("n"),
        "extra": F.from_json("extra", "map<string,string>"), "group_key": F.nullif(F.col("group_key"), F.lit(""))}
    return found.select(*[values.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in ALERTS.fields], "version")
