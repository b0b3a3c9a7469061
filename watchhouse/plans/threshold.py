"""Threshold and absence rules: many rules, one pass over the events."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchhouse.functions import columns as c
from watchhouse.operators import filters
from watchhouse.plans.rule_bodies import Rule
from watchhouse.plans.triggers import as_triggers, shown
from watchhouse.schema import TRIGGERS

_NUMBER = "decimal(38,6)"

_PARAMS = T.StructType([
    T.StructField("rule_no", T.IntegerType()), T.StructField("rule_id", T.StringType()),
    T.StructField("name", T.StringType()), T.StructField("severity", T.StringType()),
    T.StructField("group_column", T.StringType()), T.StructField("window_seconds", T.LongType()),
    T.StructField("minimum", T.LongType()), T.StructField("op", T.StringType()),
    T.StructField("bound", T.DoubleType()), T.StructField("hours_start", T.IntegerType()),
    T.StructField("hours_end", T.IntegerType()),
])


def _params(rules: Sequence[Rule], compat: bool) -> list[tuple]:
    rows = []
    for no, rule in enumerate(rules):
        body, mode = rule.body, _mode(rule, compat)
        hours, aggregate = body.get("outside_hours") or {}, body.get("aggregate") or {}
        rows.append((
            no, rule.id, rule.name, rule.severity, rule.group_by, rule.window_seconds,
            int(body["distinct_users"] if mode == "distinct" else body.get("count", 1)),
            aggregate.get("op", "gt") if mode == "aggregate" else None,
            float(aggregate["value"]) if mode == "aggregate" else None,
            hours.get("start"), hours.get("end"),
        ))
    return rows


def _mode(rule: Rule, compat: bool) -> str:
    """count | distinct | aggregate; with ``compat`` rules without grouping always count rows."""
    if compat and not rule.group_by:
        return "count"
    if rule.body.get("distinct_users"):
        return "distinct"
    return "aggregate" if rule.body.get("aggregate") else "count"


def _extra_number(name: str) -> Column:
    return F.try_element_at(F.col("extra"), F.lit(name)).try_cast(_NUMBER)


def _matches(rules: Sequence[Rule], compat: bool, within: Callable[[Rule], Column]) -> Column:
    """Array of (rule_no, group, number) for every rule the row satisfies; ``within`` is the rule's time condition."""
    hits = []
    for no, rule in enumerate(rules):
        wanted = within(rule) & filters.event_filter(rule.filters)
        number = F.lit(None).cast(_NUMBER)
        if _mode(rule, compat) == "aggregate":
            field = rule.body["aggregate"]["field"]
            wanted = wanted & F.try_element_at(F.col("extra"), F.lit(field)).isNotNull()
            number = _extra_number(field)
        group = F.col(rule.group_by) if rule.group_by else F.lit(None)
        hit = F.struct(F.lit(no).alias("rule_no"), group.cast("string").alias("grp"), number.alias("number"))
        hits.append(F.when(wanted, hit))
    return F.array_compact(F.array(*hits))


def threshold_matches(events: DataFrame, rules: Sequence[Rule], as_of, compat: bool, *carry: str) -> DataFrame:
    """(carried columns, rule_no, grp, number): a row for every rule that an event satisfies."""
    widest = max(rule.window_seconds for rule in rules)
    scanned = events.filter(filters.in_window(as_of, widest))
    return scanned.select(*carry, F.inline(_matches(rules, compat, lambda rule: filters.in_window(as_of, rule.window_seconds))))


def threshold_triggers(events: DataFrame, rules: Sequence[Rule], as_of, compat: bool = False) -> DataFrame:
    """Triggers of all given threshold rules.

    Each row is expanded to the rules it satisfies and counted per (rule, group) with map-side
    partial aggregation, so hot groups never travel as rows.  Counting distinct users needs a second
    level of grouping, so those rules form a second, equally shaped pass.
    """
    plain = [r for r in rules if _mode(r, compat) != "distinct"]
    distinct = [r for r in rules if _mode(r, compat) == "distinct"]
    parts = []
    if plain:
        counted = threshold_matches(events, plain, as_of, compat, "received_at").groupBy("rule_no", "grp").agg(
            F.count(F.lit(1)).alias("event_count"), F.min("received_at").alias("first_seen"),
            F.max("received_at").alias("last_seen"), F.max("number").alias("number"),
        )
        parts.append(_decide(counted, plain, compat))
    if distinct:
        rows = threshold_matches(events, distinct, as_of, compat, "received_at", "user_name")
        counted = rows.groupBy("rule_no", "grp").agg(
            F.count_distinct("user_name").alias("event_count"), F.min("received_at").alias("first_seen"),
            F.max("received_at").alias("last_seen"),
        ).withColumn("number", F.lit(None).cast(_NUMBER))
        parts.append(_decide(counted, distinct, compat))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _decide(counted: DataFrame, rules: Sequence[Rule], compat: bool) -> DataFrame:
    """Keep groups that reach their rule's bound and turn them into triggers."""
    params = counted.sparkSession.createDataFrame(_params(rules, compat), _PARAMS)
    df = counted.join(params, "rule_no")
    number, bound, op = F.col("number").cast("double"), F.col("bound"), F.col("op")
    reached = (
        F.when(op.isNull(), F.col("event_count") >= F.col("minimum"))
        .when(op == "gt", number > bound).when(op == "lt", number < bound)
        .when(op == "gte", number >= bound).when(op == "lte", number <= bound)
        .otherwise(number == bound)
    )
    allowed = F.col("hours_start").isNull() | filters.outside_hours(
        F.col("last_seen"), F.col("hours_start"), F.col("hours_end")
    )
    description = F.concat(
        F.lit("Triggered "), F.col("event_count").cast("string"), F.lit(" event(s) within "),
        F.col("window_seconds").cast("string"), F.lit("s"),
    )
    return as_triggers(
        df.filter(reached & allowed), rule_id=F.col("rule_id"), severity=F.col("severity"), name=F.col("name"),
        group_column=F.col("group_column"),
        group=F.when(F.col("group_column").isNotNull(), shown(F.col("grp"))), description=description,
    )


def threshold_rule(events: DataFrame, rule: Rule, as_of, compat: bool = False) -> DataFrame:
    return threshold_triggers(events, [rule], as_of, compat)


# --- panes: partial results that a stream keeps ------------------------------------------------------

PANE_SECONDS = 30
SKETCH_BITS = 12  # 4 096 registers: a standard error of 1.6 %, one user in some dozens


def _of_rule(values: list) -> Column:
    """The value of the row's rule."""
    return F.get(F.array(*[F.lit(v) for v in values]), F.col("rule_no"))


def _with_member(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``member``: the user, for rules that count users."""
    return rows.withColumn("member", F.when(_of_rule([_mode(r, False) == "distinct" for r in rules]), F.col("user_name")))


def _partial() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.min("received_at").alias("first_seen"), F.max("received_at").alias("last_seen"),
            F.max("number").alias("number")]


def _sketch(wanted: bool) -> list[Column]:
    return [F.hll_sketch_agg("member", SKETCH_BITS).alias("users")] if wanted else []


def threshold_panes(events: DataFrame, rules: Sequence[Rule], delay: str = "1 minute", pane: int = PANE_SECONDS,
                    sketches: bool = False) -> DataFrame:
    """Partial results of all given threshold rules per pane of ``pane`` seconds: one stream for any number of rules.

    One row per (rule, group, pane), and per user for rules that count users.  A row of the input is counted once, whatever the
    window; ``threshold_tick`` combines panes.  On a stream a pane is final once the watermark has passed it; rows that
    come later than ``delay`` after it are dropped.  With ``sketches`` a pane holds a sketch of its users instead of a row for
    each: panes no longer grow with users, and their number is an estimate (see SKETCH_BITS).
    """
    rows = events.withWatermark("received_at", delay) if events.isStreaming else events
    matched = _with_member(rows.select("received_at", "user_name", F.inline(_matches(rules, False, lambda rule: F.lit(True)))), rules)
    counted = matched.withColumn("rule_id", _of_rule([r.id for r in rules])).groupBy(
        F.window("received_at", f"{pane} seconds").alias("w"), "rule_id", "grp", *([] if sketches else ["member"])).agg(*_partial(), *_sketch(sketches))
    return counted.select(F.col("w.start").alias("pane"), "rule_id", "grp", "users" if sketches else "member", "n", "first_seen", "last_seen", "number")


def threshold_tick(panes: DataFrame, events: DataFrame, rules: Sequence[Rule], as_of, pane: int = PANE_SECONDS,
                   sketches: bool = False) -> DataFrame:
    """Triggers of the look-backs ``[as_of - window, as_of)``, from whole panes and the events of panes that an end cuts.

    ``as_of`` must not lie after the watermark of the stream that keeps the panes; ``sketches`` as in ``threshold_panes``.
    """
    end = F.unix_micros(c.as_timestamp(as_of))
    width = F.lit(pane * 1_000_000)
    last_whole = F.timestamp_micros(end - F.pmod(end, width))

    def start(seconds: Column) -> Column:
        return end - seconds.cast("bigint") * 1_000_000

    def first_whole(seconds: Column) -> Column:
        return F.timestamp_micros(start(seconds) + F.pmod(-start(seconds), width))

    def cut(rule: Rule) -> Column:
        at, seconds = F.col("received_at"), F.lit(rule.window_seconds)
        return (at >= F.timestamp_micros(start(seconds))) & (at < c.as_timestamp(as_of)) & ((at < first_whole(seconds)) | (at >= last_whole))

    params = events.sparkSession.createDataFrame([(no, r.id, r.window_seconds) for no, r in enumerate(rules)], "rule_no int, rule_id string, seconds long")
    widest = F.lit(max(r.window_seconds for r in rules))
    recent = panes.filter(F.col("pane").between(F.timestamp_micros(start(widest)), c.as_timestamp(as_of)))
    whole = recent.join(params, "rule_id").filter(
        (F.col("pane") >= first_whole(F.col("seconds"))) & (F.unix_micros("pane") + width <= F.unix_micros(last_whole)))
    of_users = "users" if sketches else "member"
    names = ["rule_no", "grp", of_users, "n", "first_seen", "last_seen", "number"]
    ends = events.filter(reduce(or_, [cut(r) for r in rules])).select("received_at", "user_name", F.inline(_matches(rules, False, cut)))
    partial = _with_member(ends, rules).groupBy("rule_no", "grp", *([] if sketches else ["member"])).agg(*_partial(), *_sketch(sketches))
    members = whole.select(*names).unionByName(partial.select(*names))
    if not sketches:  # members first, so that counting them needs no set per group
        members = members.groupBy("rule_no", "grp", "member").agg(
            F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max("number").alias("number"))
    found = F.hll_sketch_estimate(F.hll_union_agg("users")) if sketches else F.count("member")
    counted = members.groupBy("rule_no", "grp").agg(
        F.sum("n").alias("_rows"), found.alias("_members"), F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"), F.max("number").alias("number"))
    users = _of_rule([_mode(r, False) == "distinct" for r in rules])
    return _decide(counted.withColumn("event_count", F.when(users, F.col("_members")).otherwise(F.col("_rows"))), rules, False)


# --- absence ---------------------------------------------------------------------------------------------


def absence_triggers(events: DataFrame, rules: Sequence[Rule], as_of) -> DataFrame:
    """One trigger, dated ``as_of``, for every rule no event satisfies."""
    params = events.sparkSession.createDataFrame(_params(rules, True), _PARAMS)
    seen = threshold_matches(events, rules, as_of, True).groupBy("rule_no").agg(F.count(F.lit(1)).alias("n"))
    return _absent(params.join(seen, "rule_no", "left_anti").withColumn("as_of", c.as_timestamp(as_of)))


def absence_ticks(events: DataFrame, rules: Sequence[Rule], ticks: DataFrame) -> DataFrame:
    """One trigger per tick of ``ticks(as_of)`` and rule that no event in ``[as_of - window, as_of]`` satisfies.

    Events are reduced to their first and last instant per rule and block of window length.  A look-back meets two blocks: the
    older one counts by its last instant, the other by its first, so ticks and blocks meet in an equality join.
    """
    low, high = ticks.agg(F.min("as_of").cast("string"), F.max("as_of").cast("string")).first()
    if low is None:
        return events.sparkSession.createDataFrame([], TRIGGERS)
    spans = [r.window_seconds * 1_000_000 for r in rules]

    def block(us: Column, span: Column) -> Column:
        return us - F.pmod(us, span)

    at = F.col("received_at")
    rows = events.filter((at >= c.seconds_before(low, max(r.window_seconds for r in rules))) & (at <= c.as_timestamp(high)))
    matched = rows.select(F.unix_micros("received_at").alias("us"), F.inline(_matches(rules, True, lambda rule: F.lit(True))))
    seen = matched.groupBy("rule_no", block(F.col("us"), _of_rule(spans)).alias("block")).agg(F.min("us").alias("low"), F.max("us").alias("high"))
    asked = ticks.filter("as_of IS NOT NULL").select("as_of").distinct().select(
        "as_of", F.inline(F.array(*[F.struct(F.lit(no).alias("rule_no"), F.lit(span).alias("span")) for no, span in enumerate(spans)])))
    us = F.unix_micros("as_of")
    looked = asked.withColumn("block", F.explode(F.array(block(us, F.col("span")), block(us, F.col("span")) - F.col("span"))))
    met = (F.col("high") >= us - F.col("span")) & (F.col("low") <= us)
    silent = looked.join(seen, ["rule_no", "block"], "left").groupBy("as_of", "rule_no").agg(
        F.bool_or(F.coalesce(met, F.lit(False))).alias("met")).filter("NOT met")
    return _absent(silent.join(events.sparkSession.createDataFrame(_params(rules, True), _PARAMS), "rule_no"))


def _absent(silent: DataFrame) -> DataFrame:
    """Triggers of rules that are silent at ``as_of``."""
    silent = silent.withColumns({"first_seen": F.col("as_of"), "last_seen": F.col("as_of"), "event_count": F.lit(0).cast("bigint")})
    return as_triggers(
        silent, rule_id=F.col("rule_id"), severity=F.col("severity"), name=F.col("name"), group_column=None,
        group=None, key=F.concat(F.col("rule_id"), F.lit(":absent")),
        description=F.concat(F.lit("No matching events in the last "), F.col("window_seconds").cast("string"), F.lit("s")),
    )


def absence_rule(events: DataFrame, rule: Rule, as_of) -> DataFrame:
    return absence_triggers(events, [rule], as_of)
