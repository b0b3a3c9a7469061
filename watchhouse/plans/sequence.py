"""Sequence rules: step 0 followed by step 1, 2, ... for the same group value, all rules in one pass.

A chain is identified by its first and last time stamp.  Listing all (first, last) pairs is quadratic
in the size of a group, so the pairs are counted instead: every start knows how many distinct
completions it reaches.  From a start the nearest next step is always the best one, so a start goes
from state to state: waiting for step 1, then for step 2, ..., then counting last steps.

The time line of a (rule, group) is cut into slices of a bounded number of rows.  A slice is a function of the
state it is entered in: the state it is left in, and how many last steps are counted on the way,
the nearest and the farthest.  These summaries compose, so slices are scanned in parallel and only one small row
a slice is gone through in order.  The plan has the same size for any number of rules and steps, and the
events are read once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchhouse.operators import filters
from watchhouse.plans.rule_bodies import Rule
from watchhouse.plans.triggers import as_triggers, shown
from watchhouse.session import cut_lineage

SLICE_ROWS = 4096
MOST_STEPS = 62

_NONE = np.iinfo(np.int64).min  # no time


def _step_rows(events: DataFrame, rules: Sequence[Rule], as_of, per: str) -> DataFrame:
    """(rule_no, grp, at, steps): rows that match a step of a rule; bit k of ``steps`` says step k matches.

    Chains are followed in the order of ``at``.  To report completions, time runs backwards and the steps are numbered from the last.
    """
    hits = []
    for no, rule in enumerate(rules):
        steps = rule.body["steps"]
        if len(steps) > MOST_STEPS:
            raise ValueError(f"rule {rule.id}: more than {MOST_STEPS} steps")
        matches = [filters.step_filter(step) for step in (steps if per == "start" else steps[::-1])]
        bits = reduce(add, [F.when(m, F.lit(1 << k).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for k, m in enumerate(matches)])
        group = F.col(rule.group_by).cast("string")
        wanted = filters.in_window(as_of, rule.window_seconds) & reduce(or_, matches) & group.isNotNull()
        hits.append(F.when(wanted, F.struct(F.lit(no).alias("rule_no"), group.alias("grp"), bits.alias("steps"))))
    micros = F.unix_micros("received_at")
    recent = events.filter(filters.in_window(as_of, max(r.window_seconds for r in rules)))
    return recent.select((micros if per == "start" else -micros).alias("at"), F.inline(F.array_compact(F.array(*hits))))


class _Slices:
    """Rows of many slices at once: index arithmetic on one array, no loop over rows or slices."""

    def __init__(self, bits: np.ndarray, steps: np.ndarray, ends: np.ndarray):
        """Step bits of every row, number of steps of its rule, and where its slice ends."""
        self.bits, self.ends, n = bits, ends, len(bits)
        self.most = int(steps.max(initial=2))
        place = np.arange(n)
        # next[j][i]: the first row from i on that matches step j
        self.next = {}
        for j in range(1, self.most - 1):
            here = np.where((bits >> j) & 1 == 1, place, n)
            self.next[j] = np.append(np.minimum.accumulate(here[::-1])[::-1], n)
        last = (bits >> (steps - 1)) & 1 == 1
        self.seen = np.concatenate([[0], np.cumsum(last)])
        self.following = np.append(np.minimum.accumulate(np.where(last, place, n)[::-1])[::-1], n)
        self.former = np.maximum.accumulate(np.where(last, place, -1)) if n else place

    def run(self, at: np.ndarray, state: np.ndarray, ends: np.ndarray, steps: np.ndarray, times: np.ndarray):
        """From rows ``at`` on in a state: the state at the slice's end, last steps counted, the nearest and the farthest."""
        at, state = at.copy(), state.copy()
        for j in range(1, self.most - 1):
            waiting = np.flatnonzero((state == j) & (j < steps - 1))
            found = self.next[j][at[waiting]]
            ok = found < ends[waiting]
            at[waiting[ok]], state[waiting[ok]] = found[ok] + 1, j + 1
        counting = state == steps - 1
        n = np.where(counting, self.seen[ends] - self.seen[np.minimum(at, ends)], 0)
        some = np.flatnonzero(n > 0)
        nearest, farthest = np.full(len(at), _NONE), np.full(len(at), _NONE)
        nearest[some], farthest[some] = times[self.following[at[some]]], times[self.former[ends[some] - 1]]
        return state, n, nearest, farthest


_SLICE = ("rule_no int, grp string, slice long, state array<int>, n array<long>, nearest array<long>, farthest array<long>, "
          "starts array<struct<at: long, state: int, n: long, nearest: long, farthest: long>>")


def _lists(cut: np.ndarray, values: np.ndarray, kind: pa.DataType, nulls: bool = False) -> pa.Array:
    flat = pa.array(values, kind, mask=values == _NONE) if nulls else pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array(cut, pa.int32()), flat)


def _scan(steps_of: list[int], slice_rows: int):
    """Rows sorted by (rule_no, grp, at) -> one row per slice: its summary by entry state, and its starts."""
    known = np.array(steps_of, np.int64)

    def settle(rule, grp, at, bits, new_group, number, part):
        """Slices of whole rows; ``new_group`` marks the first row of a (rule, group)."""
        first = np.concatenate([[True], new_group[1:] | (at[1:] != at[:-1])])
        begin = np.flatnonzero(first)
        bits = np.bitwise_or.reduceat(bits, begin)  # one row per instant
        rule, at, grp, new_group = rule[begin], at[begin], grp.take(pa.array(begin)), new_group[begin]
        n = len(begin)
        place = np.arange(n)
        since = place - np.maximum.accumulate(np.where(new_group, place, 0))
        starts_slice = np.flatnonzero(since % slice_rows == 0)
        sizes = np.diff(np.append(starts_slice, n))
        ends = np.repeat(starts_slice + sizes, sizes)
        steps = known[rule]
        slices = _Slices(bits, steps, ends)
        # every state a slice can be entered in
        k = steps[starts_slice]
        which = np.repeat(np.arange(len(starts_slice)), k - 1)
        entered = np.arange(len(which)) - np.repeat(np.cumsum(k - 1) - (k - 1), k - 1) + 1
        state, count, near, far = slices.run(starts_slice[which], entered, ends[starts_slice[which]], k[which], at)
        cut = np.concatenate([[0], np.cumsum(k - 1)])
        opened = np.flatnonzero(bits & 1)
        of = slices.run(opened + 1, np.ones(len(opened), np.int64), ends[opened], steps[opened], at)
        cut_starts = np.searchsorted(opened, np.append(starts_slice, n))
        struct = pa.StructArray.from_arrays(
            [pa.array(at[opened], pa.int64()), pa.array(of[0], pa.int32()), pa.array(of[1], pa.int64()),
             pa.array(of[2], pa.int64(), mask=of[2] == _NONE), pa.array(of[3], pa.int64(), mask=of[3] == _NONE)], ["at", "state", "n", "nearest", "farthest"])
        numbers = (part << 33) + number + np.arange(len(starts_slice))
        return pa.RecordBatch.from_arrays(
            [pa.array(rule[starts_slice], pa.int32()), grp.take(pa.array(starts_slice)), pa.array(numbers, pa.int64()),
             _lists(cut, state, pa.int32()), _lists(cut, count, pa.int64()), _lists(cut, near, pa.int64(), True), _lists(cut, far, pa.int64(), True),
             pa.ListArray.from_arrays(pa.array(cut_starts, pa.int32()), struct)],
            ["rule_no", "grp", "slice", "state", "n", "nearest", "farthest", "starts"])

    def run(batches):
        part, number, held = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [*held, batch])
            if not len(table):
                continue
            rule, at, bits = (table.column(c).to_numpy() for c in ("rule_no", "at", "steps"))
            grp = table.column("grp").combine_chunks()
            grp = grp.combine_chunks() if isinstance(grp, pa.ChunkedArray) else grp
            changed = pc.not_equal(grp.slice(1), grp.slice(0, len(grp) - 1)).to_numpy(zero_copy_only=False) | (rule[1:] != rule[:-1])
            new_group = np.concatenate([[True], changed])
            # whole slices of the last group can go, the rest waits for what follows
            last = int(np.flatnonzero(new_group)[-1])
            instants = np.flatnonzero(np.concatenate([[True], at[last + 1:] != at[last:-1]])) + last
            whole = (len(instants) - 1) // slice_rows * slice_rows
            cut = int(instants[whole])
            if cut:
                out = settle(rule[:cut], grp.slice(0, cut), at[:cut], bits[:cut], new_group[:cut], number, part)
                number += len(out)
                yield out
            held = table.slice(cut).to_batches()
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            rule, at, bits = (table.column(c).to_numpy() for c in ("rule_no", "at", "steps"))
            grp = pa.concat_arrays(table.column("grp").chunks)
            yield settle(rule, grp, at, bits, np.arange(len(rule)) == 0, number, part)

    return run


_CARRIED = "slice long, later struct<state: array<int>, n: array<long>, nearest: array<long>, farthest: array<long>>"


def _carry(batches):
    """Slices sorted by (rule_no, grp, slice descending) -> the composition of all later slices of the group, by entry state."""
    key, later = None, None
    for batch in batches:
        out = {"slice": [], "later": []}
        columns = [batch.column(c).to_pylist() for c in ("rule_no", "grp", "slice", "state", "n", "nearest", "farthest")]
        for rule, grp, number, state, n, nearest, farthest in zip(*columns):
            if (rule, grp) != key:
                key = (rule, grp)
                later = {"state": list(range(1, len(state) + 1)), "n": [0] * len(state), "nearest": [None] * len(state), "farthest": [None] * len(state)}
            out["slice"].append(number)
            out["later"].append(later)
            # first this slice, then the later ones in the state it leaves
            after = [s - 1 for s in state]
            later = {
                "state": [later["state"][s] for s in after], "n": [x + later["n"][s] for x, s in zip(n, after)],
                "nearest": [later["nearest"][s] if x is None else x for x, s in zip(nearest, after)],
                "farthest": [x if later["farthest"][s] is None else later["farthest"][s] for x, s in zip(farthest, after)]}
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("slice", pa.int64()), ("later", pa.struct(
            [("state", pa.list_(pa.int32())), ("n", longs), ("nearest", longs), ("farthest", longs)]))]))


def all_chains(events: DataFrame, rules: Sequence[Rule], as_of, per: str = "start", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(rule_no, grp, ts, n, nearest, farthest): the chain starts (or completions) of all rules with the other ends they connect to.

    ``per="start"``: ``ts`` is a start; ``n`` distinct completions, ``nearest`` the first of them,
    ``farthest`` the last.  ``per="completion"``: ``ts`` is a completion; ``n`` distinct starts,
    ``nearest`` the latest of them, ``farthest`` the earliest.
    """
    # written once: ordering looks at the keys before it moves the rows
    rows = cut_lineage(_step_rows(events, rules, as_of, per), "sequence-steps")
    order = ["rule_no", "grp", "at"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.select(*order, "steps").repartitionByRange(n, *order).sortWithinPartitions(*order)
    slices = cut_lineage(ordered.mapInArrow(_scan([len(r.body["steps"]) for r in rules], slice_rows), _SLICE), "sequence-slices")
    summaries = slices.drop("starts").repartition("rule_no", "grp").sortWithinPartitions("rule_no", "grp", F.col("slice").desc())
    carried = summaries.mapInArrow(_carry, _CARRIED)
    starts = slices.where("size(starts) > 0").select("slice", "rule_no", "grp", "starts").join(carried, "slice").select(
        "rule_no", "grp", "later", F.inline("starts"))
    later = lambda name: F.get(F.col("later")[name], F.col("state") - 1)
    moment = lambda micros: F.timestamp_micros(micros if per == "start" else -micros)
    found = starts.select(
        "rule_no", "grp", moment(F.col("at")).alias("ts"), (F.col("n") + later("n")).alias("n"),
        moment(F.coalesce("nearest", later("nearest"))).alias("nearest"), moment(F.coalesce(later("farthest"), "farthest")).alias("farthest"))
    return found.where("n > 0")


def chains(events: DataFrame, rule: Rule, as_of, per: str = "start", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``all_chains`` of one rule."""
    return all_chains(events, [rule], as_of, per, slice_rows).drop("rule_no")


_PARAMS = T.StructType([
    T.StructField("rule_no", T.IntegerType()), T.StructField("rule_id", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("severity", T.StringType()), T.StructField("group_column", T.StringType()),
    T.StructField("window_seconds", T.LongType()), T.StructField("steps", T.LongType()),
])


def sequence_triggers(events: DataFrame, rules: Sequence[Rule], as_of, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Triggers of all given sequence rules: one per rule and group, for all of its chains at once.

    ``event_count`` is steps x chains, which is what the alert of that group accumulates when each
    chain is reported separately; ``extra.chains`` holds the number of chains.
    """
    params = events.sparkSession.createDataFrame(
        [(no, r.id, r.name, r.severity, r.group_by, r.window_seconds, len(r.body["steps"])) for no, r in enumerate(rules)], _PARAMS)
    grouped = all_chains(events, rules, as_of, "start", slice_rows).groupBy("rule_no", "grp").agg(
        F.sum("n").alias("chains"), F.min("ts").alias("first_seen"), F.max("farthest").alias("last_seen"),
    ).join(params, "rule_no").withColumn("event_count", F.col("chains") * F.col("steps"))
    text = lambda name: F.col(name).cast("string")
    return as_triggers(
        grouped, rule_id=F.col("rule_id"), severity=F.col("severity"), name=F.col("name"), group_column=F.col("group_column"),
        group=shown(F.col("grp")),
        description=F.concat(text("steps"), F.lit("-step sequence completed within "), text("window_seconds"), F.lit("s")),
        extra=F.create_map(F.lit("chains"), text("chains")),
    )


def sequence_rule(events: DataFrame, rule: Rule, as_of, slice_rows: int = SLICE_ROWS) -> DataFrame:
    return sequence_triggers(events, [rule], as_of, slice_rows)
