"""Hard negatives and near-equal vectors against brute force in numpy."""

import numpy as np
import pytest

from watchhouse.llm import grid_join, zone_negatives
from watchhouse.llm.grid_join import near_duplicates
from watchhouse.llm.zone_negatives import mine

SCHEMA = "vec_id long, label int, embedding array<float>, q string, mark string, block string"


def _frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], schema).repartition(5)


def _fits(vector):
    return vector is not None and len(vector) > 0 and all(x is not None and np.isfinite(x) for x in vector)


def _mined(rows, positives=5, negatives=3):
    use = sorted({(i, label, tuple(np.floor(256 * np.array(v, np.float32).astype(float)).astype(int))) for i, label, v in rows if i is not None and label is not None and _fits(v)})
    out = []
    for i, label, v in use:
        if i % 5:
            continue
        scored = [(-int(np.dot(v, w)), j, other) for j, other, w in use if j != i and len(w) == len(v)]
        for p, j, _ in sorted(s for s in scored if s[2] == label)[:positives]:
            near = sorted(s for s in scored if s[2] != label and 50 * -p <= 100 * -s[0] <= 95 * -p)[:negatives]
            out += [(i, j, rank + 1, k, -p, -s) for rank, (s, k, _) in enumerate(near)]
    return sorted(out)


def _vectors(seed, n, width=6, labels=3):
    """Clusters of near copies, exact copies and loners."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, width))
    rows = []
    for i in range(n):
        kind = rng.random()
        v = centres[rng.integers(8)] if kind < 0.2 else centres[0] + rng.normal(size=width) * 0.15 if kind < 0.5 else rng.normal(size=width)
        rows.append((i, int(rng.integers(labels)) if kind > 0.3 else 0, [float(x) for x in np.float32(v)]))
    return rows


STRANGE = [(900, None, [1.0] * 6), (901, 1, None), (902, 1, []), (903, 1, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (904, 1, [float("nan")] * 6), (905, 1, [float("inf")] * 6),
           (None, 1, [1.0] * 6), (907, 1, [0.0] * 6), (908, 1, [-0.0] * 6), (910, 1, [1.0, 2.0]), (915, 1, [1.0, 2.0]), (920, 2, [1.0, 2.0]), (925, 0, [0.6, 1.3]),
           (3, 0, [1.0] * 6), (3, 0, [1.0] * 6), (3, 1, [2.0] * 6)]


def test_mined_negatives(spark, monkeypatch):
    for name, value in (("BLOCK", 8), ("PACK", 4), ("ZONES", 5), ("PACKS", 2), ("GROUP", 3), ("FIRST", 1)):
        monkeypatch.setattr(zone_negatives, name, value)
    rows = _vectors(1, 180) + STRANGE
    got = mine(_frame(spark, rows), zone_negatives.F.col("vec_id") % 5 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in got.collect()) == _mined(rows)


@pytest.mark.parametrize("rows", [[], [(0, None, [1.0])], [(0, 1, [1.0, 1.0])], [(0, 1, [1.0]), (5, 1, [1.0]), (7, 1, [2.0])]])
def test_nothing_to_mine(spark, rows):
    assert mine(_frame(spark, rows), zone_negatives.F.col("vec_id") % 5 == 0).collect() == []


def test_bounds_leave_blocks_unread(spark, monkeypatch):
    """With labels far apart the zone maps keep most blocks from being read."""
    for name, value in (("BLOCK", 16), ("GROUP", 1000)):
        monkeypatch.setattr(zone_negatives, name, value)
    rng = np.random.default_rng(2)
    rows = [(i, i % 8, (np.eye(8)[i % 8] * 3 + rng.normal(size=8) * 0.05).tolist()) for i in range(800)]
    read = []
    choose = zone_negatives._choose

    def counting(*args):
        chosen = choose(*args)
        read.append((args[2], chosen.count()))
        return chosen
    monkeypatch.setattr(zone_negatives, "_choose", counting)
    got = mine(_frame(spark, rows), zone_negatives.F.col("vec_id") % 100 == 0)
    assert got.count() == 0  # no negative is half as near as a positive
    assert sum(n for same, n in read if not same) == 0


def _classes(rows, threshold):
    n = len(rows)
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if label is not None and i is not None and _fits(v) and any(v) else None for i, label, v in rows]
    near = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and rows[i][1] == rows[j][1] and len(unit[i]) == len(unit[j])
             and unit[i] @ unit[j] >= threshold] for i in range(n)]
    out = []
    for i in range(n):
        seen, queue = {i}, [i]
        while queue:
            for j in near[queue.pop()]:
                if j not in seen:
                    seen.add(j)
                    queue.append(j)
        least = None if rows[i][0] is None else min(rows[j][0] for j in seen)
        out.append((rows[i][0], len(near[i]), least, rows[i][0] is not None and least == rows[i][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_near_duplicates(spark, monkeypatch, kind):
    monkeypatch.setattr(grid_join, "BLOCK", 16)
    monkeypatch.setattr(grid_join, "LEAF", 4)
    rows = [(i, label, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, label, v in _vectors(4, 260) + STRANGE]
    got = near_duplicates(_frame(spark, rows, SCHEMA.replace("float", kind)), 0.93)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == _classes(rows, 0.93)


def test_chain_and_one_common_vector(spark):
    """A chain of links through many vectors, and a vector that a third of all rows share."""
    turn = [[float(np.cos(a)), float(np.sin(a)), 0.0] for a in np.arange(0, 3, 0.3)]
    rows = [(100 + i, 1, v) for i, v in enumerate(turn)] + [(i, 2, [0.5, 0.5, 0.5]) for i in range(2000, 4000)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(_frame(spark, rows), 0.93).collect()}
    assert len(got) == len(rows)
    assert {got[100 + i][1] for i in range(len(turn))} == {100} and got[100][0] == 1 and got[105][0] == 2
    assert set(v for k, v in got.items() if k > 2000) == {(1999, 2000, False)} and got[2000] == (1999, 2000, True)


@pytest.mark.parametrize("rows", [[], [(1, None, [1.0])], [(1, 1, [1.0])]])
def test_nothing_to_join(spark, rows):
    assert [tuple(r) for r in near_duplicates(_frame(spark, rows)).collect()] == [(1, 0, 1, True)] * len(rows)
