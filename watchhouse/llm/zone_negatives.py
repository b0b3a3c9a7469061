"""Hard-negative mining over Hilbert-ordered blocks with zone maps.

Rows are range-sorted by label and by the Hilbert key of their leading principal dimensions and written as Parquet blocks of one
label, each with the smallest and largest value of every dimension (its zone map).  Interval arithmetic on a zone map bounds the
inner products of an anchor with all rows of a block from both sides, so the scores that an anchor is looking for (its window)
decide which blocks it must read:

1. an anchor's own block gives a first idea of its best positives; blocks of its label that can hold better ones are read;
2. the blocks with the highest bounds give first negatives for the windows set by the positives;
3. the other blocks that can hold a score within a window, and not below the negatives already found, are read.

The result is exact.  Anchors lie in packs of neighbours; packs meet zone maps, and then blocks, in bounded groups.

Vectors become integers, floor(scale * component).  Rows with a null id, a null label, a null or empty vector, null or non-finite
components, or components of 2^27 or more after scaling take no part; vectors are compared with those of their length; a zero
vector scores 0.  Ties go to the smaller id, and for rows of one id to the smaller vector; equal rows count once; rows of one id are
never each other's partners.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchhouse.llm.common import partitions, stored
from watchhouse.llm.hilbert import hilbert_keys
from watchhouse.llm.moments import Axes, as_matrix, by_length, principal_axes, whole_vector

BLOCK, PACK = 256, 256  # rows of a block, anchors of a pack
ZONES, PACKS = 1024, 16  # zone maps and packs that meet in one group
GROUP = 32  # blocks read in one group
FIRST = 4  # blocks of a group of zone maps read before windows are narrowed
DIMENSIONS, BITS = 6, 8
LARGEST = 1 << 27

_LEAST = np.iinfo(np.int64).min


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of rows; products in doubles where these hold them exactly."""
    if len(a) and len(b) and np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2 ** 52:
        return np.rint(a @ b.T).astype(np.int64)
    return np.einsum("id,jd->ij", a.astype(np.int64), b.astype(np.int64))


def _hilbert(block: np.ndarray, axes: Axes) -> np.ndarray:
    points = axes.project(block)
    bits = DIMENSIONS * BITS // points.shape[1]
    scaled = points / np.where(axes.deviation > 0, axes.deviation, 1) / 6 + 0.5  # three deviations to each side
    return hilbert_keys(np.clip(scaled * (1 << bits), 0, (1 << bits) - 1).astype(np.int64), bits)


def _blocks(rows: DataFrame) -> DataFrame:
    """One row per block of at most BLOCK sorted rows of a label: its rows and its zone map."""
    names = ["length", "label", "vec_id", "q", "anchor"]

    def cut(batches):
        part, number = TaskContext.get().partitionId(), 0
        held, key = [], None  # slices of the open block

        def close():
            table = pa.Table.from_batches(held).combine_chunks()
            q = as_matrix(table.column("q"))
            row = table.slice(0, 1).select(["length", "label"])
            anchors = np.flatnonzero(table.column("anchor").to_numpy(zero_copy_only=False).astype(bool)).astype(np.int32)
            for name, value in (("block", np.int64((part << 24) + number)), ("low", q.min(0).astype(np.int64)), ("high", q.max(0).astype(np.int64)),
                                ("ids", table.column("vec_id").to_numpy().tobytes()), ("q", q.astype(np.int32).tobytes()), ("anchors", anchors)):
                row = row.append_column(name, pa.array([value]))
            return row.to_batches()[0]

        for batch in batches:
            keys = list(zip(batch.column("length").to_pylist(), batch.column("label").to_pylist()))
            low = 0
            while low < len(keys):
                room = BLOCK - sum(map(len, held))
                if held and (keys[low] != key or room == 0):
                    yield close()
                    held, room, number = [], BLOCK, number + 1
                key, high = keys[low], low + 1
                while high < len(keys) and high - low < room and keys[high] == key:
                    high += 1
                held.append(batch.slice(low, high - low))
                low = high
        if held:
            yield close()

    kind = dict(rows.dtypes)["label"]
    return rows.select(*names).mapInArrow(cut, f"length int, label {kind}, block long, low array<long>, high array<long>, ids binary, q binary, anchors array<int>")


def _ids(column: pa.Array) -> np.ndarray:
    """Ids held as bytes, of several blocks."""
    return np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in column])


def _vectors(column: pa.Array, length: int) -> np.ndarray:
    """Vectors held as bytes, of several rows or blocks."""
    return np.concatenate([np.frombuffer(x.as_py(), np.int32) for x in column]).reshape(-1, length).astype(np.float64)


def _own_blocks(blocks: DataFrame, positives: int) -> DataFrame:
    """Anchors with the score that ``positives`` rows of their own block reach (none: the least number)."""
    kind = dict(blocks.dtypes)["label"]

    def seed(batches):
        for batch in batches:
            for i in range(len(batch)):
                length, block = batch.column("length")[i].as_py(), batch.column("block")[i].as_py()
                ids, q = _ids(batch.column("ids").slice(i, 1)), _vectors(batch.column("q").slice(i, 1), length)
                at = np.array(batch.column("anchors")[i].as_py(), dtype=np.int64)
                scores = _scores(q[at], q)
                scores[ids[at][:, None] == ids] = _LEAST
                nth = len(ids) - positives
                best = np.partition(scores, nth, axis=1)[:, nth] if nth >= 0 else np.full(len(at), _LEAST)
                yield pa.RecordBatch.from_pydict({
                    "length": pa.array([length] * len(at), pa.int32()), "label": pa.array([batch.column("label")[i].as_py()] * len(at), batch.column("label").type),
                    "row": (block << 10) + at, "anchor_id": ids[at], "q": pa.array([x.tobytes() for x in q[at].astype(np.int32)], pa.binary()), "reach": best})

    return blocks.where("size(anchors) > 0").select("length", "label", "block", "ids", "q", "anchors").mapInArrow(
        seed, f"length int, label {kind}, row long, anchor_id long, q binary, reach long")


def _packed(anchors: DataFrame) -> DataFrame:
    """Anchors with the pack of neighbours they belong to."""
    kind = dict(anchors.dtypes)["label"]

    def number(batches):
        pack, size, key = TaskContext.get().partitionId() << 24, 0, None
        for batch in batches:
            out = []
            for own in zip(batch.column("length").to_pylist(), batch.column("label").to_pylist()):
                if key is not None and (own != key or size == PACK):
                    pack, size = pack + 1, 0
                key, size = own, size + 1
                out.append(pack)
            yield batch.append_column("pack", pa.array(out, pa.int64()))

    order = ["length", "label", "row"]
    parts = max(1, -(-anchors.count() // (4 * PACK)))
    sorted_ = anchors.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return sorted_.mapInArrow(number, f"length int, label {kind}, row long, anchor_id long, q binary, reach long, pack long")


def _choose(anchors: DataFrame, zones: DataFrame, same_label: bool, first: bool | None, chunks: int, pack_groups: int) -> DataFrame:
    """(pack, bucket, block) of the blocks that the anchors must read.

    ``anchors`` have the scores they look for in ``lows`` and ``highs``, one entry per window.  ``first`` takes the FIRST blocks of
    the highest bound (True) or the others (False).
    """
    def bound(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"pack": [], "bucket": [], "block": []}
        packs, lengths = left.column("pack").to_numpy(), right.column("length").to_numpy()
        labels, blocks = right.column("label"), right.column("block").to_numpy()
        for pack in np.unique(packs) if len(right) else ():
            some = left.filter(pa.array(packs == pack))
            length, label = some.column("length")[0].as_py(), some.column("label")[0].as_py()
            fits = np.flatnonzero((lengths == length) & ((np.array(labels.to_pylist()) == label) == same_label))
            if len(fits) == 0:
                continue
            some_zones = right.take(pa.array(fits))
            low, high = as_matrix(some_zones.column("low")), as_matrix(some_zones.column("high"))
            q = _vectors(some.column("q"), length)
            up, down = np.maximum(q, 0), np.minimum(q, 0)
            most, least = up @ high.T + down @ low.T, up @ low.T + down @ high.T
            slack = 1e-9 * (np.abs(most) + np.abs(least))  # sums of large products round
            wanted = np.zeros(len(fits), bool)
            for n, (lows, highs) in enumerate(zip(some.column("lows").to_pylist(), some.column("highs").to_pylist())):
                for x, y in zip(lows, highs):
                    if x <= y:
                        wanted |= (most[n] + slack[n] >= x) & (least[n] - slack[n] <= y)
            if first is not None:
                lead = np.zeros(len(fits), bool)
                lead[np.lexsort((blocks[fits], -most.max(0)))[:FIRST]] = True
                wanted &= lead == first
            chosen = blocks[fits[wanted]]
            chunk = right.column("chunk")[0].as_py()
            out["pack"] += [pack] * len(chosen)
            out["bucket"] += [chunk * ZONES + i // GROUP for i in range(len(chosen))]
            out["block"] += chosen.tolist()
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    dealt = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n).cast("long"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = anchors.select("*", dealt("pack", pack_groups).alias("packs"), every(chunks).alias("chunk"))
    right = zones.select("*", dealt("block", chunks).alias("chunk"), every(pack_groups).alias("packs"))
    return left.groupBy("chunk", "packs").cogroup(right.groupBy("chunk", "packs")).applyInArrow(bound, "pack long, bucket long, block long")


def _read(chosen: DataFrame, anchors: DataFrame, blocks: DataFrame, take: int) -> DataFrame:
    """The first ``take`` rows of the chosen blocks in every window of every anchor: (row, window, vec_id, score)."""
    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"row": [], "window": [], "vec_id": [], "score": []}
        if len(left) and len(right):
            length = left.column("length")[0].as_py()
            ids, base = _ids(right.column("ids")), _vectors(right.column("q"), length)
            order = np.argsort(ids, kind="stable")
            ids, base = ids[order], base[order]
            own = left.column("anchor_id").to_numpy()
            q = _vectors(left.column("q"), length)
            for n, (row, scores) in enumerate(zip(left.column("row").to_pylist(), _scores(q, base))):
                lows, highs = left.column("lows")[n].as_py(), left.column("highs")[n].as_py()
                near = np.flatnonzero((scores >= min(lows, default=0)) & (scores <= max(highs, default=-1)) & (ids != own[n]))
                if len(near) > 4096 and len(lows) == 1:  # only the best can count
                    edge = np.partition(scores[near], len(near) - take)[len(near) - take]
                    near = near[scores[near] >= edge]
                falling = near[np.argsort(-scores[near], kind="stable")]
                for window, (x, y) in enumerate(zip(lows, highs)):
                    start = np.searchsorted(-scores[falling], -y)
                    for at in falling[start:start + take]:
                        if scores[at] >= x:
                            for name, value in (("row", row), ("window", window), ("vec_id", ids[at]), ("score", scores[at])):
                                out[name].append(int(value))
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    groups = chosen.select("pack", "bucket").distinct().join(anchors, "pack")
    members = chosen.join(blocks.select("block", "ids", "q"), "block").select(F.col("pack").alias("_pack"), F.col("bucket").alias("_bucket"), "ids", "q")
    found = groups.groupBy("pack", "bucket").cogroup(members.groupBy("_pack", "_bucket")).applyInArrow(score, "row long, window long, vec_id long, score long")
    return _best(found, take)


def _best(found: DataFrame, take: int) -> DataFrame:
    rank = Window.partitionBy("row", "window").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= take)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """Negatives of every anchor and positive: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors``: vec_id, label, embedding.  A negative is a row of another label with
    ``low * positive_score <= 100 * negative_score <= high * positive_score``, 0 <= low < high; a positive below 0 has none.
    """
    fits = F.expr("NOT exists(q, x -> abs(x) >= double(%d))" % LARGEST)
    rows = (vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & whole_vector("embedding"))
            .select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
                    F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("q"))
            .where(fits).select("vec_id", "label", "anchor", F.transform("q", lambda x: x.cast("int")).alias("q")).distinct())
    kind = dict(rows.dtypes)["label"]
    rows = stored(rows, "vectors")
    axes = principal_axes(rows, "q", DIMENSIONS)

    def keys(batches):
        for batch in batches:
            length, key = np.zeros(len(batch), np.int32), np.zeros(len(batch), np.int64)
            for places, block in by_length(batch, "q"):
                length[places], key[places] = block.shape[1], _hilbert(block, axes[block.shape[1]])
            yield batch.append_column("length", pa.array(length)).append_column("key", pa.array(key))

    keyed = rows.mapInArrow(keys, f"vec_id long, label {kind}, anchor boolean, q array<int>, length int, key long")
    order = ["length", "label", "key", "vec_id", "q"]
    parts = max(1, min(partitions(vectors), -(-rows.count() // (4 * BLOCK))))
    blocks = stored(_blocks(keyed.repartitionByRange(parts, *order[:-1]).sortWithinPartitions(*order)), "blocks")
    anchors = stored(_packed(_own_blocks(blocks, positives)), "anchors")
    zones = blocks.select("length", "label", "block", "low", "high")
    n_blocks, n_packs = blocks.count(), anchors.select("pack").distinct().count()
    grid = -(-max(1, n_blocks) // ZONES), -(-max(1, n_packs) // PACKS)

    own = anchors.drop("reach")
    looking = anchors.select("*", F.array("reach").alias("lows"), F.array(F.lit(np.iinfo(np.int64).max).cast("long")).alias("highs")).drop("reach")
    best = stored(_read(_choose(looking, zones, True, None, *grid), looking, blocks, positives), "positives").drop("window").withColumnRenamed("rank", "n")
    # windows in the order of the positives, from ``low`` percent of the score rounded up to ``high`` percent rounded down
    reached_by = lambda percent, up: F.when(F.col("score") >= 0, F.call_function("div", F.col("score") * percent + up, F.lit(100).cast("long")))
    rounded = best.select("row", "n", F.coalesce(reached_by(low, 99), F.lit(0)).alias("x"), F.coalesce(reached_by(high, 0), F.lit(-1)).alias("y"))
    listed = rounded.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("n", "x", "y"))).alias("w"))
    windows = listed.select("row", F.transform("w", lambda e: e["x"]).alias("lows"), F.transform("w", lambda e: e["y"]).alias("highs"))
    asked = own.join(windows, "row")
    found = stored(_read(_choose(asked, zones, False, True, *grid), asked, blocks, negatives), "first-negatives").drop("rank")
    # a full window looks for nothing below its last find
    full = found.groupBy("row", "window").agg(F.count("*").alias("c"), F.min("score").alias("least")).where(F.col("c") == negatives)
    reached = full.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("window", "least"))).alias("reached"))
    narrowed = asked.join(reached, "row", "left").withColumn("lows", F.expr(
        "transform(lows, (x, i) -> greatest(x, coalesce(try_element_at(reached, CAST(i AS BIGINT)), x)))")).drop("reached")
    rest = _read(_choose(narrowed, zones, False, False, *grid), narrowed, blocks, negatives).drop("rank")
    final = _best(found.unionByName(rest), negatives)
    named = best.select("row", (F.col("n") - 1).cast("long").alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return (final.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}).join(named, ["row", "window"]).join(own.select("row", "anchor_id"), "row")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
