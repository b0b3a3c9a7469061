"""Sharding by histogram sort, in DataFrame operations only.

Rows are ordered by (xxhash64 of the text, doc_id), so equal texts lie together, and cut into shards of nearly equal
bytes.  The cuts are found by counting: each round adds up the exact bytes of every probe interval of the still open
key ranges, keeps the one interval that holds each target, and divides it into finer probes, until an interval holds no
more bytes than the tolerance (or a single key).  Only then are the rows exchanged, once, by range.  A group of equal texts
that exceeds a shard is cut by doc_id, so one hot text never fills one task.

Null or empty texts have size 8 and take part like others; a null doc_id sorts first; repeated rows share a key and stay
together (sizes are then equal up to the bytes of that key); an empty table gives no rows; other columns are carried on,
except those named like an output column, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchhouse.llm.common import partitions, stored

ROW_OVERHEAD = 8
FAN_OUT_BITS = 10
TOLERANCE = 0.0005  # of a shard's bytes
SINGLE = -1  # marks a cut that falls inside one key value


def _refine(keys: DataFrame, key: str, where: Column, low: int, high: int, targets: list[int], slack: int, whole: bool = False) -> dict[int, tuple[int, int, int]]:
    """For each target (bytes below, within the rows of ``where``): a cut of ``key``, 0 or SINGLE, and the bytes below it.

    Every round is one aggregate over the rows inside the open intervals.  An interval closes when one of its probes misses
    the target by no more than ``slack`` bytes, or when it is a single key value; ``whole`` says that such a value is not cut, so that
    its nearer edge is taken.
    """
    open_at = {t: (low, high, 0) for t in targets}
    done: dict[int, tuple[int, int, int]] = {}
    shift = max(0, (high - low).bit_length() - FAN_OUT_BITS)
    while open_at:
        intervals = sorted(set(open_at.values()))
        number = None
        for n, (lo, hi, _) in enumerate(intervals):
            inside = F.col(key).between(lo, hi)
            number = F.when(inside, n) if number is None else number.when(inside, n)
        counted = (
            keys.where(where).select(number.alias("interval"), F.shiftright(key, shift).alias("cell"), "size")
            .where("interval IS NOT NULL").groupBy("interval", "cell").agg(F.sum("size").alias("bytes")).collect()
        )  # at most intervals x (2^FAN_OUT_BITS + 1) rows
        cells: dict[int, list[tuple[int, int]]] = {}
        for row in counted:
            cells.setdefault(row.interval, []).append((row.cell, row.bytes))
        closing = {}
        for target, (lo, hi, below) in open_at.items():
            for cell, held in sorted(cells[intervals.index((lo, hi, below))]):
                if below + held > target:
                    break
                below += held
            first, last = max(lo, cell << shift), min(hi, ((cell + 1) << shift) - 1)
            if target - below <= slack:
                done[target] = (first, 0, below)
            elif below + held - target <= slack:
                done[target] = (last + 1, 0, below + held)
            elif first == last and whole:
                done[target] = (first, 0, below) if 2 * (target - below) <= held else (last + 1, 0, below + held)
            elif first == last:
                done[target] = (first, SINGLE, below)
            else:
                closing[target] = (first, last, below)
        open_at, shift = closing, max(0, shift - FAN_OUT_BITS)
    return done


def splitters(keys: DataFrame, n_shards: int) -> list[tuple[int, int]]:
    """Cuts (hash, id): shard s holds the keys from cut s-1 on and below cut s.  keys: hash, id, size."""
    span = keys.agg(F.sum("size").alias("total"), F.min("hash").alias("lo"), F.max("hash").alias("hi")).first()
    if span.total is None:
        return []
    slack = int(span.total / n_shards * TOLERANCE)
    targets = [span.total * s // n_shards for s in range(1, n_shards)]
    found = _refine(keys, "hash", F.lit(True), span.lo, span.hi, targets, slack)
    cuts = []
    for target in targets:
        start, flag, below = found[target]
        if flag != SINGLE:
            cuts.append((start, -(1 << 63)))
            continue
        inside = F.col("hash") == start
        ids = keys.where(inside).agg(F.min("id").alias("lo"), F.max("id").alias("hi")).first()
        at, _, _ = _refine(keys, "id", inside, ids.lo, ids.hi, [target - below], slack, True)[target - below]
        cuts.append((start, at))
    return sorted(cuts)


def shard_rows(rows: DataFrame, n_shards: int) -> DataFrame:
    """``rows`` (hash, id, size and any others) with shard and slot; slot is gapless from 0 in each shard.

    The exchange is a range partitioning on the whole key; places within a shard are the places within a partition plus the
    sizes of the partitions before it, so no window spans a shard.
    """
    rows = stored(rows.drop("shard", "slot"), "shard-keys")
    shard = F.lit(0)
    for hash_cut, id_cut in splitters(rows, n_shards):
        # a cut just above the largest long cannot be a literal; no key lies beyond it
        beyond = F.lit(False) if hash_cut >= 1 << 63 else (F.col("hash") > hash_cut) | ((F.col("hash") == hash_cut) & (F.col("id") >= min(id_cut, (1 << 63) - 1)))
        shard = shard + beyond.cast("int")
    placed = rows.withColumn("shard", shard).repartitionByRange(partitions(rows), "hash", "id").sortWithinPartitions("hash", "id")
    placed = stored(placed.withColumn("_at", F.monotonically_increasing_id()), "sharded")
    part = F.shiftright("_at", 33).alias("_part")
    pieces = placed.groupBy(part, "shard").agg(F.count("*").alias("n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("_part", "shard", "_first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    return (
        placed.withColumn("_part", part).join(pieces, ["_part", "shard"])
        .withColumn("slot", (F.col("_at") - F.col("_first") + F.col("_before")).cast("long")).drop("_at", "_part", "_first", "_before")
    )


def shard_documents(docs: DataFrame, n_shards: int, carry: list[str] | None = None) -> DataFrame:
    """Documents with size, text_crc32, law, shard, slot and grown_shard; ``carry`` names columns to take along (default all)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    made = ["size", "text_crc32", "law", "shard", "slot", "grown_shard", "hash", "id"]
    names = [c for c in (docs.columns if carry is None else carry) if c not in made]
    rows = docs.select(
        *names, (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("hash"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"),
    )
    return (
        shard_rows(rows, n_shards).withColumn("law", F.lit("bytes")).withColumn("shard", F.col("shard").cast("int"))
        .withColumn("grown_shard", F.lit(None).cast("int")).drop("hash", "id")
    )


def write_shards(docs: DataFrame, n_shards: int, path: str) -> None:
    """Write whole documents to one folder per shard, each file in slot order."""
    shard_documents(docs, n_shards).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
