"""Approximate nearest neighbours by shifted space-filling curves.

Each of several curves projects the vectors on a few random axes, shifts and cuts the projections into cells and orders the
vectors by the Hilbert key of their cell.  Cells follow the distribution of all rows on an axis, so length counts as it does in
the distance.  Near vectors are often neighbours on at least one curve.  Per curve the vectors are range-partitioned and numbered
along the key; a query is compared exactly with those at most a window of places away; the finds of all curves are merged and
ranked by exact distance in double precision.

Law of the window: rows / (2 * curves) places to each side, at least ``window``.  The windows of all curves thus have as many places
as the table has rows, whatever its size; a window of fixed size would find ever less as rows grow.  Vectors without any
structure need this; the work grows with queries times rows.

Equal vectors are first reduced to one row with the smallest ids they stand for (as many as can ever be returned), so a vector
shared by very many rows takes one place on a curve and ties resolve to the smallest ids.

Null or zero vectors and those with null or non-finite components, and rows without an id, take no part; vectors of different
lengths are compared only with their like; repeated ids are returned once; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchhouse.llm.common import partitions, stored
from watchhouse.llm.hilbert import hilbert_keys

CURVES = 24
WINDOW = 1024  # places to each side, at least
DIMENSIONS, BITS = 6, 8
KNOTS = 257  # of the distribution on an axis
BLOCK = 32768  # rows compared in one task, at most


def _usable(vectors: DataFrame) -> DataFrame:
    clean = F.expr("embedding IS NOT NULL AND vec_id IS NOT NULL AND size(embedding) > 0 AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity')) "
                   "AND exists(embedding, x -> x != 0)")
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding")).where(F.coalesce(clean, F.lit(False)))


def _distinct(vectors: DataFrame, keep: int) -> DataFrame:
    """One row per distinct vector: rep (its smallest id), embedding and the ``keep`` smallest ids.

    Ranked in parts first, so the ids of a very common vector never meet in one task.
    """
    named = vectors.withColumn("_part", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    parts = (
        named.distinct().withColumn("_n", F.row_number().over(Window.partitionBy("embedding", "_part").orderBy("vec_id"))).where(F.col("_n") <= keep)
        .drop("_n").withColumn("_n", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("_n") <= keep)
    )
    return parts.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _projected(block: np.ndarray, curve: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors on the random axes of a curve, and the shift of its grid on each axis."""
    rng = np.random.default_rng(1000 + curve)
    width = block.shape[1]
    axes, _ = np.linalg.qr(rng.standard_normal((width, min(width, DIMENSIONS))))
    return block @ axes, rng.random(axes.shape[1]) / 3


def _spread(reps: DataFrame, curves: int) -> dict[tuple[int, int, int], np.ndarray]:
    """Knots of equal numbers of rows on every axis, by vector length, curve and dimension, counted over all rows.

    Every batch gives its own knots, which are merged by their weight.
    """
    shares = np.linspace(0, 1, KNOTS)

    def parts(batches):
        for batch in batches:
            frame = batch.to_pandas()
            for size, rows in frame.groupby(frame["embedding"].map(len)):
                block = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
                knots = [np.quantile(_projected(block, curve)[0], shares, axis=0).T for curve in range(curves)]
                axes = [(curve, d) for curve, found in enumerate(knots) for d in range(len(found))]
                yield pa.RecordBatch.from_pydict({
                    "size": np.full(len(axes), size), "curve": [c for c, _ in axes], "axis": [d for _, d in axes], "n": np.full(len(axes), len(block)),
                    "knots": [knots[c][d].tolist() for c, d in axes]})

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        values, weights = np.concatenate(rows["knots"].to_numpy()), np.repeat(rows["n"].to_numpy(), KNOTS)
        order = np.argsort(values, kind="stable")
        total = np.cumsum(weights[order]) - weights[order] / 2
        knots = np.interp(shares * weights.sum(), total, values[order])
        return rows[["size", "curve", "axis"]].head(1).assign(knots=[knots])

    merged = (reps.select("embedding").mapInArrow(parts, "size long, curve long, axis long, n long, knots array<double>")
              .groupBy("size", "curve", "axis").applyInPandas(merge, "size long, curve long, axis long, knots array<double>"))
    return {(r.size, r.curve, r.axis): np.array(r.knots) for r in merged.toLocalIterator()}


def _cells(block: np.ndarray, curve: int, spread: dict[tuple[int, int, int], np.ndarray]) -> tuple[np.ndarray, int]:
    """Cells of the vectors on a curve of their own axes and shift, and the bits of a cell."""
    points, shift = _projected(block, curve)
    bits = DIMENSIONS * BITS // points.shape[1]
    cells = np.empty(points.shape, np.int64)
    for d in range(points.shape[1]):
        knots, first = np.unique(spread[block.shape[1], curve, d], return_index=True)
        # share of the rows below, so that no outlier stretches the grid; the shift moves the cell borders
        below = np.interp(points[:, d], knots, first / (KNOTS - 1))
        cells[:, d] = (below + shift[d]) / (4 / 3) * ((1 << bits) - 1)
    return cells, bits


def nearest(vectors: DataFrame, is_query: Column, k: int, curves: int = CURVES, window: int = WINDOW) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of the ``k`` nearest rows found for every query row."""
    usable = _usable(vectors)
    reps = stored(_distinct(usable, k + 1), "vectors")
    spread = _spread(reps, curves)

    def keys(batches):
        for batch in batches:
            frame = batch.select(["rep", "embedding"]).to_pandas()
            for size, rows in frame.groupby(frame["embedding"].map(len)):
                block = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
                for curve in range(curves):
                    key = hilbert_keys(*_cells(block, curve, spread))
                    yield pa.RecordBatch.from_pydict({
                        "line": np.full(len(key), curve * 1_000_000 + size), "key": key, "rep": rows["rep"].to_numpy()})

    # line: curve and vector length; the order of a line is (key, rep)
    lines = reps.mapInArrow(keys, "line long, key long, rep long")
    placed = stored(
        lines.repartitionByRange(partitions(vectors), "line", "key", "rep").sortWithinPartitions("line", "key", "rep")
        .withColumn("_at", F.monotonically_increasing_id()), "curves")
    part = F.shiftright("_at", 33).alias("_part")
    pieces = placed.groupBy(part, "line").agg(F.count("*").alias("n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("line").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.greatest(F.lit(window), F.ceil(F.sum("n").over(Window.partitionBy("line")) / (2 * curves))).alias("reach")
    pieces = pieces.select("_part", "line", "_first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"), reach)
    numbered = placed.withColumn("_part", part).join(pieces, ["_part", "line"]).select(
        "line", "rep", "reach", (F.col("_at") - F.col("_first") + F.col("_before")).alias("place"))

    queries = usable.where(is_query).select(F.col("vec_id").alias("query_id"), "embedding")
    asked = stored(queries.join(reps, "embedding").select("query_id", "rep").distinct(), "queries")
    asked_reps = asked.select("rep").distinct().withColumn("asked", F.lit(True))
    with_vectors = numbered.join(asked_reps, "rep", "left").join(reps.select("rep", "embedding"), "rep")
    rows_of_block = F.least("reach", F.lit(BLOCK))
    block, beside = F.floor(F.col("place") / rows_of_block), F.ceil(F.col("reach") / rows_of_block)
    data = with_vectors.select("line", block.alias("block"), "place", "reach", "rep", "embedding", F.lit(False).alias("query"))
    # a query looks into its own block and those beside it
    looking = with_vectors.where("asked").select(
        "line", F.explode(F.sequence(block - beside, block + beside)).alias("block"), "place", "reach", "rep", "embedding", F.lit(True).alias("query"))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        """At most BLOCK or window data rows; queries in bounded numbers at a time."""
        looking, data = rows[rows["query"]], rows[~rows["query"]]
        out = {"query_rep": [], "rep": [], "score": []}
        if len(looking) and len(data):
            reach, places, reps_ = data["reach"].iloc[0], data["place"].to_numpy(), data["rep"].to_numpy()
            base = np.stack(data["embedding"].to_numpy()).astype(np.float64)
            squares, most = np.einsum("ij,ij->i", base, base), min(k + 1, len(data))
            for start in range(0, len(looking), 64):
                some = looking.iloc[start:start + 64]
                asked = np.stack(some["embedding"].to_numpy()).astype(np.float64)
                own = np.einsum("ij,ij->i", asked, asked)
                rough = squares - 2 * (asked @ base.T) + own[:, None]
                inside = np.abs(places - some["place"].to_numpy()[:, None]) <= reach
                rough[~inside] = np.inf
                # products round, so what may be among the nearest is measured again by its gaps
                limit = np.partition(rough, most - 1, axis=1)[:, most - 1] + 1e-15 * (base.shape[1] + 4) * (own + squares.max())
                for i, (rep, vector) in enumerate(zip(some["rep"], asked)):
                    near = np.flatnonzero(inside[i] & ~(rough[i] > limit[i]))
                    gap = base[near] - vector
                    score = np.sqrt(np.einsum("ij,ij->i", gap, gap))
                    order = np.lexsort((reps_[near], score))[:k + 1]
                    out["query_rep"] += [rep] * len(order)
                    out["rep"] += reps_[near[order]].tolist()
                    out["score"] += score[order].tolist()
        return pd.DataFrame(out).astype({"query_rep": "int64", "rep": "int64", "score": "float64"})

    found = data.unionByName(looking).groupBy("line", "block").applyInPandas(compare, "query_rep long, rep long, score double")
    best = Window.partitionBy("query_rep").orderBy("score", "rep")
    merged = found.groupBy("query_rep", "rep").agg(F.min("score").alias("score")).withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1).drop("_n")
    # a query's answers: the ids behind the nearest vectors, without its own
    answers = merged.join(reps.select("rep", "ids"), "rep").select("query_rep", "score", F.explode("ids").alias("vec_id"))
    first = Window.partitionBy("query_rep").orderBy("score", "vec_id")
    answers = answers.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k + 1).drop("_n")
    per_query = asked.withColumnRenamed("rep", "query_rep").join(answers, "query_rep").where("query_id != vec_id")
    rank = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return per_query.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
