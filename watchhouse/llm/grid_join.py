"""Embedding near-duplicates by an epsilon grid order join.

Vectors at length one are within a cosine exactly when they are within a distance, epsilon.  They are projected on their leading
principal axes and range-sorted by label and by their grid cells of width epsilon, axis by axis: the epsilon grid order.  The sorted
sequence is cut into blocks with the box that their projections fill.  Eight neighbouring blocks form an interval, eight intervals
the next, and so on.  The join starts with the few intervals of a label and replaces, level by level, every pair of intervals by
the pairs of their parts, leaving out those whose boxes are farther apart than epsilon (projections never lengthen a distance);
inside the tasks that join two blocks the halving goes on.

A task returns, per vector, how many it links with, and the links of a spanning forest, so groups of copies never become all their
pairs.  Equal vectors of a label are first reduced to one with its number of copies.

Rows with a null label, a null id, or a null, empty, zero or non-finite vector link with nothing (a null id has no component and is
not kept); vectors are compared with those of their length; repeated rows count as vectors of their own and link with each other;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchhouse.llm.common import partitions, stored
from watchhouse.llm.components import connect
from watchhouse.llm.moments import Axes, as_matrix, by_length, principal_axes, unit_rows, whole_vector

BLOCK, LEAF = 1024, 128  # rows of a block; rows compared without further halving
GRID, BOX = 6, 24  # leading axes in the order, and in the boxes
FAN = 8  # parts of an interval; also the blocks a block is joined with in one group


def _node() -> Column:
    """A vector's smallest id, and a mark that tells vectors of one id apart."""
    return F.struct(F.col("rep").alias("id"), F.col("mark").alias("mark"))


def _blocks(reps: DataFrame, number_type: type, axes: dict[int, Axes]) -> DataFrame:
    """One row per block of at most BLOCK sorted vectors of a label: its rows and its box."""
    kind = dict(reps.dtypes)["label"]

    def cut(batches):
        part, number = TaskContext.get().partitionId(), 0
        held, key = [], None

        def close():
            table = pa.Table.from_batches(held).combine_chunks()
            block = as_matrix(table.column("embedding"))
            points = axes[block.shape[1]].project(unit_rows(block))
            row = table.slice(0, 1).select(["length", "label"])
            of = lambda name: table.column(name).to_numpy().astype(np.int64).tobytes()
            for name, value in (("part", np.int32(part)), ("at", np.int64(number)), ("low", points.min(0)), ("high", points.max(0)),
                                ("ids", of("rep")), ("marks", of("mark")), ("copies", of("copies")), ("vectors", block.astype(number_type).tobytes())):
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

    return reps.select("length", "label", "rep", "mark", "copies", "embedding").mapInArrow(
        cut, f"length int, label {kind}, part int, at long, low array<double>, high array<double>, ids binary, marks binary, copies binary, vectors binary")


def _numbered(blocks: DataFrame) -> DataFrame:
    """Blocks counted through along the order: a count per partition, added up over the partitions."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    return blocks.join(parts, "part").withColumn("block", F.col("at") + F.col("_before")).drop("part", "at", "_before")


def _near(limit: float) -> Column:
    """Whether two boxes come within the distance ``limit``."""
    gaps = F.transform(F.arrays_zip("low", "high", "_low", "_high"),
                       lambda b: F.greatest(F.lit(0.0), b["low"] - b["_high"], b["_low"] - b["high"]))
    return F.aggregate(gaps, F.lit(0.0), lambda total, gap: total + gap * gap) <= limit * limit


def _pairs(blocks: DataFrame, limit: float) -> DataFrame:
    """(x, y): the pairs of blocks, x <= y, of one label that may hold a link."""
    keys = ["length", "label"]
    leaf = stored(blocks.select(*keys, F.col("block").alias("id"), "low", "high"), "interval-boxes")
    levels, size = [leaf], leaf.count()
    while size > 1:
        box = lambda agg, name: F.array(*[agg(F.get(name, F.lit(d))) for d in range(BOX)])
        whole = levels[-1].withColumn("id", F.call_function("div", F.col("id"), F.lit(FAN).cast("long"))).groupBy(*keys, "id")
        # boxes of fewer axes are filled up with nulls
        short = lambda name: F.filter(name, lambda x: x.isNotNull()).alias(name)
        levels.append(stored(whole.agg(box(F.min, "low").alias("low"), box(F.max, "high").alias("high")).select(*keys, "id", short("low"), short("high")), "interval-boxes"))
        size = -(-size // FAN)
    right = lambda level: level.select(*keys, F.col("id").alias("_id"), F.col("low").alias("_low"), F.col("high").alias("_high"))
    top = levels.pop()
    pairs = top.join(right(top), keys).where((F.col("id") <= F.col("_id")) & _near(limit)).select(*keys, F.col("id").alias("x"), F.col("_id").alias("y"))
    while levels:
        level = levels.pop()
        parent = lambda name: F.call_function("div", F.col(name), F.lit(FAN).cast("long"))
        left = level.withColumn("x", parent("id"))
        found = pairs.join(left, [*keys, "x"]).join(right(level).withColumn("y", parent("_id")), [*keys, "y"])
        pairs = stored(found.where((F.col("id") <= F.col("_id")) & _near(limit)).select(*keys, F.col("id").alias("x"), F.col("_id").alias("y")), "interval-pairs")
    return pairs


class _Forest:
    """Links that join what was apart."""

    def __init__(self, size: int):
        self.parent = list(range(size))
        self.links: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def link(self, x: int, y: int) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.parent[b] = a
            self.links.append((x, y))


def _leaf_links(hit: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect the same rows and columns as ``hit`` does, one a row or column at most."""
    out, rows = [], np.flatnonzero(hit.any(1))
    columns = np.zeros(hit.shape[1], bool)
    left = set(rows.tolist())
    while left:
        queue = [left.pop()]
        while queue:
            row = queue.pop()
            new = np.flatnonzero(hit[row] & ~columns)
            columns[new] = True
            out += [(row, int(c)) for c in new]
            if len(new):
                # rows that share a column with this one
                for other in np.flatnonzero(hit[:, new].any(1)).tolist():
                    if other in left:
                        left.remove(other)
                        queue.append(other)
                        out.append((other, int(new[hit[other, new].argmax()])))
    return out


class _Join:
    """Links between rows of sorted sequences that are halved until their boxes are apart or they are small."""

    def __init__(self, vectors: np.ndarray, points: np.ndarray, copies: np.ndarray, threshold: float, limit: float):
        self.vectors, self.points, self.copies, self.threshold, self.limit = vectors, points, copies, threshold, limit
        self.linked = np.zeros(len(vectors), np.int64)
        self.forest = _Forest(len(vectors))

    def run(self, a: int, b: int, c: int, d: int) -> None:
        """Rows a to b with rows c to d: two sequences that do not overlap, or one with itself."""
        if a >= b or c >= d:
            return
        x, y = self.points[a:b], self.points[c:d]
        gap = np.maximum(0, np.maximum(x.min(0) - y.max(0), y.min(0) - x.max(0)))
        if gap @ gap > self.limit * self.limit:
            return
        if b - a <= LEAF and d - c <= LEAF:
            return self.compare(a, b, c, d)
        if (a, b) == (c, d):
            middle = (a + b) // 2
            self.run(a, middle, a, middle)
            self.run(a, middle, middle, b)
            self.run(middle, b, middle, b)
        elif b - a >= d - c:
            middle = (a + b) // 2
            self.run(a, middle, c, d)
            self.run(middle, b, c, d)
        else:
            middle = (c + d) // 2
            self.run(a, b, c, middle)
            self.run(a, b, middle, d)

    def compare(self, a: int, b: int, c: int, d: int) -> None:
        hit = self.vectors[a:b] @ self.vectors[c:d].T >= self.threshold
        if (a, b) == (c, d):
            np.fill_diagonal(hit, False)
        if not hit.any():
            return
        self.linked[a:b] += hit @ self.copies[c:d]
        if (a, b) != (c, d):
            self.linked[c:d] += self.copies[a:b] @ hit
        for row, column in _leaf_links(hit):
            self.forest.link(a + row, c + column)


def _links(pairs: DataFrame, blocks: DataFrame, kind: type, axes: dict[int, Axes], threshold: float, limit: float) -> DataFrame:
    """Of the pairs of blocks: (node, n) numbers of linked vectors to be added up, and (node, other) links of forests."""
    def join(table: pa.Table) -> pa.Table:
        x = table.column("x")[0].as_py()
        table = table.sort_by([("block", "ascending")])
        numbers, length = table.column("block").to_pylist(), table.column("length")[0].as_py()
        bytes_of = lambda name, kind: [np.frombuffer(v.as_py(), kind) for v in table.column(name)]
        ids, marks, copies = (np.concatenate(bytes_of(name, np.int64)) for name in ("ids", "marks", "copies"))
        sizes = [len(v) // 8 for v in (i.as_py() for i in table.column("ids"))]
        vectors = unit_rows(np.concatenate(bytes_of("vectors", kind)).reshape(-1, length).astype(np.float64))
        starts = np.concatenate([[0], np.cumsum(sizes)])
        work = _Join(vectors, axes[length].project(vectors), copies, threshold, limit)
        own = numbers.index(x)
        for n, (number, wanted) in enumerate(zip(numbers, table.column("wanted").to_pylist())):
            if wanted:
                work.run(int(starts[own]), int(starts[own + 1]), int(starts[n]), int(starts[n + 1]))
        counted = np.flatnonzero(work.linked)
        p, q = (np.array([link[side] for link in work.forest.links], dtype=np.int64) for side in (0, 1))
        first, none = np.concatenate([counted, p]), [None] * len(counted)
        return pa.table({
            "id": pa.array(ids[first], pa.int64()), "mark": pa.array(marks[first], pa.int64()),
            "other_id": pa.array([*none, *ids[q].tolist()], pa.int64()), "other_mark": pa.array([*none, *marks[q].tolist()], pa.int64()),
            "n": pa.array([*work.linked[counted].tolist(), *[None] * len(p)], pa.int64())})

    # block x with up to FAN of its partners in a group; x itself comes along whether or not it is its own partner
    group = F.call_function("div", F.col("y"), F.lit(FAN).cast("long")).alias("group")
    partners = pairs.select("x", group, F.col("y").alias("block"), F.lit(True).alias("wanted"))
    owners = pairs.select("x", group, F.col("x").alias("block"), F.lit(False).alias("wanted")).distinct()
    members = partners.unionByName(owners).groupBy("x", "group", "block").agg(F.bool_or("wanted").alias("wanted"))
    rows = members.join(blocks.drop("low", "high", "label"), "block")
    return rows.groupBy("x", "group").applyInArrow(join, "id long, mark long, other_id long, other_mark long, n long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, label, embedding); 0 < threshold < 1."""
    limit = float(np.sqrt(2 - 2 * threshold)) + 1e-9
    usable = whole_vector("embedding") & F.exists("embedding", lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    element = dict(vectors.dtypes)["embedding"].removeprefix("array<").removesuffix(">")
    plain = F.transform("embedding", lambda x: (x + 0).cast(element))  # no negative zeros
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding", F.coalesce(usable, F.lit(False)).alias("usable"))
    marked = rows.where("usable").select("vec_id", "label", plain.alias("embedding")).withColumn("mark", F.xxhash64("label", "embedding"))
    reps = stored(marked.groupBy("label", "embedding").agg(
        F.min("vec_id").alias("rep"), F.first("mark").alias("mark"), F.count("*").alias("copies")), "vectors")
    axes = principal_axes(reps, "embedding", BOX, unit=True)

    def cells(batches):
        for batch in batches:
            length, found = np.zeros(len(batch), np.int32), [None] * len(batch)
            for places, block in by_length(batch, "embedding"):
                length[places] = block.shape[1]
                for place, cell in zip(places, np.floor(axes[block.shape[1]].project(unit_rows(block))[:, :GRID] / limit).astype(int).tolist()):
                    found[place] = cell
            yield batch.append_column("length", pa.array(length)).append_column("cells", pa.array(found, pa.list_(pa.int32())))

    schema = ", ".join(f"`{n}` {t}" for n, t in reps.dtypes)
    order = ["length", "label", "cells", "rep", "mark"]
    parts = max(1, min(partitions(vectors), -(-reps.count() // BLOCK)))
    ordered = reps.mapInArrow(cells, f"{schema}, length int, cells array<int>").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    kind = np.float32 if element == "float" else np.float64
    blocks = stored(_numbered(_blocks(ordered, kind, axes)), "blocks")
    found = stored(_links(_pairs(blocks, limit), blocks, kind, axes, threshold, limit), "links")
    counts = found.where("n IS NOT NULL").groupBy(F.struct("id", "mark").alias("node")).agg(F.sum("n").alias("n"))
    edges = found.where("n IS NULL").select(F.struct("id", "mark").alias("a"), F.struct(F.col("other_id").alias("id"), F.col("other_mark").alias("mark")).alias("b"))
    labels = connect(edges).select("node", F.col("label.id").alias("component_id"))
    told = reps.withColumn("node", _node()).join(counts, "node", "left").join(labels, "node", "left").select(
        "mark", "label", "embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component_id", "rep").alias("component_id"), "copies")
    told = stored(told, "classes")
    # fewer than a thousand vectors can have more than a thousandth of all rows as copies
    common = told.where(F.col("copies") * 1000 > marked.count())
    keys = ["mark", "label", "embedding"]
    answers = lambda df: df.select("vec_id", "n_links", "component_id")
    frequent = marked.join(F.broadcast(common), keys)
    seldom = marked.join(F.broadcast(common.select(*keys)), keys, "left_anti").join(told.select(*keys, "n_links", "component_id"), keys)
    alone = rows.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    every = answers(frequent).unionByName(answers(seldom)).unionByName(alone)
    return every.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
