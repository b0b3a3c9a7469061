"""Leading principal axes of the vectors of a table, from sums that tasks form over all rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole_vector(name: str) -> Column:
    """True for an array that is not null or empty and whose components are numbers, neither null nor infinite."""
    return F.coalesce(F.expr(f"size({name}) > 0 AND NOT exists({name}, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity'))"), F.lit(False))


def as_matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column whose lists are equally long."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def by_length(batch: pa.RecordBatch, name: str):
    """(places of the rows, their vectors) for each vector length in a batch."""
    lengths = batch.column(name).value_lengths().to_numpy(zero_copy_only=False)
    for length in np.unique(lengths):
        places = np.flatnonzero(lengths == length)
        yield places, as_matrix(batch.column(name).take(pa.array(places)))


@dataclass
class Axes:
    """Centre, leading axes (columns) and the deviation along each."""

    centre: np.ndarray
    axes: np.ndarray
    deviation: np.ndarray

    def project(self, block: np.ndarray) -> np.ndarray:
        return (block - self.centre) @ self.axes


def principal_axes(vectors: DataFrame, name: str, dimensions: int, unit: bool = False) -> dict[int, Axes]:
    """Per vector length the ``dimensions`` leading principal axes; ``unit`` takes vectors at length one.

    Tasks give the sums and products of their rows, which are added up per entry, so the driver gets one matrix a length.
    """
    def sums(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, block in by_length(batch, name):
                if unit:
                    block = unit_rows(block)
                found = np.concatenate([[len(block)], block.sum(0), (block.T @ block).ravel()])
                held[block.shape[1]] = held.get(block.shape[1], 0) + found
        for length, found in held.items():
            yield pa.RecordBatch.from_pydict({"length": [length], "sums": [found]}, schema=pa.schema([("length", pa.int64()), ("sums", pa.list_(pa.float64()))]))

    parts = vectors.select(name).mapInArrow(sums, "length long, sums array<double>")
    entries = parts.select("length", F.posexplode("sums").alias("at", "value")).groupBy("length", "at").agg(F.sum("value").alias("value"))
    matrices: dict[int, dict[int, float]] = {}
    for row in entries.toLocalIterator():
        matrices.setdefault(row.length, {})[row.at] = row.value
    out = {}
    for length, entry in matrices.items():
        flat = np.array([entry[i] for i in range(1 + length + length * length)])
        centre = flat[1:1 + length] / flat[0]
        spread = flat[1 + length:].reshape(length, length) / flat[0] - np.outer(centre, centre)
        values, axes = np.linalg.eigh((spread + spread.T) / 2)
        lead = np.argsort(-values)[:dimensions]
        out[length] = Axes(centre, axes[:, lead], np.sqrt(np.maximum(values[lead], 0)))
    return out


def unit_rows(block: np.ndarray) -> np.ndarray:
    """Rows at length one; the largest component is divided out first, so neither squares overflow nor vanish."""
    block = block / np.abs(block).max(1, keepdims=True)
    return block / np.sqrt(np.einsum("ij,ij->i", block, block))[:, None]
