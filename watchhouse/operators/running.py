"""Running aggregates over one key's time line that stay parallel when the key is hot.

A plain window would put a whole key into one task.  Here each key's time line is cut into slices:
rows are scanned within (key, slice), and one small row per slice carries the result of all earlier
slices over.  A key with a third of all rows is thus spread over as many tasks as it has slices.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_COMBINE = {
    "min": lambda a, b: F.least(a, b),  # least / greatest skip NULLs
    "max": lambda a, b: F.greatest(a, b),
    "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
}
_AGG = {"min": F.min, "max": F.max, "sum": F.sum}

DEFAULT_SLICES = 256


def time_slice(moment: Column, start: Column, span_seconds: float, slices: int = DEFAULT_SLICES) -> Column:
    """Number of the slice ``moment`` falls into, counted from ``start``."""
    width = max(1, int(span_seconds * 1_000_000) // slices)
    offset = F.unix_micros(moment) - F.unix_micros(start)
    return F.call_function("div", offset, F.lit(width).cast("bigint")).cast("bigint")


def running_before(
    df: DataFrame, keys: list[str], slice_col: str, order_col: str,
    values: Mapping[str, tuple[str, Column]], descending: bool = False,
) -> DataFrame:
    """Add, per row, aggregates over the rows strictly before it (after it when ``descending``).

    ``values`` maps output name -> (``min`` | ``max`` | ``sum``, input Column).  ``order_col`` must be
    unique within a key.  ``df`` should already be partitioned by ``keys`` + ``slice_col``.
    """
    def ordered(name):
        return F.col(name).desc() if descending else F.col(name).asc()

    before = (Window.unboundedPreceding, -1)
    local = Window.partitionBy(*keys, slice_col).orderBy(ordered(order_col)).rowsBetween(*before)
    across = Window.partitionBy(*keys).orderBy(ordered(slice_col)).rowsBetween(*before)

    totals = df.groupBy(*keys, slice_col).agg(
        *[_AGG[kind](expr).alias(f"_t_{name}") for name, (kind, expr) in values.items()]
    )
    carried = totals.select(
        *keys, slice_col,
        *[_AGG[kind](f"_t_{name}").over(across).alias(f"_c_{name}") for name, (kind, _) in values.items()],
    )
    scanned = df.select(
        "*", *[_AGG[kind](expr).over(local).alias(f"_l_{name}") for name, (kind, expr) in values.items()]
    )
    joined = scanned.join(carried, [*keys, slice_col], "left")
    return joined.select(
        *[F.col(n) for n in df.columns],
        *[_COMBINE[kind](F.col(f"_l_{name}"), F.col(f"_c_{name}")).alias(name)
          for name, (kind, _) in values.items()],
    )
