"""Ordered pages with totals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchhouse.functions import columns as c


@dataclass(frozen=True)
class Page:
    """``items`` of one page plus the one-row ``totals`` frame (total, page, page_size, pages)."""

    items: DataFrame
    totals: DataFrame


def page(table: DataFrame, order: list[Column], number: int, size: int, largest: int | None = None) -> Page:
    if number < 1 or size < 1 or (largest is not None and size > largest):
        raise ValueError(f"page and page_size must be >= 1, and page_size at most {largest}")
    pages = F.greatest(F.lit(1), F.ceil(F.col("total") / F.lit(size))).cast("bigint")
    totals = table.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.lit(number).alias("page"), F.lit(size).alias("page_size"), pages.alias("pages")
    )
    return Page(table.orderBy(*order).offset((number - 1) * size).limit(size), totals)


def page_events(events: DataFrame, number: int = 1, size: int = 50, newest_first: bool = True) -> Page:
    keys = [F.col("received_at"), F.col("id")]
    order = [k.desc() for k in keys] if newest_first else [k.asc() for k in keys]
    return page(events, order, number, size)


# blocks of time that are counted one after another, with their length in microseconds
_BLOCKS = (("hour", 3_600_000_000), ("minute", 60_000_000), ("second", 1_000_000), ("microsecond", 1))
_SORTED_ROWS = 100_000


def page_by_counts(table: DataFrame, number: int, size: int, time: str = "received_at", newest_first: bool = True,
                   id_ascending: bool = False, sorted_rows: int = _SORTED_ROWS) -> Page:
    """Any page of a table in the order of a time and the id, without sorting what lies before it.

    Rows are counted per hour (the driver gets one number an hour); sums of the counts tell which hours the page lies in, and only
    these are read and sorted.  An hour of more than ``sorted_rows`` rows is counted by minutes, then seconds and instants.  Rows
    without a time come last.
    """
    if number < 1 or size < 1:
        raise ValueError("page and page_size must be >= 1")
    begin, skipped, total, rows, moment = (number - 1) * size, 0, None, table, F.col(time)
    for unit, width in _BLOCKS:
        block = F.unix_micros(F.date_trunc(unit, moment)).alias("block")
        counts = [(r.block, r.n) for r in rows.groupBy(block).agg(F.count(F.lit(1)).alias("n")).collect()]
        counts.sort(key=lambda b: (b[0] is None, (-b[0] if newest_first else b[0]) if b[0] is not None else 0))
        total = sum(n for _, n in counts) if total is None else total
        chosen, before = [], skipped
        for start, n in counts:
            if before + n <= begin:
                skipped = before + n
            elif before < begin + size:
                chosen.append((start, n))
            before += n
        times = [start for start, _ in chosen if start is not None]
        inside = F.lit(False)
        if times:
            inside = (moment >= F.timestamp_micros(F.lit(min(times)))) & (moment < F.timestamp_micros(F.lit(max(times) + width)))
        if len(times) < len(chosen):
            inside = inside | moment.isNull()
        rows = rows.filter(inside)
        if sum(n for _, n in chosen) <= sorted_rows:
            break
    in_time = moment.desc_nulls_last() if newest_first else moment.asc_nulls_last()
    in_id = F.col("id").asc() if id_ascending else F.col("id").desc() if newest_first else F.col("id").asc()
    totals = table.sparkSession.createDataFrame([(total, number, size, max(1, -(-total // size)))], "total bigint, page int, page_size int, pages bigint")
    return Page(rows.orderBy(in_time, in_id).offset(begin - skipped).limit(size), totals)


def next_events(events: DataFrame, after_time, after_id: str, size: int = 50) -> DataFrame:
    """Keyset page: the events before (older than) the last row of the previous page.

    The bound is a filter on the scan, so deep pages cost no more than the first one.
    """
    bound = c.as_timestamp(after_time)
    older = (F.col("received_at") < bound) | ((F.col("received_at") == bound) & (F.col("id") < after_id))
    return events.filter((F.col("received_at") <= bound) & older).orderBy(
        F.col("received_at").desc(), F.col("id").desc()
    ).limit(size)


def page_alerts(alerts: DataFrame, number: int = 1, size: int = 50) -> Page:
    return page(alerts, [F.col("last_seen").desc(), F.col("id").asc()], number, size)


def page_rules(rules: DataFrame, number: int = 1, size: int = 50) -> Page:
    return page(rules, [F.col("name").asc(), F.col("id").asc()], number, size)


def page_sources(sources: DataFrame, number: int = 1, size: int = 50) -> Page:
    return page(sources, [F.col("label").asc_nulls_last(), F.col("ip_address").asc()], number, size)
