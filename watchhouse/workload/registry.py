"""The query registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from watchhouse.workload.tables import Tables, flat

Query = Callable[[SparkSession, str], DataFrame]

_PARTITIONS = "spark.sql.shuffle.partitions"

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, streaming: bool = False):
    """Register a function of ``Tables`` under its own name, with the SQL that checks it."""
    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            if not streaming:
                return flat(fn(Tables(spark, folder)))
            # streams run inside the call; adaptive execution does not coalesce state partitions, so
            # their number follows the cores of the cluster instead of a fixed default
            before = spark.conf.get(_PARTITIONS)
            spark.conf.set(_PARTITIONS, min(int(before), 4 * spark.sparkContext.defaultParallelism))
            try:
                return flat(fn(Tables(spark, folder, streaming)))
            finally:
                spark.conf.set(_PARTITIONS, before)

        run.__doc__ = fn.__doc__
        QUERIES[fn.__name__] = run
        if sql is not None:
            SQL[fn.__name__] = " ".join(line.strip() for line in sql.strip().splitlines())
        return fn

    return register
