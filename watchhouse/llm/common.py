"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import types

from pyspark.sql import DataFrame, SparkSession

from watchhouse.session import shared_dir

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write to the cluster's shared folder and read back: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions, which the operator of the cluster sizes by the input."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def worker_cache(name: str, make):
    """A value kept by the Python worker between tasks (task functions travel by value, so module globals do not)."""
    store = sys.modules.setdefault("_task_value_store", types.ModuleType("_task_value_store"))
    if not hasattr(store, name):
        setattr(store, name, make())
    return getattr(store, name)
