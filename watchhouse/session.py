"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the jobs rely on.  All can be changed on a live session.
RUNTIME_SETTINGS = {
    # every timestamp is UTC
    "spark.sql.session.timeZone": "UTC",
    # a repeated key in a key=value line: the last one counts
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # size-checked broadcast joins, skew splitting, partition coalescing
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # state beyond memory, and required by the keyed streaming operators (rate limit, sequence)
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # the parsers are wide expressions: above this bytecode size the JVM would interpret one fused
    # method, so Spark is told to generate smaller, compilable ones instead
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session and return it."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder under the cluster's shared folder (``spark.checkpoint.dir``).

    Only a local-mode session may fall back to a folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="watchhouse-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, purpose: str = "stage") -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Used where a result feeds several later jobs; unlike cached blocks the files
    survive the loss of an executor.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
