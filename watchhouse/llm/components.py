"""Connected components of a link table, by hooking and pointer jumping on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchhouse.llm.common import stored


def connect(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each component, for the nodes of ``links`` (a, b).

    Every round offers each node, and the node it points to, the least label of its neighbours, and then halves the
    pointers; the number of rounds grows with the logarithm of the longest path.  Rounds are written to the shared folder.
    """
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node"))
    while True:
        own, other = labels.select(F.col("node").alias("a"), F.col("label").alias("la")), labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        seen = both.join(other, "b").groupBy("a").agg(F.min("lb").alias("least")).join(own, "a")
        offers = seen.select(F.col("a").alias("node"), "least").unionByName(seen.select(F.col("la").alias("node"), "least")).groupBy("node").agg(F.min("least").alias("least"))
        hooked = labels.join(offers, "node", "left").select("node", "label", F.least("label", F.coalesce("least", "label")).alias("next"))
        up = hooked.select(F.col("node").alias("next"), F.col("next").alias("jump"))
        moved = stored(hooked.join(up, "next").select("node", F.col("label").alias("_old"), F.least("next", "jump").alias("label")), "labels")
        labels = moved.select("node", "label")
        if moved.where("label != _old").isEmpty():
            return labels
