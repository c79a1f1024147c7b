"""Connected components of an edge table, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(doc, class) for every end of an edge (a, b); the class is the least id it reaches.

    Labels are aggregated before each shuffle and written after each round; nothing but the
    number of labels that changed comes to the driver.
    """
    both = scratch.save(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = scratch.save(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("class")).withColumnRenamed("a", "doc"), f"{name}-0")
    step = 0
    while True:
        step += 1
        heard = both.join(labels, both.b == labels.doc).groupBy("a").agg(F.min("class").alias("heard")).withColumnRenamed("a", "doc")
        nearer = labels.join(heard, "doc").select("doc", F.col("class").alias("old"), F.least("class", "heard").alias("next"))
        jump = labels.select(F.col("doc").alias("next"), F.col("class").alias("jump"))
        labels_next = nearer.join(jump, "next").select("doc", "old", F.least("next", "jump").alias("class"))
        labels_next = scratch.save(labels_next, f"{name}-{step}")
        moved = labels_next.where("old <> class").count()
        scratch.drop(f"{name}-{step - 1}")
        labels = labels_next.select("doc", "class")
        if not moved:
            return labels
