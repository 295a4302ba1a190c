"""Connected components of an edge table, by least labels and pointer jumping; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import checkpoint


def connected(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` -> ``(id, label)`` for every id in an edge; label is the least id of its component.

    Null ends are ignored, repeated edges and loops are harmless, no edges give no rows. Every round is one job whose
    result is written to the shared folder.
    """
    ends = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = checkpoint(ends.union(ends.select("b", "a")).distinct())
    labels = checkpoint(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        of = labels.select(F.col("id").alias("label"), F.col("label").alias("root"))
        step = checkpoint(step.join(of, "label", "left").select("id", "old", F.least("label", "root").alias("label")))
        if step.where("old <> label").isEmpty():
            return step.select("id", "label")
        labels = step.select("id", "label")
