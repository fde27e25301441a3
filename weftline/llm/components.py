"""Connected components of an edge table, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, label for every id in edges: label is the smallest id of its component. In each round an
    id takes its neighbours' smallest label, then its label's label, so that long chains shorten
    by half and more; the rounds go on until one changes nothing."""
    both = materialize(edges.select(F.col(a).alias("id"), F.col(b).alias("next")).unionByName(edges.select(F.col(b).alias("id"), F.col(a).alias("next"))).distinct(), "edges")
    labels = materialize(both.groupBy("id").agg(F.least(F.first("id"), F.min("next")).alias("label")), "labels")
    while True:
        offered = both.join(labels.select(F.col("id").alias("next"), "label"), "next").groupBy("id").agg(F.min("label").alias("offer"))
        nearer = labels.join(offered, "id").select("id", F.col("label").alias("old"), F.least("label", "offer").alias("near"))
        jump = labels.select(F.col("id").alias("near"), F.col("label").alias("jump"))
        moved = materialize(nearer.join(jump, "near", "left").select("id", "old", F.least("near", F.coalesce("jump", "near")).alias("label")), "labels")
        labels = moved.select("id", "label")
        if moved.filter(F.col("old") != F.col("label")).isEmpty():
            return labels
