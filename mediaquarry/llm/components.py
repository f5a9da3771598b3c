"""Connected components of a link table by minimum labels with pointer jumping; nothing reaches the driver but a count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import staged


def components(links: DataFrame) -> DataFrame:
    """(a, b) links to (id, label): the smallest id of each component, for ids that have links.

    Each round takes the least label among a node, its neighbours and its label's own label, and is written
    to the shared folder, so lost executors cost no more than the current round.
    """
    both = staged(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct(), "links")
    labels = staged(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("far"))
        new = labels.join(near, "id", "left").join(jump, "label", "left").select("id", F.least("label", "near", "far").alias("next"), "label")
        new = staged(new, "labels")
        changed = new.filter("next <> label").limit(1).count()
        labels = new.select("id", F.col("next").alias("label"))
        if not changed:
            return labels
