"""Connected components of a table of links, by smallest labels and label jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise


def components(links: DataFrame) -> DataFrame:
    """id and label (the smallest id of its component) for each id of links (a, b).

    Each round gives a node the smallest label around it and then that label's own label; each round's table
    is written to the shared folder. Nodes with very many links cost one combined row a task.
    """
    both = links.select("a", "b").filter("a <> b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")).filter("a <> b")).distinct()
    both = materialise(both, "links")
    labels = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    labels = materialise(labels, "labels")
    while True:
        seen = both.join(labels.withColumnsRenamed({"id": "b"}), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("seen"))
        lower = labels.join(seen, "id").select("id", "label", F.least("label", "seen").alias("low"))
        jump = labels.select(F.col("id").alias("low"), F.col("label").alias("far"))
        new = materialise(lower.join(jump, "low").select("id", F.col("label").alias("was"), F.least("low", "far").alias("label")), "labels")
        done = new.filter("was <> label").limit(1).count() == 0
        labels = new.select("id", "label")
        if done:
            return labels
