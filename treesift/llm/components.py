"""Connected components of a graph that lies in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treesift.llm.common import kept


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every end of ``edges`` (a, b): the least id that it reaches.

    Each round takes the least label of all neighbours and then the label of
    that label, so a round covers twice the distance of the one before.  Labels
    stay in tables; the driver sees one number a round.  No edges: no rows.
    """
    both = kept(
        edges.select(F.col("a").alias("id"), F.col("b").alias("other"))
        .union(edges.select(F.col("b"), F.col("a")))
        .where("id <> other")
        .distinct(),
        "edges",
    )
    labels = kept(both.groupBy("id").agg(F.min("other").alias("least")).select("id", F.least("id", "least").alias("root")), "labels")
    while True:
        seen = labels.select(F.col("id").alias("other"), F.col("root").alias("near"))
        near = both.join(seen, "other").groupBy("id").agg(F.min("near").alias("near"))
        hop = labels.join(near, "id", "left").select("id", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("id").alias("root"), F.col("root").alias("far"))
        step = kept(hop.join(jump, "root", "left").select("id", "old", F.least("root", "far").alias("root")), "labels")
        changed = step.where("old <> root").limit(1).count()
        labels = step.select("id", "root")
        if not changed:
            return labels
