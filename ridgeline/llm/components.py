"""Connected components over distributed edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """v, c for every node of the edges (a, b): c is the smallest node that v reaches.

    Each round takes the smallest label among a node and its neighbours, then the label of that label, until nothing
    changes; labels and edges stay in tables, and a node of any degree is met by partial minima only. Null ends must
    have been dropped. Repeated edges and loops change nothing; no edges give no rows.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("c")))
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), F.col("c").alias("n")), "b").groupBy(F.col("a").alias("v")).agg(F.min("n").alias("n"))
        step = labels.join(near, "v").select("v", F.col("c").alias("old"), F.least("c", "n").alias("m"))
        jump = labels.select(F.col("v").alias("m"), F.col("c").alias("j"))
        after = written(step.join(jump, "m").select("v", F.least("m", "j").alias("c"), (F.least("m", "j") < F.col("old")).alias("moved")))
        labels = after.select("v", "c")
        if after.where("moved").limit(1).count() == 0:
            return labels
