"""Connected components by least labels, with pointer jumping; each round is cut to a scratch table, and those of the round before go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut, discard


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges`` (columns a, b, of one orderable type): comp is the least node of its component.

    Hubs with many edges meet as keys of joins only, which adaptive execution splits, and of least-value aggregates, which combine early.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))), "edges")
    held = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")), "labels")
    while True:
        labels = held.select("node", "comp")
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("comp").alias("near"))
        spread = cut(
            labels.join(near, labels.node == near.a).select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp")), "spread"
        )
        jump = spread.select(F.col("node").alias("via"), F.col("comp").alias("further"))
        new = cut(spread.join(jump, F.col("comp") == F.col("via")).select("node", "was", F.least("comp", "further").alias("comp")), "labels")
        changed = new.where(F.col("was") != F.col("comp")).limit(1).count()
        discard(held)
        discard(spread)
        held = new
        if not changed:
            discard(both)
            return new.select("node", "comp")
