"""Connected components by minimum labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.windows import shared_folder


def connected_components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, over undirected edges of longs.

    Labels spread over edges and jump to their own label's label, so that the rounds grow with the logarithm of the
    longest path. Each round is cut in the shared checkpoint folder.
    """
    shared_folder(edges)
    both = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y"))
    both = both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct().checkpoint(eager=True)
    labels = both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label"))
    labels = labels.checkpoint(eager=True)
    for _ in range(rounds):
        near = both.join(labels.select(F.col("x").alias("y"), "label"), "y").groupBy("x").agg(F.min("label").alias("near"))
        spread = labels.join(near, "x").select("x", "label", F.least("label", "near").alias("next"))
        jump = spread.join(labels.select(F.col("x").alias("next"), F.col("label").alias("far")), "next").select("x", F.least("next", "far").alias("new"), "label").checkpoint(eager=True)
        moved = jump.where("new <> label").limit(1).count()
        labels = jump.select("x", F.col("new").alias("label"))
        if not moved:
            return labels.select(F.col("x").alias("node"), F.col("label").alias("component"))
    raise RuntimeError(f"components: not settled after {rounds} rounds")
