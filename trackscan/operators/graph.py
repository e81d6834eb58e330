"""Connected components of an undirected graph by min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackscan.session import materialize

#: Rounds of plain propagation before every further round also jumps pointers.
PLAIN_ROUNDS = 3


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 200) -> DataFrame:
    """(node, label) for every node of edges; label is the smallest node that it can reach.

    edges holds orderable keys; direction, repeats, loops and rows with a null end don't matter.
    Each round sends labels along edges, keeps the least by a map-side-combined aggregate, and
    writes the labels to the shared folder, so that plans stay short and a lost executor costs one
    round. Both sides of each join come from written tables: adaptive execution can split the
    partition of a hub. The graph never reaches the driver.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    both = materialize(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "cc-edges")
    own = edges.select(F.col(src).alias("node")).union(edges.select(F.col(dst).alias("node"))).where("node IS NOT NULL")
    low = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low"))
    loops = own.distinct().join(low, "node", "left")
    labels = materialize(loops.select("node", F.least("node", F.coalesce("low", "node")).alias("label")), "cc-labels")
    for done in range(max_rounds):
        sent = both.join(labels.withColumnRenamed("node", "v"), "v").select(F.col("u").alias("node"), "label", F.lit(None).cast(labels.schema["label"].dataType).alias("was"))
        kept = labels.select("node", "label", F.col("label").alias("was"))
        new = sent.unionByName(kept).groupBy("node").agg(F.min("label").alias("label"), F.max("was").alias("was"))
        new = materialize(new, "cc-labels")
        if new.where("label <> was").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")
        if done >= PLAIN_ROUNDS:
            up = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
            labels = materialize(labels.join(up, "label").select("node", F.col("above").alias("label")), "cc-labels")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
