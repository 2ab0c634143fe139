"""Connected components of an edge table by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionloom.session import cut_lineage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) for every node of an edge; ``comp`` is the smallest node of its component.

    A round gives each node the smallest label among its neighbours (summed map-side, so a node with very many edges is
    one row per task) and then follows labels of labels, which halves the depth of every tree. State is checkpointed
    each round. Null ends and loops are ignored.
    """
    plain = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    both = cut_lineage(plain.unionByName(plain.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = cut_lineage(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("comp")))
    while True:
        heard = both.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("comp").alias("m"))
        near = labels.join(heard, F.col("node") == F.col("u"), "left").select(
            "node", F.col("comp").alias("was"), F.least("comp", F.coalesce("m", "comp")).alias("comp")
        )
        near = cut_lineage(near)
        up = near.select(F.col("node").alias("n2"), F.col("comp").alias("c2"))
        jumped = cut_lineage(near.join(up, F.col("comp") == F.col("n2"), "left").select(
            "node", "was", F.least("comp", F.coalesce("c2", "comp")).alias("comp")
        ))
        labels = jumped.select("node", "comp")
        if not jumped.where("comp <> was").limit(1).count():
            return labels
