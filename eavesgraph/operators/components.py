"""Connected components within frames by propagation of minimum labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eavesgraph.session import drop_path, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One half pass: hand every neighbour the smallest label that a node sees.

    edges: (frame_id, u, v) with v < u, each once. The large half looks at all
    neighbours and moves the larger ones, the small half moves the smaller.
    """
    if large:
        both = edges.unionByName(edges.select("frame_id", F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("frame_id", "u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        up = both.where("v > u").join(least, ["frame_id", "u"])
        return up.select("frame_id", F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = edges.groupBy("frame_id", "u").agg(F.min("v").alias("m"))
    down = edges.join(least, ["frame_id", "u"]).where("v <> m").select("frame_id", F.col("v").alias("u"), F.col("m").alias("v"))
    return down.unionByName(least.select("frame_id", "u", F.col("m").alias("v"))).distinct()


def _flat(edges: DataFrame) -> bool:
    """True if every node has one label and no label has one itself."""
    one = lambda c, own: edges.select("frame_id", F.col(c).alias("x"), F.lit(own).alias("own"), F.lit(1 - own).alias("root"))
    seen = one("u", 1).unionByName(one("v", 0)).groupBy("frame_id", "x").agg(F.sum("own").alias("own"), F.max("root").alias("root"))
    return not seen.where("own > 1 or (own > 0 and root > 0)").limit(1).count()


def minimum_labels(links: DataFrame) -> DataFrame:
    """(frame_id, u, label): the smallest node of its component for every linked node but itself.

    links: (frame_id, u, v), any order of the ends. Minimum labels are passed
    on until every node hangs directly on the smallest of its component; every
    half pass is written to the shared folder. Loops (u = v) and repeated links
    are harmless; nulls are no links.
    """
    edges = links.where("u <> v").select("frame_id", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, path = written(edges, "labels")
    while True:
        for large in (True, False):
            old, (edges, path) = path, written(_star(edges, large), "labels")
            drop_path(edges.sparkSession, old)
        if _flat(edges):
            return edges.withColumnRenamed("v", "label")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(frame_id, u, label) for every node; a node without links is its own component."""
    return nodes.select("frame_id", "u").join(minimum_labels(links), ["frame_id", "u"], "left").withColumn("label", F.coalesce("label", "u"))
