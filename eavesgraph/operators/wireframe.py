"""Candidate edges, edge labels, splitting and merging of wireframes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")


def candidate_edges(corners: DataFrame, key: str = "corner_id") -> DataFrame:
    """(frame_id, i, j, length), i < j: all pairs of corners of a frame; frames with one corner have none.

    This is the result asked for, a row per pair; corners of a frame are few.
    """
    a = corners.select("frame_id", F.col(key).alias("i"), *[F.col(c).alias(f"a{c}") for c in XYZ])
    b = corners.select("frame_id", F.col(key).alias("j"), *[F.col(c).alias(f"b{c}") for c in XYZ])
    d2 = sum(((F.col(f"a{c}") - F.col(f"b{c}")) * (F.col(f"a{c}") - F.col(f"b{c}")) for c in XYZ), F.lit(0.0))
    return a.join(b, "frame_id").where("i < j").select("frame_id", "i", "j", F.sqrt(d2).alias("length"))


def edge_membership(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Add is_edge: whether the pair (i, j) is an edge of the frame."""
    e = edges.select("frame_id", F.col("src").alias("i"), F.col("dst").alias("j"), F.lit(True).alias("is_edge"))
    return pairs.join(e, ["frame_id", "i", "j"], "left").withColumn("is_edge", F.coalesce("is_edge", F.lit(False)))


def split_edges(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(frame_id, cluster_id, src, dst, with ids local to the cluster): edges whose ends fall into one cluster.

    membership: frame_id, vertex_id, cluster_id. Ids are numbered from 0 in
    each cluster by vertex_id; edges across clusters vanish.
    """
    w = Window.partitionBy("frame_id", "cluster_id").orderBy("vertex_id")
    ids = membership.withColumn("local", F.row_number().over(w) - 1)
    end = lambda c: ids.select("frame_id", "cluster_id", F.col("vertex_id").alias(c), F.col("local").alias(f"{c}_local"))
    j = edges.join(end("src"), ["frame_id", "src"]).join(end("dst"), ["frame_id", "cluster_id", "dst"])
    return j.select("frame_id", "cluster_id", F.col("src_local").alias("src"), F.col("dst_local").alias("dst"))


def merge_offsets(membership: DataFrame) -> DataFrame:
    """(frame_id, cluster_id, n_vertices, offset): how far a cluster's ids move when clusters are put back together."""
    n = membership.groupBy("frame_id", "cluster_id").agg(F.count("*").alias("n_vertices"))
    w = Window.partitionBy("frame_id").orderBy("cluster_id").rowsBetween(Window.unboundedPreceding, -1)
    return n.withColumn("offset", F.coalesce(F.sum("n_vertices").over(w), F.lit(0)))


def merged_edges(parts: DataFrame, offsets: DataFrame) -> DataFrame:
    """(frame_id, src, dst): edges of the clusters with the ids of the merged wireframe."""
    j = parts.join(offsets.select("frame_id", "cluster_id", "offset"), ["frame_id", "cluster_id"])
    return j.select("frame_id", (F.col("src") + F.col("offset")).alias("src"), (F.col("dst") + F.col("offset")).alias("dst"))


def merged_vertices(vertices: DataFrame, membership: DataFrame, offsets: DataFrame) -> DataFrame:
    """(frame_id, vertex_id, x, y, z): the vertices of the clusters with the ids of the merged wireframe; none are joined."""
    w = Window.partitionBy("frame_id", "cluster_id").orderBy("vertex_id")
    local = membership.select("frame_id", "cluster_id", "vertex_id", (F.row_number().over(w) - 1).alias("local"))
    j = local.join(offsets.select("frame_id", "cluster_id", "offset"), ["frame_id", "cluster_id"]).join(vertices.select("frame_id", "vertex_id", *XYZ), ["frame_id", "vertex_id"])
    return j.select("frame_id", (F.col("local") + F.col("offset")).alias("vertex_id"), *XYZ)


def distinct_colors(clusters: DataFrame, by: str = "frame_id", key: str = "cluster_id") -> DataFrame:
    """(by, key, r, g, b): hues at even steps from 0 to 360 over the clusters of a group in order, both ends red-most, as whole numbers."""
    w = Window.partitionBy(by).orderBy(key)
    n = clusters.select(by, key).distinct().withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy(by))})
    h = F.when(F.col("_n") > 1, F.col("_i") * 360.0 / (F.col("_n") - 1)).otherwise(F.lit(0.0)) / 60.0
    x = F.floor((1 - F.abs(h % 2 - 1)) * 255).cast("int")
    full, none = F.lit(255), F.lit(0)
    shades = [(full, x, none), (x, full, none), (none, full, x), (none, x, full), (x, none, full), (full, none, x)]
    pick = lambda k: reduce(lambda other, i: F.when(h < i + 1, shades[i][k]).otherwise(other), range(4, -1, -1), shades[5][k])
    return n.select(by, key, *[pick(k).alias(c) for k, c in enumerate("rgb")])


def prefer_clusters(originals: DataFrame, merged: DataFrame) -> DataFrame:
    """Frames of ``merged`` win over originals with the same frame_id."""
    return originals.join(merged.select("frame_id").distinct(), "frame_id", "left_anti").unionByName(merged)


def size_gate(points: DataFrame, threshold: int) -> DataFrame:
    """(frame_id, n_points, branch): small frames are copied, larger ones are clustered."""
    n = points.groupBy("frame_id").agg(F.count("*").alias("n_points"))
    return n.withColumn("branch", F.when(F.col("n_points") <= threshold, "original").otherwise("cluster"))


def loop_edges(faces: DataFrame) -> DataFrame:
    """(frame_id, src, dst): closed loops over ``ids`` (array), each vertex to the one before it, sorted, each once."""
    prev = F.concat(F.slice("ids", -1, 1), F.slice("ids", 1, F.size("ids") - 1))
    e = faces.where(F.size("ids") > 0).select("frame_id", F.explode(F.arrays_zip(F.col("ids").alias("a"), prev.alias("b"))).alias("e"))
    e = e.select("frame_id", F.least("e.a", "e.b").alias("src"), F.greatest("e.a", "e.b").alias("dst"))
    return e.where("src <> dst").distinct()
