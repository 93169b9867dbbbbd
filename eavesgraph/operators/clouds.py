"""Clean clouds, wireframes and predictions from the delivered tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eavesgraph.operators.integrity import frame_key

XYZ = ("x", "y", "z")
CHANNELS = ("r", "g", "b", "nir", "intensity")
#: Added to vertex ids where points and vertices are numbered together.
VERTEX_BASE = 1 << 40


def cloud(points: DataFrame, *more: str) -> DataFrame:
    """(frame_id, point_id, x, y, z and more columns); repeated rows count once."""
    return points.select("frame_id", "point_id", *XYZ, *more).distinct()


def corners_of(vertices: DataFrame) -> DataFrame:
    """(frame_id, vertex_id, x, y, z): per vertex the row that was loaded first among those not deleted."""
    live = vertices.where("deleted_at is null and frame_id is not null and vertex_id is not null")
    first = F.min_by(F.struct(*XYZ), F.struct("loaded_at", "vertex_row")).alias("p")
    return live.groupBy(frame_key("frame_id").alias("frame_id"), "vertex_id").agg(first).select("frame_id", "vertex_id", "p.*")


def members(points: DataFrame, vertices: DataFrame) -> DataFrame:
    """(frame_id, member_id, kind, x, y, z): sample points and vertices as one cloud; vertices are numbered after all points."""
    p = points.select("frame_id", F.col("point_id").cast("long").alias("member_id"), F.lit("sample").alias("kind"), *XYZ)
    v = vertices.select("frame_id", (F.col("vertex_id") + F.lit(VERTEX_BASE)).alias("member_id"), F.lit("vertex").alias("kind"), *XYZ)
    return p.unionByName(v)


def vertex_labels(labels: DataFrame) -> DataFrame:
    """(frame_id, vertex_id, cluster_id): the labels of members() that belong to vertices."""
    return labels.where(F.col("member_id") >= VERTEX_BASE).select("frame_id", (F.col("member_id") - F.lit(VERTEX_BASE)).cast("int").alias("vertex_id"), "cluster_id")


def undirected_edges(edges: DataFrame) -> DataFrame:
    """(frame_id, src, dst), src < dst, each pair once; loops and ends of -1 or null are dropped."""
    e = edges.where("frame_id is not null and src >= 0 and dst >= 0 and src <> dst")
    return e.select(frame_key("frame_id").alias("frame_id"), F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def predicted_corners(corners: DataFrame, padding: float = -10.0) -> DataFrame:
    """(frame_id, corner_id, x, y, z, n_members) without padding rows, the smallest row of each corner."""
    real = corners.where(~((F.col("x") == padding) & (F.col("y") == padding) & (F.col("z") == padding)))
    return real.groupBy("frame_id", "corner_id").agg(F.min(F.struct(*XYZ, "n_members")).alias("c")).select("frame_id", "corner_id", "c.*")


def live_norms(frames: DataFrame) -> DataFrame:
    """One row per frame: the first loaded that is not deleted."""
    values = ["cx", "cy", "cz", "max_distance", "cube_min", "cube_max"]
    kept = frames.where("deleted_at is null").groupBy("frame_id").agg(F.min_by(F.struct(*values), F.struct("loaded_at", *values)).alias("n"))
    return kept.select("frame_id", "n.*")


def selected_places(pred: DataFrame, points: DataFrame, threshold: float = 0.5, padding: float = -10.0) -> DataFrame:
    """(frame_id, point_id, px, py, pz): predicted points above the score, moved by their offset.

    Rows with a null or NaN score, with padding offsets, or of points that do
    not exist are left out, as are places that are null or not finite. Repeated
    rows count once; of rows of a point that differ the smallest place counts.
    """
    real = ~((F.col("dx") == padding) & (F.col("dy") == padding) & (F.col("dz") == padding))
    sel = pred.where((F.col("score") > threshold) & ~F.isnan("score") & real).select("frame_id", "point_id", "dx", "dy", "dz")
    moved = points.select("frame_id", "point_id", *XYZ).join(sel.hint("shuffle_hash"), ["frame_id", "point_id"])
    place = F.struct(*[(F.col(c) + F.col(f"d{c}")).alias(f"p{c}") for c in XYZ])
    out = moved.groupBy("frame_id", "point_id").agg(F.min(place).alias("p")).select("frame_id", "point_id", "p.*")
    sound = [F.abs(F.col(f"p{c}")) < 1e12 for c in XYZ]
    return out.where(sound[0] & sound[1] & sound[2])


def local_ids(df: DataFrame, order: list[str], name: str = "local_id") -> DataFrame:
    """Dense ids from 0 in each frame, in the given order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy("frame_id").orderBy(*order)) - 1)
