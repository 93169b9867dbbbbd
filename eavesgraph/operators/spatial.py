"""Radius, nearest and k-nearest joins inside frames, by grid cells.

All joins are equi-joins on (frame, cell) with the exact distance as residual.
Distances are squared sums of differences, never the expanded square.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eavesgraph.session import multiplied, written

XYZ = ("x", "y", "z")
#: Pairs that the last step of knn() compares rather than to look in a wider radius.
DIRECT = 10_000_000


def squared(a: str = "q", b: str = "t") -> Column:
    d = [F.col(f"{a}{c}") - F.col(f"{b}{c}") for c in XYZ]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def _side(df: DataFrame, key: str, name: str, *more: str) -> DataFrame:
    return df.select("frame_id", F.col(key).alias(f"{name}_id"), *[F.col(c).alias(f"{name[0]}{c}") for c in XYZ], *more)


def _meet(q: DataFrame, t: DataFrame, cell: Column) -> DataFrame:
    """Pairs whose cells touch; ``cell`` is the edge, a column of both sides."""
    around = F.explode(F.array(*[F.struct(*[F.lit(d).alias(c) for d, c in zip((i, j, k), XYZ)]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]))
    q = q.withColumn("_o", around).withColumns({f"_c{c}": F.floor(F.col(f"q{c}") / cell) + F.col(f"_o.{c}") for c in XYZ}).drop("_o")
    t = t.withColumns({f"_c{c}": F.floor(F.col(f"t{c}") / cell) for c in XYZ})
    return multiplied(q).join(t, ["frame_id", "_cx", "_cy", "_cz"]).drop("_cx", "_cy", "_cz")


def radius_pairs(queries: DataFrame, targets: DataFrame, radius: float, q_key: str = "point_id", t_key: str = "point_id", inclusive: bool = False) -> DataFrame:
    """(frame_id, query_id, target_id, d2) of pairs nearer than radius (or at it, if inclusive).

    Every target lies in one cell, every query looks into the 27 around it, so
    a pair comes out once. Repeated rows give repeated pairs; rows with a null
    coordinate or frame match nothing.
    """
    near = _meet(_side(queries, q_key, "query"), _side(targets, t_key, "target"), F.lit(float(radius))).withColumn("d2", squared())
    r2 = radius * radius
    return near.where(F.col("d2") <= r2 if inclusive else F.col("d2") < r2).select("frame_id", "query_id", "target_id", "d2")


def first_in_ball(queries: DataFrame, targets: DataFrame, radius: float, nsample: int, q_key: str = "vertex_id", t_key: str = "point_id", keep_empty: bool = False, fill: bool = False, inclusive: bool = False) -> DataFrame:
    """(frame_id, query_id, slot, target_id): the first nsample targets in order of id, not of distance.

    keep_empty: a query without hits gives one row with a null target. fill:
    short lists are filled up with their first hit. inclusive: targets at the radius count.
    """
    w = Window.partitionBy("frame_id", "query_id").orderBy("target_id")
    hits = radius_pairs(queries, targets, radius, q_key, t_key, inclusive).withColumn("slot", F.row_number().over(w) - 1).where(F.col("slot") < nsample).select("frame_id", "query_id", "slot", "target_id")
    if fill:
        agg = hits.groupBy("frame_id", "query_id").agg(F.min("target_id").alias("first"), F.count("*").alias("n"))
        pad = agg.where(F.col("n") < nsample).select("frame_id", "query_id", F.explode(F.sequence(F.col("n").cast("int"), F.lit(nsample - 1))).alias("slot"), F.col("first").alias("target_id"))
        hits = hits.unionByName(pad)
    if keep_empty:
        asked = queries.select("frame_id", F.col(q_key).alias("query_id")).distinct()
        hits = asked.join(hits, ["frame_id", "query_id"], "left")
    return hits


def nearest_within(queries: DataFrame, targets: DataFrame, radius: float, q_key: str = "point_id", t_key: str = "vertex_id") -> DataFrame:
    """(frame_id, query_id, target_id, d2): the nearest target under the radius; ties go to the lower id. Queries without one are left out."""
    best = F.min(F.struct("d2", "target_id")).alias("b")
    return radius_pairs(queries, targets, radius, q_key, t_key).groupBy("frame_id", "query_id").agg(best).select("frame_id", "query_id", "b.target_id", "b.d2")


def knn(queries: DataFrame, targets: DataFrame, k: int, q_key: str = "vertex_id", t_key: str = "point_id", with_self: bool = True, widen: tuple[float, ...] = (1.0, 4.0, 16.0), spread: int = 50_000) -> DataFrame:
    """(frame_id, query_id, target_id, rank, dist): the k nearest targets of each query, ties to the lower id.

    The extent of a frame gives a first cell, and how full the cells of its
    targets are gives the radius: the mean over targets, so empty stretches and
    outliers do not count. A query that has k targets within the radius is
    settled, since none outside can be nearer; the others look again in wider
    radii, until those left compare with their whole frames in at most DIRECT
    pairs or no radius is left; frames are dealt by a hash into parts of about
    ``spread`` targets for that. Each step is written, so no later one
    repeats it. with_self=False leaves out the target with the query's own id.
    """
    near, _ = written(_side(targets, t_key, "target"), "targets")
    extent = near.groupBy("frame_id").agg(F.count("*").alias("n"), *[(F.max(f"t{c}") - F.min(f"t{c}")).alias(f"e{c}") for c in XYZ])
    area = F.greatest(F.col("ex") * F.col("ey"), F.col("ex") * F.col("ez"), F.col("ey") * F.col("ez"), F.lit(1e-6))
    first = extent.select("frame_id", F.sqrt(F.lit(float(k)) * area / F.col("n")).alias("_r"), "n")
    inside = near.join(first, "frame_id").groupBy("frame_id", "_r", "n", *[F.floor(F.col(f"t{c}") / F.col("_r")).alias(f"_c{c}") for c in XYZ]).agg(F.count("*").alias("_n"))
    full = inside.groupBy("frame_id", "_r", "n").agg((F.sum(F.col("_n") * F.col("_n")) / F.sum("_n")).alias("_own"))
    base = written(full.select("frame_id", (F.col("_r") * F.sqrt(F.least(F.lit(1.0), F.lit(float(k)) / F.col("_own")))).alias("_r"), "n", F.ceil(F.col("n") / spread).alias("_parts")), "radii")[0]
    q, t = _side(queries, q_key, "query").join(base, "frame_id"), near.join(base.drop("n").withColumnsRenamed({"_r": "_tr", "_parts": "_tp"}), "frame_id")
    other = F.lit(True) if with_self else F.col("query_id") != F.col("target_id")
    key = ["frame_id", "query_id"]
    order = Window.partitionBy(*key).orderBy("d2", "target_id")

    def top(pairs: DataFrame) -> DataFrame:
        return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    q, _ = written(q, "asked")
    parts, left = [], q
    for step in widen:
        r = F.col("_r") * step
        around = F.explode(F.array(*[F.struct(*[F.lit(d).alias(c) for d, c in zip((i, j, m), XYZ)]) for i in (-1, 0, 1) for j in (-1, 0, 1) for m in (-1, 0, 1)]))
        a = left.withColumn("_o", around).withColumns({f"_c{c}": F.floor(F.col(f"q{c}") / r) + F.col(f"_o.{c}") for c in XYZ}).drop("_o")
        b = t.withColumns({f"_c{c}": F.floor(F.col(f"t{c}") / (F.col("_tr") * step)) for c in XYZ}).drop("_tr", "_tp")
        near = multiplied(a).join(b, ["frame_id", "_cx", "_cy", "_cz"]).withColumn("d2", squared()).where((F.col("d2") <= r * r) & other).select(*key, "target_id", "d2")
        best, _ = written(top(near), "nearest")
        full = best.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") >= k).select(*key)
        parts.append(best.join(full, key, "left_semi"))
        left = left.join(full, key, "left_anti")
        if (left.agg(F.sum("n")).first()[0] or 0) <= DIRECT:
            break
    dealt = left.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    held = t.withColumn("_part", F.pmod(F.xxhash64("target_id"), "_tp")).drop("_tr", "_tp")
    parts.append(top(multiplied(dealt).join(held, ["frame_id", "_part"]).withColumn("d2", squared()).where(other).select(*key, "target_id", "d2")))
    return reduce(DataFrame.unionByName, parts).select(*key, "target_id", "rank", F.sqrt("d2").alias("dist"))


def assign_targets(points: DataFrame, corners: DataFrame, radius: float) -> DataFrame:
    """(frame_id, point_id, label, ox, oy, oz): 1 and the scaled offset to the nearest corner under the radius, else 0 and zeros."""
    near = nearest_within(points, corners, radius).select("frame_id", F.col("query_id").alias("point_id"), F.col("target_id").alias("vertex_id"))
    goal = near.join(corners.select("frame_id", "vertex_id", *[F.col(c).alias(f"v{c}") for c in XYZ]), ["frame_id", "vertex_id"])
    j = points.join(goal, ["frame_id", "point_id"], "left")
    off = [F.coalesce((F.col(f"v{c}") - F.col(c)) / radius, F.lit(0.0)).alias(f"o{c}") for c in XYZ]
    return j.select("frame_id", "point_id", F.col("vertex_id").isNotNull().cast("int").alias("label"), *off)


def interpolate(neighbours: DataFrame, features: DataFrame, columns: list[str], guard: float = 1e-8) -> DataFrame:
    """Inverse-distance mean of the neighbours' features; neighbours as knn() gives them."""
    w = 1.0 / (F.col("dist") + guard)
    j = neighbours.join(features.withColumnRenamed("point_id", "target_id").select("frame_id", "target_id", *columns), ["frame_id", "target_id"]).withColumn("w", w)
    return j.groupBy("frame_id", "query_id").agg(*[(F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(c) for c in columns])


def group_relative(groups: DataFrame, queries: DataFrame, targets: DataFrame, columns: list[str], q_key: str = "vertex_id", t_key: str = "point_id") -> DataFrame:
    """Neighbour coordinates relative to the query, with the neighbours' features; zeros where a query has none."""
    q = queries.select("frame_id", F.col(q_key).alias("query_id"), *[F.col(c).alias(f"q{c}") for c in XYZ])
    t = targets.select("frame_id", F.col(t_key).alias("target_id"), *XYZ, *columns)
    j = groups.join(q, ["frame_id", "query_id"]).join(t, ["frame_id", "target_id"], "left")
    rel = [F.coalesce(F.col(c) - F.col(f"q{c}"), F.lit(0.0)).alias(f"d{c}") for c in XYZ]
    return j.select("frame_id", "query_id", "slot", "target_id", *rel, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in columns])


def pool(groups: DataFrame, columns: list[str], how=F.max) -> DataFrame:
    """One row per query: each channel reduced over its neighbours."""
    return groups.groupBy("frame_id", "query_id").agg(*[how(c).alias(c) for c in columns])
