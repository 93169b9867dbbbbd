"""Groups of points that lie together, by grid density clustering in SQL.

Places are quantised to cells whose diagonal is under the linking distance, so
all points of a cell belong together; cells are counted, adjacent cells are
joined, and minimum labels are propagated over the joined cells until nothing
changes. The groups are exactly the connected components of "at most eps apart".
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eavesgraph.operators.cells import boxed, cell_links, cell_side, with_cells
from eavesgraph.operators.components import minimum_labels
from eavesgraph.session import written

CELL = ["frame_id", "gx", "gy", "gz"]


def density_groups(places: DataFrame, eps: float = 0.10, least: int = 5) -> tuple[DataFrame, DataFrame]:
    """(members, groups) of points linked by chains of steps of at most eps within a frame.

    places: frame_id, point_id, px, py, pz, one row a point. members:
    (frame_id, label, point_id, px, py, pz and the cell), label being the
    smallest point_id of the group; groups: (frame_id, label, n_points). Only
    groups of at least ``least`` points come out. Points at one place are
    linked. However many points two neighbouring cells hold, they are compared
    by the boxes of their halves until those decide (cell_links). An empty table
    gives empty results.
    """
    side = cell_side(eps)
    placed, _ = written(with_cells(places, side), "placed")
    cells, _ = written(boxed(placed), "cells")
    labels = minimum_labels(cell_links(placed, cells, eps, side))
    named = cells.select(*CELL, "n", "u").join(labels, ["frame_id", "u"], "left").withColumn("label", F.coalesce("label", "u"))
    groups = named.groupBy("frame_id", "label").agg(F.sum("n").alias("n_points")).where(F.col("n_points") >= least)
    kept = named.join(groups, ["frame_id", "label"], "left_semi")
    return placed.join(kept.select(*CELL, "label", F.col("n").alias("n_cell")), CELL), groups


def describe_groups(members: DataFrame, groups: DataFrame, typical: int = 3) -> DataFrame:
    """Size, mean and most typical members of every group.

    Typical are members of the densest cell (ties: the cell that comes first),
    those nearest the group's mean first (to nine digits of the square), then by point_id.
    """
    key = ["frame_id", "label"]
    cell = F.struct((-F.col("n_cell")).alias("n"), "gx", "gy", "gz")
    mean = members.groupBy(*key).agg(*[F.avg(f"p{c}").alias(f"m{c}") for c in "xyz"], F.min(cell).alias("dense"))
    inside = members.join(mean, key).where(cell == F.col("dense"))
    d2 = F.round(sum(((F.col(f"p{c}") - F.col(f"m{c}")) * (F.col(f"p{c}") - F.col(f"m{c}")) for c in "xyz"), F.lit(0.0)), 9)
    ranked = inside.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(d2, "point_id"))).where(F.col("rank") <= typical)
    top = ranked.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("rank", "point_id")))["point_id"].alias("central"))
    return groups.join(mean.drop("dense"), key).join(top, key).select("frame_id", F.col("label").alias("first_point_id"), "n_points", *[F.round(f"m{c}", 6).alias(c) for c in "xyz"], "central")
