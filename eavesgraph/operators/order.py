"""Positions along curves, patches of fixed size, voxels and offsets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eavesgraph.functions import curves
from eavesgraph.session import written

XYZ = ("x", "y", "z")


def quantise(points: DataFrame, grid: float) -> DataFrame:
    """Add gx, gy, gz: whole steps of ``grid`` above the minimum of the frame."""
    low = points.groupBy("frame_id").agg(*[F.min(c).alias(f"lo{c}") for c in XYZ])
    j = points.join(low, "frame_id")
    return j.withColumns({f"g{c}": F.floor((F.col(c) - F.col(f"lo{c}")) / grid) for c in XYZ}).drop("lox", "loy", "loz")


def row_numbers(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Add the position from 0 of each row in its key, without one task for a hot key.

    Rows are dealt by ranges of (keys, order) and written; each range numbers
    its own rows, and the counts of the ranges before are added.
    """
    ranged, _ = written(df.repartitionByRange(*keys, *order).withColumn("_p", F.spark_partition_id()), "ranged")
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offset = ranged.groupBy(*keys, "_p").agg(F.count("*").alias("_n")).withColumn("_o", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = ranged.withColumn("_i", F.row_number().over(Window.partitionBy(*keys, "_p").orderBy(*order)) - 1)
    return local.join(offset, [*keys, "_p"]).withColumn(name, F.col("_i") + F.col("_o")).drop("_i", "_o", "_p")


def serialise(points: DataFrame, grid: float, order: str = "z", depth: int = curves.DEPTH, wrap: bool = False) -> DataFrame:
    """(frame_id, point_id, code, position): the place of each point along a curve of its frame; ties by point_id.

    wrap: of coordinates of more than ``depth`` bits the lowest count, so the
    curve of a wide frame begins again every 2^depth steps; else they are an error.
    """
    at = [curves.wrapped(F.col(c), depth) if wrap else F.col(c) for c in ("gx", "gy", "gz")]
    coded = quantise(points, grid).select("frame_id", "point_id", curves.encode(order, *at, depth).alias("code"))
    return row_numbers(coded, ["frame_id"], ["code", "point_id"], "position")


def patches(serial: DataFrame, size: int) -> DataFrame:
    """(frame_id, point_id, patch, slot, filler): blocks of ``size`` along the curve.

    The last block of a frame larger than one block is filled up with the rows
    just before it (filler = true).
    """
    n = serial.groupBy("frame_id").agg(F.count("*").alias("n"))
    own = serial.join(n, "frame_id").withColumn("patch", F.floor(F.col("position") / size)).withColumn("slot", F.col("position") % size)
    last = F.floor((F.col("n") - 1) / size)
    missing = (last + 1) * size - F.col("n")
    tail = own.where((F.col("n") > size) & (F.col("patch") == last - 1) & (F.col("slot") >= size - missing))
    fill = tail.withColumn("patch", last)
    cols = ["frame_id", "point_id", "patch", "slot"]
    return own.select(*cols, F.lit(False).alias("filler")).unionByName(fill.select(*cols, F.lit(True).alias("filler")))


def voxel_pool(points: DataFrame, grid: float, columns: list[str], shift: int = 0, reduce=F.max) -> DataFrame:
    """(frame_id, voxel, n_points, first_id, mean x y z, columns): one row per occupied voxel, 2^shift grid steps wide."""
    q = quantise(points, grid)
    voxel = F.shiftright(curves.morton(F.col("gx"), F.col("gy"), F.col("gz")), 3 * shift).alias("voxel")
    return q.groupBy("frame_id", voxel).agg(F.count("*").alias("n_points"), F.min("point_id").alias("first_id"), *[F.avg(c).alias(c) for c in XYZ], *[reduce(c).alias(c) for c in columns])


def voxel_unpool(points: DataFrame, pooled: DataFrame, grid: float, column: str, shift: int = 0) -> DataFrame:
    """(frame_id, point_id, value): the point's own value plus that of its voxel."""
    q = quantise(points, grid).withColumn("voxel", F.shiftright(curves.morton(F.col("gx"), F.col("gy"), F.col("gz")), 3 * shift))
    j = q.join(pooled.select("frame_id", "voxel", F.col(column).alias("_v")), ["frame_id", "voxel"])
    return j.select("frame_id", "point_id", (F.col(column) + F.col("_v")).alias("value"))


def voxel_neighbours(points: DataFrame, grid: float, reach: int = 1) -> DataFrame:
    """(frame_id, gx, gy, gz, n_neighbours): occupied voxels within ``reach`` steps on every axis, the voxel itself not counted."""
    v = quantise(points, grid).select("frame_id", "gx", "gy", "gz").distinct()
    steps = [(i, j, k) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) for k in range(-reach, reach + 1) if (i, j, k) != (0, 0, 0)]
    off = F.explode(F.array(*[F.struct(*[F.lit(d).cast("long").alias(c) for d, c in zip(s, XYZ)]) for s in steps]))
    seen = v.withColumn("o", off).select("frame_id", *[(F.col(f"g{c}") + F.col(f"o.{c}")).alias(f"g{c}") for c in XYZ])
    hit = seen.groupBy("frame_id", "gx", "gy", "gz").agg(F.count("*").alias("n"))
    return v.join(hit, ["frame_id", "gx", "gy", "gz"], "left").select("frame_id", "gx", "gy", "gz", F.coalesce("n", F.lit(0)).cast("long").alias("n_neighbours"))


def voxel_groups(points: DataFrame, grid: float, shift: int = 0) -> DataFrame:
    """(frame_id, point_id, group_id, n_points): the number from 0 of the point's voxel among those of its frame, in order of code, and its points."""
    q = quantise(points, grid)
    coded = q.select("frame_id", "point_id", F.shiftright(curves.morton(F.col("gx"), F.col("gy"), F.col("gz")), 3 * shift).alias("voxel"))
    groups = row_numbers(coded.groupBy("frame_id", "voxel").agg(F.count("*").alias("n_points")), ["frame_id"], ["voxel"], "group_id")
    return coded.join(groups, ["frame_id", "voxel"]).select("frame_id", "point_id", "group_id", "n_points")


def relative_positions(serial: DataFrame, points: DataFrame, grid: float, size: int) -> DataFrame:
    """(frame_id, patch, a, b, dx, dy, dz): grid steps from slot b to slot a for all pairs of slots of a patch of ``size``."""
    q = quantise(points, grid).select("frame_id", "point_id", "gx", "gy", "gz")
    p = patches(serial, size).join(q, ["frame_id", "point_id"]).select("frame_id", "patch", "slot", "gx", "gy", "gz")
    a, b = (p.select("frame_id", "patch", F.col("slot").alias(n), *[F.col(f"g{c}").alias(f"{n}{c}") for c in XYZ]) for n in "ab")
    return a.join(b, ["frame_id", "patch"]).select("frame_id", "patch", "a", "b", *[(F.col(f"a{c}") - F.col(f"b{c}")).alias(f"d{c}") for c in XYZ])


def counts_of(offsets: DataFrame, by: list[str], order: list[str], offset: str = "offset") -> DataFrame:
    """Add ``count``: each running total less the one before it (0 for the first)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return offsets.withColumn("count", F.col(offset) - F.coalesce(F.lag(offset).over(w), F.lit(0)))


def frame_offsets(points: DataFrame) -> DataFrame:
    """(frame_id, n_points, offset): rows of each frame and of those before it by frame_id.

    Counts are small (one row a frame) before they are numbered.
    """
    counts = points.groupBy("frame_id").agg(F.count("*").alias("n_points"))
    ranged, _ = written(counts.repartitionByRange("frame_id").withColumn("_p", F.spark_partition_id()), "counts")
    part = ranged.groupBy("_p").agg(F.sum("n_points").alias("s")).withColumn("b", F.coalesce(F.sum("s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("s")
    inner = Window.partitionBy("_p").orderBy("frame_id").rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("_i", F.coalesce(F.sum("n_points").over(inner), F.lit(0)))
    return local.join(F.broadcast(part), "_p").select("frame_id", "n_points", (F.col("_i") + F.col("b")).alias("offset"))


def haar_levels(value: Column, by: list[str], position: str, levels: int = 3) -> list[Column]:
    """Mean of the block of 2^level rows along the position that a row lies in (approximation of a db1 wavelet, up to scale)."""
    return [F.avg(value).over(Window.partitionBy(*by, F.floor(F.col(position) / 2**k))).alias(f"approx_{k}") for k in range(1, levels + 1)]


def haar_transform(df: DataFrame, value: str, position: str, levels: int = 3) -> DataFrame:
    """Coefficients of the db1 wavelet along the positions of each frame: (frame_id, level, k, approx, detail).

    Level 1 joins the rows 2k and 2k + 1: approx is their sum and detail their
    difference over the root of 2; the next level does so with the approximations.
    A row without a partner is met by itself. Each level is an aggregate, so a frame is spread over tasks.
    """
    cur, out = df.select("frame_id", F.col(position).cast("long").alias("k"), F.col(value).alias("approx")), []
    for level in range(1, levels + 1):
        even = F.col("k") % 2 == 0
        pair = cur.groupBy("frame_id", F.floor(F.col("k") / 2).alias("k")).agg(F.max(F.when(even, F.col("approx"))).alias("a"), F.max(F.when(~even, F.col("approx"))).alias("b"))
        b = F.coalesce("b", "a")
        cur = pair.select("frame_id", "k", ((F.col("a") + b) / F.sqrt(F.lit(2.0))).alias("approx"), ((F.col("a") - b) / F.sqrt(F.lit(2.0))).alias("detail"))
        cur, _ = written(cur, "level")
        out.append(cur.select("frame_id", F.lit(level).alias("level"), "k", "approx", "detail"))
        cur = cur.select("frame_id", "k", "approx")
    return reduce(DataFrame.unionByName, out)


def upsampled(coefficients: DataFrame, level: int, positions: DataFrame, position: str = "pos", column: str = "approx") -> DataFrame:
    """(frame_id, position, value): a level of haar_transform() drawn out linearly to the rows' positions, its ends held.

    The coefficient k stands at the middle of its 2^level rows.
    """
    c = coefficients.where(F.col("level") == level).select("frame_id", "k", F.col(column).alias("v"))
    last = c.groupBy("frame_id").agg(F.max("k").alias("last"))
    x = (F.col(position) + 0.5) / F.lit(float(2**level)) - 0.5
    p = positions.select("frame_id", position).join(last, "frame_id").withColumn("x", F.greatest(F.lit(0.0), F.least(x, F.col("last").cast("double"))))
    p = p.withColumns({"k0": F.floor("x"), "k1": F.least(F.floor("x") + 1, F.col("last"))})
    at = lambda n: c.select("frame_id", F.col("k").alias(f"k{n}"), F.col("v").alias(f"v{n}"))
    j = p.join(at(0), ["frame_id", "k0"]).join(at(1), ["frame_id", "k1"])
    return j.select("frame_id", position, (F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("x") - F.col("k0"))).alias("value"))
