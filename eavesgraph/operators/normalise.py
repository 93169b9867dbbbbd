"""Per-frame scaling: centroid and extent, cubes, z-scores, ranges, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")


def frame_stats(points: DataFrame) -> DataFrame:
    """(frame_id, cx, cy, cz, max_distance, cube_min, cube_max, n_points) by two aggregates.

    max_distance is the largest distance from the centroid, the cube holds all
    axes before centring. Both steps combine on the map side, so a frame of any
    size is no hot group.
    """
    mean = points.groupBy("frame_id").agg(*[F.avg(c).alias(f"c{c}") for c in XYZ], F.least(*[F.min(c) for c in XYZ]).alias("cube_min"), F.greatest(*[F.max(c) for c in XYZ]).alias("cube_max"), F.count("*").alias("n_points"))
    d2 = sum(((F.col(c) - F.col(f"c{c}")) * (F.col(c) - F.col(f"c{c}")) for c in XYZ), F.lit(0.0))
    far = points.join(mean, "frame_id").groupBy("frame_id").agg(F.sqrt(F.max(d2)).alias("max_distance"))
    return mean.join(far, "frame_id")


def normalise(points: DataFrame, stats: DataFrame) -> DataFrame:
    """Centre on the centroid and divide by max_distance; a frame of one place gives nulls."""
    j = points.join(stats.select("frame_id", "cx", "cy", "cz", "max_distance"), "frame_id")
    return j.withColumns({c: F.try_divide(F.col(c) - F.col(f"c{c}"), "max_distance") for c in XYZ}).drop("cx", "cy", "cz", "max_distance")


def denormalise(points: DataFrame, stats: DataFrame) -> DataFrame:
    """The inverse of normalise()."""
    j = points.join(stats.select("frame_id", "cx", "cy", "cz", "max_distance"), "frame_id")
    return j.withColumns({c: F.col(c) * F.col("max_distance") + F.col(f"c{c}") for c in XYZ}).drop("cx", "cy", "cz", "max_distance")


def box_stats(points: DataFrame) -> DataFrame:
    """(frame_id, cx, cy, cz, scale): the mean and the largest absolute coordinate about it (1 if that is 0)."""
    mean = points.groupBy("frame_id").agg(*[F.avg(c).alias(f"c{c}") for c in XYZ], *[F.min(c).alias(f"lo{c}") for c in XYZ], *[F.max(c).alias(f"hi{c}") for c in XYZ])
    scale = F.greatest(*[F.greatest(F.col(f"hi{c}") - F.col(f"c{c}"), F.col(f"c{c}") - F.col(f"lo{c}")) for c in XYZ])
    return mean.select("frame_id", "cx", "cy", "cz", F.when(scale == 0, 1.0).otherwise(scale).alias("scale"))


def unit_box(points: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Centre on the mean and divide by the largest absolute coordinate."""
    j = points.join(box_stats(points) if stats is None else stats, "frame_id")
    return j.withColumns({c: (F.col(c) - F.col(f"c{c}")) / F.col("scale") for c in XYZ}).drop("cx", "cy", "cz", "scale")


def from_unit_box(points: DataFrame, stats: DataFrame) -> DataFrame:
    """The inverse of unit_box() with the stats it used."""
    j = points.join(stats, "frame_id")
    return j.withColumns({c: F.col(c) * F.col("scale") + F.col(f"c{c}") for c in XYZ}).drop("cx", "cy", "cz", "scale")


def cube_scale(points: DataFrame, stats: DataFrame) -> DataFrame:
    """Scale all axes by one minimum and maximum."""
    j = points.join(stats.select("frame_id", "cube_min", "cube_max"), "frame_id")
    return j.withColumns({c: F.try_divide(F.col(c) - F.col("cube_min"), F.col("cube_max") - F.col("cube_min")) for c in XYZ}).drop("cube_min", "cube_max")


def _joined(df: DataFrame, columns: list[str], **aggs) -> DataFrame:
    made = [f(c).alias(f"_{n}_{c}") for n, f in aggs.items() for c in columns]
    return df.join(df.groupBy("frame_id").agg(*made), "frame_id")


def zscore(df: DataFrame, columns: list[str]) -> DataFrame:
    """(v - mean) / population deviation in each frame; a constant column gives null."""
    j = _joined(df, columns, mean=F.avg, sd=F.stddev_pop)
    out = {c: F.try_divide(F.col(c) - F.col(f"_mean_{c}"), F.when(F.col(f"_sd_{c}") > 1e-12, F.col(f"_sd_{c}"))) for c in columns}
    return j.withColumns(out).drop(*[f"_{n}_{c}" for n in ("mean", "sd") for c in columns])


def minmax(df: DataFrame, columns: list[str], guard: float = 1e-8) -> DataFrame:
    """(v - min) / (max - min + guard) in each frame."""
    j = _joined(df, columns, lo=F.min, hi=F.max)
    out = {c: (F.col(c) - F.col(f"_lo_{c}")) / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}") + guard) for c in columns}
    return j.withColumns(out).drop(*[f"_{n}_{c}" for n in ("lo", "hi") for c in columns])


def frame_draw(name: str, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the frame, a name and the seed only (portable: from md5)."""
    digest = F.md5(F.concat_ws("|", F.col("frame_id"), F.lit(name), F.lit(seed)).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def rotate_z(df: DataFrame, angle: Column | float) -> DataFrame:
    """Turn about the z axis by the angle in radians."""
    a = F.lit(angle) if isinstance(angle, (int, float)) else angle
    return df.withColumns({"x": F.col("x") * F.cos(a) - F.col("y") * F.sin(a), "y": F.col("x") * F.sin(a) + F.col("y") * F.cos(a)})


def augment(df: DataFrame, seed: int = 0, limit: float = 3.141592653589793 / 36) -> DataFrame:
    """Mirror x and y of half the frames each and turn every frame by up to ``limit``, the same for all its rows."""
    flip = lambda c: F.when(frame_draw(f"mirror_{c}", seed) > 0.5, -F.col(c)).otherwise(F.col(c))
    return rotate_z(df.withColumns({"x": flip("x"), "y": flip("y")}), (frame_draw("turn", seed) * 2 - 1) * limit)


def jitter(df: DataFrame, sigma: tuple[float, float] = (0.005, 0.010), clip: float = 10.0, share: float = 0.8, seed: int = 0) -> DataFrame:
    """Add clipped normal noise to xyz of a share of the frames; sigma is drawn for each frame, other columns stay.

    Draws depend on the frame, the point, the axis and the seed only (Box-Muller
    over md5), so a repeated task gives the same points.
    """
    s = F.lit(sigma[0]) + frame_draw("sigma", seed) * (sigma[1] - sigma[0])

    def noise(axis: str) -> Column:
        digest = F.md5(F.concat_ws("|", F.col("frame_id"), F.col("point_id").cast("string"), F.lit(axis), F.lit(seed)).cast("binary"))
        u, v = ((F.conv(F.substring(digest, at, 8), 16, 10).cast("double") + 1) / F.lit(4294967297.0) for at in (1, 9))
        normal = F.sqrt(-2 * F.ln(u)) * F.cos(v * (2 * 3.141592653589793))
        return F.least(F.greatest(normal * s, F.lit(-clip)), F.lit(clip))

    return df.withColumns({c: F.when(frame_draw("jitter", seed) < share, F.col(c) + noise(c)).otherwise(F.col(c)) for c in XYZ})


def running_offsets(df: DataFrame, by: list[str], order: list[str], n: str) -> DataFrame:
    """Add ``offset``: the sum of ``n`` over the rows before."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("offset", F.coalesce(F.sum(n).over(w), F.lit(0)))
