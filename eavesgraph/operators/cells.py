"""Links between the cells of a grid that hold points within reach of each other, however full the cells are."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eavesgraph.session import multiplied, written

XYZ = ("x", "y", "z")
#: Cells along an edge of a block; blocks are the join key of adjacent cells.
BLOCK = 8
#: Pairs of points of two cells that are compared one by one; fuller cells are halved first.
DIRECT = 4096


def cell_side(eps: float) -> float:
    """The edge of cells whose diagonal is just under eps."""
    return eps / 3**0.5 * 0.9995


def with_cells(points: DataFrame, side: float) -> DataFrame:
    """Add gx, gy, gz, the cell of the place px, py, pz."""
    return points.withColumns({f"g{c}": F.floor(F.col(f"p{c}") / side) for c in XYZ})


def boxed(placed: DataFrame, key: str = "point_id") -> DataFrame:
    """Cells with the number of their points, the smallest id and the bounds of the places."""
    box = [f(F.col(f"p{c}")).alias(f"{e}{c}") for c in XYZ for e, f in (("lo", F.min), ("hi", F.max))]
    return placed.groupBy("frame_id", "gx", "gy", "gz").agg(F.count("*").alias("n"), F.min(key).alias("u"), *box)


def _square(terms: list[Column]) -> Column:
    return sum((t * t for t in terms[1:]), terms[0] * terms[0])


def _gap() -> Column:
    return _square([F.greatest(F.lit(0.0), F.col(f"blo{c}") - F.col(f"ahi{c}"), F.col(f"alo{c}") - F.col(f"bhi{c}")) for c in XYZ])


def _span() -> Column:
    return _square([F.greatest(F.col(f"bhi{c}") - F.col(f"alo{c}"), F.col(f"ahi{c}") - F.col(f"blo{c}")) for c in XYZ])


def _side(cells: DataFrame, s: str) -> list[Column]:
    return [F.col("n").alias(f"{s}n"), *[F.col(f"g{c}").alias(f"{s}g{c}") for c in XYZ], *[F.col(f"{e}{c}").alias(f"{s}{e}{c}") for e in ("lo", "hi") for c in XYZ]]


def _compared(open_: DataFrame, placed: DataFrame, eps: float) -> DataFrame:
    """(frame_id, u, v) of open pairs of cells that hold points at most eps apart; of a cell only points within eps of the other's box are compared."""
    of = lambda s: placed.select("frame_id", *[F.col(f"g{c}").alias(f"{s}g{c}") for c in XYZ], *[F.col(f"p{c}").alias(f"{s}{c}") for c in XYZ])
    one = open_.join(of("a"), ["frame_id", "agx", "agy", "agz"])
    out = [F.greatest(F.lit(0.0), F.col(f"blo{c}") - F.col(f"a{c}"), F.col(f"a{c}") - F.col(f"bhi{c}")) for c in XYZ]
    one = one.where(_square(out) <= eps * eps).select("frame_id", "u", "v", "bgx", "bgy", "bgz", "ax", "ay", "az")
    two = one.join(of("b"), ["frame_id", "bgx", "bgy", "bgz"]).where(_square([F.col(f"a{c}") - F.col(f"b{c}") for c in XYZ]) <= eps * eps)
    return two.select("frame_id", "u", "v").distinct()


def cell_links(placed: DataFrame, cells: DataFrame, eps: float, side: float, direct: int = DIRECT) -> DataFrame:
    """(frame_id, u, v), u < v: pairs of cells that hold points at most eps apart.

    placed: points with places and cells (with_cells); cells: boxed() of them.
    A cell meets those of the blocks that its bounding box, widened by eps,
    touches. Boxes within eps as a whole are linked, boxes farther apart are
    not. Of the rest, pairs of at most ``direct`` pairs of points are compared
    by their points. Fuller cells are halved along each axis, and the boxes of
    the halves decide, level by level, until every pair is linked, ruled out or
    small; a part whose points lie at one place always decides. So no pair of
    cells costs more than its parts near the limit, however many points pile up.
    """
    block = lambda c: F.floor(c / BLOCK)
    a = cells
    for c in XYZ:
        a = a.select("*", F.explode(F.sequence(block(F.floor((F.col(f"lo{c}") - eps) / side)), block(F.floor((F.col(f"hi{c}") + eps) / side)))).alias(f"b{c}"))
    a = a.select("frame_id", "bx", "by", "bz", "u", *_side(a, "a"))
    b = cells.select("frame_id", *[block(F.col(f"g{c}")).alias(f"b{c}") for c in XYZ], F.col("u").alias("v"), *_side(cells, "b"))
    near = multiplied(a).join(b, ["frame_id", "bx", "by", "bz"]).where((F.col("u") < F.col("v")) & (_gap() <= eps * eps)).withColumn("sure", _span() <= eps * eps)
    near, _ = written(near.drop("bx", "by", "bz"), "near-cells")
    small = F.col("an") * F.col("bn") <= direct
    found = [near.where("sure").select("frame_id", "u", "v"), _compared(near.where(~F.col("sure") & small), placed, eps)]
    full = near.where(~F.col("sure") & ~small)
    level = 0
    while not full.isEmpty():
        level += 1
        halves = lambda s: F.floor(F.col(f"p{s}") / (side / 2**level))
        part = with_cells(placed.join(full.select("frame_id", *[F.explode(F.array(*[F.struct(*[F.col(f"{s}g{c}").alias(f"g{c}") for c in XYZ]) for s in "ab"])).alias("g")]).select("frame_id", "g.*").distinct(), ["frame_id", "gx", "gy", "gz"]).withColumnsRenamed({f"g{c}": f"o{c}" for c in XYZ}), side / 2**level)
        part, _ = written(part, "parts")
        boxes, _ = written(boxed(part.withColumn("point_id", F.lit(0)).withColumns({f"g{c}": halves(c) for c in XYZ})).drop("u").join(part.select("frame_id", "gx", "gy", "gz", *[f"o{c}" for c in XYZ]).distinct(), ["frame_id", "gx", "gy", "gz"]), "boxes")
        of = lambda s: boxes.select("frame_id", *[F.col(f"o{c}").alias(f"{s}o{c}") for c in XYZ], *_side(boxes, s))
        pairs = full.select("frame_id", "u", "v", *[F.col(f"{s}g{c}").alias(f"{s}o{c}") for s in "ab" for c in XYZ])
        met = pairs.join(of("a"), ["frame_id", "aox", "aoy", "aoz"]).join(of("b"), ["frame_id", "box", "boy", "boz"]).where(_gap() <= eps * eps)
        met, _ = written(met.withColumn("sure", _span() <= eps * eps), "half-cells")
        sure, _ = written(met.where("sure").select("frame_id", "u", "v").distinct(), "decided")
        rest = met.where("not sure").join(sure, ["frame_id", "u", "v"], "left_anti")
        found += [sure, _compared(rest.where(small), part, eps)]
        placed, full = part.drop("ox", "oy", "oz"), rest.where(~small)
    return reduce(DataFrame.unionByName, found).distinct() if level else reduce(DataFrame.unionByName, found)
