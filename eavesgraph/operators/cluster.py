"""Density and height-constrained clustering, centroids and merging of small clusters."""

from __future__ import annotations

import math
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eavesgraph.operators import local
from eavesgraph.operators.cells import boxed, cell_links, cell_side, with_cells
from eavesgraph.operators.components import components, minimum_labels
from eavesgraph.operators.spatial import XYZ, knn, radius_pairs
from eavesgraph.session import broadcast_if_small, multiplied, written

#: Rows of a frame up to which segments() cuts it in one task.
SEGMENTED = 2_500_000


def _numbered(labels: DataFrame) -> DataFrame:
    """Clusters of a frame numbered from 0 by their smallest member."""
    groups = labels.select("frame_id", "label").distinct()
    ranked = groups.withColumn("cluster_id", F.row_number().over(Window.partitionBy("frame_id").orderBy("label")) - 1)
    return labels.join(ranked, ["frame_id", "label"])


def dbscan(points: DataFrame, eps: float, min_pts: int) -> DataFrame:
    """(frame_id, point_id, cluster_id, is_core): density clusters of each frame, noise with a null cluster.

    Neighbours are at most eps away, the point itself does not count, and a
    point with min_pts neighbours is core. Clusters are the connected cores,
    numbered by their smallest core; a border point joins the lowest numbered
    cluster among its core neighbours. The result does not depend on the order
    of rows. Frames without a cluster come out as noise only.

    Cells of a diagonal under eps that hold more than min_pts points are all
    core without looking at pairs; only points of emptier cells are compared
    with their surroundings. Connected cells, not points, are the nodes of the
    components, so dense places cost no more than their points.
    """
    side = cell_side(eps)
    own, _ = written(with_cells(points.select("frame_id", "point_id", *[F.col(c).alias(f"p{c}") for c in XYZ]), side), "placed")
    cell = ["frame_id", "gx", "gy", "gz"]
    count = own.groupBy(*cell).agg(F.count("*").alias("_n"))
    own, _ = written(own.join(count, cell).withColumn("dense", F.col("_n") > min_pts).drop("_n"), "sized")
    plain = lambda df: df.select("frame_id", "point_id", *[F.col(f"p{c}").alias(c) for c in XYZ])
    sparse = own.where("not dense")
    pairs, _ = written(radius_pairs(plain(sparse), plain(own), eps, inclusive=True).where("query_id <> target_id").select("frame_id", F.col("query_id").alias("point_id"), "target_id"), "pairs")
    enough = pairs.groupBy("frame_id", "point_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_pts).select("frame_id", "point_id")
    core, _ = written(own.where("dense").unionByName(sparse.join(enough, ["frame_id", "point_id"], "left_semi")).drop("dense"), "core")
    cells, _ = written(boxed(core), "core-cells")
    named = components(cells, cell_links(core, cells, eps, side))
    cells = cells.select(*cell, "u").join(_numbered(named), ["frame_id", "u"])
    cores, _ = written(core.join(cells, cell).select("frame_id", "point_id", "cluster_id"), "cores")
    reach = pairs.join(cores.withColumnRenamed("point_id", "target_id"), ["frame_id", "target_id"]).groupBy("frame_id", "point_id").agg(F.min("cluster_id").alias("border_id"))
    j = own.select("frame_id", "point_id").join(cores, ["frame_id", "point_id"], "left").join(reach, ["frame_id", "point_id"], "left")
    return j.select("frame_id", "point_id", F.coalesce("cluster_id", "border_id").alias("cluster_id"), F.col("cluster_id").isNotNull().alias("is_core"))


def centroids(points: DataFrame, labels: DataFrame) -> DataFrame:
    """(frame_id, corner_id, n_members, x, y, z): mean of the members of each cluster, noise skipped."""
    j = points.select("frame_id", "point_id", *XYZ).join(labels.where("cluster_id is not null").select("frame_id", "point_id", "cluster_id"), ["frame_id", "point_id"])
    return j.groupBy("frame_id", F.col("cluster_id").alias("corner_id")).agg(F.count("*").alias("n_members"), *[F.avg(c).alias(c) for c in XYZ])


def height_components(points: DataFrame, distance: float, height: float, key: str = "point_id") -> DataFrame:
    """(frame_id, key, cluster_id): components of the steps shorter than ``distance`` that rise less than ``height``.

    Members of a cell are always linked, so cells are the nodes. Cells whose
    boxes decide are joined first; the points of two cells are compared only
    where their boxes leave it open and they are not yet together, so the result
    is exact. Rows with a coordinate that is null, not finite or beyond 1e12
    stay alone.
    """
    sound = F.coalesce(reduce(lambda a, b: a & b, [F.abs(c) < 1e12 for c in XYZ]), F.lit(False))
    p, _ = written(points.select("frame_id", F.col(key).alias("u"), *XYZ, sound.alias("_sound")), "members")
    if not (distance > 0 and height > 0):
        return _numbered(p.select("frame_id", "u", F.col("u").alias("label"))).select("frame_id", F.col("u").alias(key), "cluster_id")
    tall = 0.999 * min(height, distance / 2)
    wide = 0.999 * math.sqrt((distance * distance - tall * tall) / 2)
    edge = {"x": wide, "y": wide, "z": tall}
    at = p.where("_sound").select("frame_id", "u", *XYZ, *[F.floor(F.col(c) / edge[c]).alias(f"_c{c}") for c in XYZ])
    cell = ["frame_id", "_cx", "_cy", "_cz"]
    cells, _ = written(at.groupBy(*cell).agg(F.min("u").alias("node"), *[g(c).alias(f"{n}{c}") for c in XYZ for g, n in ((F.min, "lo"), (F.max, "hi"))]), "cells")
    own, _ = written(at.join(cells.select(*cell, "node"), cell).select("frame_id", "node", "u", *XYZ), "own")

    reach = {c: math.ceil(distance / wide) if c != "z" else math.ceil(min(height, distance) / tall) for c in XYZ}
    steps = [o for o in product(*[range(-reach[c], reach[c] + 1) for c in XYZ]) if o > (0, 0, 0)]
    box = lambda n: [F.col(f"{e}{c}").alias(f"{n}{e}{c}") for c in XYZ for e in ("lo", "hi")]
    around = F.explode(F.array(*[F.struct(*[F.lit(d).alias(c) for d, c in zip(o, XYZ)]) for o in steps]))
    a = cells.select("frame_id", F.col("node").alias("u"), *box("a"), *cell[1:], around.alias("_o")).withColumns({f"_c{c}": F.col(f"_c{c}") + F.col(f"_o.{c}") for c in XYZ}).drop("_o")
    b = cells.select(*cell, F.col("node").alias("v"), *box("b"))
    apart = {c: F.greatest(F.lit(0.0), F.col(f"blo{c}") - F.col(f"ahi{c}"), F.col(f"alo{c}") - F.col(f"bhi{c}")) for c in XYZ}
    span = {c: F.greatest(f"ahi{c}", f"bhi{c}") - F.least(f"alo{c}", f"blo{c}") for c in XYZ}
    within = lambda d: (d["x"] * d["x"] + d["y"] * d["y"] + d["z"] * d["z"] < distance * distance) & (F.abs(d["z"]) < height)
    pairs, _ = written(multiplied(a).join(b, cell).where(within(apart)).withColumn("_sure", within(span)).drop(*cell[1:]), "cell_pairs")

    nodes = cells.select("frame_id", F.col("node").alias("u"))
    first, _ = written(components(nodes, pairs.where("_sure").select("frame_id", "u", "v")), "first")
    side = lambda c: first.select("frame_id", F.col("u").alias(c), F.col("label").alias(f"l{c}"))
    undecided, _ = written(pairs.where("not _sure").join(side("u"), ["frame_id", "u"]).join(side("v"), ["frame_id", "v"]).where("lu <> lv"), "undecided")

    def near(end: str, other: str, name: str) -> DataFrame:
        j = undecided.join(own.select("frame_id", F.col("node").alias(end), *[F.col(c).alias(f"{name}{c}") for c in XYZ]), ["frame_id", end])
        gap = {c: F.greatest(F.lit(0.0), F.col(f"{other}lo{c}") - F.col(f"{name}{c}"), F.col(f"{name}{c}") - F.col(f"{other}hi{c}")) for c in XYZ}
        return j.where(within(gap)).select("frame_id", "u", "v", "lu", "lv", *[f"{name}{c}" for c in XYZ])

    met = near("u", "b", "q").join(near("v", "a", "t").drop("lu", "lv"), ["frame_id", "u", "v"]).where(within({c: F.col(f"q{c}") - F.col(f"t{c}") for c in XYZ}))
    last = minimum_labels(met.select("frame_id", F.col("lu").alias("u"), F.col("lv").alias("v")).distinct()).select("frame_id", F.col("u").alias("label"), F.col("label").alias("_last"))
    final = first.join(last, ["frame_id", "label"], "left").select("frame_id", F.col("u").alias("node"), F.coalesce("_last", "label").alias("label"))
    alone = p.where("not _sound").select("frame_id", "u", F.col("u").alias("label"))
    labels, _ = written(own.join(final, ["frame_id", "node"]).select("frame_id", "u", "label").unionByName(alone), "labelled")
    return _numbered(labels).select("frame_id", F.col("u").alias(key), "cluster_id")


def merge_small(points: DataFrame, labels: DataFrame, min_points: int, key: str = "point_id", samples: Column | None = None) -> DataFrame:
    """(frame_id, key, cluster_id): members of clusters under min_points go, one by one, to the cluster of the nearest member of a large one.

    samples: condition on ``points``; only rows that meet it count for the size
    of a cluster and draw others to it, but all rows of small clusters move.
    Frames without a large cluster stay as they are. Ties of distance go to the
    lower id. Clusters are renumbered from 0 in their old order.
    """
    labels, _ = written(labels, "merging")
    sample = F.lit(True) if samples is None else F.coalesce(samples, F.lit(False))
    placed = labels.join(points.select("frame_id", key, *XYZ, sample.alias("_sample")), ["frame_id", key])
    sizes = placed.groupBy("frame_id", "cluster_id").agg((F.count_if("_sample") >= min_points).alias("large"))
    both, _ = written(placed.join(sizes, ["frame_id", "cluster_id"]), "sized")
    any_large = sizes.where("large").select("frame_id").distinct()
    movers = both.where("not large").join(any_large, "frame_id", "left_semi")
    host = both.where("large and _sample")
    to = knn(movers, host, 1, key, key).join(host.select("frame_id", F.col(key).alias("target_id"), F.col("cluster_id").alias("to_id")), ["frame_id", "target_id"]).select("frame_id", F.col("query_id").alias(key), "to_id")
    moved = labels.join(to, ["frame_id", key], "left").select("frame_id", key, F.coalesce("to_id", "cluster_id").alias("label"))
    return _numbered(moved).select("frame_id", key, "cluster_id")


def segments(both: DataFrame, distance: float, height: float, min_points: int, whole: int = SEGMENTED) -> DataFrame:
    """(frame_id, member_id, cluster_id): height_components() of the samples and vertices of members(), those under ``min_points`` samples merged by merge_small().

    Repeated rows count once. Frames of up to ``whole`` rows are cut in one task
    each (local.segments()), larger ones by tables.
    """
    fine = distance > 0 and height > 0
    sizes = both.groupBy("frame_id").count()
    large, _ = written(sizes.where((F.col("count") > (whole if fine else 0)) & F.col("frame_id").isNotNull()).select("frame_id"), "large-frames")
    small = both if large.isEmpty() else both.join(broadcast_if_small(large), "frame_id", "left_anti")
    parts, _ = written(local.segments(small, distance, height, min_points, -1, scaled=False).select("frame_id", "member_id", "cluster_id"), "parts")
    left, _ = written(large.unionByName(parts.where(F.col("cluster_id") == local.OPEN).select("frame_id").distinct()), "by-tables")
    if left.isEmpty():
        return parts
    rest, _ = written(both.join(broadcast_if_small(left), "frame_id", "left_semi").distinct(), "union")
    labels = merge_small(rest, height_components(rest, distance, height, "member_id"), min_points, "member_id", F.col("kind") == "sample")
    return parts.where(F.col("cluster_id") != local.OPEN).unionByName(labels)


def _nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """For each row of x the nearest centre, ties to the lower one; no table of all distances is held."""
    if x.shape[1] == 3:
        return local.closest(x, centres)
    step = max(1, local.HELD // centres.size)
    return np.concatenate([((x[i : i + step, None] - centres) ** 2).sum(2).argmin(1) for i in range(0, len(x), step)])


def _seeds(x: np.ndarray, k: int, rng: np.random.Generator, few: int = 1_000_000) -> list[int]:
    """Rows of x drawn by k-means++, fewer than k where no other place is left.

    Beyond ``few`` rows times draws the sums of the distances are kept by blocks
    of rows, and a draw changes only the leaves of the cloud that it comes near to.
    """
    at = [int(rng.integers(len(x)))]
    d = ((x - x[at[0]]) ** 2).sum(1)
    if len(x) * k <= few:
        while len(at) < k and d.sum() > 0:
            at.append(int(rng.choice(len(x), p=d / d.sum())))
            d = np.minimum(d, ((x - x[at[-1]]) ** 2).sum(1))
        return at
    leaves = local._leaves(x)
    lo, hi = np.stack([x[r].min(0) for r in leaves]), np.stack([x[r].max(0) for r in leaves])
    size = np.array([len(r) for r in leaves])
    held = np.stack([np.pad(r, (0, size.max() - len(r)), mode="edge") for r in leaves])
    first = np.arange(0, len(x), 512)
    sums = np.add.reduceat(d, first)
    top = d[held].max(1)
    exact = total = sums.sum()
    for i in range(1, k):
        if i % 256 == 0 or total < exact / 2:  # what was taken off leaves the error of larger sums
            sums = np.add.reduceat(d, first)
            exact = total = sums.sum()
        if not total > 0:
            break
        u = rng.random()
        ends = sums.cumsum()
        b = min(int(ends.searchsorted(u * ends[-1], "right")), len(first) - 1)
        inside = d[first[b] : first[b] + 512].cumsum()
        j = first[b] + int(inside.searchsorted(u * ends[-1] - (ends[b - 1] if b else 0), "right"))
        if j >= first[b] + len(inside) or not d[j] > 0:
            ends = d.cumsum()
            j = min(int(ends.searchsorted(u * ends[-1], "right")), int(np.flatnonzero(d)[-1]))
        at.append(j)
        met = np.flatnonzero((np.maximum(0, np.maximum(lo - x[j], x[j] - hi)) ** 2).sum(1) < top)
        rows = held[met][np.arange(held.shape[1]) < size[met, None]]
        new = ((x[rows] - x[j]) ** 2).sum(1)
        less = new < d[rows]
        rows, new = rows[less], new[less]
        sums -= np.bincount(rows // 512, d[rows] - new, len(sums))
        np.maximum(sums, 0, out=sums)
        d[rows] = new
        top[met] = d[held[met]].max(1)
        total = sums.sum()
    return at


def kmeans(points: DataFrame, columns: list[str], clusters, rounds: int = 20, seed: int = 42) -> DataFrame:
    """(frame_id, point_id, cluster_id): k-means of each frame, seeded by k-means++.

    clusters: a number, or the name of a column that holds the number for the
    row's frame. Frames are independent, and one task holds one frame, but
    never the distances of all its points to all centres.
    """
    fixed = isinstance(clusters, int)
    src = points.select("frame_id", "point_id", *columns, *([] if fixed else [F.col(clusters).alias("_k")]))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point_id", kind="stable")
        x = pdf[columns].to_numpy(float)
        k = max(1, min(len(x), clusters if fixed else int(pdf["_k"].iloc[0])))
        centres = x[_seeds(x, k, np.random.default_rng(seed))]
        for _ in range(rounds):
            own = _nearest_centre(x, centres)
            n = np.bincount(own, minlength=len(centres))
            sums = np.stack([np.bincount(own, v, len(centres)) for v in x.T], 1)
            new = np.where((n > 0)[:, None], sums / np.maximum(n, 1)[:, None], centres)
            if np.allclose(new, centres):
                break
            centres = new
        return pd.DataFrame({"frame_id": pdf["frame_id"], "point_id": pdf["point_id"], "cluster_id": own.astype("int32")})

    return src.groupBy("frame_id").applyInPandas(run, "frame_id string, point_id long, cluster_id int")


def estimated_clusters(points: DataFrame, radius: float, most: int | None = None) -> DataFrame:
    """(frame_id, k): the number of clusters from the mean distance to the nearest other point; at most half the points, and ``most`` if given."""
    near = knn(points, points, 1, "point_id", "point_id", with_self=False)
    spacing = near.groupBy("frame_id").agg(F.avg("dist").alias("d"), F.count("*").alias("n"))
    k = F.floor(F.col("n") * F.col("d") / radius)
    k = k if most is None else F.least(k, F.lit(most))
    return spacing.select("frame_id", F.greatest(F.lit(1), F.least(k, F.floor(F.col("n") / 2))).cast("int").alias("k"))
