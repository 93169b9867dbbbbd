"""Optimal assignment of predicted to true corners, and the counters made from it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eavesgraph.operators.wireframe import edge_membership

XYZ = ("x", "y", "z")


class Distances:
    """The matrix of distances of two sets of places as assign() reads it: a row at a time, made when it is asked for."""

    def __init__(self, a: np.ndarray, b: np.ndarray, guard: float = 0.0):
        self.a, self.b, self.guard, self.shape = a, b, guard, (len(a), len(b))

    @property
    def T(self) -> Distances:
        return Distances(self.b, self.a, self.guard)

    def __getitem__(self, at) -> np.ndarray:
        r, c = at if isinstance(at, tuple) else (at, slice(None))
        return np.sqrt(((self.a[r] - self.b[c]) ** 2).sum(-1) + self.guard)


def assign(cost: np.ndarray | Distances) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of a cheapest assignment of a rectangular cost matrix.

    Shortest augmenting paths with dual prices; the inner step runs on whole
    rows. Of equally short ways the lowest column is taken.
    """
    if cost.shape[0] > cost.shape[1]:
        c, r = assign(cost.T)
        order = np.argsort(r)
        return r[order], c[order]
    n, m = cost.shape
    u, v = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for i in range(n):
        dist, back = np.full(m, np.inf), np.full(m, -1)
        done = np.zeros(m, bool)
        row, base, last = i, 0.0, -1
        while True:
            way = base + cost[row] - u[row] - v
            better = ~done & (way < dist)
            dist[better], back[better] = way[better], last
            j = int(np.where(done, np.inf, dist).argmin())
            done[j], base, last = True, dist[j], j
            if owner[j] < 0:
                break
            row = owner[j]
        seen = np.flatnonzero(done)
        seen = seen[seen != last]
        u[owner[seen]] += base - dist[seen]
        v[seen] -= base - dist[seen]
        u[i] += base
        while last >= 0:
            prev = back[last]
            owner[last] = i if prev < 0 else owner[prev]
            last = prev
    cols = np.flatnonzero(owner >= 0)
    order = np.argsort(owner[cols])
    return owner[cols][order], cols[order]


def match_corners(predicted: DataFrame, truth: DataFrame, guard: float = 0.0) -> DataFrame:
    """(frame_id, corner_id, vertex_id, dist): the cheapest assignment in each frame; the smaller side is matched whole.

    guard is added under the root of the squared distance. One task holds the
    corners of one frame, not its points, and of the distances one row at a time.
    """
    p = predicted.select("frame_id", F.col("corner_id").alias("p_id"), *[F.col(c).alias(f"p{c}") for c in XYZ])
    t = truth.select(F.col("frame_id").alias("t_frame"), F.col("vertex_id").alias("t_id"), *[F.col(c).alias(f"t{c}") for c in XYZ])

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"frame_id": np.zeros(0, object), "corner_id": np.zeros(0, np.int32), "vertex_id": np.zeros(0, np.int32), "dist": np.zeros(0)})
        a, b = a.sort_values("p_id", kind="stable"), b.sort_values("t_id", kind="stable")
        d = Distances(a[["px", "py", "pz"]].to_numpy(), b[["tx", "ty", "tz"]].to_numpy(), guard)
        r, c = assign(d)
        return pd.DataFrame({"frame_id": np.full(len(r), a["frame_id"].iloc[0], object), "corner_id": a["p_id"].to_numpy()[r], "vertex_id": b["t_id"].to_numpy()[c], "dist": d[r, c]})

    return p.groupBy("frame_id").cogroup(t.groupBy("t_frame")).applyInPandas(run, "frame_id string, corner_id int, vertex_id int, dist double")


def within(matches: DataFrame, radius: float) -> DataFrame:
    """Matches nearer than the radius; they are cut off after the assignment."""
    return matches.where(F.col("dist") < radius)


def frame_counters(predicted: DataFrame, truth: DataFrame, edges: DataFrame, scores: DataFrame, radius: float = 0.1, threshold: float = 0.5, cubes: DataFrame | None = None) -> DataFrame:
    """Per frame: tp_points, n_pred_points, n_label_points, tp_edges, n_pred_edges, n_label_edges and summed biases.

    cubes: frame_id, cube_min, cube_max of clouds whose corners come scaled by
    them; biases are then in the units of the cloud.

    scores: frame_id, i, j (predicted corner ids, i < j), score. A predicted
    edge counts if both its corners were assigned, whatever their distance.
    """
    m = match_corners(predicted, truth, 1e-6)
    hit = within(m, radius).join(predicted.select("frame_id", "corner_id", *[F.col(c).alias(f"p{c}") for c in XYZ]), ["frame_id", "corner_id"]).join(truth.select("frame_id", "vertex_id", *[F.col(c).alias(f"t{c}") for c in XYZ]), ["frame_id", "vertex_id"])
    points = hit.groupBy("frame_id").agg(F.count("*").alias("tp_points"), *[F.sum(F.abs(F.col(f"p{c}") - F.col(f"t{c}"))).alias(f"bias_{c}") for c in XYZ])
    if cubes is not None:
        span = cubes.select("frame_id", (F.col("cube_max") - F.col("cube_min")).alias("_span"))
        points = points.join(span, "frame_id", "left").withColumns({f"bias_{c}": F.col(f"bias_{c}") * F.col("_span") for c in XYZ}).drop("_span")
    end = lambda c: m.select("frame_id", F.col("corner_id").alias(c), F.col("vertex_id").alias(f"{c}v"))
    e = scores.where(F.col("score") > threshold).join(end("i"), ["frame_id", "i"]).join(end("j"), ["frame_id", "j"])
    e = e.select("frame_id", F.least("iv", "jv").alias("i"), F.greatest("iv", "jv").alias("j"))
    lines = edge_membership(e, edges).groupBy("frame_id").agg(F.count("*").alias("n_pred_edges"), F.count_if("is_edge").alias("tp_edges"))
    count = lambda df, name: df.groupBy("frame_id").agg(F.count("*").alias(name))
    out = count(truth, "n_label_points")
    for other in (count(predicted, "n_pred_points"), points, lines, count(edges, "n_label_edges")):
        out = out.join(other, "frame_id", "full")
    return out.fillna(0)


def global_metrics(counters: DataFrame) -> DataFrame:
    """One row of micro precision, recall and F1 of points and edges, and mean bias; empty ratios are 0."""
    s = counters.agg(*[F.sum(c).alias(c) for c in ("tp_points", "n_pred_points", "n_label_points", "tp_edges", "n_pred_edges", "n_label_edges", "bias_x", "bias_y", "bias_z")])
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    out = {}
    for kind in ("points", "edges"):
        out[f"precision_{kind}"], out[f"recall_{kind}"] = ratio(f"tp_{kind}", f"n_pred_{kind}"), ratio(f"tp_{kind}", f"n_label_{kind}")
        p, r = out[f"precision_{kind}"], out[f"recall_{kind}"]
        out[f"f1_{kind}"] = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return s.select(*[v.alias(k) for k, v in out.items()], *[ratio(f"bias_{c}", "tp_points").alias(f"bias_{c}") for c in XYZ])
