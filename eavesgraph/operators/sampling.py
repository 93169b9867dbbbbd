"""Samples of frames: resampling, farthest points, weighted draws, top columns."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eavesgraph.operators.order import row_numbers
from eavesgraph.session import multiplied

XYZ = ["x", "y", "z"]


def portable_hash(*parts: Column | str, seed: int = 0) -> Column:
    """A number in [0, 2^32) from md5, which other engines compute alike."""
    text = F.concat_ws("|", *parts, F.lit(seed))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def resample(points: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(frame_id, slot, point_id): n rows of every frame.

    Of a frame with more than n points, n are drawn with replacement; else all
    points come and repeats fill up. Draws depend on frame, slot and seed only.
    """
    numbered = row_numbers(points.select("frame_id", "point_id"), ["frame_id"], ["point_id"], "pos")
    count = numbered.groupBy("frame_id").agg(F.count("*").alias("total"))
    slots = count.select("frame_id", "total", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("slot"))
    draw = F.pmod(portable_hash("frame_id", F.col("slot").cast("string"), seed=seed), F.col("total"))
    pick = F.when((F.col("total") <= n) & (F.col("slot") < F.col("total")), F.col("slot").cast("long")).otherwise(draw)
    return multiplied(slots.withColumn("pos", pick)).join(numbered, ["frame_id", "pos"]).select("frame_id", "slot", "point_id")


def weighted_sample(points: DataFrame, score: str, n: int, beta: float = 5.0, seed: int = 0) -> DataFrame:
    """(frame_id, point_id, rank): n points of each frame without replacement, with weights exp(beta * score).

    Each row gets ln(u) / weight and the largest win, so one ranked window does it.
    """
    u = (portable_hash("frame_id", F.col("point_id").cast("string"), seed=seed) + 1) / F.lit(4294967297.0)
    key = F.ln(u) / F.exp(F.col(score) * beta)
    w = Window.partitionBy("frame_id").orderBy(F.desc("_k"), "point_id")
    ranked = points.withColumn("_k", F.round(key, 12)).withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= n).select("frame_id", "point_id", "rank")


def farthest(x: np.ndarray, n: int, chosen: list[int] | None = None) -> np.ndarray:
    """Row numbers of a farthest-point sample; starts at the first row or goes on from ``chosen``, ties to the lowest."""
    picked = list(chosen or [0])
    d = np.min([((x - x[i]) ** 2).sum(1) for i in picked], axis=0)
    while len(picked) < min(n, len(x)):
        i = int(d.argmax())
        picked.append(i)
        d = np.minimum(d, ((x - x[i]) ** 2).sum(1))
    return np.array(picked[:n])


def farthest_points(points: DataFrame, n: int, features: list[str] | None = None, w_xyz: float = 1.0, w_features: float = 0.0) -> DataFrame:
    """(frame_id, slot, point_id): n points of each frame, each the farthest from those before it.

    Distances are weighted sums over xyz and features. The steps depend on each
    other, so a frame is one task; only the columns used are sent there.
    """
    cols = XYZ + (features or [])
    scale = np.sqrt([w_xyz] * 3 + [w_features] * len(features or []))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point_id", kind="stable")
        at = farthest(pdf[cols].fillna(0.0).to_numpy(float) * scale, n)
        return pd.DataFrame({"frame_id": pdf["frame_id"].to_numpy()[at], "slot": np.arange(len(at), dtype=np.int32), "point_id": pdf["point_id"].to_numpy()[at]})

    return points.select("frame_id", "point_id", *cols).groupBy("frame_id").applyInPandas(run, "frame_id string, slot int, point_id long")


def adaptive_sample(points: DataFrame, score: str, target: int, first: int = 4096, share: float = 0.8, seed: int = 0) -> DataFrame:
    """(frame_id, point_id): weighted draw, the best ``share`` of the target by score, the rest by farthest points."""
    drawn = points.join(weighted_sample(points, score, first, seed=seed), ["frame_id", "point_id"]).select("frame_id", "point_id", *XYZ, F.col(score).alias("_s"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_s", "point_id"], ascending=[False, True], kind="stable")
        keep = max(1, min(len(pdf), int(target * share)))
        at = farthest(pdf[XYZ].to_numpy(float), target, list(range(keep)))
        return pdf.iloc[at][["frame_id", "point_id"]]

    return drawn.groupBy("frame_id").applyInPandas(run, "frame_id string, point_id long")


def adaptive_rows(frame: str, ids: np.ndarray, x: np.ndarray, score: np.ndarray, target: int, first: int = 4096, share: float = 0.8, beta: float = 5.0, seed: int = 0) -> np.ndarray:
    """adaptive_sample() of one frame: row numbers; a NaN score is a null. Rows come in order of ids."""
    rows = np.arange(len(ids))
    if len(ids) > first:
        u = np.array([(int(hashlib.md5(f"{frame}|{i}|{seed}".encode()).hexdigest()[:8], 16) + 1) / 4294967297.0 for i in ids.tolist()])
        key = np.round(np.log(u) / np.exp(score * beta), 12)
        rows = np.sort(np.lexsort((ids, -key))[:first])
    if target >= len(rows):
        return rows
    rows = rows[np.lexsort((ids[rows], -score[rows]))]
    keep = max(1, min(len(rows), int(target * share)))
    return rows[farthest(x[rows], target, list(range(keep)))]


def top_variance(features: DataFrame, column: str, width: int, n: int) -> DataFrame:
    """(frame_id, column_no, variance, rank): the n columns of an array with the largest variance in each frame."""
    v = features.select("frame_id", F.posexplode(column).alias("column_no", "v")).where(F.col("column_no") < width)
    var = v.groupBy("frame_id", "column_no").agg(F.var_pop("v").alias("variance"))
    w = Window.partitionBy("frame_id").orderBy(F.desc(F.round("variance", 12)), "column_no")
    return var.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def newest(df: DataFrame, by: list[str], at: str, n: int = 1) -> DataFrame:
    """The n newest rows of each group."""
    w = Window.partitionBy(*by).orderBy(F.desc(at))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
