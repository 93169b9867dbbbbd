"""Frames cut into parts where they lie, against brute force and the way by tables."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eavesgraph.operators import cluster, local, pipelines
from tests.test_operators import cloud
from tests.test_segments import brute_labels


def heaps(n, seed=0):
    """Full cells beside each other, stray places and places that are taken twice."""
    rng = np.random.default_rng(seed)
    full = [rng.random((n, 3)) * (0.9, 0.9, 0.1) + at for at in ((0, 0, 0), (1, 0, 0), (1.2, 1.3, 0.15), (4, 4, 0), (5.1, 4, 0.1), (4, 5.4, 1))]
    x = np.concatenate((*full, rng.random((60, 3)) * (9, 9, 2) - 3)).round(2)
    x[5:9] = x[-1]
    return rng.permutation(x)


@pytest.mark.parametrize("held", [50, 1_000_000])
@pytest.mark.parametrize("distance, height", [(1.5, 0.2), (0.7, 0.5), (0.6, 2.0), (0.3, 0.05)])
def test_parts_equal_brute_force(monkeypatch, distance, height, held):
    monkeypatch.setattr(local, "HELD", held)
    frames = [heaps(100), heaps(3, 1), heaps(20, 2)[:1], heaps(120, 3)]
    got = local.height_parts(np.repeat(np.arange(4), list(map(len, frames))), np.concatenate(frames), distance, height)
    want, n = [], 0
    for x in frames:
        want += [n + i for i in brute_labels(x, distance, height)]
        n = max(want) + 1
    assert got.tolist() == want


@pytest.mark.parametrize("seed", range(6))
def test_full_cells_are_joined_in_any_order(seed):
    rng = np.random.default_rng(seed)
    at = np.cumsum(rng.choice((1.2, 1.9, 3.5), 12, p=(0.6, 0.3, 0.1)))
    x = rng.permutation(np.concatenate([rng.random((80, 3)) * (0.5, 0.5, 0.1) + (a * (-1) ** seed, a * (seed % 3), 0) for a in at]))
    assert local.height_parts(np.zeros(len(x), int), x, 1.5, 0.2).tolist() == brute_labels(x, 1.5, 0.2)


@pytest.mark.parametrize("n", [40, 6000])
def test_the_closest_is_that_of_brute_force(n):
    rng = np.random.default_rng(n)
    t, q = (rng.random((n, 3)) * 9).round(1), np.concatenate(((rng.random((700, 3)) * 9).round(1), rng.random((3, 3)) * 90))
    assert (local.closest(q, t) == np.concatenate([local._squares(q[i : i + 50], t).argmin(1) for i in range(0, len(q), 50)])).all()


def test_frames_are_put_together_from_batches():
    names = [f for f, n in (("a", 3), ("b", 25), ("c", 1), ("d", 1), ("e", 9)) for _ in range(n)]
    t = pa.table({"frame_id": names, "i": range(len(names))})
    for size in (1, 2, 7, 100):
        got = list(local.whole_frames(iter(t.to_batches(max_chunksize=size)), 4))
        assert pa.concat_tables(got).equals(t) and sum(len(set(g["frame_id"].to_pylist())) for g in got) == 5
    assert not list(local.whole_frames(iter([]), 4))


def test_parts_are_those_of_tables_and_only_odd_frames_take_them(spark, rows, monkeypatch):
    p = cloud(spark, heaps(60)).unionByName(cloud(spark, heaps(2, 1), "b")).unionByName(cloud(spark, heaps(9, 2)[:20], "small")).unionByName(cloud(spark, heaps(5, 3), "odd").withColumn("x", F.when(F.col("point_id") == 3, F.lit(float("nan"))).otherwise(F.col("x"))))
    v = p.where("point_id % 7 = 0 and not isnan(x)").select("frame_id", F.col("point_id").cast("int").alias("vertex_id"), "x", (F.col("y") + 0.05).alias("y"), "z")
    v = v.unionByName(v.where("frame_id = 'a' and vertex_id = 0").withColumn("frame_id", F.lit("none")))
    e = v.select("frame_id", F.col("vertex_id").alias("src"), (F.col("vertex_id") + 7 * (1 + F.col("vertex_id") % 3)).alias("dst"))
    p, v, e = (spark.createDataFrame(df.collect(), df.schema) for df in (p, v, e))
    seen, keep = [], cluster.height_components
    monkeypatch.setattr(cluster, "height_components", lambda m, *a: seen.extend(r.frame_id for r in m.select("frame_id").distinct().collect()) or keep(m, *a))
    cut = pipelines.split_frames(p.unionByName(p.limit(50)), v, e, 0.1, 0.03, 15, 40)
    got = [[tuple(map(str, r)) for r in rows(df)] for df in cut]
    assert seen == ["odd"]
    want = pipelines.split_frames(p, v, e, 0.1, 0.03, 15, 40, whole=0)
    assert sorted(seen[1:]) == ["a", "b", "odd"]
    assert got == [[tuple(map(str, r)) for r in rows(df)] for df in want]
    parts = {(r[0], r[-1]) for r in got[0]}
    assert ("small", "original") in parts and ("a", "cluster_1") in parts and not any(r[0] == "none" for r in got[1]) and len(got[2]) > 10
