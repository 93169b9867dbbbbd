"""Whole jobs on small fixtures."""

import numpy as np
import pytest

from eavesgraph.functions import losses
from eavesgraph.operators import order, pipelines, sampling, wireframe
from eavesgraph.sources import files


def cloud(spark, x, frame="a"):
    return spark.createDataFrame([(frame, i, *map(float, p)) for i, p in enumerate(x)], "frame_id string, point_id long, x double, y double, z double")


def corners(spark, x, frame="a", key="vertex_id"):
    return spark.createDataFrame([(frame, i, *map(float, p)) for i, p in enumerate(x)], f"frame_id string, {key} int, x double, y double, z double")


def test_frames_are_split_and_merged_again(spark, rows):
    two = [(i / 100, 0, 0) for i in range(30)] + [(5 + i / 100, 0, 0) for i in range(30)] + [(2.5, 3, 0)]
    p = cloud(spark, two).unionByName(cloud(spark, two[:5], "small"))
    v = corners(spark, [(0, 0, 0), (0.2, 0, 0), (5, 0, 0), (5.2, 0, 0)]).unionByName(corners(spark, [(0, 0, 0), (1, 0, 0)], "small"))
    e = spark.createDataFrame([("a", 0, 1), ("a", 1, 2), ("a", 2, 3), ("small", 0, 1)], "frame_id string, src int, dst int")
    cut_p, cut_v, cut_e = pipelines.split_frames(p, v, e, distance=0.05, height=0.05, min_points=20, threshold=10)
    assert rows(cut_p.groupBy("frame_id", "part").count()) == [("a", "cluster_0", 30), ("a", "cluster_1", 31), ("small", "original", 5)] or rows(cut_p.groupBy("frame_id", "part").count()) == [("a", "cluster_0", 31), ("a", "cluster_1", 30), ("small", "original", 5)]
    assert rows(cut_e, "frame_id", "part", "src", "dst") == [("a", "cluster_0", 0, 1), ("a", "cluster_1", 0, 1), ("small", "original", 0, 1)]
    assert rows(cut_v.where("frame_id = 'a'"), "part", "vertex_id", "x") == [("cluster_0", 0, 0.0), ("cluster_0", 1, 0.2), ("cluster_1", 0, 5.0), ("cluster_1", 1, 5.2)]
    empty = pipelines.split_frames(p.limit(0), v.limit(0), e.limit(0))
    assert [df.count() for df in empty] == [0, 0, 0]


def test_objects_are_merged_by_cluster_and_replace_originals(spark):
    lines = [("x/city_7_cluster_10.obj", ["v 3 3 3", "l 1 1", "l 1 5"]), ("x/city_7_cluster_2.obj", ["# note", "v 1 1 1", " v 2 2 2", "l 2 1", "l 1 2 3"]), ("x/city_7_original.obj", ["v 9 9 9"]), ("x/city_a_b_original.obj", ["# kept", "v 1 1 1", "", None])]
    df = spark.createDataFrame([(p, i, t) for p, ts in lines for i, t in enumerate(ts)], "path string, line_no int, line string")
    got = {}
    for r in pipelines.merge_objects(df).orderBy("frame_id", "line_no").collect():
        got.setdefault(r.frame_id, []).append(r.line)
    assert got == {"7": ["v 1 1 1", "v 2 2 2", "v 3 3 3", "l 2 1", "l 3 3"], "a_b": ["# kept", "v 1 1 1"]}
    assert pipelines.merge_objects(df.limit(0)).count() == 0


def test_a_dataset_is_loaded_from_its_manifest(spark, tmp_path, rows):
    rng = np.random.default_rng(0)
    for f in ("one", "two"):
        (tmp_path / f).mkdir()
        np.savetxt(tmp_path / f / "points.xyz", np.hstack((rng.random((40, 3)), rng.integers(0, 256, (40, 3)), rng.random((40, 2)))), fmt="%.4f")
        (tmp_path / f / "polygon.obj").write_text("v 0 0 0\nv 1 1 1\nl 2 1\n")
    (tmp_path / "train.txt").write_text(f"{tmp_path}/one\n\n{tmp_path}/two/\n")
    p, v, e = pipelines.load_dataset(spark, f"file://{tmp_path}/train.txt", color=True, nir=True, n=64, augment=True, sigma=(0.001, 0.002))
    assert p.count() == 128 and v.count() == 4 and rows(e) == [("one", 0, 1), ("two", 0, 1)]
    far = p.selectExpr("max(x*x+y*y+z*z) AS m", "min(nir) AS lo", "max(nir) AS hi").first()
    assert far.m == pytest.approx(1) and 0 <= far.lo and far.hi <= 1
    assert sorted(map(tuple, p.collect())) == sorted(map(tuple, p.collect()))
    (tmp_path / "cfg").mkdir()
    (tmp_path / "cfg" / "a.yaml").write_text("MODEL:\n  eps: 0.03\n")
    pytest.importorskip("yaml")
    assert pipelines.read_config(f"{tmp_path}/cfg/a.yaml") == {"ROOT_DIR": str(tmp_path.resolve()), "MODEL": {"eps": 0.03}}


def test_groups_about_farthest_points(spark):
    x = np.random.default_rng(1).random((60, 3)).round(3)
    got = pipelines.sample_and_group(cloud(spark, x), 5, 4).collect()
    chosen = sampling.farthest(x, 5)
    for slot, i in enumerate(chosen):
        near = sorted(range(60), key=lambda j: (round(((x[j] - x[i]) ** 2).sum(), 12), j))[:4]
        mine = sorted((r for r in got if r.slot == slot), key=lambda r: r.rank)
        assert [r.neighbour for r in mine] == near and mine[0].point_id == i
        assert np.allclose([(r.dx, r.dy, r.dz) for r in mine], x[near] - x[i])


def test_loss_of_ranges_equals_the_definition(spark):
    rng = np.random.default_rng(2)
    for n in (1, 2, 50):
        s, y = rng.normal(size=n).round(1), rng.integers(0, 2, n)
        e = 1 - s * (2 * y - 1)
        o = np.argsort(-e, kind="stable")
        t, cy, cn = y.sum(), np.cumsum(y[o]), np.cumsum(1 - y[o])
        j = 1 - (t - cy) / (t + cn)
        want = (np.maximum(e[o], 0) * np.diff(np.concatenate(([0], j)))).sum()
        df = spark.createDataFrame([("a", float(a), int(b)) for a, b in zip(s, y)], "frame_id string, s double, y int")
        assert losses.lovasz_hinge(df, "s", "y", ["frame_id"]).first().loss == pytest.approx(want)
    assert losses.lovasz_hinge(df.limit(0), "s", "y", ["frame_id"]).count() == 0


def test_layout_records_and_listing(spark, tmp_path, rows):
    a, b = (spark.createDataFrame([(p,) for p in ps], "path string") for ps in (["xyz/1.xyz", "xyz/3.xyz"], ["wireframe/1.obj", "wireframe/2.obj"]))
    assert rows(pipelines.relayout(a, b, "out/")) == [("wireframe/1.obj", "out/1/polygon.obj"), ("xyz/1.xyz", "out/1/points.xyz")]
    text = spark.createDataFrame([("v 1 2 3",), (" l 1 2",), ("vn 1",), ("#",), (None,)], "line string")
    assert rows(files.text_records(text)) == [("l 1 2",), ("v 1 2 3",)]
    (tmp_path / "d").mkdir()
    for n in ("d/a.xyz", "b.xyz", "c.obj"):
        (tmp_path / n).write_text("1 2 3\n")
    assert {r.path.rsplit("/", 1)[1] for r in files.files_under(spark, f"file://{tmp_path}", ".xyz").collect()} == {"a.xyz", "b.xyz"}
    assert rows(wireframe.distinct_colors(spark.createDataFrame([("a", i) for i in range(3)] + [("b", 4)], "frame_id string, cluster_id int"))) == [("a", 0, 255, 0, 0), ("a", 1, 0, 255, 255), ("a", 2, 255, 0, 0), ("b", 4, 255, 0, 0)]


def test_a_wavelet_of_an_odd_run_comes_back_flat(spark):
    df = spark.createDataFrame([("a", i, 2.0) for i in range(7)], "frame_id string, pos long, z double")
    c = order.haar_transform(df, "z", "pos").collect()
    assert all(r.detail == 0 and r.approx == pytest.approx(2 * 2 ** (r.level / 2)) for r in c) and len(c) == 4 + 2 + 1


def test_lines_keep_their_order_over_splits(spark, tmp_path):
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "points.xyz").write_text("".join(f"{i} 0 0\r\n" if i % 3 else f"{i}\t0  0\n" for i in range(5000)))
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = files.read_xyz(spark, f"file://{tmp_path}/one/points.xyz").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)
    assert sorted((r.point_id, r.x) for r in got) == [(i, float(i)) for i in range(5000)]


def test_counts_of_a_stream_over_micro_batches(spark, tmp_path):
    from pyspark.sql import functions as F

    from eavesgraph.streaming import frames

    rows = spark.range(40).select(F.concat(F.lit("f"), F.col("id") % 3).alias("frame_id"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.col("id").cast("int"))).alias("at"))
    for k in range(4):
        rows.where(F.col("frame_id").isNotNull() & (F.dayofyear("at") % 4 == k)).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = frames.parquet_stream(spark, f"file://{tmp_path}/in", rows.schema, 1)
    out = f"file://{tmp_path}/out"
    frames.written_counts(frames.windowed_counts(stream, "at", late="60 days"), out, f"file://{tmp_path}/check").awaitTermination()
    got = frames.latest(spark, out, ["start", "frame_id"])
    assert got.agg(F.sum("n_rows")).first()[0] == 40 and spark.read.parquet(out).select("batch").distinct().count() >= 4
