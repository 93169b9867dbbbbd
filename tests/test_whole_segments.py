"""Segments of points and vertices made where the frames lie, against the way by tables."""

import pytest
from pyspark.sql import functions as F

from eavesgraph.operators import cluster
from eavesgraph.operators.clouds import members, vertex_labels
from eavesgraph.operators.wireframe import merge_offsets
from eavesgraph.plans import geometry
from tests.test_operators import cloud
from tests.test_parts import heaps


def tables(spark):
    p = cloud(spark, heaps(40)).unionByName(cloud(spark, heaps(9, 2)[:15] + 7e5, "few")).unionByName(cloud(spark, heaps(6, 1), "b").withColumn("x", F.col("x") - 4e6))
    v = p.where("point_id % 7 = 0").select("frame_id", F.col("point_id").cast("int").alias("vertex_id"), (F.col("x") + 0.4).alias("x"), "y", (F.col("z") + 0.05).alias("z"))
    v = v.unionByName(v.where("frame_id = 'a'").withColumn("frame_id", F.lit("none")))
    return (spark.createDataFrame(df.collect(), df.schema) for df in (p, v))


def by_tables(both, *args):
    return cluster.merge_small(both, cluster.height_components(both, *args[:2], "member_id"), args[2], "member_id", F.col("kind") == "sample")


def test_offsets_of_segments_are_made_without_tables_of_cells(spark, rows, tmp_path, monkeypatch):
    p, v = tables(spark)
    p.unionByName(p.limit(30)).write.parquet(f"{tmp_path}/points.parquet")
    v.withColumns({"deleted_at": F.lit(None).cast("timestamp"), "loaded_at": F.lit(0), "vertex_row": F.lit(0)}).write.parquet(f"{tmp_path}/vertices.parquet")
    want = rows(merge_offsets(vertex_labels(by_tables(members(p, v), 1.5, 0.2, 20))))
    monkeypatch.setattr(cluster, "height_components", lambda *a: pytest.fail("tables of cells"))
    assert rows(geometry.segment_merge_offsets(spark, str(tmp_path))) == want and {r[0] for r in want} == {"a", "b", "few", "none"}


def test_frames_too_wide_or_odd_go_by_tables(spark, rows, monkeypatch):
    p, v = tables(spark)
    far = cloud(spark, [(0, 0, 0), (0.1, 0, 0), (9e11, -9e11, 9e11), (0, 8e11, 0)], "far").unionByName(cloud(spark, [(0, 0, 0), (0, 0, 5e12), (0, 0, 5e12)], "beyond"))
    odd = cloud(spark, heaps(2, 3)[:30], "odd").unionByName(cloud(spark, [(0, 0, 0)], "odd"))
    both = members(p.unionByName(spark.createDataFrame(far.unionByName(odd).collect(), p.schema)), v)
    same = both.where("frame_id <> 'odd'")
    want = rows(by_tables(same, 0.7, 0.3, 15))
    seen, keep = [], cluster.height_components
    monkeypatch.setattr(cluster, "height_components", lambda m, *a: seen.append(sorted(r.frame_id for r in m.select("frame_id").distinct().collect())) or keep(m, *a))
    assert rows(cluster.segments(same, 0.7, 0.3, 15)) == want and seen == [["beyond", "far"]]
    assert {r.frame_id for r in cluster.segments(both, 0.7, 0.3, 15).collect()} == {r[0] for r in want} | {"odd"} and seen[1] == ["beyond", "far", "odd"]
    assert rows(cluster.segments(same, 0.7, 0.3, 15, whole=0)) == want and len(seen[2]) == 6
