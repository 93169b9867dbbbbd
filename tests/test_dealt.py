"""Rejects, orphans and small files: nulls, empty tables, repeats, clashing columns, conflicts."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from eavesgraph.operators import integrity, skew
from eavesgraph.sources import compaction, structural

LINES = "line_id long, file_path string, frame_id string, file_kind string, n_cols int, line_no int, raw string, reason string, values string"


def lines(spark, cases):
    data = [(i, "f", "a", kind, n, i, raw, "mine", "theirs") for i, (kind, n, raw) in enumerate(cases)]
    return spark.createDataFrame(data, LINES)


def test_rejects_have_the_first_reason(spark):
    cases = [
        ("xyz", 3, "1 2 3"), ("xyz", 3, '"1" 2\t"3"'), ("xyz", 3, '"1 2" 3'), ("xyz", 3, '"" 2 3'), ("xyz", 3, "1 2"), ("xyz", None, "1 2 3"),
        ("xyz", 3, "1 2 nan"), ("xyz", 3, "1 2 1e999"), ("xyz", 3, "+.5 -1. 1E+2"), ("xyz", 3, "1 2 3 4"), ("xyz", 6, "1 2 3 0 255 256"), ("xyz", 6, "1 2 3 0 255 25.5"),
        ("xyz", 8, "1 2 3 4 5 6 0 -1"), ("xyz", 3, "  # note"), ("xyz", 3, " \t\r"), ("xyz", 3, None), ("obj", None, "v 1 2 3"), ("obj", None, "v 1 2"), ("obj", None, "l 1 2"), ("obj", None, 'v 1 2 "3'),
        ("xyz", 3, '1 2 "3"x'), ("xyz", 3, "1 2 ３"), ("xyz", 3, "1 2 " + "9" * 400), (None, 3, "1 2 3"),
    ]
    got = {r.line_id: r.reason for r in structural.parse_lines(lines(spark, cases)).collect()}
    want = {0: None, 1: None, 2: "quoting", 3: "value", 4: "columns", 5: "columns", 6: "value", 7: "value", 8: None, 9: "value", 10: "value", 11: None, 12: "value", 16: None, 17: "columns", 19: "quoting", 20: "quoting", 21: "value", 22: "value", 23: None}
    assert got == want
    assert sorted(map(tuple, structural.loaded_points(lines(spark, cases)).select("line_id", "x", "z", "r").collect()))[2] == (8, 0.5, 100.0, None)
    assert [tuple(r) for r in structural.loaded_vertices(lines(spark, cases)).collect()] == [(16, 1.0, 2.0, 3.0)]


def test_rejects_of_nothing(spark):
    assert structural.parse_lines(lines(spark, [])).count() == 0


def test_quoted_delimiters_by_parity():
    buf = np.frombuffer(b'a "b c" d', np.uint8)
    ix = structural.index_fields(buf, np.array([0]), np.array([len(buf)]), quoted_delimiters=True)
    assert [bytes(buf[s:e]) for s, e in zip(ix.start, ix.end)] == [b"a", b'"b c"', b"d"]


def at(day):
    return datetime(2024, 1, day)


def test_orphans(spark, rows):
    edges = spark.createDataFrame([(1, " A", 0, 1, at(5), "x"), (2, "a", 2, 9, at(5), "x"), (3, "a", -1, None, at(5), "x"), (4, None, 0, 1, at(5), "x"), (5, "A ", 3, 3, at(1), "x"), (6, "a", 3, 3, at(9), "x")], "edge_row long, frame_id string, src int, dst int, loaded_at timestamp, state string")
    vertices = spark.createDataFrame([(10, "a", 0, at(1), None), (11, "a", 0, at(2), at(3)), (12, "A", 1, at(1), at(2)), (13, "a ", 3, at(7), None), (14, "b", 2, at(1), None), (15, "", 2, at(1), None)], "vertex_row long, frame_id string, vertex_id int, loaded_at timestamp, deleted_at timestamp")
    frames = spark.createDataFrame([("a", at(1), None), ("B", at(2), None)], "frame_id string, loaded_at timestamp, deleted_at timestamp")
    got = rows(integrity.wireframe_orphans(edges, vertices, frames), "ref_table", "row_id", "ref_col", "state")
    assert got == [("edges", 1, "dst", "deleted"), ("edges", 2, "dst", "missing"), ("edges", 2, "src", "missing"), ("edges", 5, "dst", "late"), ("edges", 5, "src", "late"), ("vertices", 14, "frame_id", "late"), ("vertices", 15, "frame_id", "missing")]
    counts = integrity.wireframe_orphans(edges, vertices, frames, counts=True)
    assert rows(counts, "ref_table", "ref_col", "state", "n_refs") == [("edges", "dst", "deleted", 1), ("edges", "dst", "late", 1), ("edges", "dst", "missing", 1), ("edges", "src", "late", 1), ("edges", "src", "missing", 1), ("vertices", "frame_id", "late", 1), ("vertices", "frame_id", "missing", 1)]
    none = integrity.wireframe_orphans(edges.limit(0), vertices.limit(0), frames)
    assert none.count() == 0
    assert integrity.wireframe_orphans(edges, vertices.limit(0), frames).count() == 8


def test_heavy_keys_are_split(spark, rows, monkeypatch):
    monkeypatch.setattr(skew, "HEAVY_LEAST", 5)
    left = spark.createDataFrame([("hot", i) for i in range(20)] + [("cold", 99), (None, 98)], "k string, v int")
    heavy = skew.heavy_keys(left.groupBy("k").agg(F.count("*").alias("n")), ["k"])
    assert heavy == [("hot",)]
    states = spark.createDataFrame([("hot", 1), ("cold", 2)], "k string, s int")
    got = skew.join_by_weight(left, states, ["k"], heavy)
    assert got.count() == 22 and got.where("s = 1").count() == 20 and got.where("s is null").count() == 1
    assert skew.join_by_weight(left, states, ["k"], heavy, "inner").count() == 21


def test_a_hot_frame_is_split_off_without_settings(spark, rows, monkeypatch):
    heavy = []
    keep = integrity.heavy_keys
    monkeypatch.setattr(integrity, "heavy_keys", lambda *a, **k: heavy.append(keep(*a, **k)) or heavy[-1])
    vertices = spark.range(3000).selectExpr("id AS vertex_row", "IF(id < 1500, 'hot', concat('f', id)) AS frame_id", "cast(id AS int) AS vertex_id", "timestamp'2024-01-05' AS loaded_at", "cast(NULL AS timestamp) AS deleted_at")
    frames = spark.createDataFrame([("hot", at(9), None), ("f2000", at(1), None)], "frame_id string, loaded_at timestamp, deleted_at timestamp")
    edges = spark.createDataFrame([], "edge_row long, frame_id string, src int, dst int, loaded_at timestamp")
    got = integrity.wireframe_orphans(edges, vertices, frames).groupBy("state").count()
    assert rows(got) == [("late", 1500), ("missing", 1499)] and [("hot",)] in heavy
    assert rows(integrity.wireframe_orphans(edges, vertices, frames, counts=True), "state", "n_refs") == [("late", 1500), ("missing", 1499)]


FILES = "file_id long, file_path string, frame_id string, kind string, written_at timestamp, n_bytes long, body string, x double"


def files(spark):
    return spark.createDataFrame([
        (1, "landing/pts/a/1", "a", "pts", at(2), 0, "# c\n1 2.0 3 4\r\n\n 5\t6 7 8 \nbad line", 0.0),
        (2, "landing/pts/A/2", None, "pts", at(1), None, "1.0 2 +3e0 4.000\n1 2 3 5", 0.0),
        (3, "landing/off/a/3", "a", "offset_pts", at(1), 0, "1 2 3 4\n1 2 3 4", 0.0),
        (4, "landing/pts/a/4", "a", "pts", at(1), 0, None, 0.0),
        (5, "landing/pts/a/5", "a ", "pts", at(1), 0, "", 0.0),
    ], FILES)


def test_surplus_copies(spark, rows):
    r = compaction.body_records(files(spark))
    assert rows(compaction.surplus_copies(r)) == [(1, 2), (3, 2)]
    assert r.where("malformed is not null").count() == 1
    assert compaction.unique_records(r).count() == 5
    assert compaction.surplus_copies(compaction.body_records(files(spark).limit(0))).count() == 0


def test_compaction_keeps_every_record_once(spark, tmp_path):
    made = compaction.consolidate(files(spark).repartition(4), f"file://{tmp_path}/t", buckets=1)
    assert made.read().count() == 5
    assert all(len(f) == 1 for f in made.listing().values())


def test_only_crowded_partitions_are_rewritten(spark, tmp_path):
    t = compaction.SnapshotTable(spark, f"file://{tmp_path}/t", ["p"])
    df = spark.range(1000).withColumn("p", F.when(F.col("id") < 900, 1).otherwise(2))
    t.append(df.where("p = 1").repartition(9))
    t.append(df.where("p = 2").coalesce(1))
    before = t.listing()
    snap = t.compact(target_bytes=1 << 20, min_small=4)
    after = t.listing()
    assert len(after["p=1"]) == 1 and after["p=2"] == before["p=2"]
    assert snap.version == 3 and snap.partitions == after
    assert sorted(r.id for r in t.read().collect()) == list(range(1000))
    assert t.compact(target_bytes=1 << 20, min_small=4).version == 3


def test_conflicts_are_found(spark, tmp_path):
    t = compaction.SnapshotTable(spark, f"file://{tmp_path}/t", ["p"])
    df = spark.range(100).withColumn("p", F.lit(1)).repartition(8)
    base = t.append(df)
    t.append(df)
    with pytest.raises(compaction.Conflict):
        t.compact(min_small=2, base=base)
    df.write.mode("append").partitionBy("p").parquet(t.path)
    assert t.read().count() == 200
    assert t.compact(min_small=2).version == 3 and t.read().count() == 200
