"""p5_found and the consolidation it comes from."""

import json
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from eavesgraph.plans import dealt
from eavesgraph.sources import compaction
from tests.test_dealt import at, files


def test_landed_lines_are_compacted_to_first_copies(spark, tmp_path, rows):
    made = compaction.consolidate(files(spark).repartition(4), f"file://{tmp_path}/t", buckets=1)
    landed = json.loads(Path(f"{tmp_path}/t/_snapshots/00000001.json").read_text())
    assert landed and landed != made.listing()
    assert made.current().version == 2 and made.read().count() == 5
    assert rows(compaction.surplus_of(made)) == [(1, 2), (3, 2)]


def test_found_comes_from_the_consolidation(spark, tmp_path, rows, monkeypatch):
    files(spark).write.parquet(f"{tmp_path}/tiny_files.parquet")
    made, keep = [], compaction.consolidate
    monkeypatch.setattr(compaction, "consolidate", lambda *a, **k: made.append(keep(*a, **k)) or made[-1])
    assert rows(dealt.p5_found(spark, str(tmp_path))) == [(1, 2), (3, 2)] and made[0].current().version == 2
    none = files(spark).limit(0)
    assert compaction.surplus_of(keep(none, f"file://{tmp_path}/none")).count() == 0


def partitions(spark, path):
    return compaction.SnapshotTable(spark, f"file://{path}/t", ["p"])


def numbers(spark, lo, hi):
    return spark.range(lo, hi).withColumn("p", F.lit(1)).repartition(8)


def test_a_writer_with_a_stale_version_adds_its_rows_once(spark, tmp_path, monkeypatch):
    t = partitions(spark, tmp_path)
    t.append(numbers(spark, 0, 10))
    stale, now = t.current(), t.current
    t.append(numbers(spark, 10, 20))
    seen = []
    monkeypatch.setattr(t, "current", lambda: seen.append(1) or (stale if len(seen) == 1 else now()))
    assert t.append(numbers(spark, 20, 30)).version == 3
    assert sorted(r.id for r in t.read().collect()) == list(range(30))


def test_writers_at_the_same_time_lose_and_double_nothing(spark, tmp_path):
    t = partitions(spark, tmp_path)
    with ThreadPoolExecutor(4) as pool:
        done = [pool.submit(partitions(spark, tmp_path).append, numbers(spark, k * 10, k * 10 + 10)) for k in range(4)]
        assert sorted(d.result().version for d in done) == [1, 2, 3, 4]
    assert sorted(r.id for r in t.read().collect()) == list(range(40))
    base = t.current()
    assert t.compact(min_small=2, base=base).version == 5
    with pytest.raises(compaction.Conflict):
        t.compact(min_small=2, base=base)
    assert sorted(r.id for r in t.read().collect()) == list(range(40))


def test_a_failure_before_publishing_changes_nothing(spark, tmp_path, monkeypatch):
    t = partitions(spark, tmp_path)
    t.append(numbers(spark, 0, 50))
    before = t.current()
    with monkeypatch.context() as m:
        m.setattr(t, "_claim", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            t.compact(min_small=2)
        with pytest.raises(OSError):
            t.append(numbers(spark, 50, 60))
    assert t.current() == before and sorted(r.id for r in t.read().collect()) == list(range(50))
    assert t.compact(min_small=2).version == 2 and t.current().partitions["p=1"].keys() != before.partitions["p=1"].keys()
    assert sorted(r.id for r in t.read(before).collect()) == list(range(50))
    assert len(t.vacuum()) == 3 and sorted(r.id for r in t.read().collect()) == list(range(50))


def test_a_rewrite_that_loses_rows_is_not_published(spark, tmp_path, monkeypatch):
    t = partitions(spark, tmp_path)
    t.append(numbers(spark, 0, 50))
    write = t._write
    monkeypatch.setattr(t, "_write", lambda df: write(df.where("id <> 7").unionByName(df.where("id = 8"))))
    with pytest.raises(RuntimeError):
        t.compact(min_small=2)
    assert t.current().version == 1 and t.read().count() == 50


def test_a_later_delivery_is_consolidated_into_the_table(spark, tmp_path, rows):
    path = f"file://{tmp_path}/t"
    compaction.consolidate(files(spark), path)
    again = files(spark).withColumn("file_id", F.col("file_id") + 100).withColumn("written_at", F.lit(at(9)).cast("timestamp"))
    made = compaction.consolidate(again, path)
    assert made.read().where("malformed is null").count() == 4 and made.current().landed == []
    assert rows(compaction.surplus_of(made)) == sorted([(101, 2), (101, 4), (102, 1), (102, 2), (103, 1), (103, 2)], key=str)


def test_only_landing_partitions_with_many_files_are_taken(spark, tmp_path, rows):
    made = compaction.consolidate(files(spark), f"file://{tmp_path}/t", min_small=2)
    assert rows(made.read(), "kind", "file_id") == [("pts", 1), ("pts", 1), ("pts", 2), ("pts", 2)]
    assert rows(compaction.landing_partitions(files(spark)), "kind", "frame_id", "n_files", "n_small") == [("offset_pts", "a", 1, 1), ("pts", "a", 4, 4)]
