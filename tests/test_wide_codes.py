"""Frames wider than 21 bits of grid steps, against their SQL and whole numbers."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from eavesgraph.functions import curves


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """A frame of 30 km, 3 million steps of the grid, and three small ones."""
    d = str(tmp_path_factory.mktemp("wide"))
    x = (np.random.default_rng(5).random((60, 3)) * (3_000_000, 90_000, 2_000)).round() / 100
    rows = [("wide" if i < 40 else f"f{i % 3}", i, *map(float, v)) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "frame_id string, point_id long, x double, y double, z double").coalesce(1).write.parquet(f"{d}/points.parquet")
    return d


@pytest.mark.parametrize("name", ["hilbert_roundtrip", "serialize_hilbert_trans", "relative_positions"])
def test_a_frame_of_thirty_kilometres_is_as_its_sql(spark, rows, wide, name):
    got = entry.queries()[name](spark, wide)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW points AS SELECT * FROM '{wide}/points.parquet/*.parquet'")
    want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert rows(got) == sorted(map(tuple, want), key=str) and got.count() > 0


def test_wide_hilbert_codes_agree_with_narrow_ones(spark):
    x = np.random.default_rng(2).integers(0, 1 << 21, (40, 3))
    df = spark.createDataFrame([tuple(map(int, v)) for v in x], "gx long, gy long, gz long")
    at = [F.col(c) for c in df.columns]
    code = curves.hilbert_wide(*at)
    assert all(r.high == 0 and r.low == r.c for r in df.select(code["high"].alias("high"), code["low"].alias("low"), curves.hilbert(*at).alias("c")).collect())


def test_many_batches_above_deep_codes_stay_whole(spark):
    df = spark.createDataFrame([(b, c) for b in (0, 1, 40_000) for c in (0, 5, (1 << 57) - 1)], "b long, c long")
    got = df.select("b", "c", curves.batched(F.col("c"), F.col("b"), 19, 40_001).alias("v"))
    assert got.schema["v"].dataType.simpleString() == "decimal(38,0)" and all(int(r.v) == (r.b << 57) + r.c for r in got.collect())
    fits = df.select("b", curves.batched(F.lit(7).cast("long"), F.col("b"), 5, 40_001).alias("v"))
    assert fits.schema["v"].dataType.simpleString() == "bigint" and all(r.v == (r.b << 15) + 7 for r in fits.collect())
