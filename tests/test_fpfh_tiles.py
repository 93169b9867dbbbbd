"""FPFH of large frames by tiles, against whole frames."""

import numpy as np
import pytest

from eavesgraph.operators import local, spatial
from eavesgraph.plans import geometry
from tests.test_operators import cloud


def sheet(n):
    rng = np.random.default_rng(n)
    x = rng.random((n, 3)) * (1, 0.7, 0.02)
    x[:3] = [(0.5, 0.3, 0.9), (0.5, 0.31, 0.9), (0.1, 0.1, -0.9)]
    return x.round(4)


def test_tiles_and_the_rest_equal_whole_frames(spark, monkeypatch):
    x, ball, flat = sheet(4000), (0.05, 9), (0.03, 6)
    ids, lists = local.fpfh(np.arange(len(x)), x, ball, flat)
    written, seen = local.written, {}
    monkeypatch.setattr(local, "written", lambda df, name: seen.setdefault(name, written(df, name)))
    got = {r.point_id: r.fpfh for r in local.fpfh_by_tiles(cloud(spark, x), ball, flat, 300, 200).collect()}
    assert got.keys() == set(ids.tolist()) and len(got) < len(x)
    assert all(np.allclose(got[i], v) for i, v in zip(ids.tolist(), lists[0].to_pylist()))
    assert 1000 < seen["settled"][0].count() < len(x) and not seen["unsettled"][0].isEmpty()


def test_large_frames_take_no_tables_of_pairs(spark, tmp_path, monkeypatch):
    cloud(spark, sheet(700)).write.parquet(f"{tmp_path}/points.parquet")
    want = {r.point_id: r.fpfh for r in geometry.fpfh_descriptor(spark, str(tmp_path)).collect()}
    monkeypatch.setattr(geometry, "WHOLE_FRAME", 600)
    monkeypatch.setattr(spatial, "knn", lambda *a, **o: pytest.fail("pairs of points"))
    got = {r.point_id: r.fpfh for r in geometry.fpfh_descriptor(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and np.mean([np.allclose(got[i], want[i]) for i in want]) > 0.99
