"""Sides that explode() has multiplied are not broadcast, however small their estimate is."""

import re

import numpy as np
import pytest

from eavesgraph.operators import cells, cluster, sampling, spatial
from eavesgraph.session import written
from tests.test_operators import cloud


def broadcast_joins(df):
    """Broadcast joins by more than the frame (and range): one row a frame or range may be broadcast."""
    joins = re.findall(r"BroadcastHashJoin \[[^\],]*,[^\]]*\]", df._jdf.queryExecution().sparkPlan().toString())
    return [x for x in joins if "_p#" not in x]


@pytest.fixture
def points(spark):
    return cloud(spark, np.random.default_rng(3).random((60, 3)) * 4)


def test_draws_and_neighbours_of_few_rows_are_shuffled(points):
    points, _ = written(points, "points")
    assert broadcast_joins(sampling.resample(points, 8)) == []
    assert broadcast_joins(spatial.radius_pairs(points, points, 0.5)) == []


@pytest.mark.parametrize("module, table, run", [(cluster, "cell_pairs", lambda p: cluster.height_components(p, 1.5, 0.2)), (cells, "near-cells", lambda p: cluster.dbscan(p, 0.5, 2)), (spatial, "nearest", lambda p: spatial.knn(p, p, 3, "point_id", "point_id"))])
def test_cells_of_few_rows_are_shuffled(points, monkeypatch, module, table, run):
    seen, keep = [], module.written
    monkeypatch.setattr(module, "written", lambda df, name: (name == table and seen.append(broadcast_joins(df)), keep(df, name))[1])
    run(points)
    assert seen and not any(seen)
