"""Segments of points and vertices together, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eavesgraph.operators import cluster, wireframe
from eavesgraph.operators.clouds import members, vertex_labels
from tests.test_operators import cloud


def brute_labels(x, distance, height):
    label = list(range(len(x)))
    for i in range(len(x)):
        d = x - x[i]
        for j in np.flatnonzero(((d * d).sum(1) < distance * distance) & (np.abs(d[:, 2]) < height)):
            a, b = sorted((label[i], label[j]))
            label = [a if v == b else v for v in label]
    order = sorted(set(label))
    return [order.index(v) for v in label]


@pytest.mark.parametrize("distance, height", [(1.5, 0.2), (0.7, 0.5), (0.6, 2.0)])
def test_height_components_equal_brute_force(spark, distance, height):
    rng = np.random.default_rng(7)
    x = (rng.random((220, 3)) * (9, 9, 2) - 3).round(1)
    got = {r.point_id: r.cluster_id for r in cluster.height_components(cloud(spark, x), distance, height).collect()}
    assert [got[i] for i in range(len(x))] == brute_labels(x, distance, height)


def test_vertices_are_joined_through_points_and_samples_count(spark, rows):
    roof = [(0.4 * i, 0, 0) for i in range(20)]
    p = cloud(spark, [*roof, (0, 0, 5)])
    ends = [(0, 0, 0), (7.6, 0, 0), (0, 0.1, 5), (0.1, 0, 5)]
    v = spark.createDataFrame([("a", i, *map(float, e)) for i, e in enumerate(ends)], "frame_id string, vertex_id int, x double, y double, z double")
    e = spark.createDataFrame([("a", 0, 1), ("a", 0, 2), ("a", 2, 3)], "frame_id string, src int, dst int")
    m = members(p, v)
    labels = cluster.height_components(m, 1.5, 0.2, "member_id")
    assert rows(vertex_labels(labels), "vertex_id", "cluster_id") == [(0, 0), (1, 0), (2, 1), (3, 1)]
    alone = cluster.height_components(v, 1.5, 0.2, "vertex_id")
    assert rows(alone, "vertex_id", "cluster_id") == [(0, 0), (1, 1), (2, 2), (3, 2)]
    merged = lambda n: vertex_labels(cluster.merge_small(m, labels, n, "member_id", F.col("kind") == "sample"))
    assert wireframe.split_edges(e, merged(20)).count() == 3
    assert rows(merged(1), "vertex_id", "cluster_id") == rows(vertex_labels(labels), "vertex_id", "cluster_id")
    assert rows(merged(2), "vertex_id", "cluster_id") == [(0, 0), (1, 0), (2, 0), (3, 0)]
    assert rows(merged(21), "vertex_id", "cluster_id") == rows(vertex_labels(labels), "vertex_id", "cluster_id")
