"""The operators of clouds and wireframes on small fixtures, against brute force where there is one."""

import itertools
import math

import numpy as np
import pytest

from eavesgraph.functions import curves
from eavesgraph.operators import cluster, match, normalise, order, sampling, spatial, wireframe
from eavesgraph.sources import files


def cloud(spark, xyz, frame="a"):
    return spark.createDataFrame([(frame, i, float(x), float(y), float(z)) for i, (x, y, z) in enumerate(xyz)], "frame_id string, point_id long, x double, y double, z double")


def test_neighbour_at_the_radius(spark, rows):
    p = cloud(spark, [(i, 0, 0) for i in range(5)])
    assert spatial.radius_pairs(p, p, 1.0).count() == 5
    assert spatial.radius_pairs(p, p, 1.0, inclusive=True).count() == 13


def test_dbscan_counts_without_the_point_itself(spark, rows):
    p = cloud(spark, [(0, 0, 0), (1, 0, 0), (2, 0, 0), (9, 9, 9)])
    assert rows(cluster.dbscan(p, 1.0, 2), "point_id", "cluster_id", "is_core") == [(0, 0, False), (1, 0, True), (2, 0, False), (3, None, False)]
    assert cluster.dbscan(p, 1.0, 3).where("cluster_id is not null").count() == 0
    assert cluster.dbscan(p.limit(0), 1.0, 3).count() == 0


def test_border_point_joins_the_lower_cluster(spark, rows):
    left, right = [(0, 0, 0), (-0.5, 0, 0), (-0.5, 0.5, 0)], [(2, 0, 0), (2.5, 0, 0), (2.5, 0.5, 0)]
    p = cloud(spark, [*right, (1, 0, 0), *left])
    got = {r.point_id: (r.cluster_id, r.is_core) for r in cluster.dbscan(p, 1.0, 3).collect()}
    assert got[3] == (0, False) and got[0] == (0, True) and got[4] == (1, True)


def test_height_step_is_strict(spark, rows):
    p = cloud(spark, [(0, 0, 0), (0.1, 0, 0.2), (0.2, 0, 0.3)])
    assert rows(cluster.height_components(p, 1.0, 0.2), "point_id", "cluster_id") == [(0, 0), (1, 1), (2, 1)]


@pytest.mark.parametrize("k", [1, 4])
def test_knn_equals_brute_force(spark, k):
    rng = np.random.default_rng(k)
    x = np.concatenate((rng.random((150, 3)), rng.random((5, 3)) * 40)).round(2)
    p = cloud(spark, x)
    got = {}
    for r in spatial.knn(p, p, k, "point_id", "point_id", with_self=False).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.target_id
    for i in range(len(x)):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        want = np.lexsort((np.arange(len(x)), d))[:k]
        assert np.allclose(d[[got[i][j + 1] for j in range(k)]], d[want])


def test_nearest_tie_goes_to_the_lower_id(spark, rows):
    q = cloud(spark, [(0, 0, 0)])
    t = spark.createDataFrame([("a", 5, 1.0, 0.0, 0.0), ("a", 3, -1.0, 0.0, 0.0)], "frame_id string, vertex_id int, x double, y double, z double")
    assert rows(spatial.nearest_within(q, t, 2.0), "target_id") == [(3,)]


def test_normalise_and_back(spark):
    p = cloud(spark, np.random.default_rng(0).random((50, 3)))
    st = normalise.frame_stats(p)
    a = {r.point_id: r for r in p.collect()}
    for r in normalise.denormalise(normalise.normalise(p, st), st).collect():
        assert math.isclose(r.x, a[r.point_id].x, abs_tol=1e-12)
    one = cloud(spark, [(1, 1, 1)])
    assert normalise.normalise(one, normalise.frame_stats(one)).first().x is None


def test_assignment_is_cheapest():
    rng = np.random.default_rng(0)
    for _ in range(100):
        n, m = (int(v) for v in rng.integers(1, 6, 2))
        c = rng.random((n, m)).round(1)
        r, k = match.assign(c)
        least = min(n, m)
        best = min(sum(c[i, j] for i, j in zip(p, q)) for p in itertools.combinations(range(n), least) for q in itertools.permutations(range(m), least))
        assert len(set(k.tolist())) == least and math.isclose(c[r, k].sum(), best, abs_tol=1e-9)


def test_curves():
    grid = np.array(list(itertools.product(range(8), repeat=3)))
    h = curves.hilbert_index(grid, 3)
    assert sorted(h) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(h)], axis=0)).sum(1) == 1).all()
    x = np.random.default_rng(0).integers(0, 65536, (500, 3))
    assert (curves.hilbert_point(curves.hilbert_index(x)) == x).all()


def test_row_numbers_and_patches(spark, rows):
    p = cloud(spark, [(i, 0, 0) for i in range(10)])
    s = order.row_numbers(p.select("frame_id", "point_id"), ["frame_id"], ["point_id"], "position")
    assert rows(s, "point_id", "position") == [(i, i) for i in range(10)]
    last = order.patches(s, 4).where("patch = 2")
    assert rows(last, "slot", "point_id", "filler") == [(0, 8, False), (1, 9, False), (2, 6, True), (3, 7, True)]


def test_farthest_points():
    x = np.array([[0.0], [1], [10], [9]])
    assert sampling.farthest(x, 3).tolist() == [0, 2, 1]


def test_obj_dialects(spark, rows):
    make = lambda text: spark.createDataFrame([("a", i, t) for i, t in enumerate(text)], "frame_id string, line_no int, line string")
    t = make(["v 0 0 0", "v 1 0 0", "v 1 1 0", "l 1 2", "l 2 1", "l 2 3", "# c", "l x 2", ""])
    assert rows(files.obj_edges(t), "src", "dst") == [(0, 1), (1, 2)]
    assert rows(files.obj_edges(t, "ordered"), "src", "dst") == [(0, 1), (1, 0), (1, 2)]
    f = make(["f 1//1 2//2 3//3"])
    assert rows(files.obj_edges(f, "face"), "src", "dst") == rows(files.obj_edges(f, "loop"), "src", "dst") == [(0, 1), (0, 2), (1, 2)]
    assert files.obj_vertices(t).count() == 3


def test_xyz_and_ply_files(spark, tmp_path, rows):
    for name, text in (("a", "1 2 3 4 5 6\n7 8 9 1 2 3\n"), ("b", "1 2 3\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "points.xyz").write_text(text)
    got = files.read_xyz(spark, f"file://{tmp_path}/*/points.xyz", color=True)
    assert rows(got, "frame_id", "point_id", "x", "r") == [("a", 0, 1.0, 4.0), ("a", 1, 7.0, 1.0), ("b", 0, 1.0, None)]
    (tmp_path / "c.ply").write_text("ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nend_header\n1 2 3\n4 5 6\n")
    assert rows(files.read_cloud(spark, f"file://{tmp_path}/c.ply"), "frame_id", "point_id", "z") == [("c", 0, 3.0), ("c", 1, 6.0)]
    with pytest.raises(ValueError):
        files.read_cloud(spark, "a.las")


def test_split_and_merge(spark, rows):
    m = spark.createDataFrame([("a", 0, 0), ("a", 1, 0), ("a", 2, 1), ("a", 3, 1)], "frame_id string, vertex_id int, cluster_id int")
    e = spark.createDataFrame([("a", 0, 1), ("a", 1, 2), ("a", 2, 3)], "frame_id string, src int, dst int")
    parts = wireframe.split_edges(e, m)
    assert rows(parts, "cluster_id", "src", "dst") == [(0, 0, 1), (1, 0, 1)]
    assert rows(wireframe.merged_edges(parts, wireframe.merge_offsets(m)), "src", "dst") == [(0, 1), (2, 3)]
    one = spark.createDataFrame([("b", 0, 1.0, 1.0, 1.0)], "frame_id string, corner_id int, x double, y double, z double")
    assert wireframe.candidate_edges(one).count() == 0
