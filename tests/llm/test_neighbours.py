"""Cells, graphs written down, and recall for every vector."""

import numpy as np

from eavesgraph.llm import neighbours
from eavesgraph.llm.vamana import ShardIndex


def fusion(spark, x, run=lambda i: "r"):
    data = [(i, run(i), v[:3].tolist(), v[3:8].tolist(), v[8:].tolist()) for i, v in enumerate(x)]
    return neighbours.vectors(spark.createDataFrame(data, "vec_id long, run_id string, xyz array<double>, fpfh array<double>, mrgd array<double>"))


def test_a_stored_graph_answers_as_before():
    rng = np.random.default_rng(0)
    x, ids = rng.normal(size=(700, 11)).round(2), rng.permutation(700)
    a = ShardIndex(ids, x)
    b = ShardIndex.load(*a.stored())
    for one, two in zip(a.nearest(x[:50], ids[:50], 10, 32), b.nearest(x[:50], ids[:50], 10, 32)):
        assert np.array_equal(one, two)


def test_cells_out_of_reach_hold_nothing_nearer():
    rng = np.random.default_rng(1)
    x, c = rng.normal(size=(400, 11)), rng.normal(size=(9, 11))
    own = neighbours.closest(x, c)
    radius = rng.random(400) * 2
    row, cell = neighbours.crossed(x, own, radius, c)
    sent = set(zip(row.tolist(), cell.tolist())) | set(enumerate(own.tolist()))
    for i in range(400):
        for j in np.flatnonzero(((x - x[i]) ** 2).sum(1) <= radius[i] ** 2):
            assert (i, int(own[j])) in sent


def test_recall_of_every_vector_over_cells_and_parts(spark):
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(6, 11))[rng.integers(0, 6, 1500)] * 4 + rng.normal(size=(1500, 11))).round(3)
    x[300:420] = x[7]
    base = fusion(spark, x, lambda i: "small" if i % 50 == 0 else "large")
    base = base.unionByName(base.where("vec_id < 20"))
    got = {}
    for r in neighbours.nearest(base, base, shard=60).collect():
        got.setdefault(r.vec_id, []).append((r.rank, r.neighbour))
    hits = []
    for i in range(1500):
        ids = np.array([j for j in range(1500) if (j % 50 == 0) == (i % 50 == 0)])
        want = neighbours.brute_force(x[ids], ids, x[[i]], [i], 10)[0].tolist()
        mine = [n for _, n in sorted(got[i])]
        assert len(mine) == 10 and i not in mine and len(set(mine)) == 10
        hits.append(len(set(mine) & set(want)) / 10)
    assert np.mean(hits) >= 0.98
    assert [n for _, n in sorted(got[351])] == [7, *range(301, 310)]
