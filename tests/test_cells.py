"""Density clusters and cell links against brute force, with very full cells."""

import numpy as np
import pytest

from eavesgraph.operators import cells, cluster, spatial
from tests.test_operators import cloud


def brute(x, eps, m):
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    near = (d <= eps * eps) & ~np.eye(len(x), dtype=bool)
    core = near.sum(1) >= m
    label = np.where(core, np.arange(len(x)), -1)
    while True:
        new = np.array([min([label[i], *label[near[i] & core]]) if core[i] else -1 for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    number = {v: k for k, v in enumerate(sorted(set(label[core])))}
    out = []
    for i in range(len(x)):
        ids = [number[label[j]] for j in ([i] if core[i] else np.flatnonzero(near[i] & core))]
        out.append((i, min(ids) if ids else None, bool(core[i])))
    return out


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_density_clusters(spark, rows, seed):
    rng = np.random.default_rng(seed)
    x = (rng.random((250, 3)) * [1.0, 1.0, 0.2]).round(3)
    x[:60] = (rng.random((60, 3)) * 0.05 + 0.5).round(3)
    x[60:70] = x[0]
    got = rows(cluster.dbscan(cloud(spark, x), 0.12, 4))
    assert got == sorted([("a", *t) for t in brute(x, 0.12, 4)], key=str)


@pytest.mark.parametrize("gap", [0.0999, 0.1001])
def test_full_cells_are_halved_until_they_decide(spark, gap):
    rng = np.random.default_rng(3)
    a, b = rng.random((150, 3)) * [0.04, 0.05, 0.05], rng.random((150, 3)) * [0.04, 0.05, 0.05] + [0.04 + 0.058, 0, 0]
    a[:40], b[:40] = [0.02, 0.01, 0.01], [0.02 + gap, 0.01, 0.01]
    a, b = a[a[:, 0] <= 0.02], b[b[:, 0] >= 0.02 + gap]
    x = np.concatenate((a, b))
    placed = cells.with_cells(cloud(spark, x).withColumnsRenamed({c: f"p{c}" for c in "xyz"}), cells.cell_side(0.1)).cache()
    links = cells.cell_links(placed, cells.boxed(placed), 0.1, cells.cell_side(0.1), direct=4)
    cell = np.floor(x / cells.cell_side(0.1)).astype(int)
    key = {}
    for i, c in enumerate(map(tuple, cell)):
        key.setdefault(c, []).append(i)
    want = set()
    for p in key.values():
        for q in key.values():
            if min(p) < min(q) and (((x[p][:, None] - x[q][None]) ** 2).sum(-1) <= 0.01).any():
                want.add((min(p), min(q)))
    assert {(r.u, r.v) for r in links.collect()} == want


def test_nearest_in_uneven_clouds(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate((rng.random((200, 3)), rng.random((30, 3)) * 0.01 + [900, 0, 0], [[1e5, 0, 0], [0, -1e5, 3]])).round(4)
    got = {}
    for r in spatial.knn(cloud(spark, x), cloud(spark, x), 5, "point_id", "point_id", spread=40).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.target_id))
    for i in range(len(x)):
        want = sorted(range(len(x)), key=lambda j: (((x[i] - x[j]) ** 2).sum(), j))[:5]
        assert [t for _, t in sorted(got[i])] == want
