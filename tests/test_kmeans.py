"""k-means of a frame with many clusters, without a table of all distances."""

import tracemalloc

import numpy as np

from eavesgraph.operators import cluster


def direct(x, k, rounds, seed=42):
    rng = np.random.default_rng(seed)
    at = [int(rng.integers(len(x)))]
    d = ((x - x[at[0]]) ** 2).sum(1)
    while len(at) < k and d.sum() > 0:
        at.append(int(rng.choice(len(x), p=d / d.sum())))
        d = np.minimum(d, ((x - x[at[-1]]) ** 2).sum(1))
    centres = x[at]
    for _ in range(rounds):
        own = np.stack([((x - c) ** 2).sum(1) for c in centres], 1).argmin(1)
        new = np.stack([x[own == i].mean(0) if (own == i).any() else c for i, c in enumerate(centres)])
        if np.allclose(new, centres):
            break
        centres = new
    return at, own


def clumps(n):
    rng = np.random.default_rng(n)
    x = (rng.random((n, 3)) * (90, 40, 6) + rng.integers(0, 3, (n, 1)) * 200).round(2)
    x[: n // 10] = x[n // 10]
    return x


def test_seeds_are_those_of_single_sums():
    for n, k in ((1600, 700), (3000, 2999)):
        x = clumps(n)
        assert cluster._seeds(x, k, np.random.default_rng(42), 0) == direct(x, k, 1)[0]
    same = np.repeat([[1.0, 2, 3], [4, 5, 6]], 900, 0)
    assert len(cluster._seeds(same, 50, np.random.default_rng(1), 0)) == 2


def test_clusters_of_a_frame_take_no_table_of_distances(monkeypatch):
    class Now:
        """Stands for a table of one frame."""

        def select(self, *_):
            return self

        def groupBy(self, _):
            return self

        def applyInPandas(self, run, _):
            return run

    x, k = clumps(4000), 1900
    run = cluster.kmeans(Now(), ["x", "y", "z"], k, 3)
    pdf = cluster.pd.DataFrame({"frame_id": "a", "point_id": np.arange(len(x)), "x": x[:, 0], "y": x[:, 1], "z": x[:, 2]})
    tracemalloc.start()
    got = run(pdf)["cluster_id"].to_numpy()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 4000 * 1900 * 8 / 2
    assert (got == direct(x, k, 3)[1]).all()
