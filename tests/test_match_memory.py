"""Assignment of many corners without their matrix of distances."""

import tracemalloc

import numpy as np

from eavesgraph.operators import match


def test_distances_are_made_by_rows():
    rng = np.random.default_rng(1)
    for n, m in ((40, 90), (90, 40), (30, 30)):
        a, b = rng.random((n, 3)).round(1), rng.random((m, 3)).round(1)
        whole = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1) + 1e-6)
        for got, want in zip(match.assign(match.Distances(a, b, 1e-6)), match.assign(whole)):
            assert got.tolist() == want.tolist()
    a, b = rng.random((300, 3)), rng.random((6000, 3))
    tracemalloc.start()
    r, c = match.assign(match.Distances(a, b))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(set(c.tolist())) == 300 and peak < 300 * 6000 * 8 / 4
