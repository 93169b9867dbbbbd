"""What the genetic part adds to best fit, and the bound on levels."""

import numpy as np

from eavesgraph.llm import packing


def test_triples_that_fill_a_bin_are_packed_better_than_by_best_fit():
    rng = np.random.default_rng(0)
    a, b = rng.integers(1638, 4096, (2, 300))
    b = np.minimum(b, 8192 - a - 1)
    p = packing.Packer(rng.permutation(np.concatenate((a, b, 8192 - a - b))), 8192, 1)
    first = len(np.unique(p.fresh(0.0)))
    best = p.evolve([], packing.EPOCHS * packing.GENERATIONS, packing.POPULATION)[0][1]
    assert len(np.unique(best)) <= first - 4 and np.bincount(best, weights=p.size).max() <= 8192


def test_awkward_sizes_end_after_the_last_level(spark, monkeypatch):
    monkeypatch.setattr(packing, "LEVELS", 2)
    docs = spark.createDataFrame([(i, "x" * 4100) for i in range(90)], "doc_id long, text string")
    packed = packing.pack(docs, shard=20)
    assert packed.count() == 90 == packed.select("doc_id").distinct().count() == packed.select("container_id").distinct().count()
