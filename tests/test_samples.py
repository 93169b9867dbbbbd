"""Sizes and score of the registered samples."""

import numpy as np

from eavesgraph.operators import sampling
from eavesgraph.plans import geometry
from tests.test_operators import cloud


def test_samples_have_the_size_of_the_operator(spark, tmp_path, monkeypatch):
    x = np.random.default_rng(1).random((2300, 3)).round(4)
    cloud(spark, x).write.parquet(f"{tmp_path}/points.parquet")
    d = str(tmp_path)
    assert geometry.farthest_points(spark, d).count() == 2048
    assert geometry.deterministic_resample_2048(spark, d).count() == 2048
    asked, keep = [], sampling.adaptive_sample
    monkeypatch.setattr(sampling, "adaptive_sample", lambda p, *a: asked.append((p, a)) or keep(p, *a))
    assert geometry.adaptive_sample(spark, d).distinct().count() == 2048
    p, sizes = asked[0]
    assert sizes == ("score", 2048, 4096)
    shape = {r.point_id: r.score for r in geometry.geometric_features(spark, d).collect()}
    assert all(np.isclose(r.score, shape[r.point_id]) for r in p.collect())
