"""Codes of large clouds, all orders, and coordinates that do not fit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eavesgraph.functions import curves
from eavesgraph.operators import order


def cols():
    return [F.col(c) for c in ("gx", "gy", "gz")]


def grid(spark, x):
    return spark.createDataFrame([(i, *map(int, v)) for i, v in enumerate(x)], "i long, gx long, gy long, gz long")


@pytest.mark.parametrize("name", curves.ORDERS)
def test_every_order_comes_back_with_and_without_a_batch(spark, name):
    rng = np.random.default_rng(0)
    x = np.concatenate((rng.integers(0, 1 << 21, (50, 3)), [[0, 0, 0], [(1 << 21) - 1] * 3, [1 << 20, 65536, 65535]]))
    df = grid(spark, x)
    got = curves.decode(name, F.col("code"))
    back = df.select(*cols(), curves.encode(name, *cols()).alias("code")).select(*cols(), *[got[c].alias(c) for c in "xyz"], "code")
    assert all((r.gx, r.gy, r.gz) == (r.x, r.y, r.z) for r in back.collect()) and back.select("code").distinct().count() == len(x)
    small = grid(spark, x >> 11)
    got = curves.decode(name, F.col("code"), 10)
    both = small.select(*cols(), curves.encode(name, *cols(), 10, F.col("i"), 6).alias("code"), "i").select(*cols(), *[got[c].alias(c) for c in "xyz"], "i", F.shiftright("code", 30).alias("b"))
    assert all((r.gx, r.gy, r.gz, r.i) == (r.x, r.y, r.z, r.b) for r in both.collect())


def test_what_does_not_fit_is_an_error(spark):
    for name in curves.ORDERS:
        for bad in ([1 << 21, 0, 0], [0, 0, -1]):
            with pytest.raises(Exception, match="does not fit"):
                grid(spark, [bad]).select(curves.encode(name, *cols())).collect()
        assert grid(spark, [[1, 1, 1]]).select(curves.encode(name, *[F.when(c > 5, c) for c in cols()])).first()[0] is None
    with pytest.raises(ValueError):
        curves.encode("z", *cols(), 21, F.lit(1), 1)
    with pytest.raises(ValueError):
        curves.data_depth(grid(spark, [[1 << 21, 0, 0]]))
    assert curves.data_depth(grid(spark, [[1 << 20, 0, 0]])) == 21 and curves.data_depth(grid(spark, np.zeros((0, 3)))) == 1


def test_a_frame_of_three_kilometres_keeps_its_order(spark):
    x = np.random.default_rng(1).random((200, 3)) * [3000, 900, 60]
    df = spark.createDataFrame([("a", i, *map(float, v)) for i, v in enumerate(x)], "frame_id string, point_id long, x double, y double, z double")
    cell = np.floor((x - x.min(0)) / 0.01).astype(np.int64)
    code = sum(((cell[:, a] >> b) & 1) << (3 * b + 2 - a) for b in range(21) for a in range(3))
    want = {int(i): k for k, i in enumerate(np.lexsort((np.arange(200), code)))}
    got = {r.point_id: r.position for r in order.serialise(df, 0.01).collect()}
    assert got == want and cell.max() > 65535
