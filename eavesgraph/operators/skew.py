"""Joins to one-row-per-key tables that stay even when few keys hold most rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy if it holds at least this share of all rows, so there are at most as many heavy keys as the share goes into one.
HEAVY_SHARE = 1 / 1024
#: Below this many rows a key is no load for a task and is not split off.
HEAVY_LEAST = 1_000


def heavy_keys(counts: DataFrame, keys: list[str], n: str = "n", share: float = HEAVY_SHARE, least: int | None = None) -> list[tuple]:
    """The keys that hold at least ``share`` of all rows and ``least`` rows (HEAVY_LEAST); at most 1 / share of them.

    counts: per key (or key and period) the number ``n`` of rows. Which keys are
    split off changes the plan of a join, never its rows.
    """
    per = counts.groupBy(*keys).agg(F.sum(n).alias("_n"))
    total = counts.agg(F.sum(n)).first()[0] or 0
    least = max(HEAVY_LEAST if least is None else least, int(total * share) + 1)
    if total < least:
        return []
    return [tuple(r[k] for k in keys) for r in per.where(F.col("_n") >= least).select(*keys).collect()]


def join_by_weight(rows: DataFrame, states: DataFrame, keys: list[str], heavy: list[tuple], how: str = "left") -> DataFrame:
    """Join ``rows`` to ``states`` (one row a key); heavy keys are broadcast, the rest shuffled.

    Null keys never match. heavy: what heavy_keys() gave, so the broadcast side
    has at most 1024 rows.
    """
    if not heavy:
        return rows.join(states, keys, how)
    spark = rows.sparkSession
    schema = rows.select(*keys).schema
    marks = spark.createDataFrame(heavy, schema)
    split = rows.join(F.broadcast(marks.withColumn("_heavy", F.lit(True))), keys, "left")
    hot_states = F.broadcast(states.join(F.broadcast(marks), keys, "left_semi"))
    hot = split.where("_heavy").drop("_heavy").join(hot_states, keys, how)
    rest = split.where("_heavy is null").drop("_heavy").join(states, keys, how)
    return reduce(DataFrame.unionByName, [hot, rest])
