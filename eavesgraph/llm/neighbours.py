"""The k most similar vectors of the same run, from pruned graphs of the cells of each run."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eavesgraph.llm.vamana import ShardIndex
from eavesgraph.session import broadcast_if_small, drop_path, small, written

#: Parts of a vector and their lengths.
PARTS = (("xyz", 3), ("fpfh", 5), ("mrgd", 3))
DIMS = sum(n for _, n in PARTS)
#: Vectors of a shard; a graph holds at most about twice as many.
SHARD = 8192
#: Most cells of a run and of all runs, vectors a cell in the sample that places them, and rounds of k-means.
RUN_CELLS, CELLS, SAMPLE, ROUNDS = 1024, 200_000, 64, 6
#: Most tasks that build graphs.
TASKS = 20_000
#: Queries that one task puts to one graph.
BLOCK = 16_384
GRAPH = ["dims", "start", "ids", "x", "first", "count", "edges"]
COLUMNS = [f"c{i}" for i in range(DIMS)]


def vectors(fusion: DataFrame) -> DataFrame:
    """(vec_id, run_id, c0..c10) of the rows that take part.

    A row takes part if its arrays have 3, 5 and 3 entries, none null or NaN;
    rows with a null vec_id or run_id do not. Repeated (vec_id, run_id) rows
    with one vector count once.
    """
    sound = F.col("vec_id").isNotNull() & F.col("run_id").isNotNull()
    for c, n in PARTS:
        sound = sound & (F.size(c) == n) & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v))
    every = [F.col(c)[i] for c, n in PARTS for i in range(n)]
    return fusion.where(F.coalesce(sound, F.lit(False))).select("vec_id", "run_id", *[v.alias(n) for v, n in zip(every, COLUMNS)])


def _cells(base: DataFrame, shard: int) -> dict[str, np.ndarray]:
    """Centroids of the cells of every run of more than ``shard`` vectors, by k-means on a sample.

    A run has a cell for every ``shard`` vectors, but at most RUN_CELLS, and
    all runs together have at most about CELLS; what a cell holds beyond a shard
    is split by a hash later. The sample has about SAMPLE vectors a cell, picked
    by a hash of vec_id. All vectors are indexed; the sample only places cells.
    """
    size = base.groupBy("run_id").agg(F.count("*").alias("n")).where(F.col("n") > shard)
    size, scratch = written(size, "runs")
    total = size.agg(F.sum("n")).first()[0]
    if not total:
        drop_path(base.sparkSession, scratch)
        return {}
    cells = F.least(F.lit(RUN_CELLS), F.ceil(F.col("n") / F.lit(max(shard, total / CELLS))))
    wanted = broadcast_if_small(size.select("run_id", cells.cast("int").alias("k"), F.greatest(F.lit(1), F.floor(F.col("n") / (cells * SAMPLE))).cast("long").alias("every")))
    picked = base.join(wanted, "run_id").where(F.pmod(F.xxhash64("vec_id", F.lit(1)), "every") == 0)

    def means(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.unique(pdf[COLUMNS].to_numpy(np.float64), axis=0)
        c = x[np.random.default_rng(0).permutation(len(x))[: int(pdf["k"].iloc[0])]].copy()
        for _ in range(ROUNDS):
            near = closest(x, c)
            n = np.bincount(near, minlength=len(c))
            total = np.stack([np.bincount(near, weights=v, minlength=len(c)) for v in x.T], 1)
            c[n > 0] = total[n > 0] / n[n > 0, None]
        return pd.DataFrame(c, columns=COLUMNS).assign(run_id=pdf["run_id"].iloc[0])

    rows = picked.groupBy("run_id").applyInPandas(means, ", ".join(f"{c} double" for c in COLUMNS) + ", run_id string").toPandas()
    drop_path(base.sparkSession, scratch)
    return {run: np.ascontiguousarray(g[COLUMNS].to_numpy(np.float64)) for run, g in rows.groupby("run_id")}


def closest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row."""
    half = (c * c).sum(1) / 2
    step = max(1, 4_000_000 // len(c))
    return np.concatenate([(half - x[i : i + step] @ c.T).argmin(1) for i in range(0, len(x), step)]) if len(x) else np.zeros(0, np.int64)


def crossed(x: np.ndarray, own: np.ndarray, radius: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of the other cells that reach into the ball of each row.

    Whatever lies in another cell is beyond the plane half-way between both
    centroids, so cells whose plane is farther than the radius hold no nearer vector.
    """
    d2 = (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)
    gap = np.sqrt(np.maximum(((c[own] * c[own]).sum(1)[:, None] - 2 * c[own] @ c.T + (c * c).sum(1)), 1e-18))
    plane = (d2 - d2[np.arange(len(x)), own][:, None]) / (2 * gap)
    need = plane <= radius[:, None] * (1 + 1e-9) + 1e-9
    need[np.arange(len(x)), own] = False
    return np.nonzero(need)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMS)


def _by_run(column: pa.Array):
    """(run, its rows) of a batch."""
    code = column.dictionary_encode()
    index = code.indices.to_numpy(zero_copy_only=False)
    for i, run in enumerate(code.dictionary.to_pylist()):
        yield run, np.flatnonzero(index == i)


def _placed(vecs: DataFrame, shared) -> DataFrame:
    """Add the cell of each vector; runs without cells are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, cell = _matrix(b.column("v")), np.zeros(b.num_rows, np.int32)
            for name, at in _by_run(b.column("run_id")):
                c = shared.value.get(name)
                if c is not None:
                    cell[at] = closest(x[at], c)
            yield b.append_column("cell", pa.array(cell, pa.int32()))

    return vecs.mapInArrow(run, "run_id string, vec_id long, v array<double>, cell int")


def _others(first: DataFrame, shared, k: int) -> DataFrame:
    """The queries with the other cells that may hold something nearer than what their own cell gave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, own = _matrix(b.column("v")), b.column("cell").to_numpy(zero_copy_only=False)
            radius = b.column("radius").to_numpy(zero_copy_only=False)
            for name, at in _by_run(b.column("run_id")):
                c = shared.value.get(name)
                if c is None:
                    continue
                for lo in range(0, len(at), max(1, 1_000_000 // len(c))):
                    part = at[lo : lo + max(1, 1_000_000 // len(c))]
                    row, cell = crossed(x[part], own[part], radius[part], c)
                    if len(row):
                        yield pa.RecordBatch.from_arrays([*(v.take(pa.array(part[row])) for v in (b.column("run_id"), b.column("vec_id"), b.column("v"))), pa.array(cell.astype(np.int32))], ["run_id", "vec_id", "v", "cell"])

    full = F.when(F.size("near") >= k, F.sqrt(F.element_at("near", -1)["d2"])).otherwise(F.lit(float("inf")))
    return first.select("run_id", "vec_id", "v", "cell", full.alias("radius")).mapInArrow(run, "run_id string, vec_id long, v array<double>, cell int")


_NEAR = "run_id string, vec_id long, near array<struct<d2: double, neighbour: long>>"


def _searched(asked: DataFrame, graphs: DataFrame, parts: DataFrame, k: int, beam: int) -> DataFrame:
    """(run_id, vec_id, near): the k nearest of each query in each part of the cell it is sent to.

    Queries are dealt into blocks of about BLOCK, and a block meets the written
    graph, so no task holds all queries of a run.
    """
    where = ["run_id", "cell", "part"]
    spread = asked.join(parts, ["run_id", "cell"]).select("run_id", "cell", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)).alias("part"), "vec_id", "v")
    spread, _ = written(spread, "asked")
    n = spread.groupBy(*where).agg(F.ceil(F.count("*") / BLOCK).alias("n_blocks"))
    dealt = spread.join(broadcast_if_small(n), where).groupBy(*where, F.pmod(F.xxhash64("vec_id"), "n_blocks").alias("block")).agg(F.collect_list("vec_id").alias("q_ids"), F.flatten(F.collect_list("v")).alias("q"))
    blocks = F.broadcast(dealt) if small(spread) else dealt

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                index = ShardIndex.load(*(b.column(c)[i].as_py() for c in GRAPH))
                own = b.column("q_ids")[i].values.to_numpy(zero_copy_only=False)
                q = b.column("q")[i].values.to_numpy(zero_copy_only=False).reshape(-1, DIMS)
                row, found, d2 = index.nearest(q, own, k, beam)
                n = np.bincount(row, minlength=len(own))
                offset = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                near = pa.ListArray.from_arrays(pa.array(offset), pa.StructArray.from_arrays([pa.array(d2), pa.array(found, pa.int64())], ["d2", "neighbour"]))
                yield pa.RecordBatch.from_arrays([pa.array([b.column("run_id")[i].as_py()] * len(own), pa.string()), pa.array(own, pa.int64()), near], ["run_id", "vec_id", "near"])

    return graphs.join(blocks, where).select("run_id", *GRAPH, "q_ids", "q").mapInArrow(run, _NEAR)


def _merged(found: DataFrame, k: int, *more) -> DataFrame:
    every = F.flatten(F.collect_list("near"))
    return found.groupBy("run_id", "vec_id").agg(F.slice(F.array_sort(F.array_distinct(every)), 1, k).alias("near"), *more)


def nearest(base: DataFrame, queries: DataFrame, k: int = 10, shard: int = SHARD, beam: int = 64, degree: int = 12, build_beam: int = 16) -> DataFrame:
    """(run_id, vec_id, neighbour, d2, rank): the k nearest of each query among the base vectors of its run.

    base, queries: as vectors() gives them. A run of more than ``shard`` vectors
    is divided into cells about centroids; a cell of more than two shards is cut
    by a hash of vec_id, so no task holds more however a run is shaped. The
    graph of each part is built and written once. A query first searches its own
    cell and then, in a second pass, every cell that reaches into the ball of
    its k-th distance, so the division itself loses nothing; only the beam
    search may. A query is not its own neighbour; equal vectors under another id
    are. Ties go to the smaller id. A run with fewer than k others gives fewer
    rows. Repeated rows count once; rows with one id and other vectors all take
    part in the base, and one of them among the queries. Empty tables give an
    empty result. Recall against brute force is in the tests and in README.md.
    """
    spark = base.sparkSession
    shared = spark.sparkContext.broadcast(_cells(base, shard))
    vec = F.array(*COLUMNS).alias("v")
    placed = _placed(base.select("run_id", "vec_id", vec), shared)
    parts, _ = written(placed.groupBy("run_id", "cell").agg(F.ceil(F.count("*") / (2 * shard)).cast("int").alias("n_parts")), "cells")
    parts = broadcast_if_small(parts)

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["v"].to_numpy())
        once = ~pd.DataFrame(x).assign(i=pdf["vec_id"].to_numpy()).duplicated().to_numpy()
        index = ShardIndex(pdf["vec_id"].to_numpy()[once], x[once], degree=degree, beam=build_beam)
        return pd.DataFrame([(*key, *index.stored())], columns=["run_id", "cell", "part", *GRAPH])

    dealt = placed.join(parts, ["run_id", "cell"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), "n_parts").cast("int"))
    # a graph takes long to build for its bytes, so tasks follow from the number of graphs
    tasks = max(1, min(TASKS, parts.agg(F.sum("n_parts")).first()[0] or 0))
    graphs, _ = written(dealt.select("run_id", "cell", "part", "vec_id", "v").repartition(tasks, "run_id", "cell", "part").groupBy("run_id", "cell", "part").applyInPandas(build, "run_id string, cell int, part int, dims int, start int, ids binary, x binary, first binary, count binary, edges binary"), "graphs")
    asked, _ = written(_placed(queries.select("run_id", "vec_id", vec).dropDuplicates(["run_id", "vec_id"]), shared), "queries")
    near = _searched(asked, graphs, parts, k, beam)
    if shared.value:
        own, _ = written(_merged(near, k), "own-cell")
        near = own.unionByName(_searched(_others(own.join(asked, ["run_id", "vec_id"]), shared, k), graphs, parts, k, beam))
    return _merged(near, k).select("run_id", "vec_id", F.posexplode("near").alias("rank", "n")).select("run_id", "vec_id", "n.neighbour", "n.d2", (F.col("rank") + 1).alias("rank"))


def probe_vectors(base: DataFrame, probes: DataFrame) -> DataFrame:
    """The base vectors whose (vec_id, run_id) is a probe."""
    asked = probes.select("vec_id", "run_id").distinct()
    return base.join(broadcast_if_small(asked), ["vec_id", "run_id"], "left_semi")


def brute_force(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, k: int) -> list[np.ndarray]:
    """The exact answer on a small fixture."""
    out = []
    for v, me in zip(q, own):
        d = np.round(((x - v) ** 2).sum(1), 10)
        order = np.lexsort((ids, d))
        out.append(ids[order][ids[order] != me][:k])
    return out


