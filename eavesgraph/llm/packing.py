"""Texts packed into containers of fixed capacity by a grouping genetic algorithm.

An individual is a division of the items of a shard into bins. Crossover puts
well-filled bins of one parent into the other, drops the bins that would hold
an item twice and places the displaced items anew, each in the fullest bin that
has room for it. Islands evolve apart and send their elites on in a ring.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eavesgraph.session import written

CAPACITY = 8192
#: Items of a shard, islands of a shard, and how long they evolve.
SHARD, ISLANDS, EPOCHS, GENERATIONS, POPULATION, ELITE = 4096, 2, 3, 20, 8, 2
#: Bins filled less than this share are opened again and packed across shards, at most so many times.
CLOSED, LEVELS = 0.99, 6
#: Most tasks of an epoch.
TASKS = 20_000
INDIVIDUAL = "shard long, island int, fitness double, bin array<int>"


def pieces_of(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, size, n_pieces): whole texts, and the pieces of those larger than a container.

    Sizes are in tokens of the byte-level tokenizer: the UTF-8 bytes of text.
    Only a text of more than ``capacity`` tokens is cut, into full pieces and a
    rest. Null and empty texts have no tokens and need no container; rows
    without doc_id are left out. A repeated row is an item of its own.
    """
    n = documents.where("doc_id is not null and text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length("text").cast("long").alias("n"))
    n = n.withColumn("n_pieces", F.ceil(F.col("n") / capacity).cast("int"))
    cut = n.select("doc_id", "n", "n_pieces", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)).alias("piece"))
    return cut.select("doc_id", "piece", F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).cast("int").alias("size"), "n_pieces")


class Packer:
    """The genetic operators over the items of one shard."""

    def __init__(self, size: np.ndarray, capacity: int, seed: int):
        self.size, self.capacity, self.rng = size.astype(np.int64), capacity, np.random.default_rng(seed)

    def best_fit(self, bins: np.ndarray, fill: list[int], items: np.ndarray) -> None:
        """Place ``items`` (in the order given), each in the fullest bin with room; may open bins."""
        cap = self.capacity
        room = sorted((cap - f, b) for b, f in enumerate(fill) if f < cap)
        for i, s in zip(items.tolist(), self.size[items].tolist()):
            at = bisect_left(room, (s, -1))
            if at < len(room):
                left, b = room.pop(at)
            else:
                left, b = cap, len(fill)
                fill.append(0)
            bins[i] = b
            fill[b] += s
            if left > s:
                insort(room, (left - s, b))

    def fresh(self, noise: float) -> np.ndarray:
        """An individual by best fit, in order of decreasing size disturbed by ``noise``."""
        order = np.argsort(-self.size * (1 + noise * self.rng.random(len(self.size))), kind="stable")
        bins = np.full(len(self.size), -1, np.int64)
        self.best_fit(bins, [], order)
        return bins

    def fitness(self, bins: np.ndarray) -> float:
        """Mean of squared fills: fewer and fuller bins are better."""
        fill = np.bincount(bins, weights=self.size)
        fill = fill[fill > 0]
        return float(((fill / self.capacity) ** 2).mean()) if len(fill) else 1.0

    def cross(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Inject whole well-filled bins of b into a."""
        fill = np.bincount(b, weights=self.size)
        good = np.argsort(-fill, kind="stable")[: max(1, len(fill) // 2)]
        chosen = np.zeros(len(fill), bool)
        chosen[self.rng.choice(good, max(1, len(good) // 6), replace=False)] = True
        injected = chosen[b]
        return self._refill(a, injected, b)

    def mutate(self, a: np.ndarray) -> np.ndarray:
        """Empty the least filled bins and some others and place their items anew."""
        fill = np.bincount(a, weights=self.size)
        n = max(2, len(fill) // 20)
        gone = np.zeros(len(fill), bool)
        gone[np.argsort(fill, kind="stable")[:n]] = True
        gone[self.rng.integers(0, len(fill), n)] = True
        return self._place(a, ~gone[a], self.rng.permutation(np.flatnonzero(gone[a])) if self.rng.random() < 0.3 else None)

    def _refill(self, a: np.ndarray, injected: np.ndarray, b: np.ndarray) -> np.ndarray:
        hurt = np.zeros(int(a.max()) + 1, bool)
        hurt[a[injected]] = True
        kept = ~hurt[a]
        out = np.full(len(a), -1, np.int64)
        out[injected] = b[injected]
        out[kept] = a[kept] + int(b.max()) + 1
        return self._place(out, kept | injected)

    def _place(self, bins: np.ndarray, kept: np.ndarray, order: np.ndarray | None = None) -> np.ndarray:
        out = np.full(len(bins), -1, np.int64)
        used, out[kept] = np.unique(bins[kept], return_inverse=True)
        fill = np.bincount(out[kept], weights=self.size[kept], minlength=len(used)).astype(np.int64).tolist()
        if order is None:
            free = np.flatnonzero(~kept)
            order = free[np.argsort(-self.size[free], kind="stable")]
        self.best_fit(out, fill, order)
        return out

    def evolve(self, start: list[np.ndarray], generations: int, population: int) -> list[tuple[float, np.ndarray]]:
        """(fitness, individual) of the population after so many generations, best first."""
        pool = [*start]
        while len(pool) < population:
            pool.append(self.fresh(0.0 if not pool else 0.3 * len(pool) / population))
        ranked = sorted(((self.fitness(p), p) for p in pool), key=lambda x: -x[0])[:population]
        for _ in range(generations):
            children = []
            for k in range(max(1, population // 2)):
                i, j = self.rng.choice(len(ranked), 2, replace=len(ranked) < 2)
                child = self.cross(ranked[min(i, j)][1], ranked[max(i, j)][1])
                children.append(self.mutate(child) if k % 2 else child)
            ranked = sorted([*ranked, *((self.fitness(c), c) for c in children)], key=lambda x: -x[0])[:population]
        return ranked


def _epoch(epoch: int, capacity: int):
    """The function that evolves one island from the sizes of its shard and its own and its guests' individuals."""

    def run(items: pd.DataFrame, guests: pd.DataFrame) -> pd.DataFrame:
        shard, island = int(items["shard"].iloc[0]), int(items["island"].iloc[0])
        guests = guests.sort_values(["fitness", "origin"], ascending=[False, True], kind="stable")
        packer = Packer(np.asarray(items["size"].iloc[0]), capacity, hash((shard, island, epoch)) & 0x7FFFFFFF)
        best = packer.evolve([np.asarray(b).astype(np.int64) for b in guests["bin"]], GENERATIONS, POPULATION)[:ELITE]
        return pd.DataFrame([(shard, island, f, b.tolist()) for f, b in best], columns=["shard", "island", "fitness", "bin"])

    return run


def evolve_shards(items: DataFrame, capacity: int = CAPACITY, islands: int = ISLANDS, epochs: int = EPOCHS, tasks: int = 200) -> DataFrame:
    """(shard, doc_id, piece, size, bin) of the best individual of each shard.

    items: doc_id, piece, size, shard. The items of a shard are written once, in
    a fixed order; individuals are only the bins of that order. Between epochs
    the elites of an island stay and also move to the next island of their shard.
    tasks: how many an epoch is spread over; sizes are small but long to pack,
    so this must not follow from their bytes.
    """
    row = F.struct("doc_id", "piece", "size")
    held, _ = written(items.groupBy("shard").agg(F.array_sort(F.collect_list(row)).alias("i")).select(F.col("shard").cast("long").alias("shard"), "i"), "shards")
    sizes = held.select("shard", F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island"), F.col("i.size").alias("size")).repartition(tasks, "shard", "island")
    state = None
    for epoch in range(epochs):
        if state is None:
            guests = items.sparkSession.createDataFrame([], "g_shard long, g_island int, origin int, fitness double, bin array<int>")
        else:
            visits = F.explode(F.array(F.col("island"), (F.col("island") + 1) % islands) if islands > 1 else F.array("island"))
            guests = state.select(F.col("shard").alias("g_shard"), visits.alias("g_island"), F.col("island").alias("origin"), "fitness", "bin")
        state = sizes.groupBy("shard", "island").cogroup(guests.repartition(tasks, "g_shard", "g_island").groupBy("g_shard", "g_island")).applyInPandas(_epoch(epoch, capacity), INDIVIDUAL)
    best = state.groupBy("shard").agg(F.max_by("bin", F.struct("fitness", -F.col("island"))).alias("bin"))
    return held.join(best, "shard").select("shard", F.explode(F.arrays_zip("i.doc_id", "i.piece", "i.size", "bin")).alias("i")).select("shard", "i.doc_id", "i.piece", "i.size", "i.bin")


def pack(documents: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """(container_id, doc_id, piece, n_pieces, size): every text or piece in one container.

    Full pieces are containers of their own. The other items are dealt by a
    hash into shards of about ``shard`` items, so that no task holds more
    however many items there are; what the best individuals leave in bins filled
    under the share CLOSED is dealt anew and packed again across shards, until
    one shard is left or LEVELS levels were made; the last level keeps all its
    bins. The result is deterministic. An empty table gives no containers.
    """
    items, _ = written(pieces_of(documents, capacity), "pieces")
    whole = items.where(F.col("size") == capacity).select(F.concat_ws("-", F.lit("full"), "doc_id", "piece").alias("container_id"), "doc_id", "piece", "size")
    done, rest, level = [whole], items.where(F.col("size") < capacity).select("doc_id", "piece", "size"), 0
    n = rest.count()
    while n:
        shards = max(1, math.ceil(n / shard))
        dealt = rest.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", F.lit(level)), F.lit(shards)))
        packed, _ = written(evolve_shards(dealt, capacity, tasks=min(shards * ISLANDS, TASKS)), "packed")
        fill = packed.groupBy("shard", "bin").agg(F.sum("size").alias("fill"))
        last = shards == 1 or level == LEVELS - 1
        ready = packed if last else packed.join(fill.where(F.col("fill") >= CLOSED * capacity), ["shard", "bin"], "left_semi")
        left = None if last else packed.join(fill.where(F.col("fill") < CLOSED * capacity), ["shard", "bin"], "left_semi").select("doc_id", "piece", "size")
        n = 0 if last else left.count()
        done.append(ready.select(F.concat_ws("-", F.lit(level), "shard", "bin").alias("container_id"), "doc_id", "piece", "size"))
        rest, level = left, level + 1
    counts = items.where("n_pieces > 1").select("doc_id", "n_pieces").distinct()
    out = reduce(DataFrame.unionByName, done).join(counts, "doc_id", "left")
    return out.select("container_id", "doc_id", "piece", F.coalesce("n_pieces", F.lit(1)).alias("n_pieces"), "size")


def containers(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(container_id, n_items, n_tokens, unused)."""
    return packed.groupBy("container_id").agg(F.count("*").alias("n_items"), F.sum("size").alias("n_tokens")).withColumn("unused", F.lit(capacity) - F.col("n_tokens"))
