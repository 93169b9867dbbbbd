"""References to rows that are missing, deleted or later than the referring row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eavesgraph.operators.skew import heavy_keys, join_by_weight
from eavesgraph.session import small, written


def frame_key(c: Column | str) -> Column:
    """Frame ids are the same if equal after trimming blanks and lower-casing."""
    return F.lower(F.trim(c))


def key_states(targets: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: has it any row, and the earliest loaded_at of rows not deleted."""
    live = F.col("deleted_at").isNull()
    return targets.groupBy(*keys).agg(F.max(live).alias("any_live"), F.min(F.when(live, F.col("loaded_at"))).alias("first_live"))


def state_of(loaded_at: str = "loaded_at") -> Column:
    """missing, deleted, late or null (resolved), from a left join to key_states().

    A row whose loaded_at is null, or whose target has none, is not late.
    """
    return F.when(F.col("any_live").isNull(), "missing").when(~F.col("any_live"), "deleted").when(F.col("first_live") > F.col(loaded_at), "late")


def _verdicts(refs: DataFrame, targets: DataFrame, keys: list[str]) -> tuple[DataFrame, list[tuple], DataFrame]:
    """(references per key and month with the key's state, heavy keys, states)."""
    pre = refs.groupBy("ref_table", "ref_col", *keys, F.date_trunc("month", "loaded_at").alias("month")).agg(F.count("*").alias("n"), F.min("loaded_at").alias("first_ref"), F.max("loaded_at").alias("last_ref"))
    pre, _ = written(pre, "references")
    states = key_states(targets, keys)
    heavy = heavy_keys(pre, keys)
    return join_by_weight(pre, states, keys, heavy), heavy, states


def _rows_of(refs: DataFrame, flagged: DataFrame, keys: list[str], heavy: list[tuple]) -> DataFrame:
    """The references to flagged keys; these are written and counted, and broadcast if few, else joined by weight."""
    flagged, _ = written(flagged, "flagged")
    if small(flagged):
        return refs.join(F.broadcast(flagged), keys)
    return join_by_weight(refs, flagged, keys, heavy, "inner")


def find_orphans(refs: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """One row per reference that does not resolve.

    refs: ref_table, row_id, ref_col, the ``keys`` and loaded_at. targets: the
    ``keys``, loaded_at, deleted_at. References are pre-aggregated per key and
    month; only keys with an unresolved or possibly late reference go on to the
    rows. Heavy keys meet a broadcast side of at most 1024 rows, the others
    are shuffled; flagged keys meet the rows as a broadcast side if a count
    shows that they are few. A null in a key is no reference. Repeated reference rows stay
    as they are; repeated target rows count once. Empty tables: with no
    references nothing comes out, with no targets every reference is missing.
    """
    refs = refs.dropna(subset=keys)
    joined, heavy, _ = _verdicts(refs, targets, keys)
    suspect = joined.where(F.col("any_live").isNull() | ~F.col("any_live") | (F.col("first_live") > F.col("first_ref")))
    flagged = suspect.groupBy(*keys).agg(F.first("any_live").alias("any_live"), F.first("first_live").alias("first_live"))
    rows = _rows_of(refs, flagged, keys, heavy)
    return rows.withColumn("state", state_of()).where("state is not null").select("ref_table", "row_id", "ref_col", "state", "loaded_at")


def count_orphans(refs: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Unresolved references per referring table, column, month of loaded_at and state.

    Months that lie wholly before or after the target's arrival are decided
    from the pre-aggregate; only the month in which it arrived is looked at by
    row. A null loaded_at counts under a null month.
    """
    refs = refs.dropna(subset=keys)
    joined, heavy, _ = _verdicts(refs, targets, keys)
    whole = F.when(F.col("any_live").isNull(), "missing").when(~F.col("any_live"), "deleted").when(F.col("first_live") > F.col("last_ref"), "late")
    split = (F.col("first_live") > F.col("first_ref")) & (F.col("first_live") <= F.col("last_ref"))
    sure = joined.withColumn("state", whole).where("state is not null").select("ref_table", "ref_col", "month", "state", "n")
    partly = joined.where(split).groupBy(*keys).agg(F.first("first_live").alias("first_live"), F.collect_set(F.struct("ref_table", "ref_col")).alias("columns"))
    rows = _rows_of(refs, partly, keys, heavy).withColumn("month", F.date_trunc("month", "loaded_at"))
    late = rows.where(F.array_contains("columns", F.struct("ref_table", "ref_col")) & (F.col("first_live") > F.col("loaded_at")) & (F.date_trunc("month", "first_live") == F.col("month"))).select("ref_table", "ref_col", "month", F.lit("late").alias("state"), F.lit(1).cast("long").alias("n"))
    return sure.unionByName(late).groupBy("ref_table", "ref_col", "month", "state").agg(F.sum("n").alias("n_refs"))


def edge_references(edges: DataFrame) -> DataFrame:
    """src and dst of ``edges`` as references; null and -1 refer to nothing."""
    ends = F.explode(F.array(*[F.struct(F.lit(c).alias("ref_col"), F.col(c).alias("vertex_id")) for c in ("src", "dst")]))
    e = edges.select("edge_row", frame_key("frame_id").alias("frame_id"), "loaded_at", ends.alias("e"))
    return e.select(F.lit("edges").alias("ref_table"), F.col("edge_row").alias("row_id"), "e.ref_col", "frame_id", "e.vertex_id", "loaded_at").where("frame_id is not null and vertex_id is not null and vertex_id <> -1")


def vertex_references(vertices: DataFrame) -> DataFrame:
    return vertices.select(F.lit("vertices").alias("ref_table"), F.col("vertex_row").alias("row_id"), F.lit("frame_id").alias("ref_col"), frame_key("frame_id").alias("frame_id"), "loaded_at").where("frame_id is not null")


def wireframe_orphans(edges: DataFrame, vertices: DataFrame, frames: DataFrame, counts: bool = False) -> DataFrame:
    """Orphans of edges -> vertices and vertices -> frames, as rows or as monthly counts."""
    run = count_orphans if counts else find_orphans
    corner = vertices.select(frame_key("frame_id").alias("frame_id"), "vertex_id", "loaded_at", "deleted_at")
    frame = frames.select(frame_key("frame_id").alias("frame_id"), "loaded_at", "deleted_at")
    return run(edge_references(edges), corner, ["frame_id", "vertex_id"]).unionByName(run(vertex_references(vertices), frame, ["frame_id"]))
