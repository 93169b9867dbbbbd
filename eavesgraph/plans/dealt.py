"""Queries of the general training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eavesgraph.operators import integrity
from eavesgraph.session import scratch_path, table
from eavesgraph.sources import compaction, structural


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return structural.rejects(table(spark, d, "source_lines")).select("line_id", "reason").distinct()


def p1_points(spark: SparkSession, d: str) -> DataFrame:
    return structural.loaded_points(table(spark, d, "source_lines"))


def p1_vertices(spark: SparkSession, d: str) -> DataFrame:
    return structural.loaded_vertices(table(spark, d, "source_lines"))


def p1_reject_counts(spark: SparkSession, d: str) -> DataFrame:
    """Records and rejects by reason of each file."""
    by = structural.parse_lines(table(spark, d, "source_lines")).groupBy("file_path")
    return by.agg(F.count("*").alias("n_records"), *[F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in ("quoting", "columns", "value")])


def _wireframe(spark: SparkSession, d: str, counts: bool) -> DataFrame:
    return integrity.wireframe_orphans(*(table(spark, d, t) for t in ("edges", "vertices", "frame_norm")), counts)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _wireframe(spark, d, False).select("ref_table", "row_id", "ref_col", "state").distinct()


def p3_monthly(spark: SparkSession, d: str) -> DataFrame:
    return _wireframe(spark, d, True).withColumn("month", F.date_format("month", "yyyy-MM"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The record lines that the consolidation did not keep."""
    return compaction.surplus_of(compaction.consolidate(table(spark, d, "tiny_files"), scratch_path(spark, "compacted")))


def p5_partitions(spark: SparkSession, d: str) -> DataFrame:
    """Landing partitions with at least eight small files."""
    return compaction.landing_partitions(table(spark, d, "tiny_files")).where("n_small >= 8")


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    """The records after consolidation, read back from the compacted table."""
    made = compaction.consolidate(table(spark, d, "tiny_files"), scratch_path(spark, "compacted"))
    return made.read().select("kind", "frame_id", F.col("point_id").cast("long").alias("point_id"), "x", "y", "z", "file_id", "line_no")


QUERIES = {f.__name__: f for f in (p1_found, p1_points, p1_vertices, p1_reject_counts, p3_found, p3_monthly, p5_found, p5_partitions, p5_records)}

_LINES = """WITH t AS (SELECT *, trim(raw, E' \\t\\r\\n') AS s FROM source_lines),
r AS (SELECT *, string_split_regex(s, '[ \\t]+') AS a FROM t WHERE s <> '' AND NOT starts_with(s, '#')),
v AS (SELECT *, CASE WHEN file_kind = 'obj' THEN a[2:] ELSE a END AS f, CASE WHEN file_kind = 'obj' THEN 3 ELSE n_cols END AS want
      FROM r WHERE file_kind <> 'obj' OR a[1] = 'v'),
g AS (SELECT *, len(list_filter(f, lambda x: contains(x, '"') AND NOT regexp_full_match(x, '"[^"]*"'))) > 0 AS bad_quote,
      list_transform(f, lambda x: CASE WHEN regexp_full_match(x, '"[^"]*"') THEN substr(x, 2, length(x) - 2) ELSE x END) AS h FROM v),
n AS (SELECT *, list_transform(h, lambda x: CASE WHEN regexp_full_match(x, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?')
      THEN TRY_CAST(ltrim(x, '+') AS DOUBLE) END) AS num FROM g),
p AS (SELECT *, CASE WHEN bad_quote THEN 'quoting' WHEN want IS NULL OR len(f) <> want THEN 'columns'
      WHEN len(list_filter(num, lambda x: x IS NULL OR isinf(x))) > 0 THEN 'value'
      WHEN len(num) >= 6 AND (least(num[4], num[5], num[6]) < 0 OR greatest(num[4], num[5], num[6]) > 255) THEN 'value'
      WHEN len(num) >= 8 AND least(num[7], num[8]) < 0 THEN 'value' END AS reason FROM n) """

_ORPHANS = """WITH refs AS (
  SELECT 'edges' AS ref_table, edge_row AS row_id, c AS ref_col, lower(trim(frame_id)) AS f, v, loaded_at FROM (
    SELECT edge_row, frame_id, 'src' AS c, src AS v, loaded_at FROM edges UNION ALL SELECT edge_row, frame_id, 'dst', dst, loaded_at FROM edges)
  WHERE frame_id IS NOT NULL AND v IS NOT NULL AND v <> -1
  UNION ALL SELECT 'vertices', vertex_row, 'frame_id', lower(trim(frame_id)), NULL, loaded_at FROM vertices WHERE frame_id IS NOT NULL),
vs AS (SELECT lower(trim(frame_id)) AS f, vertex_id AS v, bool_or(deleted_at IS NULL) AS live, min(loaded_at) FILTER (WHERE deleted_at IS NULL) AS first FROM vertices GROUP BY 1, 2),
fs AS (SELECT lower(trim(frame_id)) AS f, bool_or(deleted_at IS NULL) AS live, min(loaded_at) FILTER (WHERE deleted_at IS NULL) AS first FROM frame_norm GROUP BY 1),
j AS (SELECT refs.*, live, first FROM refs LEFT JOIN vs ON refs.f = vs.f AND refs.v = vs.v WHERE ref_table = 'edges'
  UNION ALL SELECT refs.*, live, first FROM refs LEFT JOIN fs ON refs.f = fs.f WHERE ref_table = 'vertices'),
o AS (SELECT *, CASE WHEN live IS NULL THEN 'missing' WHEN NOT live THEN 'deleted' WHEN first > loaded_at THEN 'late' END AS state FROM j) """

_RECORDS = """WITH l AS (SELECT file_id, kind, written_at, lower(trim(coalesce(frame_id, split_part(file_path, '/', 3)))) AS frame_id,
    unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS line_no FROM tiny_files),
s AS (SELECT * EXCLUDE (line), regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS line FROM l),
r AS (SELECT *, string_split_regex(line, '[ \\t]+') AS f FROM s WHERE line <> '' AND NOT starts_with(line, '#')),
n AS (SELECT file_id, line_no, written_at, kind, frame_id, CAST(ltrim(f[1], '+') AS DOUBLE) AS p, CAST(ltrim(f[2], '+') AS DOUBLE) AS x, CAST(ltrim(f[3], '+') AS DOUBLE) AS y, CAST(ltrim(f[4], '+') AS DOUBLE) AS z FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY kind, frame_id, p, x, y, z ORDER BY written_at, file_id, line_no) AS rn FROM n) """

ORACLE = {
    "p1_found": _LINES + "SELECT DISTINCT line_id, reason FROM p WHERE reason IS NOT NULL",
    "p1_points": _LINES + "SELECT line_id, num[1] AS x, num[2] AS y, num[3] AS z, num[4] AS r, num[5] AS g, num[6] AS b, num[7] AS nir, num[8] AS intensity FROM p WHERE reason IS NULL AND file_kind <> 'obj'",
    "p1_vertices": _LINES + "SELECT line_id, num[1] AS x, num[2] AS y, num[3] AS z FROM p WHERE reason IS NULL AND file_kind = 'obj'",
    "p1_reject_counts": _LINES + "SELECT file_path, count(*) AS n_records, count(*) FILTER (WHERE reason = 'quoting') AS n_quoting, count(*) FILTER (WHERE reason = 'columns') AS n_columns, count(*) FILTER (WHERE reason = 'value') AS n_value FROM p GROUP BY 1",
    "p3_found": _ORPHANS + "SELECT DISTINCT ref_table, row_id, ref_col, state FROM o WHERE state IS NOT NULL",
    "p3_monthly": _ORPHANS + "SELECT ref_table, ref_col, strftime(date_trunc('month', loaded_at AT TIME ZONE 'UTC'), '%Y-%m') AS month, state, count(*) AS n_refs FROM o WHERE state IS NOT NULL GROUP BY ALL",
    "p5_found": _RECORDS + "SELECT file_id, CAST(line_no AS INTEGER) AS line_no FROM k WHERE rn > 1",
    "p5_partitions": "SELECT kind, lower(trim(coalesce(frame_id, split_part(file_path, '/', 3)))) AS frame_id, count(*) AS n_files, count(*) AS n_small, CAST(sum(strlen(coalesce(body, ''))) AS BIGINT) AS n_bytes FROM tiny_files GROUP BY 1, 2 HAVING count(*) >= 8",
    "p5_records": _RECORDS + "SELECT kind, frame_id, CAST(p AS BIGINT) AS point_id, x, y, z, file_id, CAST(line_no AS INTEGER) AS line_no FROM k WHERE rn = 1",
}
