"""Queries of the readers and writers and of the streams, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from eavesgraph.plans.geometry import _C, _E, _V, corners, edges, points
from eavesgraph.session import scratch_path, table
from eavesgraph.sources import files
from eavesgraph.streaming import frames

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _obj(spark, d):
    t = table(spark, d, "source_lines").where("file_kind = 'obj' and raw is not null")
    return t.select("frame_id", "line_no", F.col("raw").alias("line"))


_LINES = "o AS (SELECT frame_id, string_split_regex(trim(raw, E' \\t\\r\\n'), '\\s+') AS f FROM source_lines WHERE file_kind = 'obj' AND raw IS NOT NULL), l AS (SELECT frame_id, TRY_CAST(f[2] AS INTEGER) - 1 AS a, TRY_CAST(f[3] AS INTEGER) - 1 AS b FROM o WHERE f[1] = 'l' AND len(f) >= 3)"


@query(f"WITH {_LINES} SELECT DISTINCT frame_id, least(a, b) AS src, greatest(a, b) AS dst FROM l WHERE a IS NOT NULL AND b IS NOT NULL")
def obj_line_edges(spark, d):
    """Edges of the ``l`` records of the OBJ lines."""
    return files.obj_edges(_obj(spark, d))


@query(f"WITH {_C} SELECT frame_id, point_id AS line_no, printf('%.6f %.6f %.6f', x, y, z) AS line FROM c")
def xyz_format_lines(spark, d):
    return files.xyz_lines(points(spark, d))


@query(f"WITH {_V}, {_E}, u AS (SELECT frame_id, 0 AS p, vertex_id AS a, 0 AS b, printf('v %.6f %.6f %.6f', x, y, z) AS line FROM v UNION ALL SELECT frame_id, 1, src, dst, printf('l %d %d', src + 1, dst + 1) FROM e) SELECT frame_id, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY p, a, b) - 1 AS INTEGER) AS line_no, line FROM u")
def obj_format_lines(spark, d):
    return files.obj_lines(corners(spark, d), edges(spark, d))


@query(f"WITH {_V} SELECT frame_id, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY vertex_id) - 1 AS INTEGER) AS vertex_id, x, y, z FROM v WHERE frame_id IN (SELECT frame_id FROM v)")
def obj_write_read(spark, d):
    """Vertices written as OBJ files and read back."""
    path = scratch_path(spark, "obj")
    v = corners(spark, d)
    files.write_frames(files.obj_lines(v, edges(spark, d).join(v.select("frame_id").distinct(), "frame_id", "left_semi")), path)
    return files.read_obj(spark, f"{path}/*/*.txt", frame=files.partition_frame)[0]


_FILES = "f AS (SELECT DISTINCT file_path AS path, file_kind, string_split(file_path, '/')[-2] AS frame_id FROM source_lines)"


@query(f"WITH {_FILES} SELECT a.frame_id, a.path AS left_path, b.path AS right_path FROM f a LEFT JOIN f b ON a.frame_id = b.frame_id AND b.file_kind = 'xyz' WHERE a.file_kind = 'obj'")
def stem_match(spark, d):
    """Wireframe files and the clouds of the same name, if any."""
    f = table(spark, d, "source_lines").select(F.col("file_path").alias("path"), "file_kind").distinct()
    return files.stem_match(f.where("file_kind = 'obj'"), f.where("file_kind = 'xyz'"), "left")


@query("SELECT DISTINCT regexp_replace(file_path, '/[^/]*$', '') AS path FROM source_lines")
def manifest_paths(spark, d):
    return files.manifest_of(table(spark, d, "source_lines").select(F.col("file_path").alias("path")))


@query("SELECT DISTINCT file_path, split_part(string_split(file_path, '/')[-1], '.', 1) AS stem, string_split(file_path, '/')[-2] AS folder FROM source_lines")
def path_parts(spark, d):
    return table(spark, d, "source_lines").select("file_path", files.stem("file_path").alias("stem"), files.folder("file_path").alias("folder")).distinct()


@query("SELECT strftime(to_timestamp(floor(epoch(captured_at) / 2592000) * 2592000) AT TIME ZONE 'UTC', '%Y-%m-%d') AS start, frame_id, count(*) AS n_rows FROM points WHERE captured_at IS NOT NULL GROUP BY ALL")
def stream_windowed_counts(spark, d):
    """Rows per frame and 30 days, as a stream run to its end."""
    stream = _points_stream(spark, d)
    out = scratch_path(spark, "counts")
    frames.written_counts(frames.windowed_counts(stream, "captured_at"), out, scratch_path(spark, "stream")).awaitTermination()
    return frames.latest(spark, out, ["start", "frame_id"]).withColumn("start", F.date_format("start", "yyyy-MM-dd"))


def _points_stream(spark, d):
    """The points as a stream; rows without a time are left out. A table of several files is one micro-batch, so no row of it is late."""
    path = f"{d}/points.parquet"
    return frames.parquet_stream(spark, f"{d}/[p]oints.parquet", spark.read.parquet(path).schema, 1_000_000).where("captured_at is not null")


@query("SELECT DISTINCT frame_id, point_id FROM points WHERE captured_at IS NOT NULL")
def stream_distinct_points(spark, d):
    """Points of a stream without their repeats, as a batch operator writes them."""
    out = scratch_path(spark, "distinct")
    kept = frames.distinct_rows(_points_stream(spark, d).select("frame_id", "point_id", "captured_at"), ["frame_id", "point_id"], "captured_at")
    frames.each_batch(kept, lambda df: df.select("frame_id", "point_id"), out, scratch_path(spark, "stream")).awaitTermination()
    return spark.read.parquet(out).select("frame_id", "point_id")
