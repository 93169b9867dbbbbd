"""Text files of clouds and wireframes: XYZ, OBJ in four dialects, PLY, manifests; readers and writers."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eavesgraph.operators.order import row_numbers

CHANNELS = ("x", "y", "z", "r", "g", "b", "nir", "intensity")


def stem(path: Column | str) -> Column:
    """The last part of a path, before its first dot."""
    return F.split_part(F.substring_index(path, "/", -1), F.lit("."), F.lit(1))


def folder(path: Column | str) -> Column:
    """The part before the last of a path."""
    return F.substring_index(F.substring_index(path, "/", -2), "/", 1)


def cluster_name(path: Column | str) -> dict[str, Column]:
    """id, cluster number and whether it is a cluster, of names like ``city_<id>_cluster_<n>.obj`` or ``city_<id>_original.obj``."""
    name = stem(path)
    number = F.regexp_extract(name, "_cluster_([0-9]+)$", 1)
    return {"id": F.regexp_extract(name, "^[^_]*_(.*?)(_cluster_[0-9]+|_original)?$", 1), "is_cluster": number != "", "cluster_id": number.try_cast("int")}


def files_under(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """(path, n_bytes) of the files in a folder and below whose names end so; the listing is Spark's, contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("n_bytes"))
    return found.where(F.endswith("path", F.lit(suffix))) if suffix else found


def text_records(lines: DataFrame, kinds: tuple[str, ...] = ("v", "l")) -> DataFrame:
    """The lines whose first word is one of ``kinds``, as text, trimmed."""
    return lines.withColumn("line", F.trim("line")).where(F.split_part(F.translate("line", "\t", " "), F.lit(" "), F.lit(1)).isin(*kinds))


def text_lines(spark: SparkSession, path: str | list[str], frame=folder) -> DataFrame:
    """(frame_id, line_no from 0, line) of text files; the order of lines is that of the file.

    A large file is read in splits by several tasks: lines are ordered by the
    start of their split and their place in it, and numbered by ranges.
    """
    read = spark.read.option("lineSep", "\n").text(path)
    lines = read.select(frame(F.col("_metadata.file_path")).alias("frame_id"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"), F.regexp_replace("value", "\r$", "").alias("line"))
    return row_numbers(lines, ["_file"], ["_block", "_row"], "line_no").select("frame_id", F.col("line_no").cast("int").alias("line_no"), "line")


def points_of(lines: DataFrame, columns: tuple[str, ...] = CHANNELS[:3]) -> DataFrame:
    """Points of XYZ lines by position; lines with fewer numbers than three are left out, absent channels are null."""
    f = lines.withColumn("f", F.filter(F.split(F.trim("line"), r"[ \t]+"), lambda v: v != "")).where(F.size("f") >= 3)
    value = [F.try_element_at("f", F.lit(CHANNELS.index(c) + 1)).try_cast("double").alias(c) for c in columns]
    numbered = row_numbers(f.select("frame_id", "line_no", *value), ["frame_id"], ["line_no"], "point_id")
    return numbered.select("frame_id", "point_id", *columns)


def all_columns(lines: DataFrame, least: int = 3) -> DataFrame:
    """(frame_id, point_id, x, y, z, rest array): points with all their columns; lines of fewer than ``least`` numbers are left out."""
    f = lines.withColumn("f", F.transform(F.filter(F.split(F.trim("line"), r"[ \t]+"), lambda v: v != ""), lambda v: v.try_cast("double"))).where(F.size("f") >= least)
    numbered = row_numbers(f.select("frame_id", "line_no", "f"), ["frame_id"], ["line_no"], "point_id")
    return numbered.select("frame_id", "point_id", *[F.col("f")[i].alias(c) for i, c in enumerate("xyz")], F.slice("f", 4, F.greatest(F.size("f") - 3, F.lit(0))).alias("rest"))


def read_xyz(spark: SparkSession, path: str | list[str], color: bool = False, nir: bool = False, intensity: bool = False, frame=folder) -> DataFrame:
    """Points of XYZ files with the channels asked for."""
    wanted = CHANNELS[:3] + (CHANNELS[3:6] if color else ()) + (("nir",) if nir else ()) + (("intensity",) if intensity else ())
    return points_of(text_lines(spark, path, frame), wanted)


def obj_vertices(lines: DataFrame) -> DataFrame:
    """(frame_id, vertex_id, x, y, z) of the ``v`` records, numbered from 0 in the order of lines."""
    f = lines.withColumn("f", F.split(F.trim("line"), r"\s+")).where((F.col("f")[0] == "v") & (F.size("f") >= 4))
    v = f.select("frame_id", "line_no", *[F.col("f")[i + 1].try_cast("double").alias(c) for i, c in enumerate("xyz")])
    return row_numbers(v, ["frame_id"], ["line_no"], "vertex_id").select("frame_id", F.col("vertex_id").cast("int").alias("vertex_id"), *"xyz")


def obj_edges(lines: DataFrame, dialect: str = "line") -> DataFrame:
    """(frame_id, src, dst), ids from 0.

    line: ``l i j``, sorted and each once. loop: any record but ``v`` is a
    closed loop over its ids. face: ``f`` records with ``id//normal``, as loops.
    ordered: ``l i j`` as they stand, repeats kept, with line_no. Records whose
    ids are no integers are left out.
    """
    f = lines.withColumn("f", F.filter(F.split(F.trim("line"), r"\s+"), lambda v: v != "")).where(F.size("f") >= 2)
    kind = F.col("f")[0]
    picked = f.where(kind == "l") if dialect in ("line", "ordered") else f.where(kind == "f") if dialect == "face" else f.where((kind != "v") & ~F.startswith(kind, F.lit("#")))
    ids = F.transform(F.slice("f", 2, F.size("f") - 1), lambda v: F.split_part(v, F.lit("/"), F.lit(1)).try_cast("int") - 1)
    e = picked.withColumn("ids", ids).where(F.forall("ids", lambda v: v.isNotNull()))
    if dialect == "ordered":
        return e.where(F.size("ids") >= 2).select("frame_id", "line_no", F.col("ids")[0].alias("src"), F.col("ids")[1].alias("dst"))
    if dialect == "line":
        pair = e.where(F.size("ids") >= 2).select("frame_id", F.least(F.col("ids")[0], F.col("ids")[1]).alias("src"), F.greatest(F.col("ids")[0], F.col("ids")[1]).alias("dst"))
        return pair.distinct()
    from eavesgraph.operators.wireframe import loop_edges

    return loop_edges(e.select("frame_id", "ids"))


def read_obj(spark: SparkSession, path: str | list[str], dialect: str = "line", frame=folder) -> tuple[DataFrame, DataFrame]:
    lines = text_lines(spark, path, frame)
    return obj_vertices(lines), obj_edges(lines, dialect)


def _ply(content: bytes) -> np.ndarray:
    """x y z of a PLY file, ASCII or binary little endian."""
    head, _, body = content.partition(b"end_header")
    body = body[body.index(b"\n") + 1 :]
    lines = [line.split() for line in head.decode("ascii", "replace").splitlines() if line.strip()]
    kinds = {"float": "<f4", "float32": "<f4", "double": "<f8", "float64": "<f8", "uchar": "u1", "uint8": "u1", "char": "i1", "int8": "i1", "short": "<i2", "ushort": "<u2", "int": "<i4", "int32": "<i4", "uint": "<u4"}
    n, props, inside = 0, [], False
    for w in lines:
        if w[0] == "element":
            inside = w[1] == "vertex"
            n = int(w[2]) if inside else n
        elif w[0] == "property" and inside:
            props.append((w[-1], kinds.get(w[1], "<f4")))
    names = [p for p, _ in props]
    at = [names.index(c) for c in "xyz"]
    if any(w[:2] == ["format", "ascii"] for w in lines):
        return np.loadtxt(io.BytesIO(body), max_rows=n, ndmin=2, usecols=at) if n else np.zeros((0, 3))
    rows = np.frombuffer(body, np.dtype(props), count=n)
    return np.stack([rows[c].astype(float) for c in "xyz"], 1)


def read_ply(spark: SparkSession, path: str, frame=stem) -> DataFrame:
    """(frame_id, point_id, x, y, z) of PLY files; a file is decoded in one task."""
    files = spark.read.format("binaryFile").load(path).select(frame("path").alias("frame_id"), "content")

    def run(batches):
        for b in batches:
            for name, content in zip(b["frame_id"], b["content"]):
                p = _ply(bytes(content))
                yield pd.DataFrame({"frame_id": np.full(len(p), name, object), "point_id": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]})

    return files.mapInPandas(run, "frame_id string, point_id long, x double, y double, z double")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path): one per non-empty line."""
    return spark.read.text(path).select(F.trim("value").alias("path")).where("path <> ''")


def read_cloud(spark: SparkSession, path: str, **flags: bool) -> DataFrame:
    """The reader that fits the extension: .ply, .xyz, or .obj of closed loops (as its vertices); others are refused."""
    if path.endswith(".obj"):
        v = read_obj(spark, path, "loop")[0]
        return v.withColumn("point_id", F.col("vertex_id").cast("long")).select("frame_id", "point_id", *"xyz")
    if path.endswith(".ply"):
        return read_ply(spark, path)
    if path.endswith((".xyz", ".txt")):
        return read_xyz(spark, path, **flags)
    raise ValueError(f"no reader for {path}: expected .xyz or .ply")


def manifest_of(paths: DataFrame) -> DataFrame:
    """Sorted distinct folders."""
    return paths.select(F.regexp_replace("path", "/[^/]*$", "").alias("path")).distinct().orderBy("path")


def stem_match(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join files (path) of two kinds on their folder: (frame_id, left_path, right_path)."""
    a = left.select(folder("path").alias("frame_id"), F.col("path").alias("left_path"))
    if how == "left_anti":
        return a.join(right.select(folder("path").alias("frame_id")), "frame_id", how)
    return a.join(right.select(folder("path").alias("frame_id"), F.col("path").alias("right_path")), "frame_id", how)


def xyz_lines(points: DataFrame, columns: tuple[str, ...] = CHANNELS[:3], exact: bool = False) -> DataFrame:
    """(frame_id, line_no, line): six digits, or the shortest exact numbers."""
    parts = [F.col(c).cast("string") if exact else F.format_string("%.6f", F.col(c)) for c in columns]
    return points.select("frame_id", F.col("point_id").alias("line_no"), F.concat_ws(" ", *parts).alias("line"))


def obj_lines(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(frame_id, line_no, line): ``v`` records by vertex_id, then ``l`` records by (src, dst), ids from 1."""
    v = vertices.select("frame_id", F.lit(0).alias("part"), F.col("vertex_id").alias("a"), F.lit(0).alias("b"), F.format_string("v %.6f %.6f %.6f", "x", "y", "z").alias("line"))
    e = edges.select("frame_id", F.lit(1).alias("part"), F.col("src").alias("a"), F.col("dst").alias("b"), F.format_string("l %d %d", F.col("src") + 1, F.col("dst") + 1).alias("line"))
    every = row_numbers(v.unionByName(e), ["frame_id"], ["part", "a", "b", "line"], "line_no")
    return every.select("frame_id", F.col("line_no").cast("int").alias("line_no"), "line")


def edge_lines(edges: DataFrame) -> DataFrame:
    """(frame_id, line): both ends from 1, each followed by a blank."""
    return edges.select("frame_id", F.format_string("%d %d ", F.col("src") + 1, F.col("dst") + 1).alias("line"))


def ply_lines(points: DataFrame, positive: str) -> DataFrame:
    """(frame_id, line_no, line): ASCII PLY of each frame with the points of the condition red and the others black.

    The header is the ten lines before the points, which are in order of point_id.
    """
    p = row_numbers(points.select("frame_id", "point_id", F.format_string("%.6f %.6f %.6f", "x", "y", "z").alias("t"), F.coalesce(F.expr(positive), F.lit(False)).alias("red")), ["frame_id"], ["point_id", "t"], "i")
    body = p.select("frame_id", (F.col("i") + 10).alias("line_no"), F.concat("t", F.when(F.col("red"), " 255 0 0").otherwise(" 0 0 0")).alias("line"))
    head = ["ply", "format ascii 1.0", None, "property float x", "property float y", "property float z", "property uchar red", "property uchar green", "property uchar blue", "end_header"]
    n = points.groupBy("frame_id").agg(F.count("*").alias("n"))
    text = [F.concat(F.lit("element vertex "), F.col("n").cast("string")) if h is None else F.lit(h) for h in head]
    return n.select("frame_id", F.posexplode(F.array(*text)).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long")).unionByName(body)


def colored_lines(points: DataFrame, positive: str) -> DataFrame:
    """XYZ lines with positives red and the rest black."""
    red = F.when(F.col(positive), 255.0).otherwise(0.0)
    return xyz_lines(points.withColumns({"r": red, "g": F.lit(0.0), "b": F.lit(0.0)}), CHANNELS[:6])


def write_frames(lines: DataFrame, path: str) -> None:
    """One text per frame under ``frame_id=<id>/``, lines in order."""
    lines.repartition("frame_id").sortWithinPartitions("frame_id", "line_no").select("frame_id", "line").write.partitionBy("frame_id").text(path)


def partition_frame(path: Column | str) -> Column:
    """The frame of a path that write_frames() made."""
    return F.regexp_extract(path, "frame_id=([^/]*)/", 1)
