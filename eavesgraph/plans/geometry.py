"""Queries of the point-cloud and wireframe operators and their SQL."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eavesgraph.functions import curves, losses
from eavesgraph.operators import cluster, features, local, match, normalise, order, sampling, spatial, wireframe
from eavesgraph.operators.clouds import VERTEX_BASE, cloud, corners_of, live_norms, members, predicted_corners, selected_places, undirected_edges, vertex_labels
from eavesgraph.session import small as few, table, written

XYZ = ("x", "y", "z")
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def R(c: Column | str) -> Column:
    """Six digits, without a negative zero, as in the SQL."""
    return F.round(c, 6) + F.lit(0.0)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: R(c) for c in columns})


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def points(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return cloud(table(spark, d, "points"), *more)


def corners(spark: SparkSession, d: str) -> DataFrame:
    return corners_of(table(spark, d, "vertices"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    return undirected_edges(table(spark, d, "edges"))


def predicted(spark: SparkSession, d: str) -> DataFrame:
    return predicted_corners(table(spark, d, "corners"))


def places(spark: SparkSession, d: str) -> DataFrame:
    s = selected_places(table(spark, d, "pred_points"), table(spark, d, "points"))
    return s.select("frame_id", "point_id", *[F.col(f"p{c}").alias(c) for c in XYZ])


_C = "c AS (SELECT DISTINCT frame_id, point_id, x, y, z FROM points)"
_CA = "c AS (SELECT DISTINCT frame_id, point_id, x, y, z, r, g, b, nir, intensity FROM points)"
_V = """v AS (SELECT frame_id, vertex_id, x, y, z FROM (SELECT lower(trim(frame_id)) AS frame_id, vertex_id, x, y, z,
  row_number() OVER (PARTITION BY lower(trim(frame_id)), vertex_id ORDER BY loaded_at, vertex_row) AS rn FROM vertices
  WHERE deleted_at IS NULL AND frame_id IS NOT NULL AND vertex_id IS NOT NULL) WHERE rn = 1)"""
_E = "e AS (SELECT DISTINCT lower(trim(frame_id)) AS frame_id, least(src, dst) AS src, greatest(src, dst) AS dst FROM edges WHERE frame_id IS NOT NULL AND src >= 0 AND dst >= 0 AND src <> dst)"
_P = """p AS (SELECT frame_id, corner_id, x, y, z, n_members FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, corner_id
  ORDER BY x, y, z, n_members NULLS FIRST) AS rn FROM corners WHERE NOT (x = -10 AND y = -10 AND z = -10)) WHERE rn = 1)"""
_N = """n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY loaded_at, cx, cy, cz, max_distance, cube_min, cube_max) AS rn
  FROM frame_norm WHERE deleted_at IS NULL) WHERE rn = 1)"""
_S = """s AS (SELECT DISTINCT frame_id, point_id, x + dx AS x, y + dy AS y, z + dz AS z FROM pred_points JOIN (SELECT DISTINCT frame_id, point_id, x, y, z FROM points) USING (frame_id, point_id)
  WHERE score > 0.5 AND NOT isnan(score) AND NOT (dx = -10 AND dy = -10 AND dz = -10))"""
_M = """m AS (SELECT frame_id, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, least(min(x), min(y), min(z)) AS cube_min, greatest(max(x), max(y), max(z)) AS cube_max, count(*) AS n_points FROM c GROUP BY 1),
st AS (SELECT m.*, md.max_distance FROM m JOIN (SELECT frame_id, sqrt(max((x-cx)*(x-cx) + (y-cy)*(y-cy) + (z-cz)*(z-cz))) AS max_distance FROM c JOIN m USING (frame_id) GROUP BY 1) md USING (frame_id))"""
_D2 = "(a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)"


def _r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 AS {n.split('.')[-1]}" for n in names)


def _r3(x: str, y: str, z: str) -> str:
    return f"round({x}, 6) + 0.0 AS x, round({y}, 6) + 0.0 AS y, round({z}, 6) + 0.0 AS z"


# --- scaling ---------------------------------------------------------------


@query(f"WITH {_C}, {_M} SELECT frame_id, point_id, {_r3('(x-cx)/nullif(max_distance,0)', '(y-cy)/nullif(max_distance,0)', '(z-cz)/nullif(max_distance,0)')} FROM c JOIN st USING (frame_id)")
def frame_normalize(spark, d):
    p = points(spark, d)
    return rounded(normalise.normalise(p, normalise.frame_stats(p)), *XYZ)


@query(f"WITH {_C}, {_M} SELECT frame_id, cube_min, cube_max, n_points, " + ", ".join(f"round({c}, 9) + 0.0 AS {c}" for c in ("cx", "cy", "cz", "max_distance")) + " FROM st")
def frame_cube_bounds(spark, d):
    """Bounds to nine digits: means of coordinates in millimetres lie half-way between numbers of six."""
    return normalise.frame_stats(points(spark, d)).withColumns({c: F.round(c, 9) + F.lit(0.0) for c in ("cx", "cy", "cz", "max_distance")})


@query(f"WITH {_C}, {_M} SELECT frame_id, point_id, {_r3(*[f'({c}-cube_min)/nullif(cube_max-cube_min,0)' for c in 'xyz'])} FROM c JOIN st USING (frame_id)")
def cube_minmax(spark, d):
    p = points(spark, d)
    return rounded(normalise.cube_scale(p, normalise.frame_stats(p)), *XYZ)


@query(f"""WITH {_C}, b AS (SELECT frame_id, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, greatest(max(x)-avg(x), avg(x)-min(x), max(y)-avg(y), avg(y)-min(y), max(z)-avg(z), avg(z)-min(z)) AS s FROM c GROUP BY 1)
SELECT frame_id, point_id, {_r3(*[f'({c}-c{c})/CASE WHEN s = 0 THEN 1 ELSE s END' for c in 'xyz'])} FROM c JOIN b USING (frame_id)""")
def unit_box(spark, d):
    return rounded(normalise.unit_box(points(spark, d)), *XYZ)


@query(f"WITH {_P}, {_N} SELECT frame_id, corner_id, {_r3(*[f'{c}*max_distance+c{c}' for c in 'xyz'])} FROM p JOIN n USING (frame_id)")
def denormalize_corners(spark, d):
    out = normalise.denormalise(predicted(spark, d), live_norms(table(spark, d, "frame_norm")))
    return rounded(out, *XYZ).select("frame_id", "corner_id", *XYZ)


@query(f"WITH {_C}, {_M} SELECT frame_id, 0.0::DOUBLE AS error FROM st WHERE max_distance > 0")
def denormalize_roundtrip(spark, d):
    """Largest error of normalising and going back, per frame."""
    p = points(spark, d)
    st = normalise.frame_stats(p)
    back = normalise.denormalise(normalise.normalise(p, st), st).select("frame_id", "point_id", *[F.col(c).alias(f"b{c}") for c in XYZ])
    err = F.greatest(*[F.abs(F.col(c) - F.col(f"b{c}")) for c in XYZ])
    return p.join(back, ["frame_id", "point_id"]).groupBy("frame_id").agg(R(F.max(err)).alias("error")).where("error is not null")


@query(f"""WITH {_CA}, q AS (SELECT frame_id, avg(r/255) AS mr, stddev_pop(r/255) AS sr, avg(g/255) AS mg, stddev_pop(g/255) AS sg, avg(b/255) AS mb, stddev_pop(b/255) AS sb FROM c WHERE r IS NOT NULL GROUP BY 1)
SELECT frame_id, point_id, round((r/255-mr)/CASE WHEN sr > 1e-12 THEN sr END, 6) + 0.0 AS r, round((g/255-mg)/CASE WHEN sg > 1e-12 THEN sg END, 6) + 0.0 AS g, round((b/255-mb)/CASE WHEN sb > 1e-12 THEN sb END, 6) + 0.0 AS b FROM c JOIN q USING (frame_id) WHERE r IS NOT NULL""")
def feature_zscore(spark, d):
    p = points(spark, d, "r", "g", "b", "nir", "intensity").where("r is not null")
    scaled = p.select("frame_id", "point_id", *[(F.col(c) / 255).alias(c) for c in ("r", "g", "b")])
    return rounded(normalise.zscore(scaled, ["r", "g", "b"]), "r", "g", "b")


@query(f"WITH {_CA}, q AS (SELECT frame_id, min(intensity) AS lo, max(intensity) AS hi FROM c WHERE intensity IS NOT NULL GROUP BY 1) SELECT frame_id, point_id, round((intensity-lo)/(hi-lo+1e-8), 6) + 0.0 AS intensity FROM c JOIN q USING (frame_id) WHERE intensity IS NOT NULL")
def feature_minmax(spark, d):
    p = points(spark, d, "r", "g", "b", "nir", "intensity").where("intensity is not null").select("frame_id", "point_id", "intensity")
    return rounded(normalise.minmax(p, ["intensity"]), "intensity")


@query("SELECT DISTINCT frame_id, point_id, x, y, z, r, g, b, nir FROM points WHERE r IS NOT NULL AND nir IS NOT NULL")
def channel_projection(spark, d):
    """Colour and near infrared of the clouds that have both."""
    return cloud(table(spark, d, "points").where("r is not null and nir is not null"), "r", "g", "b", "nir")


_DRAW = "CAST('0x' || substr(md5(frame_id || '|{}|0'), 1, 8) AS BIGINT) / 4294967296.0"


@query(f"""WITH {_C}, f AS (SELECT frame_id, point_id, CASE WHEN {_DRAW.format('mirror_x')} > 0.5 THEN -x ELSE x END AS x, CASE WHEN {_DRAW.format('mirror_y')} > 0.5 THEN -y ELSE y END AS y, z, ({_DRAW.format('turn')} * 2 - 1) * pi() / 36 AS t FROM c)
SELECT frame_id, point_id, {_r3('x*cos(t)-y*sin(t)', 'x*sin(t)+y*cos(t)', 'z')} FROM f""")
def mirror_rotate_z(spark, d):
    return rounded(normalise.augment(points(spark, d)), *XYZ)


# --- spatial joins ---------------------------------------------------------


@query(f"WITH {_C}, {_V}, h AS (SELECT a.frame_id, a.vertex_id AS query_id, b.point_id AS target_id, row_number() OVER (PARTITION BY a.frame_id, a.vertex_id ORDER BY b.point_id) - 1 AS slot FROM v a JOIN c b ON a.frame_id = b.frame_id AND {_D2} < 1.0) SELECT frame_id, query_id, CAST(slot AS INTEGER) AS slot, target_id FROM h WHERE slot < 16")
def ball_query_first_n(spark, d):
    return spatial.first_in_ball(corners(spark, d), points(spark, d), 1.0, 16)


@query(f"""WITH {_C}, {_V}, h AS (SELECT a.frame_id, a.vertex_id AS query_id, b.point_id AS target_id, row_number() OVER (PARTITION BY a.frame_id, a.vertex_id ORDER BY b.point_id) - 1 AS slot FROM v a JOIN c b ON a.frame_id = b.frame_id AND {_D2} < 0.25),
k AS (SELECT frame_id, query_id, min(target_id) AS first FROM h GROUP BY ALL), g AS (SELECT k.*, s FROM k, range(4) t(s))
SELECT g.frame_id, g.query_id, CAST(s AS INTEGER) AS slot, coalesce(h.target_id, first) AS target_id FROM g LEFT JOIN h ON g.frame_id = h.frame_id AND g.query_id = h.query_id AND g.s = h.slot""")
def ball_query_padded(spark, d):
    return spatial.first_in_ball(corners(spark, d), points(spark, d), 0.5, 4, fill=True)


@query(f"WITH {_C}, {_V} SELECT a.frame_id, a.vertex_id AS query_id, least(count(b.point_id), 16) AS n FROM v a LEFT JOIN c b ON a.frame_id = b.frame_id AND {_D2} < 0.25 GROUP BY ALL")
def ball_query_stack_empty(spark, d):
    hits = spatial.first_in_ball(corners(spark, d), points(spark, d), 0.5, 16, keep_empty=True)
    return hits.groupBy("frame_id", "query_id").agg(F.count("target_id").alias("n"))


_NEAR = f"nn AS (SELECT * FROM (SELECT a.frame_id, a.point_id, b.vertex_id, b.x AS vx, b.y AS vy, b.z AS vz, {_D2} AS d2, row_number() OVER (PARTITION BY a.frame_id, a.point_id ORDER BY {_D2}, b.vertex_id) AS rn FROM c a JOIN v b ON a.frame_id = b.frame_id AND {_D2} < 2.25) WHERE rn = 1)"


@query(f"WITH {_C}, {_V}, {_NEAR} SELECT frame_id, point_id AS query_id, vertex_id AS target_id, round(d2, 6) + 0.0 AS d2 FROM nn")
def ball_center_query(spark, d):
    return rounded(spatial.nearest_within(points(spark, d), corners(spark, d), 1.5), "d2")


@query(f"WITH {_C}, {_V}, {_NEAR} SELECT c.frame_id, c.point_id, CAST(vertex_id IS NOT NULL AS INTEGER) AS label, round(coalesce((vx-x)/1.5, 0), 6) + 0.0 AS ox, round(coalesce((vy-y)/1.5, 0), 6) + 0.0 AS oy, round(coalesce((vz-z)/1.5, 0), 6) + 0.0 AS oz FROM c LEFT JOIN nn USING (frame_id, point_id)")
def assign_targets(spark, d):
    return rounded(spatial.assign_targets(points(spark, d), corners(spark, d), 1.5), "ox", "oy", "oz")


@query(f"WITH {_C}, {_V}, h AS (SELECT a.frame_id, a.point_id AS query_id, b.vertex_id AS target_id, row_number() OVER (PARTITION BY a.frame_id, a.point_id ORDER BY b.vertex_id) - 1 AS slot FROM c a JOIN v b ON a.frame_id = b.frame_id AND {_D2} < 1.0) SELECT frame_id, query_id, CAST(slot AS INTEGER) AS slot, target_id FROM h WHERE slot < 3")
def multi_target_range_join(spark, d):
    return spatial.first_in_ball(points(spark, d), corners(spark, d), 1.0, 3, "point_id", "vertex_id")


_KNN = "k AS (SELECT a.frame_id, a.{q} AS query_id, b.{t} AS target_id, row_number() OVER (PARTITION BY a.frame_id, a.{q} ORDER BY {d2}, b.{t}) AS rank, sqrt({d2}) AS dist FROM {a} a JOIN {b} b ON a.frame_id = b.frame_id {more} QUALIFY rank <= {k})"


def _knn(a: str, b: str, k: int, q: str = "vertex_id", t: str = "point_id", more: str = "") -> str:
    return _KNN.format(a=a, b=b, k=k, q=q, t=t, more=more, d2=_D2)


@query(f"WITH {_C}, {_V}, {_knn('v', 'c', 8)} SELECT frame_id, query_id, target_id, CAST(rank AS INTEGER) AS rank, round(dist, 6) + 0.0 AS dist FROM k")
def knn_query(spark, d):
    return rounded(spatial.knn(corners(spark, d), points(spark, d), 8), "dist")


@query(f"WITH {_V}, {_knn('v', 'v', 4, t='vertex_id', more='AND a.vertex_id <> b.vertex_id')} SELECT frame_id, query_id, target_id, CAST(rank AS INTEGER) AS rank, round(dist, 6) + 0.0 AS dist FROM k")
def knn_graph_noself(spark, d):
    v = corners(spark, d)
    return rounded(spatial.knn(v, v, 4, t_key="vertex_id", with_self=False), "dist")


@query(f"WITH {_CA}, {_V}, {_knn('v', 'c', 3)} SELECT k.frame_id, query_id, round(sum(coalesce(intensity, 0)/(dist+1e-8))/sum(1/(dist+1e-8)), 6) + 0.0 AS intensity, round(sum(z/(dist+1e-8))/sum(1/(dist+1e-8)), 6) + 0.0 AS z FROM k JOIN c ON k.frame_id = c.frame_id AND k.target_id = c.point_id GROUP BY ALL")
def three_nn_interpolate(spark, d):
    p = points(spark, d, "r", "g", "b", "nir", "intensity").fillna(0.0, ["intensity"])
    near = spatial.knn(corners(spark, d), p, 3)
    return rounded(spatial.interpolate(near, p, ["intensity", "z"]), "intensity", "z")


@query(f"""WITH {_C}, {_V}, h AS (SELECT a.frame_id, a.vertex_id AS query_id, b.x-a.x AS dx, b.y-a.y AS dy, b.z-a.z AS dz, row_number() OVER (PARTITION BY a.frame_id, a.vertex_id ORDER BY b.point_id) AS rn FROM v a LEFT JOIN c b ON a.frame_id = b.frame_id AND {_D2} < 1.0)
SELECT frame_id, query_id, round(max(coalesce(dx, 0)), 6) + 0.0 AS dx, round(max(coalesce(dy, 0)), 6) + 0.0 AS dy, round(max(coalesce(dz, 0)), 6) + 0.0 AS dz FROM h WHERE rn <= 16 GROUP BY ALL""")
def group_maxpool(spark, d):
    v, p = corners(spark, d), points(spark, d)
    groups = spatial.group_relative(spatial.first_in_ball(v, p, 1.0, 16, keep_empty=True), v, p, [])
    return rounded(spatial.pool(groups, ["dx", "dy", "dz"]), "dx", "dy", "dz")


@query(f"WITH {_CA} SELECT frame_id, max(x) AS x, max(y) AS y, max(z) AS z, max(intensity) AS intensity FROM c GROUP BY 1")
def group_all_maxpool(spark, d):
    p = points(spark, d, "r", "g", "b", "nir", "intensity")
    return p.groupBy("frame_id").agg(*[F.max(c).alias(c) for c in (*XYZ, "intensity")])


@query(f"WITH {_C} SELECT DISTINCT q.frame_id, q.point_id, x, y, z FROM (SELECT DISTINCT frame_id, point_id FROM pred_points) q JOIN c USING (frame_id, point_id)")
def gather_points(spark, d):
    return table(spark, d, "pred_points").select("frame_id", "point_id").distinct().join(points(spark, d), ["frame_id", "point_id"])


# --- clustering ------------------------------------------------------------

EPS, MIN_PTS = 0.15, 4
_DB = f"""{_S}, pr AS (SELECT a.frame_id AS f, a.point_id AS u, b.point_id AS v FROM s a JOIN s b ON a.frame_id = b.frame_id AND a.point_id <> b.point_id AND abs(a.x-b.x) <= {EPS} AND abs(a.y-b.y) <= {EPS} AND {_D2} <= {EPS} * {EPS}),
co AS (SELECT f, u FROM pr GROUP BY ALL HAVING count(*) >= {MIN_PTS}),
cc AS (SELECT pr.* FROM pr JOIN co a ON pr.f = a.f AND pr.u = a.u JOIN co b ON pr.f = b.f AND pr.v = b.u),
re AS (SELECT f, u AS a, u AS b FROM co UNION SELECT re.f, re.a, cc.v FROM re JOIN cc ON re.f = cc.f AND re.b = cc.u),
la AS (SELECT f, a AS u, min(b) AS label FROM re GROUP BY ALL),
nu AS (SELECT f, u, dense_rank() OVER (PARTITION BY f ORDER BY label) - 1 AS cid FROM la),
bo AS (SELECT pr.f, pr.u, min(cid) AS bid FROM pr JOIN nu ON pr.f = nu.f AND pr.v = nu.u GROUP BY ALL),
db AS (SELECT s.frame_id, s.point_id, s.x, s.y, s.z, CAST(coalesce(nu.cid, bo.bid) AS INTEGER) AS cluster_id, nu.cid IS NOT NULL AS is_core FROM s LEFT JOIN nu ON s.frame_id = nu.f AND s.point_id = nu.u LEFT JOIN bo ON s.frame_id = bo.f AND s.point_id = bo.u)"""


@query(f"WITH RECURSIVE {_DB} SELECT frame_id, point_id, coalesce(cluster_id, -1) AS cluster_id, is_core FROM db")
def dbscan_labels(spark, d):
    """Cluster of each selected place; -1 is noise."""
    return cluster.dbscan(places(spark, d), EPS, MIN_PTS).fillna(-1, ["cluster_id"])


@query(f"WITH RECURSIVE {_DB} SELECT frame_id, cluster_id AS corner_id, count(*) AS n_members, round(avg(x), 6) + 0.0 AS x, round(avg(y), 6) + 0.0 AS y, round(avg(z), 6) + 0.0 AS z FROM db WHERE cluster_id IS NOT NULL GROUP BY ALL")
def corner_centroids(spark, d):
    """Score filter, offset, density clusters and their means."""
    p = places(spark, d)
    return rounded(cluster.centroids(p, cluster.dbscan(p, EPS, MIN_PTS)), *XYZ)


_HC = f"""{_V}, lk AS (SELECT a.frame_id AS f, a.vertex_id AS u, b.vertex_id AS w FROM v a JOIN v b ON a.frame_id = b.frame_id AND a.vertex_id <> b.vertex_id AND {_D2} < 2.25 AND abs(a.z-b.z) < 0.2),
re AS (SELECT frame_id AS f, vertex_id AS a, vertex_id AS b FROM v UNION SELECT re.f, re.a, lk.w FROM re JOIN lk ON re.f = lk.f AND re.b = lk.u),
la AS (SELECT f, a AS u, min(b) AS label FROM re GROUP BY ALL),
hc AS (SELECT f AS frame_id, u AS vertex_id, CAST(dense_rank() OVER (PARTITION BY f ORDER BY label) - 1 AS INTEGER) AS cluster_id FROM la)"""


@query(f"WITH RECURSIVE {_HC} SELECT * FROM hc")
def height_components(spark, d):
    return cluster.height_components(corners(spark, d), 1.5, 0.2, "vertex_id")


@query(f"""WITH RECURSIVE {_HC}, sz AS (SELECT frame_id, cluster_id, count(*) >= 3 AS large FROM hc GROUP BY ALL),
j AS (SELECT hc.*, large, x, y, z FROM hc JOIN sz USING (frame_id, cluster_id) JOIN v USING (frame_id, vertex_id)),
mv AS (SELECT a.frame_id, a.vertex_id, b.cluster_id AS t, row_number() OVER (PARTITION BY a.frame_id, a.vertex_id ORDER BY {_D2}, b.vertex_id) AS rn FROM j a JOIN j b ON a.frame_id = b.frame_id WHERE NOT a.large AND b.large),
lb AS (SELECT j.frame_id, j.vertex_id, coalesce(mv.t, j.cluster_id) AS l FROM j LEFT JOIN mv ON j.frame_id = mv.frame_id AND j.vertex_id = mv.vertex_id AND rn = 1)
SELECT frame_id, vertex_id, CAST(dense_rank() OVER (PARTITION BY frame_id ORDER BY l) - 1 AS INTEGER) AS cluster_id FROM lb""")
def merge_small_clusters(spark, d):
    return cluster.merge_small(*_split(spark, d), 3, "vertex_id")


def _split(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = corners(spark, d)
    return v, cluster.height_components(v, 1.5, 0.2, "vertex_id")


def _members(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Points and vertices as one cloud, and their height components."""
    m, _ = written(members(points(spark, d), corners(spark, d)), "union")
    return m, cluster.height_components(m, 1.5, 0.2, "member_id")


def _segments(spark: SparkSession, d: str) -> DataFrame:
    """Components of points and vertices; those of under 20 sample points are merged into the nearest large ones."""
    v, _ = written(corners(spark, d), "corners")
    return cluster.segments(members(table(spark, d, "points"), v), 1.5, 0.2, 20)


def _by_kind(labels: DataFrame) -> DataFrame:
    vertex = F.col("member_id") >= VERTEX_BASE
    own = F.when(vertex, F.col("member_id") - VERTEX_BASE).otherwise(F.col("member_id"))
    return labels.select("frame_id", F.when(vertex, "vertex").otherwise("sample").alias("kind"), own.alias("id"), "cluster_id")


_UNION = "mb AS (SELECT frame_id, point_id AS m, x, y, z, 1 AS s FROM c UNION ALL SELECT frame_id, vertex_id + 1099511627776, x, y, z, 0 FROM v)"


def _segments_sql(distance: float, height: float, least: int) -> str:
    """CTEs over mb(frame_id, m, x, y, z, s) that end in the components hm, the merged segments sg and those of the vertices sv."""
    return (
        f"lk AS MATERIALIZED (SELECT a.frame_id AS f, a.m AS u, b.m AS w FROM mb a JOIN mb b ON a.frame_id = b.frame_id AND a.m <> b.m AND abs(a.z-b.z) < {height}::DOUBLE AND {_D2} < {distance}::DOUBLE * {distance}::DOUBLE), "
        "cc(f, u, label) USING KEY (f, u) AS (SELECT frame_id, m, m FROM mb UNION (SELECT lk.f, lk.w, min(cc.label) FROM cc JOIN lk ON cc.f = lk.f AND cc.u = lk.u JOIN recurring.cc AS me ON me.f = lk.f AND me.u = lk.w WHERE cc.label < me.label GROUP BY lk.f, lk.w)), "
        "hm AS (SELECT f AS frame_id, u AS m, CAST(dense_rank() OVER (PARTITION BY f ORDER BY label) - 1 AS INTEGER) AS cluster_id FROM cc), "
        f"sz AS (SELECT frame_id, cluster_id, count(*) FILTER (WHERE s = 1) >= {least} AS large FROM hm JOIN mb USING (frame_id, m) GROUP BY ALL), "
        "j AS (SELECT hm.frame_id, hm.m, hm.cluster_id, large, x, y, z, s FROM hm JOIN sz ON hm.frame_id = sz.frame_id AND hm.cluster_id = sz.cluster_id JOIN mb ON hm.frame_id = mb.frame_id AND hm.m = mb.m), "
        f"mv AS (SELECT a.frame_id, a.m, b.cluster_id AS t FROM j a JOIN j b ON a.frame_id = b.frame_id WHERE NOT a.large AND b.large AND b.s = 1 QUALIFY row_number() OVER (PARTITION BY a.frame_id, a.m ORDER BY {_D2}, b.m) = 1), "
        "lb AS (SELECT j.frame_id, j.m, coalesce(mv.t, j.cluster_id) AS l FROM j LEFT JOIN mv ON j.frame_id = mv.frame_id AND j.m = mv.m), "
        "sg AS (SELECT frame_id, m, CAST(dense_rank() OVER (PARTITION BY frame_id ORDER BY l) - 1 AS INTEGER) AS cluster_id FROM lb), "
        "sv AS (SELECT frame_id, CAST(m - 1099511627776 AS INTEGER) AS vertex_id, cluster_id FROM sg WHERE m >= 1099511627776)"
    )


_SEG = f"{_C}, {_V}, {_UNION}, {_segments_sql(1.5, 0.2, 20)}"
_KIND = "CASE WHEN m >= 1099511627776 THEN 'vertex' ELSE 'sample' END AS kind, CASE WHEN m >= 1099511627776 THEN m - 1099511627776 ELSE m END AS id"


@query(f"WITH RECURSIVE {_SEG} SELECT frame_id, {_KIND}, cluster_id FROM hm")
def segment_components(spark, d):
    """Height components of the sample points and vertices together."""
    return _by_kind(_members(spark, d)[1])


@query(f"WITH RECURSIVE {_SEG} SELECT frame_id, {_KIND}, cluster_id FROM sg")
def segment_merge_small(spark, d):
    return _by_kind(_segments(spark, d))


@query()
def kmeans_clusters(spark, d):
    """k-means of the selected places of each frame, k from the spacing of its points."""
    p = places(spark, d)
    return cluster.kmeans(p.join(cluster.estimated_clusters(p, 1.0), "frame_id"), list(XYZ), "k")


# --- order, voxels ---------------------------------------------------------

GRID = 0.01
_Q = "lo AS (SELECT frame_id, min(x) AS lx, min(y) AS ly, min(z) AS lz FROM c GROUP BY 1), q AS (SELECT c.*, CAST(floor((x-lx)/{g}) AS BIGINT) AS gx, CAST(floor((y-ly)/{g}) AS BIGINT) AS gy, CAST(floor((z-lz)/{g}) AS BIGINT) AS gz FROM c JOIN lo USING (frame_id))"
_Z = "(" + " | ".join(f"((({c} >> {i}) & 1) << {3 * i + at})" for i in range(21) for c, at in (("gx", 2), ("gy", 1), ("gz", 0))) + ")"


@query(f"WITH {_C}, {_Q.format(g=GRID)} SELECT frame_id, point_id, {_Z} AS code FROM q")
def zorder_encode(spark, d):
    q = order.quantise(points(spark, d), GRID)
    return q.select("frame_id", "point_id", curves.morton(F.col("gx"), F.col("gy"), F.col("gz")).alias("code"))


@query(f"WITH {_C}, {_Q.format(g=GRID)} SELECT frame_id, point_id, gx, gy, gz FROM q")
def zorder_decode(spark, d):
    got = curves.from_morton(F.col("code"))
    return zorder_encode(spark, d).select("frame_id", "point_id", *[got[c].alias(f"g{c}") for c in XYZ])


@query(f"WITH {_C}, {_Q.format(g=GRID)}, z AS (SELECT frame_id, point_id, {_Z} AS code FROM q) SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY code, point_id) - 1 AS position FROM z")
def serialize_rank(spark, d):
    return order.serialise(points(spark, d), GRID)


_PATCH = f"""{_C}, {_Q.format(g=GRID)}, z AS (SELECT frame_id, point_id, {_Z} AS code FROM q),
o AS (SELECT frame_id, point_id, row_number() OVER (PARTITION BY frame_id ORDER BY code, point_id) - 1 AS pos, count(*) OVER (PARTITION BY frame_id) AS n FROM z),
w AS (SELECT *, pos // 128 AS patch, pos % 128 AS slot, (n - 1) // 128 AS last FROM o)"""


@query(f"""WITH {_PATCH} SELECT frame_id, point_id, patch, slot, false AS filler FROM w
UNION ALL SELECT frame_id, point_id, last, slot, true FROM w WHERE n > 128 AND patch = last - 1 AND slot >= 128 - ((last + 1) * 128 - n)""")
def patch_assign(spark, d):
    return order.patches(order.serialise(points(spark, d), GRID), 128)


def _hilbert_sql(source: str, depth: int, x: str = "gx", y: str = "gy") -> str:
    """CTEs that end in hc(frame_id, point_id, code): the transform bit by bit over the rows of ``source``."""
    steps, at = [f"h0 AS (SELECT frame_id, point_id, {x} AS x, {y} AS y, gz AS z FROM {source})"], 0
    for bit in (1 << b for b in range(depth - 1, 0, -1)):
        for c in "xyz":
            swap = "0" if c == "x" else f"(CASE WHEN {c} & {bit} <> 0 THEN 0 ELSE xor(x, {c}) & {bit - 1} END)"
            moved = {k: k for k in "xyz"} | ({} if c == "x" else {c: f"xor({c}, {swap})"}) | {"x": f"xor(x, CASE WHEN {c} & {bit} <> 0 THEN {bit - 1} ELSE {swap} END)"}
            steps.append(f"h{at + 1} AS (SELECT frame_id, point_id, " + ", ".join(f"{v} AS {k}" for k, v in moved.items()) + f" FROM h{at})")
            at += 1
    turn = "0"
    for bit in (1 << b for b in range(1, depth)):
        turn = f"xor({turn}, CASE WHEN z & {bit} <> 0 THEN {bit - 1} ELSE 0 END)"
    steps.append(f"g1 AS (SELECT frame_id, point_id, x, xor(x, y) AS y, xor(xor(x, y), z) AS z FROM h{at}), g2 AS (SELECT *, {turn} AS t FROM g1)")
    steps.append(f"g3 AS (SELECT frame_id, point_id, xor(x, t) AS gx, xor(y, t) AS gy, xor(z, t) AS gz FROM g2), hc AS (SELECT frame_id, point_id, {_Z} AS code FROM g3)")
    return ", ".join(steps)


@query(f"WITH {_C}, {_Q.format(g=GRID)}, {_hilbert_sql('q', 21)} SELECT * FROM hc")
def hilbert_encode(spark, d):
    q = order.quantise(points(spark, d), GRID)
    return q.select("frame_id", "point_id", curves.encode("hilbert", F.col("gx"), F.col("gy"), F.col("gz")).alias("code"))


@query(f"WITH {_C}, {_Q.format(g=GRID)}, {_hilbert_sql('q', 21, 'gy', 'gx')} SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY code, point_id) - 1 AS position FROM hc")
def serialize_hilbert_trans(spark, d):
    return order.serialise(points(spark, d), GRID, "hilbert-trans", wrap=True)


@query(f"WITH {_C}, {_Q.format(g=GRID)} SELECT frame_id, point_id, gx, gy, gz FROM q")
def hilbert_roundtrip(spark, d):
    """Coordinates got back from their Hilbert codes."""
    q = order.quantise(points(spark, d), GRID)
    wide = curves.hilbert_wide(*[F.col(f"g{c}") for c in XYZ])
    code = q.select("frame_id", "point_id", *[v.alias(k) for k, v in wide.items()])
    got = curves.from_hilbert_wide(F.col("high"), F.col("low"))
    return code.select("frame_id", "point_id", *[got[c].alias(f"g{c}") for c in XYZ])


@query(f"""WITH {_C}, {_Q.format(g=0.25)}, m AS (SELECT ceil(log2(max(greatest(gx, gy, gz)) + 1))::INTEGER AS depth FROM q), b AS (SELECT frame_id, row_number() OVER (ORDER BY frame_id) - 1 AS batch FROM (SELECT DISTINCT frame_id FROM c)),
z AS (SELECT frame_id, point_id, {_Z.replace('gx', 'gt').replace('gy', 'gx').replace('gt', 'gy')} AS code FROM q) SELECT z.frame_id, point_id, (batch << (3 * depth)) | code AS code FROM z JOIN b USING (frame_id), m""")
def batch_codes(spark, d):
    """z-trans codes with the number of the frame above them, at the depth that the data need; decimals where both do not fit a long."""
    q = order.quantise(points(spark, d), 0.25)
    offsets = order.frame_offsets(q).select("frame_id")
    numbered = order.row_numbers(offsets.withColumn("_all", F.lit(0)), ["_all"], ["frame_id"], "batch").select("frame_id", "batch")
    depth = curves.data_depth(q)
    code = curves.batched(curves.encode("z-trans", F.col("gx"), F.col("gy"), F.col("gz"), depth), F.col("batch"), depth, numbered.count())
    return q.join(numbered, "frame_id").select("frame_id", "point_id", code.alias("code"))


@query("SELECT DISTINCT frame_id, point_id, xor(point_id, point_id >> 1) AS gray, point_id AS back FROM points")
def gray_code(spark, d):
    p = table(spark, d, "points").select("frame_id", "point_id").distinct()
    g = curves.to_gray(F.col("point_id"))
    return p.select("frame_id", "point_id", g.alias("gray"), curves.from_gray(g).alias("back"))


_VOX = f"{_CA}, {_Q.format(g=0.5)}, z AS (SELECT *, {_Z} >> 3 AS voxel FROM q), vp AS (SELECT frame_id, voxel, count(*) AS n_points, min(point_id) AS first_id, avg(x) AS x, avg(y) AS y, avg(z) AS z, max(intensity) AS intensity FROM z GROUP BY ALL)"


@query(f"WITH {_VOX} SELECT frame_id, voxel, n_points, first_id, {_r('x', 'y', 'z')}, intensity FROM vp")
def voxel_pool(spark, d):
    return rounded(order.voxel_pool(points(spark, d, "r", "g", "b", "nir", "intensity"), 0.5, ["intensity"], 1), *XYZ)


@query(f"WITH {_VOX} SELECT z.frame_id, point_id, z.intensity + vp.intensity AS value FROM z JOIN vp USING (frame_id, voxel)")
def voxel_unpool(spark, d):
    p = points(spark, d, "r", "g", "b", "nir", "intensity")
    return order.voxel_unpool(p, order.voxel_pool(p, 0.5, ["intensity"], 1), 0.5, "intensity", 1)


@query(f"WITH {_C}, {_Q.format(g=0.5)}, o AS (SELECT DISTINCT frame_id, gx, gy, gz FROM q) SELECT a.frame_id, a.gx, a.gy, a.gz, count(b.gx) - 1 AS n_neighbours FROM o a JOIN o b ON a.frame_id = b.frame_id AND abs(a.gx-b.gx) <= 1 AND abs(a.gy-b.gy) <= 1 AND abs(a.gz-b.gz) <= 1 GROUP BY ALL")
def voxel_neighbours(spark, d):
    return order.voxel_neighbours(points(spark, d), 0.5)


@query(f"WITH {_C}, g AS (SELECT frame_id, count(*) AS n_points FROM c GROUP BY 1) SELECT frame_id, n_points, CAST(coalesce(sum(n_points) OVER (ORDER BY frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM g")
def offset_bincount(spark, d):
    return order.frame_offsets(points(spark, d))


@query(f"WITH {_C}, w AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY point_id) - 1 AS pos FROM c) SELECT frame_id, point_id, " + ", ".join(f"round(avg(z) OVER (PARTITION BY frame_id, pos // {2**k}), 6) + 0.0 AS approx_{k}" for k in (1, 2, 3)) + " FROM w")
def wavelet_levels(spark, d):
    """Block means of the height along the order of points, three levels."""
    p = order.row_numbers(points(spark, d), ["frame_id"], ["point_id"], "pos")
    names = [f"approx_{k}" for k in (1, 2, 3)]
    return rounded(p.select("frame_id", "point_id", *order.haar_levels(F.col("z"), ["frame_id"], "pos")), *names)


# --- wireframes ------------------------------------------------------------


@query(f"WITH {_P} SELECT a.frame_id, a.corner_id AS i, b.corner_id AS j, round(sqrt({_D2}), 6) + 0.0 AS length FROM p a JOIN p b ON a.frame_id = b.frame_id AND a.corner_id < b.corner_id")
def candidate_edges(spark, d):
    return rounded(wireframe.candidate_edges(predicted(spark, d)), "length")


@query(f"WITH {_E} SELECT * FROM e")
def undirected_edge_set(spark, d):
    return edges(spark, d)


@query(f"WITH {_P}, {_E} SELECT a.frame_id, a.corner_id AS i, b.corner_id AS j, e.src IS NOT NULL AS is_edge FROM p a JOIN p b ON a.frame_id = b.frame_id AND a.corner_id < b.corner_id LEFT JOIN e ON e.frame_id = a.frame_id AND e.src = a.corner_id AND e.dst = b.corner_id")
def edge_membership(spark, d):
    return wireframe.edge_membership(wireframe.candidate_edges(predicted(spark, d)), edges(spark, d)).drop("length")


@query(f"""WITH {_V}, o AS (SELECT frame_id, vertex_id AS a, coalesce(lag(vertex_id) OVER (PARTITION BY frame_id ORDER BY vertex_id), max(vertex_id) OVER (PARTITION BY frame_id)) AS b FROM v)
SELECT DISTINCT frame_id, least(a, b) AS src, greatest(a, b) AS dst FROM o WHERE a <> b""")
def face_loop_edges(spark, d):
    """The corners of each frame as one closed loop."""
    loops = corners(spark, d).groupBy("frame_id").agg(F.sort_array(F.collect_set("vertex_id")).alias("ids"))
    return wireframe.loop_edges(loops)


_SPLIT = f"{_HC}, {_E}, l AS (SELECT *, row_number() OVER (PARTITION BY frame_id, cluster_id ORDER BY vertex_id) - 1 AS local FROM hc), se AS (SELECT e.frame_id, a.cluster_id, a.local AS src, b.local AS dst FROM e JOIN l a ON e.frame_id = a.frame_id AND e.src = a.vertex_id JOIN l b ON e.frame_id = b.frame_id AND e.dst = b.vertex_id AND a.cluster_id = b.cluster_id), off AS (SELECT frame_id, cluster_id, n_vertices, CAST(coalesce(sum(n_vertices) OVER (PARTITION BY frame_id ORDER BY cluster_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM (SELECT frame_id, cluster_id, count(*) AS n_vertices FROM hc GROUP BY ALL))"


@query(f"WITH RECURSIVE {_SPLIT} SELECT frame_id, cluster_id, CAST(src AS INTEGER) AS src, CAST(dst AS INTEGER) AS dst FROM se")
def edges_within_cluster(spark, d):
    return wireframe.split_edges(edges(spark, d), _split(spark, d)[1])


@query(f"WITH RECURSIVE {_SPLIT} SELECT * FROM off")
def wireframe_merge_offsets(spark, d):
    return wireframe.merge_offsets(_split(spark, d)[1])


@query(f"WITH RECURSIVE {_SPLIT} SELECT frame_id, CAST(src + \"offset\" AS BIGINT) AS src, CAST(dst + \"offset\" AS BIGINT) AS dst FROM se JOIN off USING (frame_id, cluster_id)")
def wireframe_merge(spark, d):
    """Split wireframes put together again, ids moved by the vertices of the clusters before."""
    labels = _split(spark, d)[1]
    return wireframe.merged_edges(wireframe.split_edges(edges(spark, d), labels), wireframe.merge_offsets(labels))


_SEG_SPLIT = f"{_SEG}, {_E}, " + _SPLIT[len(f"{_HC}, {_E}, ") :].replace("FROM hc", "FROM sv")


@query(f"WITH RECURSIVE {_SEG_SPLIT} SELECT frame_id, cluster_id, CAST(src AS INTEGER) AS src, CAST(dst AS INTEGER) AS dst FROM se")
def segment_edges(spark, d):
    """Edges within a segment of points and vertices."""
    return wireframe.split_edges(edges(spark, d), vertex_labels(_segments(spark, d)))


@query(f"WITH RECURSIVE {_SEG_SPLIT} SELECT * FROM off")
def segment_merge_offsets(spark, d):
    return wireframe.merge_offsets(vertex_labels(_segments(spark, d)))


@query(f"WITH RECURSIVE {_SEG_SPLIT} SELECT se.frame_id, CAST(src + \"offset\" AS BIGINT) AS src, CAST(dst + \"offset\" AS BIGINT) AS dst FROM se JOIN off ON se.frame_id = off.frame_id AND se.cluster_id = off.cluster_id")
def segment_wireframe_merge(spark, d):
    """As wireframe_merge, with the segments of points and vertices."""
    labels, _ = written(vertex_labels(_segments(spark, d)), "segments")
    return wireframe.merged_edges(wireframe.split_edges(edges(spark, d), labels), wireframe.merge_offsets(labels))


@query(f"WITH {_C} SELECT frame_id, count(*) AS n_points, CASE WHEN count(*) <= 300 THEN 'original' ELSE 'cluster' END AS branch FROM c GROUP BY 1")
def size_gate(spark, d):
    return wireframe.size_gate(points(spark, d), 300)


# --- matching, metrics, losses ---------------------------------------------


@query()
def hungarian_match(spark, d):
    return match.within(match.match_corners(predicted(spark, d), corners(spark, d)), 0.2)


def _scores(spark: SparkSession, d: str) -> DataFrame:
    """A score of each candidate edge that falls with its length."""
    return wireframe.candidate_edges(predicted(spark, d)).withColumn("score", losses.sigmoid(4.0 - F.col("length")))


@query()
def eval_counters(spark, d):
    return match.frame_counters(predicted(spark, d), corners(spark, d), edges(spark, d), _scores(spark, d), 0.5)


@query()
def precision_recall_f1(spark, d):
    return match.global_metrics(eval_counters(spark, d))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """Predictions with a score, and whether their point is near a corner."""
    near = spatial.assign_targets(points(spark, d), corners(spark, d), 1.5).select("frame_id", "point_id", "label", "ox", "oy", "oz")
    p = table(spark, d, "pred_points").where("score is not null and not isnan(score)").select("frame_id", "point_id", "score", "dx", "dy", "dz").distinct()
    return p.join(near, ["frame_id", "point_id"])


_L = f"{_C}, {_V}, {_NEAR}, sc AS (SELECT DISTINCT frame_id, point_id, score, dx, dy, dz FROM pred_points WHERE score IS NOT NULL AND NOT isnan(score)), l AS (SELECT sc.*, CAST(nn.vertex_id IS NOT NULL AS INTEGER) AS label, coalesce((vx-c.x)/1.5, 0) AS ox FROM sc JOIN c USING (frame_id, point_id) LEFT JOIN nn USING (frame_id, point_id))"
_B = "least(greatest(score, 1e-12), 1 - 1e-12)"


@query(f"""WITH {_L}, k AS (SELECT frame_id, count(*) FILTER (WHERE score >= 0.5 AND label = 1) AS tp, count(*) FILTER (WHERE score >= 0.5 AND label = 0) AS fp, count(*) FILTER (WHERE score < 0.5 AND label = 0) AS tn, count(*) FILTER (WHERE score < 0.5 AND label = 1) AS fn FROM l GROUP BY 1)
SELECT *, round((tp+tn)/nullif(tp+fp+tn+fn, 0), 6) + 0.0 AS accuracy, round(tp/nullif(tp+fp, 0), 6) + 0.0 AS "precision", round(tp/nullif(tp+fn, 0), 6) + 0.0 AS recall, round(2*tp/nullif(2*tp+fp+fn, 0), 6) + 0.0 AS f1 FROM k""")
def confusion_counts(spark, d):
    return rounded(losses.confusion(_labelled(spark, d), "score", "label", by=("frame_id",)), "accuracy", "precision", "recall", "f1")


@query(f"WITH {_L} SELECT frame_id, round(avg(-(label*ln({_B}) + (1-label)*ln(1-{_B}))), 6) + 0.0 AS loss, round(1.0/greatest(sum(label), 1), 6) + 0.0 AS weight FROM l GROUP BY 1")
def bce_loss(spark, d):
    l = losses.positive_weights(_labelled(spark, d), "label", ["frame_id"])
    return l.groupBy("frame_id").agg(R(F.avg(losses.bce(F.col("score"), F.col("label")))).alias("loss"), R(F.max("weight")).alias("weight"))


@query(f"WITH {_L} SELECT frame_id, round(avg((label*0.25 + (1-label)*0.75) * pow(1 - (label*score + (1-label)*(1-score)), 2) * -(label*ln({_B}) + (1-label)*ln(1-{_B}))), 6) + 0.0 AS loss FROM l GROUP BY 1")
def focal_loss(spark, d):
    return _labelled(spark, d).groupBy("frame_id").agg(R(F.avg(losses.focal(F.col("score"), F.col("label")))).alias("loss"))


@query(f"WITH {_L}, q AS (SELECT frame_id, abs(dx/1.5 - ox) AS n FROM l WHERE label = 1) SELECT frame_id, round(avg(CASE WHEN n < 1.0/9 THEN 4.5*n*n ELSE n - 0.5/9 END), 6) + 0.0 AS loss, round(avg(n), 6) + 0.0 AS l1 FROM q GROUP BY 1")
def smooth_l1(spark, d):
    diff = F.col("dx") / 1.5 - F.col("ox")
    return _labelled(spark, d).where("label = 1").groupBy("frame_id").agg(R(F.avg(losses.smooth_l1(diff))).alias("loss"), R(F.avg(losses.l1(diff))).alias("l1"))


@query(f"""WITH {_L}, e AS (SELECT frame_id, label::DOUBLE AS y, 1 - (score*2-1)*(2*label-1) AS e FROM l),
r AS (SELECT *, row_number() OVER w AS i, sum(y) OVER w AS cy, sum(1-y) OVER w AS cn, sum(y) OVER (PARTITION BY frame_id) AS t FROM e WINDOW w AS (PARTITION BY frame_id ORDER BY e DESC, y ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
j AS (SELECT *, 1 - (t-cy)/nullif(t+cn, 0) AS j FROM r), g AS (SELECT *, j - coalesce(lag(j) OVER (PARTITION BY frame_id ORDER BY i), 0) AS g FROM j)
SELECT frame_id, round(sum(greatest(e, 0)*g), 6) + 0.0 AS loss FROM g GROUP BY 1""")
def lovasz_hinge(spark, d):
    l = _labelled(spark, d).withColumn("logit", F.col("score") * 2 - 1)
    return rounded(losses.lovasz_hinge(l, "logit", "label", ["frame_id"]), "loss")


@query(f"WITH {_P}, l AS (SELECT a.frame_id, sqrt({_D2}) AS n FROM p a JOIN p b ON a.frame_id = b.frame_id AND a.corner_id < b.corner_id) SELECT frame_id, round(avg(1/(1+exp(-(4.0-n)))*n)*0.1, 6) + 0.0 AS penalty FROM l GROUP BY 1")
def edge_distance_penalty(spark, d):
    return rounded(losses.edge_distance_penalty(_scores(spark, d), "score", "length"), "penalty")


_F5 = "f AS (SELECT vec_id, run_id, frame_id, fpfh FROM fusion_inputs WHERE len(fpfh) = 5 AND len(list_filter(fpfh, lambda x: x IS NULL OR isnan(x))) = 0)"


def _fpfh(spark: SparkSession, d: str) -> DataFrame:
    sound = (F.size("fpfh") == 5) & F.forall("fpfh", lambda v: v.isNotNull() & ~F.isnan(v))
    return table(spark, d, "fusion_inputs").where(F.coalesce(sound, F.lit(False))).select("vec_id", "run_id", "frame_id", "fpfh")


@query(f"WITH {_F5}, t AS (SELECT *, ln(list_sum(list_transform(fpfh, lambda x: exp(x)))) AS z FROM f) SELECT vec_id, round(0.8*(z-fpfh[1+vec_id%5]) + 0.2*(5*z - list_sum(fpfh) - (z-fpfh[1+vec_id%5]))/4, 6) + 0.0 AS loss FROM t")
def smoothed_cross_entropy(spark, d):
    f = _fpfh(spark, d)
    return f.select("vec_id", R(losses.cross_entropy(F.col("fpfh"), F.col("vec_id") % 5, 0.2)).alias("loss"))


# --- samples ---------------------------------------------------------------


@query(f"""WITH {_C}, w AS (SELECT frame_id, point_id, row_number() OVER (PARTITION BY frame_id ORDER BY point_id) - 1 AS pos, count(*) OVER (PARTITION BY frame_id) AS n FROM c),
t AS (SELECT frame_id, n, s FROM (SELECT DISTINCT frame_id, n FROM w), range(256) r(s)), k AS (SELECT frame_id, s, CASE WHEN n <= 256 AND s < n THEN s ELSE CAST('0x' || substr(md5(frame_id || '|' || s || '|0'), 1, 8) AS BIGINT) % n END AS pos FROM t)
SELECT k.frame_id, CAST(s AS INTEGER) AS slot, point_id FROM k JOIN w USING (frame_id, pos)""")
def deterministic_resample(spark, d):
    return sampling.resample(points(spark, d), 256)


@query("""WITH p AS (SELECT frame_id, point_id, max(score) AS score FROM pred_points WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY ALL),
k AS (SELECT frame_id, point_id, round(ln((CAST('0x' || substr(md5(frame_id || '|' || point_id || '|0'), 1, 8) AS BIGINT) + 1) / 4294967297.0) / exp(score * 5), 12) AS k FROM p)
SELECT frame_id, point_id, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY k DESC, point_id) AS INTEGER) AS rank FROM k QUALIFY rank <= 64""")
def weighted_sample_topk(spark, d):
    p = table(spark, d, "pred_points").where("score is not null and not isnan(score)").groupBy("frame_id", "point_id").agg(F.max("score").alias("score"))
    return sampling.weighted_sample(p, "score", 64)


#: Points a frame of a sample, and of the draw it is taken from.
SAMPLE, DRAWN = 2048, 4096


@query(ORACLE["deterministic_resample"].replace("256", str(SAMPLE)))
def deterministic_resample_2048(spark, d):
    return sampling.resample(points(spark, d), SAMPLE)


@query(ORACLE["weighted_sample_topk"].replace("rank <= 64", f"rank <= {DRAWN}"))
def weighted_sample_top4096(spark, d):
    p = table(spark, d, "pred_points").where("score is not null and not isnan(score)").groupBy("frame_id", "point_id").agg(F.max("score").alias("score"))
    return sampling.weighted_sample(p, "score", DRAWN)


@query()
def farthest_points(spark, d):
    return sampling.farthest_points(points(spark, d), SAMPLE)


@query()
def adaptive_sample(spark, d):
    """Sample by the shape score of the points."""
    small, large = local.by_size(table(spark, d, "points").select("frame_id", "point_id", *XYZ), local.WHOLE, unique=False)

    def run(frame, ids, x, _):
        cov = [np.empty(len(x)) for _ in local.PAIRS]
        for rows, near, _d2 in local.nearest(x, SHAPE_K):
            for c, v in zip(cov, local.spread(x[near] - x[rows][:, None], sample=True)):
                c[rows] = v
        if len(x) < 2:
            return ids[:0], []
        return ids[sampling.adaptive_rows(frame, ids, x, local.shape_scores(cov), SAMPLE, DRAWN)], []

    out = local.by_frame(small, run, {}, "")
    if large is None:
        return out
    large, _ = written(large, "large")
    cov = _covariances(large, SHAPE_K, sample=True).withColumnRenamed("point_id", "query_id")
    score, _ = written(features.shape_of(cov).select("frame_id", "point_id", "score"), "score")
    return out.unionByName(sampling.adaptive_sample(large.join(score, ["frame_id", "point_id"]), "score", SAMPLE, DRAWN))


@query(f"WITH {_F5}, u AS (SELECT run_id AS frame_id, unnest(fpfh) AS x, generate_subscripts(fpfh, 1) - 1 AS i FROM f), q AS (SELECT frame_id, i, var_pop(x) AS v FROM u GROUP BY ALL) SELECT frame_id, CAST(i AS INTEGER) AS column_no, round(v, 6) + 0.0 AS variance, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY round(v, 12) DESC, i) AS INTEGER) AS rank FROM q QUALIFY rank <= 3")
def top_variance_columns(spark, d):
    f = _fpfh(spark, d).select(F.col("run_id").alias("frame_id"), "fpfh")
    return rounded(sampling.top_variance(f, "fpfh", 5, 3), "variance")


@query("SELECT frame_id, loaded_at FROM (SELECT frame_id, loaded_at, row_number() OVER (PARTITION BY frame_id ORDER BY loaded_at DESC) AS rn FROM (SELECT DISTINCT frame_id, loaded_at FROM frame_norm)) WHERE rn = 1")
def newest_norms(spark, d):
    return sampling.newest(table(spark, d, "frame_norm").select("frame_id", "loaded_at").distinct(), ["frame_id"], "loaded_at")


# --- descriptors -----------------------------------------------------------

K = 16
#: Neighbours of the large scale of the MRGD; the small one takes every fourth.
MRGD_K = 32
#: Neighbours of the shape features.
SHAPE_K = 30
#: Points up to which a task takes a frame whole for the descriptors that need it so (FPFH, MRGD).
WHOLE_FRAME = 500_000
#: Points of all frames up to which FPFH goes by pairs, as for frames that are too large.
FEW = 500
#: Radius and most neighbours of FPFH and of its normals, in clouds scaled to the unit ball.
FPFH_BALL, FPFH_NORMALS = (0.25, 100), (0.1, 30)


def _pairs(spark: SparkSession, d: str, k: int = K) -> tuple[DataFrame, DataFrame]:
    p = points(spark, d)
    near = spatial.knn(p, p, k, "point_id", "point_id")
    return written(features.with_coordinates(near, p), "pairs")[0], p


def _covariances(p: DataFrame, k: int, sample: bool = False) -> DataFrame:
    """features.covariances() of the k nearest, by point_id, made where the points lie."""
    make = lambda ways: [*local.spread(ways, sample), np.full(len(ways), ways.shape[1])]
    by_pairs = lambda pairs: features.covariances(pairs, sample).withColumnRenamed("query_id", "point_id")
    return local.around(p, k, make, {**{c: "double" for c in local.PAIRS}, "n": "long"}, by_pairs)


_K = f"{_C}, {_knn('c', 'c', K, 'point_id')}, pr AS (SELECT k.*, q.x AS qx, q.y AS qy, q.z AS qz, t.x AS tx, t.y AS ty, t.z AS tz FROM k JOIN c q ON k.frame_id = q.frame_id AND k.query_id = q.point_id JOIN c t ON k.frame_id = t.frame_id AND k.target_id = t.point_id)"
_KL = f"{_C}, {_knn('c', 'c', MRGD_K, 'point_id')}, pr AS (SELECT k.*, q.x AS qx, q.y AS qy, q.z AS qz, t.x AS tx, t.y AS ty, t.z AS tz FROM k JOIN c q ON k.frame_id = q.frame_id AND k.query_id = q.point_id JOIN c t ON k.frame_id = t.frame_id AND k.target_id = t.point_id)"


@query(f"WITH {_K} SELECT frame_id, query_id, " + ", ".join(f"round(covar_pop(t{n[0]} - q{n[0]}, t{n[1]} - q{n[1]}), 12) + 0.0 AS {n}" for n in ("xx", "xy", "xz", "yy", "yz", "zz")) + ", count(*) AS n FROM pr GROUP BY ALL")
def neighborhood_covariance(spark, d):
    return features.covariances(_pairs(spark, d)[0]).withColumns({c: F.round(c, 12) + F.lit(0.0) for c in ("xx", "xy", "xz", "yy", "yz", "zz")})


@query(f"WITH {_K} SELECT frame_id, query_id AS point_id, round(sqrt(avg((tz-qz)*(tz-qz))), 6) + 0.0 AS height_dev FROM pr GROUP BY ALL")
def height_deviation(spark, d):
    return rounded(local.around(table(spark, d, "points"), K, local.heights, {"height_dev": "double"}, features.height_deviation), "height_dev")


@query(f"WITH {_KL} SELECT frame_id, query_id, " + ", ".join(f"round(covar_pop(t{n[0]} - q{n[0]}, t{n[1]} - q{n[1]}) * count(*) * count(*), 6) / (count(*) * count(*)) + 0.0 AS {n}" for n in ("xx", "xy", "xz", "yy", "yz", "zz")) + ", count(*) AS n FROM pr GROUP BY ALL")
def neighborhood_covariance_32(spark, d):
    """As neighborhood_covariance, with the neighbours of the MRGD; times n^2 they are whole in millionths for coordinates in millimetres, and rounded as that."""
    n = F.col("n")
    return _covariances(table(spark, d, "points"), MRGD_K).withColumns({c: F.round(F.col(c) * n * n, 6) / (n * n) + F.lit(0.0) for c in local.PAIRS}).withColumnRenamed("point_id", "query_id")


@query(f"WITH {_KL} SELECT frame_id, query_id AS point_id, round(sqrt(avg((tz-qz)*(tz-qz))), 6) + 0.0 AS height_dev FROM pr GROUP BY ALL")
def height_deviation_32(spark, d):
    """As height_deviation, with the neighbours of the MRGD."""
    return rounded(features.height_deviation(_pairs(spark, d, MRGD_K)[0]), "height_dev")


def _eigen_sql(source: str, cov: str) -> str:
    """CTEs that end in ev(frame_id, query_id, nx, ny, nz, l1, l2, l3) from neighbour pairs, by the closed form."""
    names = [(a + b, a, b) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")]
    cv = f"cv AS (SELECT frame_id, query_id, " + ", ".join(f"{cov}(t{a} - q{a}, t{b} - q{b}) AS {n}" for n, a, b in names) + f" FROM {source} GROUP BY ALL)"
    crosses = [("xy*yz - xz*ay", "xz*xy - ax*yz", "ax*ay - xy*xy"), ("xy*az - xz*yz", "xz*xz - ax*az", "ax*yz - xy*xz"), ("ay*az - yz*yz", "yz*xz - xy*az", "xy*yz - ay*xz")]
    ks = ", ".join(f"{v} AS k{i}{c}" for i, k in enumerate(crosses) for c, v in zip("xyz", k))
    pick = lambda c: f"CASE WHEN k0 >= k1 AND k0 >= k2 THEN k0{c} WHEN k1 >= k2 THEN k1{c} ELSE k2{c} END"
    row = {"x": ("ax", "xy", "xz"), "y": ("xy", "ay", "yz"), "z": ("xz", "yz", "az")}
    across = {"x": "CASE WHEN abs(rz) <= abs(rx) THEN ry ELSE 0 END", "y": "CASE WHEN abs(rz) <= abs(rx) THEN -rx ELSE rz END", "z": "CASE WHEN abs(rz) <= abs(rx) THEN 0 ELSE -ry END"}
    rows = ", ".join(f"CASE WHEN ax >= ay AND ax >= az THEN {v[0]} WHEN ay >= az THEN {v[1]} ELSE {v[2]} END AS r{c}" for c, v in row.items())
    axis = lambda c: 1 if c == "z" else 0
    return (
        f"{cv}, v1 AS (SELECT *, (xx+yy+zz)/3 AS q FROM cv WHERE NOT isnan(xx) AND xx IS NOT NULL), v2 AS (SELECT *, sqrt(((xx-q)*(xx-q) + (yy-q)*(yy-q) + (zz-q)*(zz-q) + 2*(xy*xy + xz*xz + yz*yz))/6) AS p FROM v1), "
        "v3 AS (SELECT *, CASE WHEN p > 0 THEN acos(greatest(-1, least(1, ((xx-q)*((yy-q)*(zz-q) - yz*yz) - xy*(xy*(zz-q) - yz*xz) + xz*(xy*yz - (yy-q)*xz)) / (p*p*p) / 2)))/3 ELSE 0 END AS phi FROM v2), "
        "v4 AS (SELECT *, q + 2*p*cos(phi) AS l1, q + 2*p*cos(phi + 2*pi()/3) AS l3 FROM v3), v5 AS (SELECT *, 3*q - l1 - l3 AS l2, xx - l3 AS ax, yy - l3 AS ay, zz - l3 AS az FROM v4), "
        f"v6 AS (SELECT *, {ks} FROM v5), v7 AS (SELECT *, " + ", ".join(f"k{i}x*k{i}x + k{i}y*k{i}y + k{i}z*k{i}z AS k{i}" for i in range(3)) + f", {rows} FROM v6), "
        f"v8 AS (SELECT *, " + ", ".join(f"CASE WHEN sqrt(greatest(k0, k1, k2)) > {features.FLAT}::DOUBLE*q*q THEN {pick(c)} WHEN sqrt(rx*rx + ry*ry + rz*rz) <= {features.FLAT}::DOUBLE*q THEN {axis(c)} ELSE {across[c]} END AS o{c}" for c in "xyz") + " FROM v7), "
        "ev AS (SELECT frame_id, query_id, " + ", ".join(f"CASE WHEN ox*ox + oy*oy + oz*oz > 0 THEN o{c}/sqrt(ox*ox + oy*oy + oz*oz) ELSE {axis(c)} END AS n{c}" for c in "xyz") + ", l1, l2, l3 FROM v8)"
    )


_K30 = _K.replace(_knn('c', 'c', K, 'point_id'), _knn('c', 'c', SHAPE_K, 'point_id'))


@query(f"""WITH {_KL}, {_eigen_sql('pr', 'covar_pop')}, nm AS (SELECT ev.frame_id, ev.query_id, nx*sg AS nx, ny*sg AS ny, nz*sg AS nz FROM ev JOIN (SELECT frame_id, point_id, sign(e.nx*x + e.ny*y + e.nz*z) AS sg FROM c JOIN (SELECT frame_id, query_id AS point_id, nx, ny, nz FROM ev) e USING (frame_id, point_id)) g ON ev.frame_id = g.frame_id AND ev.query_id = g.point_id),
cu AS (SELECT pr.frame_id, pr.query_id, avg(abs((tx-qx)*nx + (ty-qy)*ny + (tz-qz)*nz)) AS c FROM pr JOIN nm ON pr.frame_id = nm.frame_id AND pr.query_id = nm.query_id GROUP BY ALL), mx AS (SELECT frame_id, max(c) AS m FROM cu GROUP BY 1)
SELECT nm.frame_id, nm.query_id AS point_id, {_r('nx', 'ny', 'nz')}, round(cu.c/(m + 1e-8::DOUBLE), 6) + 0.0 AS curvature FROM nm JOIN cu ON nm.frame_id = cu.frame_id AND nm.query_id = cu.query_id JOIN mx ON nm.frame_id = mx.frame_id""")
def normals_curvature(spark, d):
    pairs, p = _pairs(spark, d, MRGD_K)
    n, _ = written(features.normals(pairs, p), "normals")
    return rounded(n.join(features.curvature(pairs, n), ["frame_id", "point_id"]), "nx", "ny", "nz", "curvature")


@query(f"""WITH {_K30}, {_eigen_sql('pr', 'covar_samp')}, sf AS (SELECT frame_id, query_id AS point_id, l3/CASE WHEN l1+l2+l3 > 1e-15::DOUBLE THEN l1+l2+l3 END AS curvature, (l1-l2)/CASE WHEN l1 > 1e-15::DOUBLE THEN l1 END AS linearity, (l2-l3)/CASE WHEN l1 > 1e-15::DOUBLE THEN l1 END AS planarity FROM ev),
sc AS (SELECT *, 0.4::DOUBLE*curvature + 0.4::DOUBLE*linearity - 0.2::DOUBLE*planarity AS s FROM sf), b AS (SELECT frame_id, min(s) AS lo, max(s) AS hi FROM sc GROUP BY 1)
SELECT frame_id, point_id, {_r('curvature', 'linearity', 'planarity')}, round((s - lo)/(hi - lo + 1e-8::DOUBLE), 6) + 0.0 AS score FROM sc JOIN b USING (frame_id)""")
def geometric_features(spark, d):
    return rounded(features.shape_features(_pairs(spark, d, SHAPE_K)[0]), "curvature", "linearity", "planarity", "score")


@query()
def fpfh_descriptor(spark, d):
    p = points(spark, d)
    p, _ = written(normalise.normalise(p, normalise.frame_stats(p)).select("frame_id", "point_id", *XYZ).dropna(subset=list(XYZ)), "unit")
    small, large = local.by_size(p, 0 if few(p, FEW) else WHOLE_FRAME)
    out = local.by_frame(small, lambda _f, ids, x, _m: local.fpfh(ids, x, FPFH_BALL, FPFH_NORMALS), {"fpfh": pa.list_(pa.float64())}, "fpfh array<double>")
    if large is None:
        return out
    if not few(p, FEW):
        tiled, large = local.by_size(large, sys.maxsize)
        out = out.unionByName(local.fpfh_by_tiles(tiled, FPFH_BALL, FPFH_NORMALS))
        if large is None:
            return out
    near = spatial.knn(large, large, FPFH_BALL[1], "point_id", "point_id").where(F.col("dist") < FPFH_BALL[0])
    pairs, _ = written(features.with_coordinates(near, large), "pairs")
    return out.unionByName(features.fpfh(pairs, features.normals(features.in_ball(pairs, *FPFH_NORMALS), large)))


@query()
def mrgd_descriptor(spark, d):
    small, large = local.by_size(points(spark, d), WHOLE_FRAME)
    drawn = small.withColumns({f"v{i}": features.drawn(i).alias("v") for i in range(6)})
    out = local.by_frame(drawn, lambda _f, ids, x, v: (ids, local.mrgd(x, np.stack([v[f"v{i}"] for i in range(6)], 1), MRGD_K)), {f"m{i}": pa.float64() for i in range(3)}, "m0 double, m1 double, m2 double", tuple(f"v{i}" for i in range(6)))
    if large is None:
        return out
    large, _ = written(large, "large")
    pairs, _ = written(features.with_coordinates(spatial.knn(large, large, MRGD_K, "point_id", "point_id"), large), "pairs")
    return out.unionByName(features.mrgd(pairs, large))


@query()
def spectral_energy(spark, d):
    """Spectral energy of the points on their neighbour graphs of both scales (8 and 32)."""
    p = points(spark, d)
    near, _ = written(spatial.knn(p, p, MRGD_K, "point_id", "point_id").select("frame_id", "query_id", "target_id", "rank"), "pairs")
    e = features.spectral_energy(near, scales=(features.every_nth(), True))
    return e.withColumnsRenamed({"energy0": "energy_small", "energy1": "energy_large"})


@query(f"WITH {_C}, {_V}, {_knn('v', 'c', 8)}, m AS (SELECT frame_id, query_id, max(-dist) AS mx FROM k GROUP BY ALL) SELECT k.frame_id, query_id, round(sum(exp(-dist-mx)*z)/sum(exp(-dist-mx)), 6) + 0.0 AS z, count(*) AS n FROM k JOIN m USING (frame_id, query_id) JOIN c ON k.frame_id = c.frame_id AND k.target_id = c.point_id GROUP BY ALL")
def scatter_softmax(spark, d):
    p = points(spark, d)
    near = spatial.knn(corners(spark, d), p, 8).join(p.select("frame_id", F.col("point_id").alias("target_id"), "z"), ["frame_id", "target_id"]).withColumn("score", -F.col("dist"))
    return rounded(features.scatter_softmax(near, ["frame_id", "query_id"], "score", ["z"]), "z")


@query(f"WITH {_F5}, g AS (SELECT run_id, max(fpfh[1]) AS m FROM f GROUP BY 1) SELECT run_id, round(sum(exp(fpfh[1]-m)*fpfh[2])/sum(exp(fpfh[1]-m)), 6) + 0.0 AS v, count(*) AS n FROM f JOIN g USING (run_id) GROUP BY 1")
def softmax_by_run(spark, d):
    f = _fpfh(spark, d).select("run_id", F.col("fpfh")[0].alias("s"), F.col("fpfh")[1].alias("v"))
    return rounded(features.scatter_softmax(f, ["run_id"], "s", ["v"]), "v")


