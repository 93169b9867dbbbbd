"""Queries of whole jobs and of the smaller operators they are made of, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from eavesgraph.functions import losses
from eavesgraph.operators import normalise, order, pipelines, sampling, scoring, spatial, wireframe
from eavesgraph.operators.clouds import live_norms, members
from eavesgraph.plans import geometry as g
from eavesgraph.plans.geometry import _C, _CA, _D2, _E, _F5, _HC, _L, _N, _P, _Q, _SPLIT, _V, _Z, GRID, ORACLE as _GEO, R, SAMPLE, XYZ, _fpfh, _labelled, _r, _r3, _scores, _split, corners, edges, points, predicted, rounded
from eavesgraph.session import table
from eavesgraph.sources import files

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# --- jobs -------------------------------------------------------------------


@query(f"""WITH {_P}, {_N}, b AS (SELECT frame_id, corner_id, row_number() OVER (PARTITION BY frame_id ORDER BY corner_id) - 1 AS vid, x*max_distance+cx AS x, y*max_distance+cy AS y, z*max_distance+cz AS z FROM p JOIN n USING (frame_id)),
l AS (SELECT a.frame_id, a.corner_id AS i, b.corner_id AS j, 1/(1+exp(-(4.0 - sqrt({_D2})))) AS s FROM p a JOIN p b ON a.frame_id = b.frame_id AND a.corner_id < b.corner_id),
e AS (SELECT l.frame_id, least(a.vid, b.vid) AS src, greatest(a.vid, b.vid) AS dst FROM l JOIN b a ON l.frame_id = a.frame_id AND l.i = a.corner_id JOIN b b ON l.frame_id = b.frame_id AND l.j = b.corner_id WHERE s > 0.5),
u AS (SELECT frame_id, 0 AS k, vid AS a, 0 AS b, printf('v %.6f %.6f %.6f', x, y, z) AS line FROM b UNION ALL SELECT frame_id, 1, src, dst, printf('l %d %d', src + 1, dst + 1) FROM e)
SELECT frame_id, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY k, a, b) - 1 AS INTEGER) AS line_no, line FROM u""")
def inference_wireframe(spark, d):
    """OBJ text of the predicted corners, scaled back, and of the candidate edges that score above a half."""
    v, e = pipelines.predicted_wireframes(predicted(spark, d), live_norms(table(spark, d, "frame_norm")), _scores(spark, d))
    return files.obj_lines(v, e)


_DRAWN = _GEO["deterministic_resample_2048"].replace("SELECT k.frame_id", "SELECT k.frame_id, x, y, z", 1)


@query(f"""WITH {_V}, d AS ({_DRAWN.replace('JOIN w USING (frame_id, pos)', 'JOIN w USING (frame_id, pos) JOIN c USING (frame_id, point_id)')}),
m AS (SELECT frame_id, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM d GROUP BY 1),
s AS (SELECT frame_id, m.cx, m.cy, m.cz, sqrt(max((x-cx)*(x-cx) + (y-cy)*(y-cy) + (z-cz)*(z-cz))) AS md FROM d JOIN m USING (frame_id) GROUP BY ALL),
q AS (SELECT d.frame_id, slot, point_id, (x-cx)/nullif(md,0) AS x, (y-cy)/nullif(md,0) AS y, (z-cz)/nullif(md,0) AS z FROM d JOIN s USING (frame_id)),
t AS (SELECT v.frame_id, vertex_id, (x-cx)/nullif(md,0) AS x, (y-cy)/nullif(md,0) AS y, (z-cz)/nullif(md,0) AS z FROM v JOIN s USING (frame_id)),
h AS (SELECT * FROM (SELECT a.frame_id, a.point_id, b.x AS vx, b.y AS vy, b.z AS vz, row_number() OVER (PARTITION BY a.frame_id, a.point_id ORDER BY {_D2}, b.vertex_id) AS rn FROM (SELECT DISTINCT frame_id, point_id, x, y, z FROM q) a JOIN t b ON a.frame_id = b.frame_id AND {_D2} < 0.1::DOUBLE * 0.1::DOUBLE) WHERE rn = 1)
SELECT q.frame_id, slot, q.point_id, {_r('q.x', 'q.y', 'q.z')}, CAST(h.point_id IS NOT NULL AS INTEGER) AS label, round(coalesce((vx-x)/0.1::DOUBLE, 0), 6) + 0.0 AS ox, round(coalesce((vy-y)/0.1::DOUBLE, 0), 6) + 0.0 AS oy, round(coalesce((vz-z)/0.1::DOUBLE, 0), 6) + 0.0 AS oz FROM q LEFT JOIN h ON q.frame_id = h.frame_id AND q.point_id = h.point_id""")
def training_rows(spark, d):
    """Drawn, scaled points of every frame with their target, as a network takes them."""
    rows, _ = pipelines.training_rows(points(spark, d), corners(spark, d), SAMPLE)
    return rounded(rows, *XYZ, "ox", "oy", "oz")


@query(f"""WITH RECURSIVE {_C}, {_V}, n AS (SELECT frame_id, count(*) AS n FROM c GROUP BY 1), mr AS (SELECT frame_id, point_id AS m, x, y, z, 1 AS s FROM c UNION ALL SELECT frame_id, vertex_id + 1099511627776, x, y, z, 0 FROM v),
mc AS (SELECT mr.* FROM mr JOIN n ON mr.frame_id = n.frame_id AND n > 300), bx AS (SELECT frame_id, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, greatest(max(x)-avg(x), avg(x)-min(x), max(y)-avg(y), avg(y)-min(y), max(z)-avg(z), avg(z)-min(z)) AS h FROM mc GROUP BY 1),
mb AS (SELECT frame_id, m, (x-cx)/CASE WHEN h = 0 THEN 1 ELSE h END AS x, (y-cy)/CASE WHEN h = 0 THEN 1 ELSE h END AS y, (z-cz)/CASE WHEN h = 0 THEN 1 ELSE h END AS z, s FROM mc JOIN bx USING (frame_id)),
{g._segments_sql(0.03, 0.01, 20)}, {_E}, pt AS (SELECT sg.frame_id, 'cluster_' || cluster_id AS part, m FROM sg),
ct AS (SELECT frame_id, part, count(*) FILTER (WHERE m < 1099511627776) AS n_points, count(*) FILTER (WHERE m >= 1099511627776) AS n_vertices, 0 AS n_edges FROM pt GROUP BY ALL
UNION ALL SELECT a.frame_id, 'cluster_' || a.cluster_id, 0, 0, count(*) FROM e JOIN sv a ON e.frame_id = a.frame_id AND e.src = a.vertex_id JOIN sv b ON e.frame_id = b.frame_id AND e.dst = b.vertex_id AND a.cluster_id = b.cluster_id GROUP BY ALL
UNION ALL SELECT frame_id, 'original', n, 0, 0 FROM n WHERE n <= 300 UNION ALL SELECT v.frame_id, 'original', 0, count(*), 0 FROM v JOIN n ON v.frame_id = n.frame_id AND n <= 300 GROUP BY ALL
UNION ALL SELECT e.frame_id, 'original', 0, 0, count(*) FROM e JOIN n ON e.frame_id = n.frame_id AND n <= 300 GROUP BY ALL)
SELECT frame_id, part, CAST(sum(n_points) AS BIGINT) AS n_points, CAST(sum(n_vertices) AS BIGINT) AS n_vertices, CAST(sum(n_edges) AS BIGINT) AS n_edges FROM ct GROUP BY ALL""")
def split_parts(spark, d):
    """Points, vertices and edges of the parts that frames of more than 300 points are split into."""
    p, v, e = pipelines.split_frames(table(spark, d, "points"), corners(spark, d), edges(spark, d), threshold=300)
    count = lambda df, name: df.groupBy("frame_id", "part").agg(F.count("*").alias(name))
    return count(p, "n_points").join(count(v, "n_vertices"), ["frame_id", "part"], "full").join(count(e, "n_edges"), ["frame_id", "part"], "full").fillna(0)


_PARTS = f"{_SPLIT}, lv AS (SELECT l.frame_id, l.cluster_id, l.local, v.x, v.y, v.z FROM l JOIN v ON l.frame_id = v.frame_id AND l.vertex_id = v.vertex_id)"


def _part_lines(spark, d):
    """The split wireframes as OBJ lines of files named after their frame and cluster."""
    v, labels = _split(spark, d)
    local = labels.join(v, ["frame_id", "vertex_id"])
    e = wireframe.split_edges(edges(spark, d), labels)
    path = F.concat(F.lit("parts/city_"), "frame_id", F.lit("_cluster_"), F.col("cluster_id").cast("string"), F.lit(".obj"))
    key = F.concat_ws("|", "frame_id", F.col("cluster_id").cast("string"))
    named = local.select(path.alias("path"), key.alias("frame_id"), "vertex_id", *XYZ)
    lines = files.obj_lines(named, e.select(key.alias("frame_id"), "src", "dst"))
    return lines.join(named.select("frame_id", "path").distinct(), "frame_id").select("path", "line_no", "line")


@query(f"""WITH RECURSIVE {_PARTS}, u AS (SELECT frame_id, 0 AS k, cluster_id, local AS a, 0 AS b, printf('v %.6f %.6f %.6f', x, y, z) AS line FROM lv
UNION ALL SELECT se.frame_id, 1, se.cluster_id, src, dst, printf('l %d %d', src + off."offset" + 1, dst + off."offset" + 1) FROM se JOIN off ON se.frame_id = off.frame_id AND se.cluster_id = off.cluster_id)
SELECT frame_id, row_number() OVER (PARTITION BY frame_id ORDER BY k, cluster_id, a, b) - 1 AS line_no, line FROM u""")
def merged_obj_lines(spark, d):
    """Wireframes split into files of clusters and merged again."""
    return pipelines.merge_objects(_part_lines(spark, d))


@query(f"WITH RECURSIVE {_PARTS} SELECT lv.frame_id, CAST(local + off.\"offset\" AS BIGINT) AS vertex_id, x, y, z FROM lv JOIN off ON lv.frame_id = off.frame_id AND lv.cluster_id = off.cluster_id")
def merged_vertices(spark, d):
    v, labels = _split(spark, d)
    return wireframe.merged_vertices(v, labels, wireframe.merge_offsets(labels))


@query(f"WITH {_C}, {_V} SELECT 'wireframe/' || f || '.obj' AS source, 'out/' || f || '/polygon.obj' AS target FROM (SELECT DISTINCT frame_id AS f FROM c INTERSECT SELECT frame_id FROM v) UNION ALL SELECT 'xyz/' || f || '.xyz', 'out/' || f || '/points.xyz' FROM (SELECT DISTINCT frame_id AS f FROM c INTERSECT SELECT frame_id FROM v)")
def relayout_plan(spark, d):
    path = lambda df, a, b: df.select("frame_id").distinct().select(F.concat(F.lit(a), "frame_id", F.lit(b)).alias("path"))
    return pipelines.relayout(path(points(spark, d), "xyz/", ".xyz"), path(corners(spark, d), "wireframe/", ".obj"), "out")


_FP = "f AS (SELECT frame_id, point_id, fpfh FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, point_id ORDER BY vec_id) AS rn FROM fusion_inputs WHERE len(fpfh) = 5 AND len(list_filter(fpfh, lambda x: x IS NULL OR isnan(x))) = 0) WHERE rn = 1)"


@query(f"""WITH {_C}, {_FP}, u AS (SELECT frame_id, point_id, unnest(fpfh) AS x, generate_subscripts(fpfh, 1) - 1 AS i FROM f),
vr AS (SELECT frame_id, i, row_number() OVER (PARTITION BY frame_id ORDER BY round(var_pop(x), 12) DESC, i) AS rank, avg(x) AS m, stddev_pop(x) AS s FROM u GROUP BY frame_id, i),
w AS (SELECT u.frame_id, u.point_id, rank, round((x - m) / CASE WHEN s > 1e-12 THEN s END, 6) + 0.0 AS z FROM u JOIN vr ON u.frame_id = vr.frame_id AND u.i = vr.i WHERE rank <= 3),
k AS (SELECT frame_id, point_id, max(z) FILTER (WHERE rank = 1) AS f0, max(z) FILTER (WHERE rank = 2) AS f1, max(z) FILTER (WHERE rank = 3) AS f2 FROM w GROUP BY ALL)
SELECT c.frame_id, c.point_id, f0, f1, f2 FROM c LEFT JOIN k ON c.frame_id = k.frame_id AND c.point_id = k.point_id""")
def fpfh_appended(spark, d):
    """Points with the three columns of their delivered descriptor that vary most, standardised."""
    sound = (F.size("fpfh") == 5) & F.forall("fpfh", lambda v: v.isNotNull() & ~F.isnan(v))
    f = table(spark, d, "fusion_inputs").where(F.coalesce(sound, F.lit(False))).groupBy("frame_id", "point_id").agg(F.min_by("fpfh", "vec_id").alias("fpfh"))
    out = pipelines.add_fpfh(points(spark, d), f, 5, 3)
    return out.select("frame_id", "point_id", *[R(F.col("fpfh")[i]).alias(f"f{i}") for i in range(3)])


@query(f"""WITH {_C}, f AS (SELECT frame_id, point_id, mrgd FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, point_id ORDER BY vec_id) AS rn FROM fusion_inputs WHERE len(mrgd) = 3) WHERE rn = 1)
SELECT c.frame_id, c.point_id, mrgd[1] AS m0, mrgd[2] AS m1, mrgd[3] AS m2 FROM c LEFT JOIN f ON c.frame_id = f.frame_id AND c.point_id = f.point_id""")
def mrgd_appended(spark, d):
    m = table(spark, d, "fusion_inputs").where("size(mrgd) = 3").groupBy("frame_id", "point_id").agg(F.min_by("mrgd", "vec_id").alias("m"))
    named = m.select("frame_id", "point_id", *[F.col("m")[i].alias(f"m{i}") for i in range(3)])
    return pipelines.add_mrgd(points(spark, d), named).select("frame_id", "point_id", "m0", "m1", "m2")


def _linear(pdf):
    """A stand-in for a trained model: the logit falls with the length."""
    import numpy as np

    return pdf[["frame_id", "i", "j"]].assign(score=1 / (1 + np.exp(pdf["length"].to_numpy() - 4.0)))


def _share(pdf):
    """A model that needs the whole frame: lengths as shares of their sum."""
    return pdf[["frame_id", "i", "j"]].assign(share=pdf["length"] / pdf["length"].sum())


@query(f"WITH {_P} SELECT a.frame_id, a.corner_id AS i, b.corner_id AS j, round(1/(1 + exp(sqrt({_D2}) - 4.0::DOUBLE)), 6) + 0.0 AS score FROM p a JOIN p b ON a.frame_id = b.frame_id AND a.corner_id < b.corner_id")
def scored_candidates(spark, d):
    """Candidate edges through the scoring hook, batch by batch."""
    return rounded(scoring.score_batches(wireframe.candidate_edges(predicted(spark, d)), _linear, "frame_id string, i int, j int, score double"), "score")


@query(f"WITH {_P}, l AS (SELECT a.frame_id, a.corner_id AS i, b.corner_id AS j, sqrt({_D2}) AS n FROM p a JOIN p b ON a.frame_id = b.frame_id AND a.corner_id < b.corner_id) SELECT frame_id, i, j, round(n / sum(n) OVER (PARTITION BY frame_id), 6) + 0.0 AS share FROM l")
def scored_frames(spark, d):
    """Candidate edges through the hook for models of whole frames."""
    return rounded(scoring.score_frames(wireframe.candidate_edges(predicted(spark, d)), _share, "frame_id string, i int, j int, share double"), "share")


@query()
def sample_and_group(spark, d):
    """64 farthest points of each frame with their 16 nearest."""
    return pipelines.sample_and_group(points(spark, d), 64, 16)


# --- smaller operators ------------------------------------------------------


@query("SELECT frame_id, point_id, row_number() OVER (ORDER BY CAST('0x' || substr(md5(frame_id || '|' || point_id || '|0'), 1, 8) AS BIGINT), frame_id, point_id) - 1 AS position FROM (SELECT DISTINCT frame_id, point_id FROM points)")
def shuffled_points(spark, d):
    return pipelines.shuffled(table(spark, d, "points").select("frame_id", "point_id").distinct(), ["frame_id", "point_id"])


@query(f"WITH {_C}, {_V} SELECT frame_id, point_id AS member_id, 'sample' AS kind, x, y, z FROM c UNION ALL SELECT frame_id, vertex_id + 1099511627776, 'vertex', x, y, z FROM v")
def union_members(spark, d):
    return members(points(spark, d), corners(spark, d))


@query(f"SELECT frame_id, point_id FROM (SELECT DISTINCT frame_id, point_id FROM points) EXCEPT SELECT frame_id, point_id FROM ({_GEO['deterministic_resample']})")
def remaining_points(spark, d):
    """The points that a sample left."""
    p = points(spark, d)
    return p.select("frame_id", "point_id").distinct().join(sampling.resample(p, 256), ["frame_id", "point_id"], "left_anti")


_HUE = "WITH RECURSIVE {hc}, k AS (SELECT DISTINCT frame_id, cluster_id FROM hc), n AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY cluster_id) - 1 AS i, count(*) OVER (PARTITION BY frame_id) AS n FROM k), h AS (SELECT *, CASE WHEN n > 1 THEN i * 360.0::DOUBLE / (n - 1) ELSE 0.0::DOUBLE END / 60.0::DOUBLE AS h FROM n), x AS (SELECT *, CAST(floor((1 - abs(fmod(h, 2) - 1)) * 255) AS INTEGER) AS x FROM h) "


@query(_HUE.format(hc=_HC) + "SELECT frame_id, cluster_id, CASE WHEN h < 1 THEN 255 WHEN h < 2 THEN x WHEN h < 4 THEN 0 WHEN h < 5 THEN x ELSE 255 END AS r, CASE WHEN h < 1 THEN x WHEN h < 3 THEN 255 WHEN h < 4 THEN x ELSE 0 END AS g, CASE WHEN h < 2 THEN 0 WHEN h < 3 THEN x WHEN h < 5 THEN 255 ELSE x END AS b FROM x")
def cluster_colors(spark, d):
    return wireframe.distinct_colors(_split(spark, d)[1])


@query(f"WITH {_C}, {_V}, h AS (SELECT a.frame_id, a.vertex_id AS query_id, b.point_id AS target_id, row_number() OVER (PARTITION BY a.frame_id, a.vertex_id ORDER BY b.point_id) - 1 AS slot FROM v a JOIN c b ON a.frame_id = b.frame_id AND {_D2} <= 0.25) SELECT frame_id, query_id, CAST(slot AS INTEGER) AS slot, target_id FROM h WHERE slot < 8")
def ball_query_inclusive(spark, d):
    return spatial.first_in_ball(corners(spark, d), points(spark, d), 0.5, 8, inclusive=True)


_P16 = g._PATCH.replace("128", "16")


@query(f"""WITH {_P16}, p AS (SELECT frame_id, point_id, patch, slot FROM w UNION ALL SELECT frame_id, point_id, last, slot FROM w WHERE n > 16 AND patch = last - 1 AND slot >= 16 - ((last + 1) * 16 - n)),
y AS (SELECT p.*, gx, gy, gz FROM p JOIN q USING (frame_id, point_id)) SELECT a.frame_id, a.patch, a.slot AS a, b.slot AS b, a.gx - b.gx AS dx, a.gy - b.gy AS dy, a.gz - b.gz AS dz FROM y a JOIN y b ON a.frame_id = b.frame_id AND a.patch = b.patch""")
def relative_positions(spark, d):
    """Grid steps between all slots of patches of 16."""
    p = points(spark, d)
    return order.relative_positions(order.serialise(p, GRID, wrap=True), p, GRID, 16)


@query(f"WITH {_C}, {_Q.format(g=0.5)}, z AS (SELECT frame_id, point_id, {_Z} AS code FROM q) SELECT frame_id, point_id, dense_rank() OVER (PARTITION BY frame_id ORDER BY code) - 1 AS group_id, count(*) OVER (PARTITION BY frame_id, code) AS n_points FROM z")
def voxel_groups(spark, d):
    return order.voxel_groups(points(spark, d), 0.5)


@query(f"WITH RECURSIVE {_SPLIT} SELECT frame_id, cluster_id, CAST(n_vertices AS BIGINT) AS \"count\" FROM off")
def offset_diff(spark, d):
    """Vertices of each cluster, from running totals."""
    o = wireframe.merge_offsets(_split(spark, d)[1]).select("frame_id", "cluster_id", (F.col("offset") + F.col("n_vertices")).alias("offset"))
    return order.counts_of(o, ["frame_id"], ["cluster_id"]).select("frame_id", "cluster_id", "count")


def _haar(last: int) -> str:
    ctes = f"{_C}, a0 AS (SELECT frame_id, row_number() OVER (PARTITION BY frame_id ORDER BY point_id) - 1 AS k, z AS v FROM c)"
    for n in range(1, last + 1):
        ctes += f", b{n} AS (SELECT frame_id, k // 2 AS k, max(v) FILTER (WHERE k % 2 = 0) AS a, max(v) FILTER (WHERE k % 2 = 1) AS b FROM a{n - 1} GROUP BY ALL), a{n} AS (SELECT frame_id, k, (a + coalesce(b, a)) / sqrt(2) AS v, (a - coalesce(b, a)) / sqrt(2) AS w FROM b{n})"
    return ctes


@query(f"WITH {_haar(3)} " + " UNION ALL ".join(f"SELECT frame_id, {n} AS level, k, round(v, 6) + 0.0 AS approx, round(w, 6) + 0.0 AS detail FROM a{n}" for n in (1, 2, 3)))
def wavelet_coefficients(spark, d):
    p = order.row_numbers(points(spark, d), ["frame_id"], ["point_id"], "pos")
    return rounded(order.haar_transform(p, "z", "pos"), "approx", "detail")


@query(f"""WITH {_haar(3)}, e AS (SELECT frame_id, max(k) AS last FROM a3 GROUP BY 1), x AS (SELECT frame_id, k AS pos, last, greatest(0.0::DOUBLE, least((k + 0.5::DOUBLE) / 8 - 0.5::DOUBLE, last)) AS x FROM a0 JOIN e USING (frame_id)),
i AS (SELECT *, CAST(floor(x) AS BIGINT) AS k0, CAST(least(floor(x) + 1, last) AS BIGINT) AS k1 FROM x)
SELECT i.frame_id, pos, round(l.v + (r.v - l.v) * (x - k0), 6) + 0.0 AS value FROM i JOIN a3 l ON i.frame_id = l.frame_id AND i.k0 = l.k JOIN a3 r ON i.frame_id = r.frame_id AND i.k1 = r.k""")
def wavelet_upsampled(spark, d):
    """The third level of the wavelet of the height, drawn out to the points."""
    p = order.row_numbers(points(spark, d), ["frame_id"], ["point_id"], "pos")
    return rounded(order.upsampled(order.haar_transform(p, "z", "pos"), 3, p), "value")


@query(f"""WITH {_C}, b AS (SELECT frame_id, CASE WHEN {g._DRAW.format('jitter')} < 0.8 THEN 1 ELSE 0 END AS on_, 0.005::DOUBLE + {g._DRAW.format('sigma')} * (0.010::DOUBLE - 0.005::DOUBLE) AS s, * EXCLUDE (frame_id) FROM c),
n AS (SELECT *, """ + ", ".join(f"md5(frame_id || '|' || point_id || '|{a}|0') AS h{a}" for a in XYZ) + """ FROM b)
SELECT frame_id, point_id, """ + ", ".join(f"round(CASE WHEN on_ = 1 THEN {a} + least(greatest(sqrt(-2 * ln((CAST('0x' || substr(h{a}, 1, 8) AS BIGINT) + 1) / 4294967297.0::DOUBLE)) * cos((CAST('0x' || substr(h{a}, 9, 8) AS BIGINT) + 1) / 4294967297.0::DOUBLE * (2 * pi())) * s, -10), 10) ELSE {a} END, 6) + 0.0 AS {a}" for a in XYZ) + " FROM n")
def gaussian_jitter(spark, d):
    return rounded(normalise.jitter(points(spark, d)), *XYZ)


@query(f"WITH {_C} SELECT frame_id, point_id, {_r('x', 'y', 'z')} FROM c")
def unit_box_roundtrip(spark, d):
    """Points put into the unit box and taken out again."""
    p = points(spark, d)
    stats = normalise.box_stats(p)
    return rounded(normalise.from_unit_box(normalise.unit_box(p, stats), stats), *XYZ)


_LOGIT = "(score * 2 - 1)"


@query(f"WITH {_L}, w AS (SELECT frame_id, 1.0::DOUBLE / greatest(sum(label), 1) AS w FROM l GROUP BY 1), q AS (SELECT l.frame_id, label AS y, {_LOGIT} AS x, 1 / (1 + exp(-{_LOGIT})) AS s, w FROM l JOIN w USING (frame_id)) SELECT frame_id, round(sum((y*0.25 + (1-y)*0.75) * pow(y*(1-s) + (1-y)*s, 2) * (greatest(x, 0) - x*y + ln(1 + exp(-abs(x)))) * w), 6) + 0.0 AS loss FROM q GROUP BY 1")
def focal_loss_weighted(spark, d):
    """Focal loss of logits, each row weighted by one over the positives of its frame."""
    l = losses.positive_weights(_labelled(spark, d), "label", ["frame_id"])
    x = F.col("score") * 2 - 1
    return l.groupBy("frame_id").agg(R(F.sum(losses.focal_logits(x, F.col("label"), weight=F.col("weight")))).alias("loss"))


@query(f"WITH {_F5}, t AS (SELECT *, ln(list_sum(list_transform(fpfh, lambda x: exp(x)))) AS z FROM f) SELECT vec_id, round((z - fpfh[1 + vec_id % 5]) * (1 + vec_id % 3), 6) + 0.0 AS loss FROM t")
def weighted_cross_entropy(spark, d):
    f = _fpfh(spark, d)
    target = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: (i == F.col("vec_id") % 5).cast("double"))
    return f.select("vec_id", R(losses.weighted_cross_entropy(F.col("fpfh"), target, 1 + F.col("vec_id") % 3)).alias("loss"))


@query(f"""WITH {_F5}, u AS (SELECT run_id, vec_id % 5 AS label, list_transform(fpfh, lambda x: exp(x) / list_sum(list_transform(fpfh, lambda y: exp(y)))) AS p FROM f),
k AS (SELECT run_id, label, unnest(p) AS q, generate_subscripts(p, 1) - 1 AS cls FROM u), e AS (SELECT run_id, cls, abs((label = cls)::INTEGER - q) AS e, (label = cls)::INTEGER::DOUBLE AS y FROM k),
r AS (SELECT *, row_number() OVER w AS i, sum(y) OVER w AS cy, sum(1-y) OVER w AS cn, sum(y) OVER (PARTITION BY run_id, cls) AS t FROM e WINDOW w AS (PARTITION BY run_id, cls ORDER BY e DESC, y ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
j AS (SELECT *, 1 - (t-cy)/nullif(t+cn, 0) AS j FROM r WHERE t > 0), d AS (SELECT *, j - coalesce(lag(j) OVER (PARTITION BY run_id, cls ORDER BY i), 0) AS d FROM j), o AS (SELECT run_id, cls, sum(e*d) AS loss FROM d GROUP BY ALL)
SELECT run_id, round(avg(loss), 6) + 0.0 AS loss FROM o GROUP BY 1""")
def lovasz_softmax(spark, d):
    """Lovász softmax of the descriptors taken as logits of five classes, per run."""
    total = F.aggregate("fpfh", F.lit(0.0), lambda a, v: a + F.exp(v))
    f = _fpfh(spark, d).select("run_id", (F.col("vec_id") % 5).alias("label"), F.transform("fpfh", lambda v: F.exp(v) / total).alias("p"))
    return rounded(losses.lovasz_softmax(f, "p", "label", ["run_id"]), "loss")


@query(f"SELECT frame_id, round(sum(v), 6) + 0.0 AS total FROM (SELECT frame_id, loss AS v FROM ({_GEO['bce_loss']}) UNION ALL SELECT frame_id, loss FROM ({_GEO['smooth_l1']}) UNION ALL SELECT frame_id, penalty FROM ({_GEO['edge_distance_penalty']})) GROUP BY 1")
def total_loss(spark, d):
    """Classification, offset and edge losses of each frame together."""
    return rounded(losses.total_loss((g.bce_loss(spark, d), "loss", 1.0), (g.smooth_l1(spark, d), "loss", 1.0), (g.edge_distance_penalty(spark, d), "penalty", 1.0)), "total")


# --- text -------------------------------------------------------------------


@query(f"WITH {_E} SELECT frame_id, printf('%d %d ', src + 1, dst + 1) AS line FROM e")
def edge_lines(spark, d):
    return files.edge_lines(edges(spark, d))


_HEADER = ["'ply'", "'format ascii 1.0'", "'element vertex ' || n", *[f"'property float {a}'" for a in XYZ], *[f"'property uchar {a}'" for a in ("red", "green", "blue")], "'end_header'"]


@query(f"WITH {_C}, n AS (SELECT frame_id, count(*) AS n FROM c GROUP BY 1) " + " UNION ALL ".join(f"SELECT frame_id, {i}::BIGINT AS line_no, {h} AS line FROM n" for i, h in enumerate(_HEADER)) + " UNION ALL SELECT frame_id, row_number() OVER (PARTITION BY frame_id ORDER BY point_id) + 9, printf('%.6f %.6f %.6f', x, y, z) || CASE WHEN z > 5 THEN ' 255 0 0' ELSE ' 0 0 0' END FROM c")
def ply_lines(spark, d):
    return files.ply_lines(points(spark, d), "z > 5")


@query(f"""WITH {_P}, s AS (SELECT DISTINCT frame_id, point_id, score, dx, dy, dz FROM pred_points WHERE NOT (dx = -10 AND dy = -10 AND dz = -10)), u AS (SELECT frame_id, 0 AS k, point_id AS i, printf('%.6f %.6f %.6f', dx, dy, dz) || CASE WHEN score > 0.5 AND NOT isnan(score) THEN ' 255 0 0' ELSE ' 255 255 255' END AS line FROM s
UNION ALL SELECT frame_id, 1, corner_id, printf('%.6f %.6f %.6f', x, y, z) || ' 255 255 0' FROM p) SELECT frame_id, row_number() OVER (PARTITION BY frame_id ORDER BY k, i, line) - 1 AS line_no, line FROM u""")
def candidate_dump(spark, d):
    """Offsets of the predictions, coloured by score, and the corners."""
    s = table(spark, d, "pred_points").where("not (dx = -10 and dy = -10 and dz = -10)").select("frame_id", "point_id", F.when(~F.isnan("score"), F.col("score")).alias("score"), F.col("dx").alias("x"), F.col("dy").alias("y"), F.col("dz").alias("z")).distinct()
    return pipelines.candidate_dump(s, predicted(spark, d))


@query(f"WITH {_CA} SELECT frame_id, row_number() OVER (PARTITION BY frame_id ORDER BY point_id) - 1 AS point_id, x, y, z, r, g, b FROM (SELECT DISTINCT frame_id, point_id, x, y, z, r, g, b FROM c WHERE r IS NOT NULL AND g IS NOT NULL AND b IS NOT NULL)")
def xyz_all_columns(spark, d):
    """Coloured points written as text and read with all their columns."""
    p = points(spark, d, "r", "g", "b").dropna(subset=["r", "g", "b"])
    got = files.all_columns(files.xyz_lines(p, files.CHANNELS[:6], exact=True), 6)
    return got.select("frame_id", "point_id", *XYZ, *[F.col("rest")[i].alias(c) for i, c in enumerate("rgb")])


@query("SELECT line_id, trim(raw) AS line FROM source_lines WHERE file_kind = 'obj' AND split_part(replace(trim(raw), chr(9), ' '), ' ', 1) IN ('v', 'l')")
def obj_text_records(spark, d):
    t = table(spark, d, "source_lines").where("file_kind = 'obj'").select("line_id", F.col("raw").alias("line"))
    return files.text_records(t)
