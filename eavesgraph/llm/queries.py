"""Queries of the training-data operators of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eavesgraph.llm import density, languages, leakage, neighbours, packing
from eavesgraph.operators.clouds import selected_places
from eavesgraph.session import table


def _groups(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return density.density_groups(selected_places(table(spark, d, "pred_points"), table(spark, d, "points")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    members, _ = _groups(spark, d)
    return members.where("point_id > label").select("frame_id", F.col("label").alias("first_point_id"), "point_id")


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups with their size, mean and three most central members."""
    return density.describe_groups(*_groups(spark, d)).withColumn("central", F.array_join("central", ","))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    base = neighbours.vectors(table(spark, d, "fusion_inputs"))
    near = neighbours.nearest(base, neighbours.probe_vectors(base, table(spark, d, "fusion_probes")))
    return near.select(F.least("vec_id", "neighbour").alias("vec_a"), F.greatest("vec_id", "neighbour").alias("vec_b")).distinct()


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Every vector whose id is divisible by 20 against all rows."""
    base = neighbours.vectors(table(spark, d, "fusion_inputs"))
    return neighbours.nearest(base, base.where("vec_id % 20 = 0")).select("vec_id", "rank", "neighbour", F.sqrt("d2").alias("distance"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Texts that the packing had to cut."""
    return packing.pack(table(spark, d, "documents")).where("n_pieces > 1").select("doc_id").distinct()


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(packing.pack(table(spark, d, "documents")))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Containers used, the fewest that could do, and the share of unused space."""
    used = packing.containers(packing.pack(table(spark, d, "documents")))
    cap = packing.CAPACITY
    return used.agg(F.count("*").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"), F.ceil(F.sum("n_tokens") / cap).alias("least"), F.round(F.sum("unused") / (F.count("*") * cap), 6).alias("unused_share"))


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every text or piece with the containers it is in and whether one of them is overfull: each must be in one, none of them overfull."""
    packed = packing.pack(table(spark, d, "documents"))
    over = packing.containers(packed).where(F.col("n_tokens") > packing.CAPACITY).select("container_id", F.lit(True).alias("over"))
    j = packed.join(over, "container_id", "left")
    return j.groupBy("doc_id", "piece", "size").agg(F.count("*").alias("n_containers"), F.count_if("over").alias("n_overfull"))


def _leaked(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaked(spark, d).select("doc_id", "item_id")


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Per leaked item: documents that hold it and the longest passage."""
    return _leaked(spark, d).groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("n_words").alias("longest"))


def _vocabulary(spark: SparkSession) -> str:
    """The vocabulary file; ``spark.eavesgraph.vocabulary`` names another."""
    return spark.conf.get("spark.eavesgraph.vocabulary", languages.VOCABULARY)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    documents, codes = table(spark, d, "documents"), table(spark, d, "lang_codes")
    found = languages.document_languages(languages.language_segments(documents, codes, _vocabulary(spark)))
    return languages.label_faults(documents, codes, found)


def p8_segments(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of one language in every document, with their confidence."""
    return languages.language_segments(table(spark, d, "documents"), table(spark, d, "lang_codes"), _vocabulary(spark))


QUERIES = {f.__name__: f for f in (p2_found, p2_groups, p4_found, p4_neighbours, p6_found, p6_containers, p6_pieces, p6_report, p7_found, p7_items, p8_found, p8_segments)}

_NEAREST = """WITH v AS (SELECT DISTINCT vec_id, run_id, list_concat(xyz, list_concat(fpfh, mrgd)) AS a FROM fusion_inputs
  WHERE len(xyz) = 3 AND len(fpfh) = 5 AND len(mrgd) = 3 AND xyz IS NOT NULL AND fpfh IS NOT NULL AND mrgd IS NOT NULL
  AND len(list_filter(list_concat(xyz, list_concat(fpfh, mrgd)), lambda x: x IS NULL OR isnan(x))) = 0),
d AS (SELECT a.vec_id, b.vec_id AS neighbour, round(list_sum(list_transform(list_zip(a.a, b.a), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 10) AS d2
  FROM v a JOIN v b ON a.run_id = b.run_id AND a.vec_id <> b.vec_id WHERE {which}),
n AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2, neighbour) AS rank FROM d QUALIFY rank <= 10) """

_SIDE = "(0.1::DOUBLE / 3::DOUBLE ** 0.5::DOUBLE * 0.9995::DOUBLE)"
_GROUPS = """WITH RECURSIVE sel AS (SELECT DISTINCT frame_id, point_id, dx, dy, dz FROM pred_points
  WHERE score > 0.5 AND NOT isnan(score) AND NOT (dx = -10 AND dy = -10 AND dz = -10)),
q AS (SELECT DISTINCT sel.frame_id AS f, sel.point_id AS p, x + dx AS x, y + dy AS y, z + dz AS z FROM sel JOIN points USING (frame_id, point_id)),
near AS (SELECT a.f, a.p AS a, b.p AS b FROM q a JOIN q b ON a.f = b.f AND abs(a.x - b.x) <= 0.1 AND abs(a.y - b.y) <= 0.1
  AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 0.1 * 0.1),
reach AS (SELECT f, a, b FROM near UNION SELECT r.f, r.a, n.b FROM reach r JOIN near n ON r.f = n.f AND r.b = n.a),
g AS (SELECT f, a AS p, min(b) AS first, count(DISTINCT b) AS n FROM reach GROUP BY 1, 2) """

ORACLE = {
    "p2_found": _GROUPS + "SELECT f AS frame_id, first AS first_point_id, p AS point_id FROM g WHERE n >= 5 AND p > first",
    "p2_groups": _GROUPS + f""", m AS (SELECT q.f, first, q.p, x, y, z, n, floor(x/{_SIDE}) AS gx, floor(y/{_SIDE}) AS gy, floor(z/{_SIDE}) AS gz FROM g JOIN q ON g.f = q.f AND g.p = q.p WHERE n >= 5),
c AS (SELECT f, first, gx, gy, gz, row_number() OVER (PARTITION BY f, first ORDER BY k DESC, gx, gy, gz) AS rn FROM (SELECT f, first, gx, gy, gz, count(*) AS k FROM m GROUP BY f, first, gx, gy, gz)),
a AS (SELECT f, first, count(*) AS n_points, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM m GROUP BY ALL),
t AS (SELECT m.f, m.first, m.p, row_number() OVER (PARTITION BY m.f, m.first ORDER BY round((x-mx)*(x-mx) + (y-my)*(y-my) + (z-mz)*(z-mz), 9), p) AS rk FROM m JOIN a ON m.f = a.f AND m.first = a.first JOIN c ON m.f = c.f AND m.first = c.first AND m.gx = c.gx AND m.gy = c.gy AND m.gz = c.gz AND rn = 1)
SELECT a.f AS frame_id, a.first AS first_point_id, n_points, round(mx, 6) + 0.0 AS x, round(my, 6) + 0.0 AS y, round(mz, 6) + 0.0 AS z, string_agg(CAST(p AS VARCHAR), ',' ORDER BY rk) AS central FROM a JOIN t ON a.f = t.f AND a.first = t.first WHERE rk <= 3 GROUP BY a.f, a.first, n_points, mx, my, mz""",
    "p4_found": _NEAREST.format(which="a.vec_id IN (SELECT vec_id FROM fusion_probes)") + "SELECT DISTINCT least(vec_id, neighbour) AS vec_a, greatest(vec_id, neighbour) AS vec_b FROM n",
    "p6_pieces": "SELECT doc_id, CAST(piece AS INTEGER) AS piece, CAST(least(8192, n - piece * 8192) AS INTEGER) AS size, 1::BIGINT AS n_containers, 0::BIGINT AS n_overfull FROM (SELECT doc_id, strlen(text) AS n, unnest(range(0, CAST(ceil(strlen(text) / 8192.0) AS BIGINT))) AS piece FROM documents WHERE text <> '')",
    "p6_found": "SELECT DISTINCT doc_id FROM documents WHERE strlen(text) > 8192",
}
