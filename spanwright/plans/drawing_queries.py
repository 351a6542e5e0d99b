"""Registration, distances and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.functions import geometry as G
from spanwright.operators import fit
from spanwright.operators.cluster import devices, leader_clusters, single_link
from spanwright.operators.spatial import attach_nearest, farthest_pairs, nearest_k, outside_boxes, segments_within, within

from .registrar import query
from .views import PRELUDE, callouts, places, targets


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Sheet points that a mirrored similarity takes to model points, a few of them off."""
    return callouts(spark, d).selectExpr("sheet", "seq", "100 + 4 * x AS x", "900 - 4 * y AS y", "x + CASE WHEN seq % 90 = 0 THEN 0.25D ELSE 0D END AS u", "y AS v")


FIT_SQL = (
    PRELUDE + ", p AS (SELECT sheet, 100 + 4 * x AS x, 900 - 4 * y AS y, x + CASE WHEN seq % 90 = 0 THEN 0.25 ELSE 0 END AS u, y AS v FROM callouts), "
    "m AS (SELECT sheet, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv, var_pop(x) + var_pop(y) AS s, covar_pop(x, u) AS xu, covar_pop(y, v) AS yv, covar_pop(x, v) AS xv, covar_pop(y, u) AS yu FROM p GROUP BY 1), "
    "k AS (SELECT sheet, n, false AS reflected, (xu + yv) / s AS a, -(xv - yu) / s AS b, (xv - yu) / s AS c, (xu + yv) / s AS d, mx, my, mu, mv FROM m UNION ALL SELECT sheet, n, true, (xu - yv) / s, (xv + yu) / s, (xv + yu) / s, -(xu - yv) / s, mx, my, mu, mv FROM m), "
    "t AS (SELECT *, mu - a * mx - b * my AS e, mv - c * mx - d * my AS f FROM k), "
    "r AS (SELECT t.sheet, reflected, t.n, a, e, f, sqrt((a * x + b * y + e - u) ** 2 + (c * x + d * y + f - v) ** 2) AS off FROM t JOIN p USING (sheet)) "
)


@query(FIT_SQL + "SELECT sheet, reflected, round(any_value(a), 6) AS p, round(any_value(e), 4) AS e, round(any_value(f), 4) AS f, any_value(n) AS n, round(sqrt(avg(off * off)), 4) AS rms, round(max(off), 4) AS worst FROM r GROUP BY 1, 2")
def similarity_fit(spark: SparkSession, d: str) -> DataFrame:
    m, r = F.col("matrix"), lambda c, n: F.round(c, n)
    return fit.similarity_fits(_pairs(spark, d), "sheet").select("sheet", "reflected", r(m[0], 6).alias("p"), r(m[4], 4).alias("e"), r(m[5], 4).alias("f"), "n", r(F.col("rms"), 4).alias("rms"), r(F.col("worst"), 4).alias("worst"))


@query(FIT_SQL + ", b AS (SELECT sheet, reflected, round(abs(any_value(a)), 6) AS scale, sqrt(avg(off * off)) AS rms, max(off) AS worst FROM r GROUP BY 1, 2) SELECT sheet, min_by(reflected, rms) AS reflected, min_by(scale, rms) AS scale, CASE WHEN min(rms) <= 8 AND min_by(worst, rms) <= 16 THEN 'high' ELSE 'low' END AS confidence FROM b GROUP BY 1")
def calibration(spark: SparkSession, d: str) -> DataFrame:
    return fit.calibrate(_pairs(spark, d), "sheet").select("sheet", "reflected", F.round("scale", 6).alias("scale"), "confidence")


@query(PRELUDE + "SELECT sheet, 1.0 * count(*) < 3 OR (var_pop(x) * var_pop(y) - covar_pop(x, y) ** 2) / (var_pop(x) + var_pop(y)) ** 2 < 1e-6 AS collinear FROM (SELECT sheet, x, y FROM callouts UNION ALL SELECT 'row', x, y FROM callouts WHERE y = 0) GROUP BY 1")
def collinearity(spark: SparkSession, d: str) -> DataFrame:
    c = callouts(spark, d).select("sheet", "x", "y")
    return c.unionByName(c.where("y = 0").withColumn("sheet", F.lit("row"))).groupBy("sheet").agg(fit.is_collinear().alias("collinear"))


@query(PRELUDE + "SELECT id, 100 + 4 * x AS px, 900 - 4 * y AS py, x AS bx, y AS by FROM callouts")
def affine_apply_invert(spark: SparkSession, d: str) -> DataFrame:
    m = F.array(*[F.lit(float(v)) for v in (4, 0, 0, -4, 100, 900)])
    px, py = G.apply_affine(m, F.col("x"), F.col("y"))
    there = callouts(spark, d).select("id", px.alias("px"), py.alias("py"))
    bx, by = G.apply_affine(G.invert_affine(m), F.col("px"), F.col("py"))
    return there.select("id", "px", "py", bx.alias("bx"), by.alias("by"))


@query(PRELUDE + ", v AS (SELECT DISTINCT n % 30 AS i FROM keys), h AS (SELECT DISTINCT n // 30 AS j FROM keys) SELECT i, j, i * 20.0 AS x, j * 20.0 AS y FROM v CROSS JOIN h")
def grid_intersections(spark: SparkSession, d: str) -> DataFrame:
    """Lettered with numbered grid lines: both lists are a sheet's, so the product is what is
    asked for."""
    p = places(spark, d)
    a, b = p.selectExpr("n % 30 AS i").distinct(), p.selectExpr("n div 30 AS j").distinct()
    z, far = F.lit(0.0), F.lit(100.0)
    x, y = G.line_intersection((F.col("i") * 20.0, z, F.col("i") * 20.0, far), (z, F.col("j") * 20.0, far, F.col("j") * 20.0))
    return a.join(b).select("i", "j", x.alias("x"), y.alias("y"))


@query(
    PRELUDE + """, q AS (SELECT * FROM callouts QUALIFY row_number() OVER (PARTITION BY sheet, y ORDER BY x, seq) = 1 OR row_number() OVER (PARTITION BY sheet, y ORDER BY x DESC, seq) = 1)
SELECT a.sheet, a.id AS a, b.id AS b, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS dist FROM q a JOIN q b ON a.sheet = b.sheet AND a.seq < b.seq
QUALIFY row_number() OVER (PARTITION BY a.sheet ORDER BY sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) DESC, a.seq, b.seq) = 1"""
)
def max_diagonal_pair(spark: SparkSession, d: str) -> DataFrame:
    """Benchmarks are picked among each sheet's grid points."""
    return farthest_pairs(callouts(spark, d), "sheet").select("sheet", "a", "b", F.round("dist", 6).alias("dist"))


NEAR = "JOIN targets t ON c.mark = t.mark AND sqrt((c.x - t.x) ** 2 + (c.y - t.y) ** 2) <= 6"


@query(PRELUDE + f"SELECT c.id AS callout, t.id AS target, round(sqrt((c.x - t.x) ** 2 + (c.y - t.y) ** 2), 6) AS dist FROM callouts c {NEAR}")
def distance_gate_join(spark: SparkSession, d: str) -> DataFrame:
    return within(callouts(spark, d), targets(spark, d), 6.0, "mark").select(F.col("id").alias("callout"), F.col("r_id").alias("target"), F.round("dist", 6).alias("dist"))


@query(PRELUDE + "SELECT c.id AS callout, t.id AS target, row_number() OVER (PARTITION BY c.id ORDER BY sqrt((c.x - t.x) ** 2 + (c.y - t.y) ** 2), t.id) AS rank FROM callouts c JOIN targets t ON sqrt((c.x - t.x) ** 2 + (c.y - t.y) ** 2) <= 25 QUALIFY rank <= 3")
def top3_nearest(spark: SparkSession, d: str) -> DataFrame:
    return nearest_k(callouts(spark, d), targets(spark, d), 25.0, 3, "id").select(F.col("id").alias("callout"), F.col("r_id").alias("target"), "rank")


@query(PRELUDE + "SELECT id, round(sqrt((x - 103) ** 2 + (y - 61) ** 2), 6) AS dist FROM targets WHERE sqrt((x - 103) ** 2 + (y - 61) ** 2) <= 60")
def nearest_to_point(spark: SparkSession, d: str) -> DataFrame:
    far = F.hypot(F.col("x") - 103, F.col("y") - 61)
    return targets(spark, d).where(far <= 60).select("id", F.round(far, 6).alias("dist")).orderBy("dist", "id")


SEG = "sqrt((c.x - t.x) ** 2 + (c.y - (t.y + greatest(0, least(1, (c.y - t.y) / 10)) * 10)) ** 2)"


@query(PRELUDE + f"SELECT c.id AS callout, min_by(t.id, ({SEG}, t.id)) AS wall, round(min({SEG}), 6) AS dist FROM callouts c JOIN targets t ON c.mark = t.mark AND {SEG} <= 12 GROUP BY 1")
def segment_distance(spark: SparkSession, d: str) -> DataFrame:
    walls = targets(spark, d).select("id", "mark", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("x").alias("bx"), (F.col("y") + 10).alias("by"))
    near = segments_within(callouts(spark, d).select("id", "mark", "x", "y"), walls, 12.0, "mark")
    return near.groupBy(F.col("id").alias("callout")).agg(F.min_by("r_id", F.struct("dist", "r_id")).alias("wall"), F.round(F.min("dist"), 6).alias("dist"))


@query(PRELUDE + "SELECT c.id, min_by(t.id, (sqrt((c.x - t.x) ** 2 + (c.y - t.y) ** 2), -t.seq)) AS body FROM callouts c LEFT JOIN targets t ON sqrt((c.x - t.x) ** 2 + (c.y - t.y) ** 2) <= 3 AND (c.mark = t.mark OR t.mark = 'H3') GROUP BY 1")
def attach_nearest_with_orphans(spark: SparkSession, d: str) -> DataFrame:
    bodies = targets(spark, d).select("seq", "id", "x", "y", F.when(F.col("mark") != "H3", F.col("mark")).alias("token"))
    return attach_nearest(callouts(spark, d).select("seq", "id", "x", "y", F.col("mark").alias("token")), bodies, 3.0).select("id", "body")


@query(PRELUDE + ", b AS (SELECT n % 5 AS k, px - 30 AS x0, py - 5 AS y0, px + 5 AS x1, py + 30 AS y1 FROM places WHERE n % 37 = 0) SELECT id FROM callouts c WHERE NOT EXISTS (SELECT 1 FROM b WHERE k = c.seq // 10 % 5 AND c.x BETWEEN x0 - 6 AND x1 + 6 AND c.y BETWEEN y0 - 6 AND y1 + 6)")
def bbox_exclusion_antijoin(spark: SparkSession, d: str) -> DataFrame:
    b = places(spark, d).where("n % 37 = 0").selectExpr("n % 5 AS k", "px - 30 AS x0", "py - 5 AS y0", "px + 5 AS x1", "py + 30 AS y1")
    return outside_boxes(callouts(spark, d).withColumn("k", F.expr("seq div 10 % 5")), b, 6.0, "k").select("id")


# a row's places meet those two columns off in the next row, 26 or 56 ft away, so each mark is one component
@query(PRELUDE + "SELECT n AS seq, min(n) OVER (PARTITION BY mark) AS component FROM places")
def single_link_components(spark: SparkSession, d: str) -> DataFrame:
    p = places(spark, d).selectExpr("n AS seq", "mark", "px - (cast(px / 20 AS int) % 3) * 12 AS x", "py AS y")
    return single_link(p, 60.0, "mark").select("seq", "component")


@query(PRELUDE + "SELECT id, mark, seq // 10 * 10 AS founder FROM callouts")
def leader_cluster_members(spark: SparkSession, d: str) -> DataFrame:
    return leader_clusters(callouts(spark, d), 3.0).select("id", "mark", "founder")


@query(PRELUDE + "SELECT 10 * n AS founder, mark, CASE WHEN n % 3 = 0 THEN px + 0.125 ELSE px END AS x, CASE WHEN n % 3 = 0 THEN py - 0.125 ELSE py END AS y, CASE WHEN n % 3 = 0 THEN 'S1,S2' ELSE 'S1' END AS sheets, row_number() OVER (ORDER BY n) AS number FROM places")
def cross_sheet_devices(spark: SparkSession, d: str) -> DataFrame:
    return devices(callouts(spark, d), 3.0, "holdown").select("founder", "mark", "x", "y", F.concat_ws(",", "sheets").alias("sheets"), F.col("seq").alias("number"))


@query(PRELUDE + ", a AS (SELECT mark, sheet, avg(x) AS mx, avg(y) AS my, 0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) AS t FROM callouts GROUP BY 1, 2) SELECT a.mark || a.sheet AS name, round(max((x - mx) * cos(t) + (y - my) * sin(t)) - min((x - mx) * cos(t) + (y - my) * sin(t)), 4) AS length FROM callouts c JOIN a USING (mark, sheet) GROUP BY 1")
def principal_axis(spark: SparkSession, d: str) -> DataFrame:
    return fit.principal_segments(callouts(spark, d).withColumn("name", F.concat("mark", "sheet")), "name").select("name", F.round("length", 4).alias("length"))


@query(PRELUDE + "SELECT CAST(((n * 7 % 180) // 10) AS INTEGER) AS bucket, count(*) AS n FROM keys GROUP BY 1 ORDER BY n DESC, bucket LIMIT 2")
def hatch_histogram(spark: SparkSession, d: str) -> DataFrame:
    ticks = places(spark, d).selectExpr("n * 7 % 180 AS angle")
    return ticks.groupBy(F.floor(F.col("angle") / 10).cast("int").alias("bucket")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "bucket").limit(2)


@query(PRELUDE + ", o AS (SELECT id, (n % 8) * 45.0 AS deg FROM (SELECT 'p' || n AS id, n FROM keys)) SELECT id, ['N','NE','E','SE','S','SW','W','NW'][1 + CAST(deg / 45 AS INTEGER)] AS direction, least(deg % 180, 180 - deg % 180) AS delta FROM o")
def compass_and_angles(spark: SparkSession, d: str) -> DataFrame:
    deg = F.expr("cast(n % 8 * 45 AS double)")
    return places(spark, d).select(F.concat(F.lit("p"), "n").alias("id"), G.compass(deg).alias("direction"), G.angle_delta(deg, F.lit(0.0)).alias("delta"))
