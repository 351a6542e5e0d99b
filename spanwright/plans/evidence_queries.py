"""Evidence, claims and pickers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.functions import marks as K
from spanwright.functions.verdicts import registration_state
from spanwright.operators import evidence as E
from spanwright.operators import fit
from spanwright.operators.spatial import closest_pair
from spanwright.sources.exports import overlay_svg

from .registrar import query
from .views import PRELUDE, callouts, elements, places, targets


@query(
    PRELUDE + "SELECT n, CASE WHEN n % 11 = 0 THEN 'paired_hardware_markers' WHEN n % 4 >= 1 + n % 3 AND n % 3 > 0 THEN 'multiple_leader_targets' WHEN n % 4 > 0 AND n % 3 = 0 THEN 'leader_target' WHEN n % 4 > 0 THEN 'leader_plus_synthetic_count_expansion' WHEN n % 3 > 0 THEN 'label_center_synthetic_count_expansion' ELSE 'label_center_fallback' END AS method FROM keys"
)
def location_evidence(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n")
    return places(spark, d).select("n", E.location_evidence(n % 11 == 0, n % 4, 1 + n % 3, 1 + n % 3).alias("e")).select("n", "e.method")


@query(PRELUDE + "SELECT n AS seq, CASE WHEN n % 4 = 0 THEN 'p_' || n ELSE 'k' || n END AS id, n * 0.5 AS x FROM keys WHERE n % 5 <> 0")
def cleaned_points(spark: SparkSession, d: str) -> DataFrame:
    raw = places(spark, d).selectExpr("n AS seq", "CASE WHEN n % 4 <> 0 THEN concat('k', n) END AS id", "CASE WHEN n % 5 = 0 THEN 'n/a' ELSE cast(n * 0.5D AS string) END AS x")
    return E.cleaned_points(raw, ("x",), "p").select("seq", "id", "x")


@query(PRELUDE + ", p AS (SELECT n AS seq, 'k' || (n % 100) AS pair_key, CAST((n * 7) % 13 AS DOUBLE) AS score FROM keys) SELECT pair_key, seq, score FROM p QUALIFY row_number() OVER (PARTITION BY pair_key ORDER BY score, seq) = 1")
def exclusive_claims(spark: SparkSession, d: str) -> DataFrame:
    return E.lowest_claims(places(spark, d).selectExpr("n AS seq", "concat('k', n % 100) AS pair_key", "cast(n * 7 % 13 AS double) AS score"))


@query(
    PRELUDE + ", m AS (SELECT n AS seq, px + 30 AS x, py + n % 3 AS y FROM places), l AS (SELECT n AS id, px AS x, py AS y FROM places WHERE n % 4 = 0), "
    "d AS (SELECT l.id, m.seq, m.x, m.y, sqrt((m.x - l.x) ** 2 + (m.y - l.y) ** 2) AS dist FROM l JOIN m ON sqrt((m.x - l.x) ** 2 + (m.y - l.y) ** 2) > 25 AND sqrt((m.x - l.x) ** 2 + (m.y - l.y) ** 2) < 85), "
    "p AS (SELECT a.id, a.seq AS a, b.seq AS b, (a.dist + b.dist) / 2 AS score FROM d a JOIN d b ON a.id = b.id AND a.seq < b.seq WHERE abs(a.x - b.x) BETWEEN 20 AND 45 AND abs(a.y - b.y) < 12 AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) BETWEEN 20 AND 45) "
    "SELECT id, a, b, round(score, 6) AS score FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY score, a, b) = 1"
)
def aligned_marker_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = places(spark, d)
    out = E.aligned_pairs(p.where("n % 4 = 0").selectExpr("n AS id", "px AS x", "py AS y"), p.selectExpr("n AS seq", "px + 30 AS x", "py + n % 3 AS y"))
    return out.select("id", "a", "b", F.round("score", 6).alias("score"))


@query(
    PRELUDE + ", l AS (SELECT n // 30 AS page, n AS seq, 'G' || (n % 7) AS text, (n % 10) * 5.0 AS x FROM keys), o AS (SELECT a.page, a.seq AS anchor, b.text, min(b.seq) AS seq FROM l a JOIN l b ON a.page = b.page AND abs(a.x - b.x) <= 6 GROUP BY ALL HAVING count(*) = 1), "
    "c AS (SELECT page, anchor, count(*) AS k FROM o GROUP BY ALL), k AS (SELECT page, anchor FROM c QUALIFY row_number() OVER (PARTITION BY page ORDER BY k DESC, anchor) = 1) SELECT page, text, seq FROM o JOIN k USING (page, anchor)"
)
def richest_label_line(spark: SparkSession, d: str) -> DataFrame:
    return E.richest_line(places(spark, d).selectExpr("n div 30 AS page", "n AS seq", "concat('G', n % 7) AS text", "cast(n % 10 * 5 AS double) AS x", "0.0D AS y"), "x")


@query(PRELUDE + "SELECT n // 8 AS label, n AS seq, CAST(n AS DOUBLE) AS x FROM keys WHERE (n % 8) % 3 = 0")
def distinct_within_tolerance(spark: SparkSession, d: str) -> DataFrame:
    p = places(spark, d).selectExpr("n div 8 AS label", "n AS seq", "cast(n AS double) AS x", "0.0D AS y")
    return E.distinct_within(p, "label", 2.0).select("label", "seq", "x")


@query(PRELUDE + ", p AS (SELECT n // 12 AS page, n AS seq, (n * n) % 97 AS x, (n * 5) % 89 AS y FROM keys) SELECT a.page, a.seq AS a, b.seq AS b FROM p a JOIN p b ON a.page = b.page AND a.seq < b.seq QUALIFY row_number() OVER (PARTITION BY a.page ORDER BY sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), a.seq, b.seq) = 1")
def closest_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = places(spark, d).selectExpr("n div 12 AS page", "n AS seq", "cast(n * n % 97 AS double) AS x", "cast(n * 5 % 89 AS double) AS y")
    return closest_pair(p, "page").select("page", "a", "b")


@query(PRELUDE + ", c AS (SELECT mark, status, count(*) AS k, min(seq) AS seen FROM elements GROUP BY ALL), t AS (SELECT mark, sum(k)::BIGINT AS n FROM c GROUP BY 1) SELECT mark, n, status AS modal FROM c JOIN t USING (mark) WHERE status IS NOT NULL QUALIFY row_number() OVER (PARTITION BY mark ORDER BY k DESC, seen) = 1")
def modal_status(spark: SparkSession, d: str) -> DataFrame:
    return E.modal_first_seen(elements(spark, d), "mark", "status")


@query("SELECT count(*) AS entries, count(*) FILTER (event_type <> 'view') AS attempted, count(*) FILTER (event_type = 'click') AS successful, (sum(CASE WHEN event_type = 'click' THEN event_id % 100 END))::BIGINT AS tokens, max_by(event_type, event_id) AS last_model FROM events")
def usage_rollup(spark: SparkSession, d: str) -> DataFrame:
    log = spark.read.parquet(f"{d}/events.parquet").selectExpr("event_id AS seq", "event_type <> 'view' AS called", "event_type = 'click' AS ok", "event_id % 100 AS tokens", "event_type AS model")
    return E.usage_rollup(log)


@query(PRELUDE + "SELECT 'HD' || (n % 20) || 'S' AS key, min_by('M' || n, n) AS mark FROM keys GROUP BY 1")
def specification_marks(spark: SparkSession, d: str) -> DataFrame:
    rows = places(spark, d).select(F.col("n").alias("seq"), F.concat(F.lit("M"), "n").alias("mark"), K.variant_key(F.concat(F.lit("S/HDU"), F.col("n") % 20, F.lit("S"))).alias("key"))
    return E.specification_marks(rows)


@query(PRELUDE + ", w AS (SELECT DISTINCT n % 50 AS p, 'i' || (n % 7) AS i FROM keys), h AS (SELECT DISTINCT n % 50 AS p, 'i' || (n % 7) AS i FROM keys WHERE n % 3 <> 0), m AS (SELECT w.p, string_agg(CASE WHEN h.i IS NULL THEN w.i END, ',' ORDER BY w.i) AS missing FROM w LEFT JOIN h ON w.p = h.p AND w.i = h.i GROUP BY 1) SELECT p, coalesce(missing, '') AS missing, missing IS NULL AS complete FROM m")
def subset_checks(spark: SparkSession, d: str) -> DataFrame:
    p = places(spark, d).selectExpr("n", "n % 50 AS p", "concat('i', n % 7) AS i")
    return E.subset_check(p, p.where("n % 3 <> 0"), "p", "i")


@query(
    PRELUDE + ", r AS (SELECT n, CASE n % 3 WHEN 0 THEN 'LOCATION_MISMATCH' WHEN 1 THEN 'REVIT_ONLY' ELSE 'PDF_ONLY' END AS verdict, CASE WHEN n % 3 <> 1 THEN px END AS px, CASE WHEN n % 3 <> 1 THEN py END AS py, CASE WHEN n % 3 <> 2 THEN px + 5 END AS tx, CASE WHEN n % 3 <> 2 THEN py - 5 END AS ty FROM places) "
    "SELECT n, CASE n % 3 WHEN 0 THEN 'connector' WHEN 1 THEN 'circle' ELSE 'box' END AS shape, coalesce(CASE n % 3 WHEN 0 THEN px BETWEEN 0 AND 400 AND py BETWEEN 0 AND 300 AND tx BETWEEN 0 AND 400 AND ty BETWEEN 0 AND 300 WHEN 1 THEN tx BETWEEN 0 AND 400 AND ty BETWEEN 0 AND 300 ELSE px BETWEEN 0 AND 400 AND py BETWEEN 0 AND 300 END, false) AS drawable FROM r"
)
def review_overlay_items(spark: SparkSession, d: str) -> DataFrame:
    r = places(spark, d).selectExpr("n", "CASE n % 3 WHEN 0 THEN 'LOCATION_MISMATCH' WHEN 1 THEN 'REVIT_ONLY' ELSE 'PDF_ONLY' END AS verdict", "CASE WHEN n % 3 <> 1 THEN px END AS px", "CASE WHEN n % 3 <> 1 THEN py END AS py", "CASE WHEN n % 3 <> 2 THEN px + 5 END AS tx", "CASE WHEN n % 3 <> 2 THEN py - 5 END AS ty")
    return E.review_items(r, 400.0, 300.0).select("n", "shape", "drawable")


@query(PRELUDE + "SELECT sheet, count(*) AS circles FROM callouts GROUP BY 1")
def overlay_svgs(spark: SparkSession, d: str) -> DataFrame:
    svg = overlay_svg(callouts(spark, d).withColumn("verdict", F.lit("LOCATION_MATCH")))
    return svg.select("sheet", (F.size(F.split("svg", "<circle ")) - 1).cast("long").alias("circles"))


@query(PRELUDE + "SELECT id, [CAST(v AS DOUBLE) FOR v IN [x - 1, y - 1, z, x + 1, y + 2, z + 3]] AS box FROM targets")
def scene_boxes(spark: SparkSession, d: str) -> DataFrame:
    box = F.array(F.array(F.col("x") + 1, F.col("y") - 1, F.col("z") + 3), F.array(F.col("x") - 1, F.col("y") + 2, F.col("z")))
    return E.scene_boxes(targets(spark, d).withColumn("bbox", box).withColumn("category", F.lit("c"))).select("id", "box")


@query(PRELUDE + "SELECT n, CASE WHEN n % 6 = 0 THEN 'ready' WHEN n % 2 = 1 AND n % 3 = 1 THEN 'runnable' ELSE 'incomplete' END AS state, concat_ws(',', CASE WHEN n % 2 <> 1 THEN 'drawing' END, CASE WHEN n % 3 <> 1 THEN 'model' END) AS missing_inputs FROM keys")
def project_readiness(spark: SparkSession, d: str) -> DataFrame:
    p = places(spark, d).selectExpr("n", "n % 2 = 1 AS drawing", "n % 3 = 1 AS model", "n % 6 = 0 AS result")
    return E.readiness(p, ("drawing", "model"), "result").select("n", "state", "missing_inputs")


@query(PRELUDE + "SELECT category, count(*) || ' elements, ' || count(DISTINCT mark) || ' marks, ' || count(*) FILTER (status = 'MATCH') || ' matched' AS line FROM elements GROUP BY 1")
def stage_narrative(spark: SparkSession, d: str) -> DataFrame:
    return E.narrative(elements(spark, d))


@query(PRELUDE + "SELECT sheet FROM elements WHERE sheet IS NOT NULL ORDER BY category <> 'holdown', seq LIMIT 1")
def primary_sheet(spark: SparkSession, d: str) -> DataFrame:
    return E.ranked_sheets(elements(spark, d).where("sheet IS NOT NULL"))


@query(PRELUDE + "SELECT n, CASE WHEN n % 5 = 0 THEN 'missing' WHEN n % 3 = 0 THEN 'failed' WHEN n % 7 = 0 THEN 'diagnostic_only' WHEN n % 3 = 1 OR n % 2 = 0 THEN 'low_confidence' ELSE 'available' END AS state FROM keys")
def registration_states(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n")
    source = F.when(n % 5 != 0, F.when(n % 7 == 0, "diagnostic").otherwise("manual"))
    confidence = F.when(n % 3 == 0, "failed").when(n % 3 == 1, "low").otherwise("high")
    return places(spark, d).select("n", registration_state(source, confidence, n % 2 == 1).alias("state"))


@query(PRELUDE + ", b AS (SELECT sheet, min_by(x, seq) AS x0, min_by(y, seq) AS y0, max_by(x, seq) AS x1, max_by(y, seq) AS y1 FROM callouts GROUP BY 1) SELECT sheet, 4.0 AS scale, CASE WHEN sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) < 20 THEN 'failed' ELSE 'medium' END AS confidence FROM b")
def two_point_benchmarks(spark: SparkSession, d: str) -> DataFrame:
    c = callouts(spark, d)
    ends = c.groupBy("sheet").agg(F.min_by(F.struct("x", "y"), "seq").alias("a"), F.max_by(F.struct("x", "y"), "seq").alias("b")).select("sheet", F.explode(F.array("a", "b")).alias("p"))
    pairs = ends.select("sheet", "p.x", "p.y", (100 + 4 * F.col("p.x")).alias("u"), (900 - 4 * F.col("p.y")).alias("v"))
    return fit.two_point(pairs, "sheet", 4.0).select("sheet", F.round("scale", 6).alias("scale"), "confidence")
