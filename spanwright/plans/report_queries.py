"""Counts, filters, sorts, unions and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.functions import verdicts as V
from spanwright.operators import reports as R
from spanwright.operators.cluster import bands, numbered

from .registrar import query
from .views import PRELUDE, callouts, elements, targets

VERDICT_SQL = (
    "CASE WHEN status = 'MATCH' THEN 'LOCATION_MATCH' WHEN status IN ('LOCATION_MISMATCH','MARK_MISMATCH','PDF_ONLY','REVIT_ONLY') THEN 'LOCATION_MISMATCH' "
    "WHEN status IN ('NO_REVIT_DATA','SPEC_ONLY','NOT_IN_SCHEDULE','NOT_EVALUATED') THEN 'NOT_APPLICABLE' ELSE 'NEEDS_REVIEW' END"
)


@query(PRELUDE + "SELECT 'total' AS dim, NULL AS value, count(*) AS n FROM elements UNION ALL SELECT 'category', category, count(*) FROM elements GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM elements WHERE status IS NOT NULL GROUP BY 2 UNION ALL SELECT 'sheet', sheet, count(*) FROM elements WHERE sheet IS NOT NULL GROUP BY 2")
def counts_by_dim(spark: SparkSession, d: str) -> DataFrame:
    return R.counts_by_dimension(elements(spark, d))


@query(PRELUDE + f"SELECT v.verdict, count(e.id) AS n FROM (VALUES ('LOCATION_MATCH'),('LOCATION_MISMATCH'),('NEEDS_REVIEW'),('NOT_APPLICABLE')) v(verdict) LEFT JOIN (SELECT id, {VERDICT_SQL} AS verdict FROM elements) e USING (verdict) GROUP BY 1")
def product_verdict_counts(spark: SparkSession, d: str) -> DataFrame:
    return R.verdict_counts(elements(spark, d))


@query(PRELUDE + f"SELECT id, {VERDICT_SQL} AS verdict, ({VERDICT_SQL}) IN ('LOCATION_MATCH','LOCATION_MISMATCH') AS is_certain, ({VERDICT_SQL}) <> 'NOT_APPLICABLE' AS in_scope FROM elements")
def product_blocks(spark: SparkSession, d: str) -> DataFrame:
    e = elements(spark, d)
    return e.withColumn("p", V.product_block(e.columns)).select("id", "p.verdict", "p.is_certain", "p.in_scope")


@query(
    PRELUDE + "SELECT count(*) AS total, count(*) FILTER (status IN ('MATCH','LOCATION_MISMATCH','PDF_ONLY','REVIT_ONLY','MARK_MISMATCH')) AS evaluable, count(*) FILTER (status = 'MATCH') AS matched, "
    "round_even(count(*) FILTER (status = 'MATCH') / count(*) FILTER (status IN ('MATCH','LOCATION_MISMATCH','PDF_ONLY','REVIT_ONLY','MARK_MISMATCH')), 4) AS accuracy, "
    "round_even(count(*) FILTER (status IN ('MATCH','LOCATION_MISMATCH','PDF_ONLY','REVIT_ONLY','MARK_MISMATCH')) / count(*), 4) AS coverage FROM elements"
)
def accuracy_metrics(spark: SparkSession, d: str) -> DataFrame:
    return R.accuracy(elements(spark, d))


@query(PRELUDE + "SELECT seq, id, mark, distance_ft FROM elements WHERE status = 'LOCATION_MISMATCH' AND category = 'holdown' AND upper(mark) = 'H3' ORDER BY seq LIMIT 100")
def filter_elements(spark: SparkSession, d: str) -> DataFrame:
    return R.page_of(R.filtered(elements(spark, d), status="LOCATION_MISMATCH", category="holdown", mark="h3"), 500).select("seq", "id", "mark", "distance_ft")


@query(PRELUDE + "SELECT id FROM elements WHERE contains(lower(concat_ws(' ', id, mark, category, sheet, status)), 'h2 shear')")
def search_elements(spark: SparkSession, d: str) -> DataFrame:
    return R.searched(elements(spark, d), "H2 shear").select("id")


@query(PRELUDE + "SELECT DISTINCT status FROM elements")
def filter_values(spark: SparkSession, d: str) -> DataFrame:
    return elements(spark, d).select("status").distinct()


@query(PRELUDE + f"SELECT id, CASE ({VERDICT_SQL}) WHEN 'LOCATION_MISMATCH' THEN 0 WHEN 'NEEDS_REVIEW' THEN 1 WHEN 'LOCATION_MATCH' THEN 2 ELSE 3 END AS severity FROM elements")
def sort_severity(spark: SparkSession, d: str) -> DataFrame:
    return R.sorted_rows(elements(spark, d), "verdict").select("id", V.severity(V.product_verdict(F.col("status"))).alias("severity"))


@query(PRELUDE + "SELECT id, distance_ft, row_number() OVER (ORDER BY distance_ft DESC NULLS LAST, seq) AS place FROM elements")
def sort_nulls_last(spark: SparkSession, d: str) -> DataFrame:
    return R.placed_rows(elements(spark, d), "distance_ft", descending=True).select("id", "distance_ft", "place")


@query(PRELUDE + "SELECT category, status, count(*) AS n FROM elements GROUP BY ALL UNION ALL SELECT category, '(all)', count(*) FROM elements GROUP BY ALL")
def category_status_rollup(spark: SparkSession, d: str) -> DataFrame:
    r = elements(spark, d).rollup("category", "status").agg(F.count("*").alias("n"), F.grouping("category").alias("gc"), F.grouping("status").alias("gs"))
    return r.where("gc = 0").select("category", F.when(F.col("gs") == 1, "(all)").otherwise(F.col("status")).alias("status"), "n")


@query(PRELUDE + f"SELECT category, mark, {VERDICT_SQL} AS verdict, count(*) AS n FROM elements GROUP BY ALL")
def group_list_dots(spark: SparkSession, d: str) -> DataFrame:
    return R.group_dots(elements(spark, d))


@query(PRELUDE + f", v AS (SELECT {VERDICT_SQL} AS verdict, count(*) AS n FROM elements GROUP BY 1) SELECT verdict, n, round_even(n / sum(n) OVER (), 6) AS share FROM v WHERE verdict <> 'NOT_APPLICABLE'")
def verdict_shares(spark: SparkSession, d: str) -> DataFrame:
    return R.shares(elements(spark, d))


RANKED = "row_number() OVER (PARTITION BY mark ORDER BY seq) AS rank"


@query(PRELUDE + f"SELECT mark, rank, left_id, right_id, CASE WHEN right_id IS NULL THEN 'PDF_ONLY' WHEN left_id IS NULL THEN 'REVIT_ONLY' ELSE 'NEEDS_REVIEW' END AS verdict FROM (SELECT mark, id AS left_id, {RANKED} FROM callouts) FULL JOIN (SELECT mark, id AS right_id, {RANKED} FROM targets) USING (mark, rank)")
def rank_aligned_pairing(spark: SparkSession, d: str) -> DataFrame:
    return R.rank_aligned(callouts(spark, d), targets(spark, d), "mark")


@query(PRELUDE + ", a AS (SELECT DISTINCT seq // 10 AS k FROM callouts), b AS (SELECT DISTINCT seq // 10 AS k FROM targets) SELECT k, CASE WHEN b.k IS NULL THEN 'left_only' WHEN a.k IS NULL THEN 'right_only' ELSE 'both' END AS side FROM a FULL JOIN b USING (k)")
def label_join_with_leftovers(spark: SparkSession, d: str) -> DataFrame:
    k = lambda df: df.selectExpr("seq div 10 AS k")
    return R.label_join(k(callouts(spark, d)), k(targets(spark, d)), "k")


DEVICE_RUN = ", runs AS (SELECT seq, category || ':' || mark || ':' || CASE WHEN seq % 3 = 0 THEN 't' || seq ELSE '@' || CAST(x AS BIGINT) || ',' || CAST(y AS BIGINT) END AS key, status FROM elements)"


def _run(spark: SparkSession, d: str) -> DataFrame:
    e = elements(spark, d).withColumn("target_id", F.when(F.col("seq") % 3 == 0, F.concat(F.lit("t"), "seq")))
    return e.select("seq", R.device_key(F.col("category")).alias("key"), "status")


@query(
    PRELUDE + DEVICE_RUN + ", o AS (SELECT key, max_by(status, seq) AS s FROM runs WHERE seq % 7 <> 0 GROUP BY 1), w AS (SELECT key, max_by(CASE WHEN seq % 9 = 0 THEN 'MATCH' ELSE status END, seq) AS s FROM runs WHERE seq % 11 <> 0 GROUP BY 1), "
    "j AS (SELECT coalesce(o.key, w.key) AS key, CASE WHEN o.key IS NULL THEN 'added' WHEN w.key IS NULL THEN 'removed' WHEN o.s IS DISTINCT FROM w.s THEN 'changed' END AS change, o.s AS old_status, w.s AS new_status FROM o FULL JOIN w ON o.key = w.key) SELECT * FROM j WHERE change IS NOT NULL"
)
def run_diff(spark: SparkSession, d: str) -> DataFrame:
    r = _run(spark, d)
    return R.run_diff(r.where("seq % 7 <> 0"), r.where("seq % 11 <> 0").withColumn("status", F.when(F.col("seq") % 9 == 0, "MATCH").otherwise(F.col("status"))))


@query(PRELUDE + ", b AS (SELECT status, count(*) AS before FROM elements WHERE seq % 7 <> 0 AND status IS NOT NULL GROUP BY 1), a AS (SELECT status, count(*) AS after FROM elements WHERE seq % 4 = 0 AND status IS NOT NULL GROUP BY 1) SELECT status, coalesce(before, 0) AS before, coalesce(after, 0) AS after, coalesce(after, 0) - coalesce(before, 0) AS delta FROM b FULL JOIN a USING (status)")
def baseline_delta(spark: SparkSession, d: str) -> DataFrame:
    e = elements(spark, d)
    return R.status_deltas(e.where("seq % 7 <> 0"), e.where("seq % 4 = 0"))


def _notes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = elements(spark, d)
    two = e.where("seq % 4 = 0").select("seq", F.col("id").alias("element_id"), F.concat(F.lit("look at "), "id").alias("comment"))
    more = e.where("seq % 20 = 0").select((F.col("seq") + 1).alias("seq"), F.col("id").alias("element_id"), F.lit("done").alias("comment"))
    return two.unionByName(more), e.where("seq % 6 = 0").select("seq", F.col("id").alias("element_id"), F.when(F.col("seq") % 12 == 0, "accept").otherwise("reject").alias("disposition"))


NOTES = ", comments AS (SELECT seq, id AS element_id, 'look at ' || id AS comment FROM elements WHERE seq % 4 = 0 UNION ALL SELECT seq + 1, id, 'done' FROM elements WHERE seq % 20 = 0), said AS (SELECT element_id, count(*) AS n_comments, string_agg(comment, ' | ' ORDER BY seq) AS comments FROM comments GROUP BY 1), decided AS (SELECT id AS element_id, CASE WHEN seq % 12 = 0 THEN 'accept' ELSE 'reject' END AS disposition FROM elements WHERE seq % 6 = 0)"


@query(PRELUDE + NOTES + "SELECT e.id AS element_id, status, coalesce(n_comments, 0) AS n_comments, coalesce(comments, '') AS comments, disposition FROM elements e LEFT JOIN said ON e.id = said.element_id LEFT JOIN decided ON e.id = decided.element_id WHERE status IN ('LOCATION_MISMATCH','NEEDS_REVIEW')")
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    return R.review_queue(elements(spark, d), *_notes(spark, d)).select("element_id", "status", "n_comments", "comments", "disposition")


@query(PRELUDE + NOTES + f"SELECT coalesce(sheet, '') AS sheet, category, mark, {VERDICT_SQL} AS verdict, coalesce(status, '') AS status, distance_ft, x AS pdf_x, y AS pdf_y, left(reason, 200) AS reason, coalesce(disposition, '') AS reviewer_disposition, left(coalesce(comments, ''), 300) AS reviewer_comments FROM elements e LEFT JOIN said ON e.id = said.element_id LEFT JOIN decided ON e.id = decided.element_id WHERE coalesce(status, '') NOT IN ('MATCH','SPEC_ONLY','NOT_EVALUATED')")
def punch_list(spark: SparkSession, d: str) -> DataFrame:
    return R.punch_list(elements(spark, d), *_notes(spark, d))


@query(PRELUDE + "SELECT id, CASE WHEN status IN ('LOCATION_MISMATCH','NEEDS_REVIEW') AND seq % 15 = 0 THEN 'MATCH' ELSE status END AS status, coalesce(status IN ('LOCATION_MISMATCH','NEEDS_REVIEW') AND seq % 15 = 0, false) AS resolved FROM elements")
def resolution_reapply(spark: SparkSession, d: str) -> DataFrame:
    e = elements(spark, d).withColumn("target_id", F.concat(F.lit("t"), "seq"))
    stored = e.where("seq % 15 = 0").select("seq", F.concat_ws(":", "category", "mark", "target_id").alias("key"), F.lit("MATCH").alias("status"))
    return R.resolved_again(e, stored).select("id", "status", F.coalesce("resolved", F.lit(False)).alias("resolved"))


@query(PRELUDE + "SELECT 0 AS source_rank, id, mark, sheet, NULL AS level FROM callouts UNION ALL SELECT 1, id, mark, NULL, level FROM targets UNION ALL SELECT 2, id, mark, sheet, NULL FROM elements WHERE id NOT IN (SELECT id FROM callouts)")
def element_union_registry(spark: SparkSession, d: str) -> DataFrame:
    c, t, e = callouts(spark, d).select("id", "mark", "sheet"), targets(spark, d).select("id", "mark", "level"), elements(spark, d).select("id", "mark", "sheet")
    return R.registry(c, t, e.join(c.select("id"), "id", "left_anti"))


@query(PRELUDE + "SELECT mark, min_by(status, seq) AS first, max_by(status, seq) AS last FROM elements GROUP BY 1")
def first_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return R.first_and_last(elements(spark, d).where("status IS NOT NULL"), "mark", "status")


@query(PRELUDE + ", vocab AS (SELECT DISTINCT category, mark FROM elements WHERE seq % 40 = 0 UNION SELECT 'post', 'H9'), plan AS (SELECT category, mark, count(*) AS plan_count FROM elements WHERE seq % 30 <> 0 GROUP BY ALL) SELECT category, mark, coalesce(plan_count, 0) AS plan_count, vocab.mark IS NOT NULL AS schedule_listed FROM plan FULL JOIN vocab USING (category, mark)")
def count_consistency(spark: SparkSession, d: str) -> DataFrame:
    e = elements(spark, d)
    vocabulary = e.where("seq % 40 = 0").select("category", "mark").distinct().unionByName(spark.sql("SELECT 'post' AS category, 'H9' AS mark"))
    return R.count_consistency(e.where("seq % 30 <> 0"), vocabulary)


@query(PRELUDE + "SELECT mark, count(*) AS callouts FROM callouts WHERE mark NOT IN (SELECT mark FROM targets WHERE mark < 'H2') GROUP BY 1")
def scope_warnings(spark: SparkSession, d: str) -> DataFrame:
    return R.scope_warnings(callouts(spark, d), targets(spark, d).where("mark < 'H2'"), "mark")


@query(PRELUDE + ", z AS (SELECT DISTINCT (n % 9) * 2.0 + (n % 3) * 25.0 AS z FROM places), s AS (SELECT z, CASE WHEN z - lag(z) OVER (ORDER BY z) > 6 THEN 1 ELSE 0 END AS step FROM z) SELECT z, CAST(sum(step) OVER (ORDER BY z) AS BIGINT) AS band FROM s")
def elevation_bands(spark: SparkSession, d: str) -> DataFrame:
    """Levels are few, so the window over all of them is small."""
    from .views import places

    z = places(spark, d).selectExpr("cast(n % 9 * 2 + n % 3 * 25 AS double) AS z").distinct().withColumn("building", F.lit(1))
    return bands(z, "z", 6.0, ["building"]).select("z", "band")


@query(PRELUDE + "SELECT id, lower(sheet) || '_holdown_' || lower(mark) || '_' || lpad(CAST(row_number() OVER (PARTITION BY sheet, mark ORDER BY seq) AS VARCHAR), 3, '0') AS mark_id FROM callouts")
def id_sequences(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    n = F.row_number().over(Window.partitionBy("sheet", "mark").orderBy("seq"))
    return callouts(spark, d).select("id", F.format_string("%s_holdown_%s_%s", F.lower("sheet"), F.lower("mark"), F.lpad(n.cast("string"), 3, "0")).alias("mark_id"))


@query(PRELUDE + "SELECT id, row_number() OVER (ORDER BY seq) AS number FROM callouts")
def running_numbers(spark: SparkSession, d: str) -> DataFrame:
    return numbered(callouts(spark, d), "seq", "number").select("id", "number")


@query(PRELUDE + "SELECT id, i AS instance, total FROM (SELECT id, 1 + seq % 3 AS total FROM callouts), LATERAL (SELECT unnest(generate_series(1, total)) AS i)")
def count_expansion(spark: SparkSession, d: str) -> DataFrame:
    c = callouts(spark, d).withColumn("total", 1 + F.col("seq") % 3)
    return c.select("id", F.explode(F.sequence(F.lit(1).cast("long"), "total")).alias("instance"), "total")


@query(PRELUDE + "SELECT mark FROM callouts WHERE sheet = 'S1' INTERSECT SELECT mark FROM targets")
def mark_intersection(spark: SparkSession, d: str) -> DataFrame:
    """Marks are few, so rows are summed up by mark where they are, and no sides are joined."""
    drawn = callouts(spark, d).where("sheet = 'S1'").select("mark", F.lit(True).alias("drawn"))
    both = drawn.unionByName(targets(spark, d).select("mark", F.lit(False).alias("drawn")))
    return both.groupBy("mark").agg(F.max("drawn").alias("a"), F.min("drawn").alias("b")).where("a AND NOT b").select("mark")


@query(PRELUDE + "SELECT seq // 10 AS k FROM callouts EXCEPT SELECT seq // 10 FROM targets")
def label_difference(spark: SparkSession, d: str) -> DataFrame:
    return callouts(spark, d).selectExpr("seq div 10 AS k").subtract(targets(spark, d).selectExpr("seq div 10 AS k"))


@query(PRELUDE + "SELECT sheet, count(*) AS n FROM callouts GROUP BY 1 ORDER BY n DESC, sheet LIMIT 1")
def densest_sheet(spark: SparkSession, d: str) -> DataFrame:
    return callouts(spark, d).groupBy("sheet").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "sheet").limit(1)


@query(PRELUDE + "SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS datum FROM targets")
def scene_bounds(spark: SparkSession, d: str) -> DataFrame:
    return targets(spark, d).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("z").alias("datum"))


@query(PRELUDE + "SELECT level, count(*) AS n, count(*) FILTER (orientation_deg IS NULL) = 0 AS oriented, min(id) AS example FROM targets GROUP BY 1")
def scope_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return targets(spark, d).groupBy("level").agg(F.count("*").alias("n"), F.every(F.col("orientation_deg").isNotNull()).alias("oriented"), F.min("id").alias("example"))


@query(PRELUDE + "SELECT id, concat_ws(',', CASE WHEN status IS NULL THEN 'no_status' END, CASE WHEN distance_ft > 8 THEN 'far' END, CASE WHEN sheet IS NULL THEN 'no_sheet' END) AS codes FROM elements")
def blocker_rules(spark: SparkSession, d: str) -> DataFrame:
    e = elements(spark, d)
    found = V.rules([(F.col("status").isNull(), "no_status", "blocker", "not evaluated"), (F.col("distance_ft") > 8, "far", "warning", "over 8 ft"), (F.col("sheet").isNull(), "no_sheet", "warning", "no sheet")])
    return e.select("id", F.concat_ws(",", F.transform(found, lambda r: r["code"])).alias("codes"))
