"""One-to-one matching and the evidence that settles ties."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.config import Gates
from spanwright.operators import matching as M
from spanwright.operators import reports as R
from spanwright.operators.cluster import devices
from spanwright.operators.spatial import within
from spanwright.sources.scratch import stash

from .registrar import query
from .report_queries import VERDICT_SQL
from .views import PRELUDE, callouts, targets

DIST = "sqrt((c.x - t.x) ** 2 + (c.y - t.y) ** 2)"


def in_order(edges: str, name: str) -> str:
    """SQL of one pass in order over ``edges`` (n, d, t, dist, off), with lists of what is taken;
    edges of different n have no end in common. Makes ``name`` (n, d, t, off) of what is taken."""
    free = "NOT list_contains(ud, e.d) AND NOT list_contains(ut, e.t)"
    return f"""
{name}_e AS (SELECT n, d, t, off, row_number() OVER (PARTITION BY n ORDER BY dist, d, t) AS i FROM {edges}),
{name}_g(n, i, ud, ut, d, t, off) AS (
  SELECT DISTINCT n, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), false FROM {edges}
  UNION ALL
  SELECT e.n, e.i, CASE WHEN {free} THEN list_append(ud, e.d) ELSE ud END, CASE WHEN {free} AND NOT e.off THEN list_append(ut, e.t) ELSE ut END,
    CASE WHEN {free} THEN e.d END, e.t, e.off FROM {name}_g g JOIN {name}_e e ON e.n = g.n AND e.i = g.i + 1),
{name} AS (SELECT n, d, t, off FROM {name}_g WHERE d IS NOT NULL)"""


RECURSIVE = PRELUDE.replace("WITH keys", "WITH RECURSIVE keys")


@query(
    RECURSIVE + f""", near AS (
  SELECT c.seq // 10 AS n, c.seq AS d, t.seq AS t, {DIST} AS dist, false AS off, t.seq // 10 AS m FROM callouts c JOIN targets t ON c.mark = t.mark AND {DIST} <= 6),
{in_order("near", "won")}
SELECT d, t FROM won"""
)
def greedy_one_to_one(spark: SparkSession, d: str) -> DataFrame:
    edges = within(callouts(spark, d), targets(spark, d), 6.0, "mark").select(F.col("seq").alias("d"), F.col("r_seq").alias("t"), "dist")
    return M.greedy_pairs(edges).select("d", "t")


@query(
    PRELUDE + f""", n AS (
  SELECT c.id, {DIST} AS dist, row_number() OVER (PARTITION BY c.id ORDER BY {DIST}, t.id) AS r, t.id AS target FROM callouts c JOIN targets t ON c.mark = t.mark AND {DIST} <= 7)
SELECT a.id, a.target AS first, b.target AS second FROM n a JOIN n b USING (id) WHERE a.r = 1 AND b.r = 2 AND a.dist <= 6 AND b.dist - a.dist < 1"""
)
def ambiguity_flags(spark: SparkSession, d: str) -> DataFrame:
    pairs = within(callouts(spark, d), targets(spark, d), 7.0, "mark").select(F.col("id").alias("d"), F.col("r_id").alias("target"), "dist")
    return M.ambiguous(pairs, Gates()).select(F.col("d").alias("id"), "first", "second")


def _sheets(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES ('S1', 1.0D, 4.0D), ('S2', 2.0D, 4.0D) AS t(sheet, rms, scale)")


@query(PRELUDE + "SELECT 10 * n AS founder, CASE WHEN n % 3 = 0 THEN 2.5 ELSE 2.25 END AS gate FROM places")
def adaptive_gates(spark: SparkSession, d: str) -> DataFrame:
    found = devices(callouts(spark, d), 3.0, "holdown")
    return M.adaptive_gate(found, _sheets(spark), Gates()).join(found.select(F.col("seq").alias("d"), "founder"), "d").select("founder", "gate")


#: Devices, their pairs, ties, claims and mark-blind claims, as in ``matching.assign``; callouts
#: and targets of different n are too far apart to meet.
ASSIGNED = RECURSIVE + f""", devs AS (
  SELECT row_number() OVER (ORDER BY n) AS d, n, 10 * n AS founder, mark, CASE WHEN n % 3 = 0 THEN px + 0.125 ELSE px END AS x,
    CASE WHEN n % 3 = 0 THEN py - 0.125 ELSE py END AS y, CASE WHEN n % 19 = 0 THEN (n + 1) % 3 * 10.0 END AS z,
    CASE WHEN n % 2 = 0 THEN n % 4 * 45.0 END AS deg, CASE WHEN n % 3 = 0 THEN 2.5 ELSE 2.25 END AS gate FROM places),
pairs AS (
  SELECT c.n, c.d, t.seq AS t, t.id AS target, {DIST} AS dist, c.gate, coalesce(abs(c.z - t.z) > 8 AND {DIST} <= c.gate, false) AS off
  FROM devs c JOIN targets t ON c.mark = t.mark AND {DIST} <= 7),
ranked AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY dist, target) AS r FROM pairs),
tied AS (
  SELECT a.n, d, a.target AS first, b.target AS second FROM ranked a JOIN ranked b USING (d)
  WHERE a.r = 1 AND b.r = 2 AND a.dist <= 6 AND b.dist - a.dist < 1),
clear AS (SELECT * FROM pairs WHERE dist <= 6 AND d NOT IN (SELECT d FROM tied)),
{in_order("clear", "claims")},
done AS (
  SELECT d, CASE WHEN NOT w.off THEN t END AS t, dist,
    CASE WHEN w.off THEN 'NEEDS_REVIEW' WHEN dist <= gate THEN 'MATCH' ELSE 'LOCATION_MISMATCH' END AS status FROM claims w JOIN pairs USING (d, t)
  UNION ALL SELECT d, NULL, NULL, 'NEEDS_REVIEW' FROM tied),
blind AS (
  SELECT c.n, c.d, t.seq AS t, {DIST} AS dist, false AS off FROM devs c JOIN targets t ON {DIST} <= 2
  WHERE c.d NOT IN (SELECT d FROM done) AND t.seq NOT IN (SELECT t FROM done WHERE t IS NOT NULL)),
{in_order("blind", "found")},
final AS (
  SELECT c.*, coalesce(o.status, 'PDF_ONLY') AS status, t.id AS target_id, t.mark AS target_mark, t.level AS target_level,
    CASE WHEN t.id IS NOT NULL THEN round_even(o.dist, 2) END AS distance_ft, i.first, i.second, CAST(NULL AS VARCHAR) AS resolved_by
  FROM devs c LEFT JOIN (SELECT * FROM done UNION ALL SELECT d, t, dist, 'MARK_MISMATCH' FROM found JOIN blind USING (d, t)) o USING (d)
  LEFT JOIN targets t ON t.seq = o.t LEFT JOIN tied i USING (d))"""
#: What tied devices may take: (d, candidate, level, deg, dist, claimed). No two devices here
#: share a candidate, so their order is of no matter.
CANDIDATES = f"""
SELECT c.d, t.id AS candidate, t.level AS level, t.orientation_deg AS deg, {DIST} AS dist, t.id IN (SELECT target_id FROM {{0}} WHERE target_id IS NOT NULL) AS claimed
FROM {{0}} c JOIN targets t ON t.id IN (c.first, c.second) WHERE c.status = 'NEEDS_REVIEW' AND c.first IS NOT NULL"""
#: The one free candidate that agrees, where both can be told.
TAKEN = """
SELECT d, min(candidate) FILTER (agrees AND NOT claimed) AS candidate, min(dist) FILTER (agrees AND NOT claimed) AS dist FROM {0}
GROUP BY d HAVING count(*) = 2 AND count(*) FILTER (agrees AND NOT claimed) = 1 AND bool_and(usable) AND min(dist) FILTER (agrees AND NOT claimed) <= 6"""
SETTLE = """
SELECT f.* REPLACE (CASE WHEN k.d IS NULL THEN f.status WHEN k.dist <= f.gate THEN 'MATCH' ELSE 'LOCATION_MISMATCH' END AS status,
  coalesce(k.candidate, f.target_id) AS target_id, CASE WHEN k.d IS NULL THEN f.resolved_by ELSE '{2}' END AS resolved_by) FROM {0} f LEFT JOIN {1} k USING (d)"""


def votes(rows: str, sheet: str) -> str:
    """SQL of the levels that a sheet's own matches agree on, as in ``matching.consensus``."""
    return f"""
v AS (SELECT {sheet} AS sheet, level, d, status FROM {rows} f JOIN targets t ON t.id = f.target_id
      WHERE first IS NULL AND status IN ('MATCH', 'LOCATION_MISMATCH') AND level IS NOT NULL),
w AS (SELECT sheet, level, count(*) FILTER (status = 'MATCH') AS sure, count(*) FILTER (status <> 'MATCH') AS weak, min(d) FILTER (status = 'MATCH') AS seen FROM v GROUP BY ALL),
top AS (SELECT *, sum(sure) OVER (PARTITION BY sheet) AS whole FROM w QUALIFY row_number() OVER (PARTITION BY sheet ORDER BY sure DESC, seen) = 1),
agreed AS (SELECT sheet, level AS value FROM top WHERE sure > 0 AND sure >= 0.6 * whole AND sure + weak >= 2)"""


SETTLED = ASSIGNED + f""",
c1 AS (SELECT x.*, f.deg IS NOT NULL AND x.deg IS NOT NULL AS usable, coalesce(least((f.deg - x.deg + 360) % 180, 180 - (f.deg - x.deg + 360) % 180) <= 20, false) AS agrees
  FROM ({CANDIDATES.format("final")}) x JOIN final f USING (d)),
k1 AS ({TAKEN.format("c1")}),
s1 AS ({SETTLE.format("final", "k1", "orientation")}),
{votes("s1", "unnest(CASE WHEN n % 3 = 0 THEN ['S1', 'S2'] ELSE ['S1'] END)")},
told AS (SELECT d, coalesce((SELECT value FROM agreed WHERE sheet = 'S1'), CASE WHEN n % 3 = 0 THEN (SELECT value FROM agreed WHERE sheet = 'S2') END) AS value FROM s1),
c2 AS (SELECT x.*, value IS NOT NULL AS usable, coalesce(x.level = value, false) AS agrees FROM ({CANDIDATES.format("s1")}) x JOIN told USING (d)),
k2 AS (SELECT * FROM ({TAKEN.format("c2")}) WHERE d NOT IN (SELECT d FROM c2 GROUP BY d HAVING bool_and(agrees))),
s2 AS ({SETTLE.format("s1", "k2", "level")})"""


def _assigned(spark: SparkSession, d: str, optimal: bool = False) -> tuple[DataFrame, DataFrame]:
    """Devices of the drawing, every 19th with an elevation of another storey and every second
    with a direction, against the model's targets."""
    n = F.expr("founder div 10")
    found = devices(callouts(spark, d), 3.0, "holdown").withColumn("z", F.when(n % 19 == 0, (n + 1) % 3 * 10.0)).withColumn("orientation_deg", F.when(n % 2 == 0, n % 4 * 45.0))
    t = targets(spark, d)
    return M.assign(found, t, _sheets(spark), Gates(), optimal=optimal), t


@query(ASSIGNED + "SELECT founder, status, target_id, target_mark, distance_ft FROM final")
def device_assign_two_pass(spark: SparkSession, d: str) -> DataFrame:
    return _assigned(spark, d)[0].select("founder", "status", "target_id", "target_mark", "distance_ft")


@query(SETTLED + f"SELECT v.verdict, count(e.d) AS n FROM (VALUES ('LOCATION_MATCH'),('LOCATION_MISMATCH'),('NEEDS_REVIEW'),('NOT_APPLICABLE')) v(verdict) LEFT JOIN (SELECT d, {VERDICT_SQL} AS verdict FROM s2) e USING (verdict) GROUP BY 1")
def device_verdict_counts(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: callouts of all sheets to devices, devices to targets, ties settled by
    direction and by storey, statuses to verdicts, verdicts counted."""
    assigned, t = _assigned(spark, d)
    settled = M.settle_by_context(M.settle_by_orientation(assigned, t, Gates()), t, Gates())
    return R.verdict_counts(settled)


@query(SETTLED + "SELECT founder, first, second, status, target_id, resolved_by FROM s2 WHERE first IS NOT NULL")
def tie_breaks(spark: SparkSession, d: str) -> DataFrame:
    assigned, t = _assigned(spark, d)
    settled = M.settle_by_context(M.settle_by_orientation(assigned, t, Gates()), t, Gates())
    return settled.where("first IS NOT NULL").select("founder", "first", "second", "status", "target_id", "resolved_by")


@query(ASSIGNED + "," + votes("final", "'A' || (n % 3)") + "SELECT sheet, value FROM agreed")
def consensus_vote(spark: SparkSession, d: str) -> DataFrame:
    assigned, t = _assigned(spark, d)
    by_area = assigned.withColumn("sheets", F.array(F.concat(F.lit("A"), F.expr("founder div 10 % 3"))))
    return M.consensus(by_area, t, Gates())


@query(ASSIGNED + "SELECT founder, status, target_id, distance_ft FROM final")
def optimal_assignment(spark: SparkSession, d: str) -> DataFrame:
    return _assigned(spark, d, optimal=True)[0].select("founder", "status", "target_id", "distance_ft")


@query(PRELUDE + f", m AS (SELECT * FROM callouts), f AS (SELECT * FROM targets WHERE seq % 10 >= 6) SELECT t.id AS target, min_by(c.id, ({DIST}, c.id)) AS device, round(min({DIST}), 6) AS dist FROM f t JOIN m c ON c.mark = t.mark AND {DIST} <= 6 GROUP BY 1")
def absorb_same_mark(spark: SparkSession, d: str) -> DataFrame:
    return M.absorb(callouts(spark, d), targets(spark, d).where("seq % 10 >= 6"), 6.0).select("target", "device", F.round("dist", 6).alias("dist"))


@query(
    PRELUDE + ", v AS (SELECT 10 * n AS seq, mark, CASE WHEN n % 5 = 0 THEN 3.75 WHEN n % 4 = 0 THEN -2.5 ELSE 0.5 END AS vx, CASE WHEN n % 3 = 0 THEN 0.25 ELSE -0.25 END AS vy FROM places), "
    "p AS (SELECT a.seq, count(*) AS peers, count(*) FILTER ((a.vx * b.vx + a.vy * b.vy) / (sqrt(a.vx ** 2 + a.vy ** 2) * sqrt(b.vx ** 2 + b.vy ** 2)) >= 0.8 AND sqrt(b.vx ** 2 + b.vy ** 2) / sqrt(a.vx ** 2 + a.vy ** 2) BETWEEN 0.5 AND 2) AS aligned FROM v a JOIN v b ON a.mark = b.mark AND a.seq <> b.seq GROUP BY 1) "
    "SELECT seq, peers, aligned, aligned >= greatest(2, peers // 2) AS systematic FROM p"
)
def systematic_shift(spark: SparkSession, d: str) -> DataFrame:
    from .views import places

    v = places(spark, d).selectExpr("10 * n AS seq", "mark", "'LOCATION_MISMATCH' AS status", "CASE WHEN n % 5 = 0 THEN 3.75D WHEN n % 4 = 0 THEN -2.5D ELSE 0.5D END AS x", "CASE WHEN n % 3 = 0 THEN 0.25D ELSE -0.25D END AS y", "0.0D AS target_x", "0.0D AS target_y")
    return R.systematic_shift(v, "mark").select("seq", "peers", "aligned", "systematic")
