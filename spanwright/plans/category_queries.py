"""Hold-downs and shear walls in one run, on a view where they contend.

Each place is one category's: up to three callouts (some drawn on a second sheet too) and up to
three targets, jittered by a multiplicative hash, so that devices fight for targets, tie, and lie
on other storeys. Places are too far apart to meet. Coordinates are multiples of 1/16 and wall
lengths powers of two, so that both engines compute the same distances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.operators import categories as C

from .matching_queries import RECURSIVE, in_order
from .registrar import query
from .report_queries import VERDICT_SQL
from .views import once, places, spread_places

H = "((n * 7919 + j * 104729 + n % 97 * (j + 3) * 31) % 1021)"
G = "((n * 6277 + j * 71993 + n % 89 * (j + 5) * 17) % 1019)"
CATEGORY = "CASE n % 2 WHEN 0 THEN 'holdown' ELSE 'shear_wall' END"

#: Column expressions of the views, the same in both engines; ``//`` is ``div`` in Spark.
CALLOUT = {
    "n": "n", "seq": "10 * n + j", "id": "concat('c', 10 * n + j)", "category": CATEGORY,
    "mark": "CASE WHEN n % 50 = 49 THEN 'X9' ELSE concat(CASE n % 2 WHEN 0 THEN 'H' ELSE 'SW-' END, (n + CASE WHEN (n + 3 * j) % 13 = 0 THEN 1 ELSE 0 END) % 4) END",
    "sheet": "concat('S', n % 6)", "x": f"px + ({H} % 33 - 16) * 0.1875", "y": f"py + ({H} // 33 % 31 - 15) * 0.1875",
    "z": "CASE WHEN n % 19 = 0 THEN 30.0 WHEN n % 3 > 0 THEN n % 3 * 10.0 END", "orientation_deg": f"CASE WHEN (n + j) % 2 = 0 THEN {H} % 4 * 45.0 END",
}
AGAIN = CALLOUT | {"seq": "10 * n + j + 5", "id": "concat('c', 10 * n + j + 5)", "sheet": "concat('T', n % 5)", "x": f"({CALLOUT['x']}) + 0.25", "y": f"({CALLOUT['y']}) - 0.25"}
_wall = lambda a, b: f"CASE WHEN n % 2 = 1 THEN {a} {b} END"
_mid = {"x": f"px + ({G} % 17 - 8) * 0.125", "y": f"py + ({G} // 17 % 17 - 8) * 0.125"}
_half = {"x": f"(CASE {G} % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 ELSE 1.0 END)", "y": f"(CASE {G} % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 WHEN 2 THEN 1.0 ELSE -1.0 END)"}
TARGET = {
    "n": "n", "seq": "10 * n + j", "id": "concat('t', 10 * n + j)", "category": CATEGORY,
    "mark": "CASE WHEN (n + j) % 29 = 0 THEN NULL ELSE concat(CASE n % 2 WHEN 0 THEN 'H' ELSE 'SW-' END, (n + CASE WHEN (n + j) % 11 = 0 THEN 1 ELSE 0 END) % 4) END",
    "x": f"CASE WHEN n % 2 = 0 THEN {_mid['x']} END", "y": f"CASE WHEN n % 2 = 0 THEN {_mid['y']} END",
    **{f"a{c}": _wall(_mid[c], f"- {_half[c]}") for c in "xy"}, **{f"b{c}": _wall(_mid[c], f"+ {_half[c]}") for c in "xy"},
    "z": "CASE WHEN n % 7 > 0 THEN n % 3 * 10.0 END", "level": f"concat('L', CASE WHEN n % 5 = 0 THEN {G} % 3 ELSE n % 6 END)",
    "orientation_deg": f"CASE WHEN n % 2 = 1 THEN CASE {G} % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 90.0 WHEN 2 THEN 45.0 ELSE 135.0 END END",
}
DOUBLES = {"x", "y", "z", "orientation_deg", "ax", "ay", "bx", "by"}
IN_CALLOUTS, IN_AGAIN, IN_TARGETS = "(n + j) % 4 <> 0", "(n + j) % 4 <> 0 AND n % 3 = 0", "(n + 2 * j) % 5 <> 0"


def _spark(rows: DataFrame, columns: dict[str, str], where: str) -> DataFrame:
    short = {c: e.replace(H, "h").replace(G, "g").replace("//", "div") for c, e in columns.items()}
    kinds = {c: f"cast(({e}) AS double) AS {c}" if c in DOUBLES else f"{e} AS {c}" for c, e in short.items()}
    hashed = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(2)))).where(where).select("*", once(F.expr(H).alias("h"), F.expr(G).alias("g")))
    return hashed.selectExpr(*kinds.values())


def _sql(columns: dict[str, str], where: str) -> str:
    kinds = [f"CAST({e} AS DOUBLE) AS \"{c}\"" if c in DOUBLES else f"{e} AS {c}" for c, e in columns.items()]
    return f"SELECT {', '.join(kinds)} FROM places, (SELECT unnest(range(3)) AS j) WHERE {where}"


def callouts(spark: SparkSession, d: str) -> DataFrame:
    p = spread_places(spark, d)
    return _spark(p, CALLOUT, IN_CALLOUTS).unionByName(_spark(p, AGAIN, IN_AGAIN))


def targets(spark: SparkSession, d: str) -> DataFrame:
    return _spark(spread_places(spark, d), TARGET, IN_TARGETS)


def sheets(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT concat('S', id) AS sheet, id * 1.0D AS rms, 4.0D AS scale FROM range(5)")


RULE_ROWS = "VALUES " + ", ".join(f"('{r.category}', {r.match_ft}, {r.mismatch_ft}, {r.ambiguity_ft}, {r.level_ft}, {r.ceiling}, {r.mark_blind}, {r.optimal}, {r.by_direction}, {r.runs})" for r in C.RULES)
FAR = (
    "sqrt((d.x - (t.ax + s * (t.bx - t.ax))) ** 2 + (d.y - (t.ay + s * (t.by_ - t.ay))) ** 2)"
).replace("s *", "greatest(0, least(1, coalesce(((d.x - t.ax) * (t.bx - t.ax) + (d.y - t.ay) * (t.by_ - t.ay)) / nullif((t.bx - t.ax) ** 2 + (t.by_ - t.ay) ** 2, 0), 0))) *")

DEVICES = RECURSIVE + f""", rules(category, match_ft, outer_ft, margin, level_ft, ceiling, blind, optimal, direction, runs) AS ({RULE_ROWS}),
sheets AS (SELECT 'S' || i AS sheet, i * 1.0 AS rms, 4.0 AS scale FROM (SELECT unnest(range(5)) AS i)),
calls AS ({_sql(CALLOUT, IN_CALLOUTS)} UNION ALL {_sql(AGAIN, IN_AGAIN)}),
goals AS (SELECT *, "by" AS by_ FROM (SELECT * REPLACE (coalesce(ax, x) AS ax, coalesce(ay, y) AS ay, coalesce(bx, x) AS bx, coalesce("by", y) AS "by") FROM ({_sql(TARGET, IN_TARGETS)}))),
turn AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY seq) AS i FROM calls),
fit(n, i, open, seq, founder) AS (
  SELECT DISTINCT n, CAST(0 AS BIGINT), CAST([] AS STRUCT(s BIGINT, mark VARCHAR, x DOUBLE, y DOUBLE, on_ VARCHAR[])[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM turn
  UNION ALL
  SELECT n, i, CASE WHEN hit IS NULL THEN list_append(open, {{'s': seq, 'mark': mark, 'x': x, 'y': y, 'on_': [sheet]}})
    ELSE list_transform(open, lambda q: CASE WHEN q.s = hit THEN {{'s': q.s, 'mark': q.mark, 'x': q.x, 'y': q.y, 'on_': list_append(q.on_, sheet)}} ELSE q END) END, seq, coalesce(hit, seq)
  FROM (SELECT o.n, o.i, f.open, o.seq, o.mark, o.x, o.y, o.sheet,
          list_filter(f.open, lambda q: q.mark = o.mark AND abs(q.x - o.x) <= 3 AND abs(q.y - o.y) <= 3 AND NOT list_contains(q.on_, o.sheet))[1].s AS hit
        FROM fit f JOIN turn o ON o.n = f.n AND o.i = f.i + 1)),
grouped AS (
  SELECT c.n, f.founder, c.category, c.mark, avg(c.x) AS x, avg(c.y) AS y, arg_min(c.z, c.seq) FILTER (c.z IS NOT NULL) AS z,
    arg_min(c.orientation_deg, c.seq) FILTER (c.orientation_deg IS NOT NULL) AS deg, list(c.id ORDER BY c.seq) AS appearances, list(c.sheet ORDER BY c.seq) AS sheets
  FROM calls c JOIN fit f ON f.seq = c.seq GROUP BY ALL),
devs AS (
  SELECT g.* EXCLUDE (founder), g.founder AS d, printf('%s_dev_%03d', g.category, row_number() OVER (PARTITION BY g.category ORDER BY g.founder)) AS id, r.* EXCLUDE (category),
    least(r.match_ft + coalesce((SELECT max(s.rms / s.scale) FROM sheets s WHERE list_contains(g.sheets, s.sheet)), 0), r.match_ft * r.ceiling) AS gate
  FROM grouped g JOIN rules r USING (category))"""

MATCHED = DEVICES + f""",
pairs AS (
  SELECT d.n, d.d, t.seq AS t, t.id AS target, {FAR} AS dist, gate, outer_ft, margin, optimal, coalesce(abs(d.z - t.z) > level_ft AND {FAR} <= gate, false) AS off
  FROM devs d JOIN goals t ON d.n = t.n AND d.mark = t.mark WHERE {FAR} <= outer_ft + margin),
ranked AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY dist, target) AS r FROM pairs),
tied AS (SELECT a.n, a.d, a.target AS first, b.target AS second FROM ranked a JOIN ranked b ON a.d = b.d AND a.r = 1 AND b.r = 2
         WHERE a.dist <= a.outer_ft AND b.dist - a.dist < a.margin),
-- decisive devices pin their best, in device order; the rest is tried in every way, per place and mark
best AS (SELECT a.n, p.mark, a.d, a.t, a.dist, row_number() OVER (PARTITION BY a.t ORDER BY a.d) AS first_of
         FROM ranked a JOIN devs p ON p.d = a.d LEFT JOIN ranked b ON b.d = a.d AND b.r = 2
         WHERE a.r = 1 AND a.optimal AND a.dist <= a.gate AND (b.d IS NULL OR b.dist - a.dist >= a.margin)),
pinned AS (SELECT * FROM best WHERE first_of = 1),
open_d AS (SELECT DISTINCT p.n, v.mark, p.d FROM pairs p JOIN devs v ON v.d = p.d WHERE p.optimal AND p.d NOT IN (SELECT d FROM pinned)),
numbers AS (SELECT *, row_number() OVER (PARTITION BY n, mark ORDER BY d) AS i, count(*) OVER (PARTITION BY n, mark) AS m FROM open_d),
choices AS (SELECT d, t, dist FROM pairs WHERE dist <= outer_ft AND t NOT IN (SELECT t FROM pinned) UNION ALL SELECT d, NULL, 12000 FROM open_d),
ways(n, mark, i, m, cost, far, ds, ts) AS (
  SELECT DISTINCT n, mark, CAST(0 AS BIGINT), m, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]) FROM numbers
  UNION ALL
  SELECT w.n, w.mark, o.i, w.m, w.cost + CAST(round(c.dist * 1e9) AS BIGINT), list_append(w.far, CAST(round(c.dist * 1e9) AS BIGINT)), list_append(w.ds, o.d), list_append(w.ts, c.t)
  FROM ways w JOIN numbers o ON o.n = w.n AND o.mark = w.mark AND o.i = w.i + 1 JOIN choices c ON c.d = o.d AND (c.t IS NULL OR NOT list_contains(w.ts, c.t))),
least_way AS (SELECT n, mark, arg_min(ds, (cost, far, ts)) AS ds, arg_min(ts, (cost, far, ts)) AS ts FROM ways WHERE i = m GROUP BY n, mark),
planned AS (SELECT d, t FROM pinned UNION ALL SELECT unnest(ds), unnest(ts) FROM least_way),
clear AS (
  SELECT p.n, p.d, p.t, p.off, CASE WHEN l.d IS NULL THEN 1000 ELSE 0 END + p.dist AS dist, p.dist AS real, p.gate
  FROM pairs p LEFT JOIN planned l ON l.d = p.d AND l.t = p.t WHERE p.dist <= p.outer_ft AND p.d NOT IN (SELECT d FROM tied)),
{in_order("clear", "claims")},
done AS (
  SELECT w.d, CASE WHEN NOT w.off THEN w.t END AS t, c.real AS dist,
    CASE WHEN w.off THEN 'NEEDS_REVIEW' WHEN c.real <= c.gate THEN 'MATCH' ELSE 'LOCATION_MISMATCH' END AS status FROM claims w JOIN clear c ON c.d = w.d AND c.t = w.t
  UNION ALL SELECT d, NULL, NULL, 'NEEDS_REVIEW' FROM tied),
loose AS (
  SELECT d.n, d.d, t.seq AS t, {FAR} AS dist, false AS off FROM devs d JOIN goals t ON d.n = t.n
  WHERE blind AND {FAR} <= match_ft AND d.d NOT IN (SELECT d FROM done) AND t.seq NOT IN (SELECT t FROM done WHERE t IS NOT NULL)),
{in_order("loose", "found")},
final AS (
  SELECT c.*, coalesce(o.status, 'PDF_ONLY') AS status, t.id AS target_id, t.mark AS target_mark, t.level AS target_level,
    CASE WHEN t.id IS NOT NULL THEN round_even(o.dist, 2) END AS distance_ft, i.first, i.second, CAST(NULL AS VARCHAR) AS resolved_by
  FROM devs c LEFT JOIN (SELECT * FROM done UNION ALL SELECT f.d, f.t, l.dist, 'MARK_MISMATCH' FROM found f JOIN loose l ON l.d = f.d AND l.t = f.t) o ON o.d = c.d
  LEFT JOIN goals t ON t.seq = o.t LEFT JOIN tied i ON i.d = c.d)"""


@query(DEVICES + "SELECT id, category, mark, x, y, z, deg AS orientation_deg, list_aggregate(appearances, 'string_agg', ',') AS appearances, list_aggregate(sheets, 'string_agg', ',') AS sheets FROM devs")
def category_devices(spark: SparkSession, d: str) -> DataFrame:
    made = C.devices_of(callouts(spark, d), 3.0)
    return made.select("id", "category", "mark", "x", "y", "z", "orientation_deg", F.concat_ws(",", "appearances").alias("appearances"), F.concat_ws(",", "sheets").alias("sheets"))


def _matched(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = targets(spark, d)
    return C.matched(C.devices_of(callouts(spark, d), 3.0), t, sheets(spark)), t


@query(MATCHED + "SELECT id, status, target_id, distance_ft, first, second FROM final")
def category_matches(spark: SparkSession, d: str) -> DataFrame:
    return _matched(spark, d)[0].select("id", "status", "target_id", "distance_ft", "first", "second")


def _in_turn(name: str, candidates: str, split: bool) -> str:
    """SQL of ties settled in device order: ``candidates`` (n, d, candidate, agrees, usable, dist,
    claimed, outer_ft); a claim takes its target from the devices after it. Makes ``name`` (d, pick)."""
    refuse = "AND NOT (len(list_filter(c.cs, lambda q: q.agrees)) = 2)" if split else ""
    return f"""
{name}_c AS (SELECT n, d, any_value(outer_ft) AS outer_ft, list({{'id': candidate, 'agrees': agrees, 'usable': usable, 'dist': dist}} ORDER BY candidate) AS cs,
             row_number() OVER (PARTITION BY n ORDER BY d) AS i FROM {candidates} GROUP BY n, d),
{name}_r(n, i, taken, d, pick) AS (
  SELECT n, CAST(0 AS BIGINT), coalesce(list(DISTINCT candidate) FILTER (claimed), CAST([] AS VARCHAR[])), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR) FROM {candidates} GROUP BY n
  UNION ALL
  SELECT n, i, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick) END, d, pick FROM (
    SELECT c.n, c.i, r.taken, c.d,
      CASE WHEN len(c.cs) = 2 AND len(list_filter(c.cs, lambda q: q.usable)) = 2 {refuse}
        AND len(list_filter(c.cs, lambda q: q.agrees AND NOT list_contains(r.taken, q.id))) = 1
        AND list_filter(c.cs, lambda q: q.agrees AND NOT list_contains(r.taken, q.id))[1].dist <= c.outer_ft
      THEN list_filter(c.cs, lambda q: q.agrees AND NOT list_contains(r.taken, q.id))[1].id END AS pick
    FROM {name}_r r JOIN {name}_c c ON c.n = r.n AND c.i = r.i + 1)),
{name} AS (SELECT d, pick FROM {name}_r WHERE pick IS NOT NULL)"""


def _candidates(rows: str) -> str:
    return f"""SELECT d.n, d.d, t.id AS candidate, t.level AS level, t.orientation_deg AS cdeg, d.deg, d.outer_ft, {FAR} AS dist,
  t.id IN (SELECT target_id FROM {rows} WHERE target_id IS NOT NULL) AS claimed
  FROM {rows} d JOIN goals t ON t.n = d.n AND t.id IN (d.first, d.second) WHERE d.direction AND d.status = 'NEEDS_REVIEW' AND d.first IS NOT NULL"""


def _after(rows: str, picks: str, name: str) -> str:
    return f"""SELECT d.* REPLACE (CASE WHEN k.d IS NULL THEN d.status WHEN {FAR} <= d.gate THEN 'MATCH' ELSE 'LOCATION_MISMATCH' END AS status,
  coalesce(k.pick, d.target_id) AS target_id, CASE WHEN k.d IS NULL THEN d.target_mark ELSE t.mark END AS target_mark,
  CASE WHEN k.d IS NULL THEN d.distance_ft ELSE round_even({FAR}, 2) END AS distance_ft, CASE WHEN k.d IS NULL THEN d.resolved_by ELSE '{name}' END AS resolved_by)
  FROM {rows} d LEFT JOIN {picks} k ON k.d = d.d LEFT JOIN goals t ON t.id = k.pick"""


SETTLED = MATCHED + f""",
c1 AS (SELECT *, deg IS NOT NULL AND cdeg IS NOT NULL AS usable, coalesce(least((deg - cdeg + 360) % 180, 180 - (deg - cdeg + 360) % 180) <= 20, false) AS agrees FROM ({_candidates("final")})),
{_in_turn("k1", "c1", False)},
s1 AS ({_after("final", "k1", "orientation")}),
v AS (SELECT unnest(f.sheets) AS sheet, t.level, f.d, f.status FROM s1 f JOIN goals t ON t.id = f.target_id
      WHERE f.direction AND first IS NULL AND status IN ('MATCH', 'LOCATION_MISMATCH')),
w AS (SELECT sheet, level, count(*) FILTER (status = 'MATCH') AS sure, count(*) FILTER (status <> 'MATCH') AS weak, min(d) FILTER (status = 'MATCH') AS seen FROM v GROUP BY ALL),
top AS (SELECT *, sum(sure) OVER (PARTITION BY sheet) AS whole FROM w QUALIFY row_number() OVER (PARTITION BY sheet ORDER BY sure DESC, seen) = 1),
agreed AS (SELECT sheet, level AS value FROM top WHERE sure > 0 AND sure >= 0.6 * whole AND sure + weak >= 2),
spots AS (SELECT d, unnest(sheets) AS sheet, unnest(range(len(sheets))) AS pos FROM s1),
told AS (SELECT p.d, arg_min(a.value, p.pos) AS value FROM spots p JOIN agreed a USING (sheet) GROUP BY p.d),
c2 AS (SELECT x.*, value IS NOT NULL AS usable, coalesce(x.level = value, false) AS agrees FROM ({_candidates("s1")}) x LEFT JOIN told USING (d)),
{_in_turn("k2", "c2", True)},
s2 AS ({_after("s1", "k2", "level")}),
free AS (SELECT * FROM goals WHERE id NOT IN (SELECT target_id FROM s2 WHERE target_id IS NOT NULL)),
cover AS (SELECT t.id, arg_min(d.id, ({FAR}, d.d)) AS covered_by FROM free t JOIN s2 d ON d.n = t.n AND d.mark = t.mark AND d.runs AND d.status = 'MATCH' WHERE {FAR} <= d.outer_ft GROUP BY t.id)"""


def _run(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = targets(spark, d)
    return C.run(callouts(spark, d), t, sheets(spark)), t


@query(
    SETTLED + f"""SELECT id, category, mark, status, {VERDICT_SQL} AS verdict, target_id, target_mark, distance_ft, first, second, resolved_by,
  status = 'PDF_ONLY' AND mark NOT IN (SELECT mark FROM goals WHERE mark IS NOT NULL) AS vocabulary_gap FROM s2"""
)
def category_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Both categories through devices, ambiguity, storeys, least totals, ties by direction and
    storey, in one table."""
    from spanwright.functions.verdicts import product_verdict

    final, _ = _run(spark, d)
    return final.select("id", "category", "mark", "status", product_verdict(F.col("status")).alias("verdict"), "target_id", "target_mark", "distance_ft", "first", "second", "resolved_by", "vocabulary_gap")


@query(SETTLED + "SELECT category, f.id, mark, covered_by, CASE WHEN covered_by IS NOT NULL THEN NULL WHEN mark IS NULL THEN 'unclassified' ELSE 'unmatched' END AS cause FROM free f LEFT JOIN cover c ON c.id = f.id")
def category_leftovers(spark: SparkSession, d: str) -> DataFrame:
    return C.left_over(*_run(spark, d))


@query(SETTLED + f"SELECT unnest(appearances) AS row, category, id AS device_id, status, {VERDICT_SQL} AS verdict, distance_ft, target_id, len(list_distinct(sheets)) AS n_sheets FROM s2")
def category_row_overrides(spark: SparkSession, d: str) -> DataFrame:
    return C.row_overrides(_run(spark, d)[0]).withColumn("n_sheets", F.col("n_sheets").cast("long"))


# ---- findings of registrations in every state, a sheet for each place

REGISTRATION = {
    "sheet": "concat('S', n)", "status": "CASE n % 6 WHEN 0 THEN 'missing' WHEN 1 THEN 'failed' WHEN 2 THEN 'diagnostic_only' WHEN 3 THEN 'low_confidence' WHEN 4 THEN 'usable' END",
    "solve_rms": "CASE WHEN n % 7 > 0 THEN n % 50 END", "solve_max": "n % 90", "held_rms": "n % 40", "held_max": "n % 80", "held_failed": "CASE WHEN n % 5 > 0 THEN n % 2 = 0 END",
    "n_held": "CASE WHEN n % 4 > 0 THEN n % 3 END", "reason": "CASE WHEN n % 12 = 1 THEN 'points are in line' END", "has_transform": "n % 8 = 2",
}
REGISTERED = f"SELECT {', '.join(f'{e} AS {c}' for c, e in REGISTRATION.items())} FROM"


@query(
    RECURSIVE + f""", r AS ({REGISTERED} places)
SELECT sheet, CAST(1 AS INTEGER) AS place, code, CASE code WHEN 'REGISTRATION_UNVALIDATED' THEN 'warning' ELSE 'blocking' END AS severity,
  CASE code WHEN 'REGISTRATION_FAILED' THEN coalesce(reason, 'The registration has no solution.')
    WHEN 'REGISTRATION_VALIDATION_FAILED' THEN 'Held-out residuals of ' || held_rms || ' pt rms and ' || held_max || ' pt at most are beyond the limits.'
    WHEN 'REGISTRATION_LOW_CONFIDENCE' THEN 'Solved residuals of ' || coalesce(CAST(solve_rms AS VARCHAR), 'unknown') || ' pt rms and ' || solve_max || ' pt at most are beyond the limits.' END AS detail
FROM (SELECT *, CASE coalesce(status, 'missing') WHEN 'missing' THEN 'REGISTRATION_MISSING' WHEN 'failed' THEN 'REGISTRATION_FAILED' WHEN 'diagnostic_only' THEN 'AUTO_EXTENT_CALIBRATION_DIAGNOSTIC_ONLY'
  WHEN 'low_confidence' THEN CASE WHEN held_failed THEN 'REGISTRATION_VALIDATION_FAILED' ELSE 'REGISTRATION_LOW_CONFIDENCE' END ELSE CASE WHEN coalesce(n_held, 0) = 0 THEN 'REGISTRATION_UNVALIDATED' END END AS code FROM r)
WHERE code IS NOT NULL"""
)
def registration_findings(spark: SparkSession, d: str) -> DataFrame:
    from spanwright.operators import blockers as K

    rows = places(spark, d).selectExpr(*[f"{e} AS {c}" for c, e in REGISTRATION.items()])
    told = F.col("code").isin(K.FAILED, K.HELD_FAILED, K.LOW)
    return K.registration_findings(rows).select("sheet", "place", "code", "severity", F.when(told, F.col("message")).alias("detail"))


@query(RECURSIVE + f", r AS ({REGISTERED} places) SELECT sheet, CASE WHEN status = 'usable' THEN 'located' WHEN status = 'diagnostic_only' AND has_transform THEN 'diagnostic' ELSE 'type_and_count' END AS mode, coalesce(status = 'usable', false) AS match_allowed FROM r")
def comparison_modes(spark: SparkSession, d: str) -> DataFrame:
    from spanwright.operators import blockers as K

    return K.comparison_modes(places(spark, d).selectExpr(*[f"{e} AS {c}" for c, e in REGISTRATION.items()]))


@query(
    RECURSIVE + f""", calls AS ({_sql(CALLOUT, IN_CALLOUTS)}), goals AS ({_sql(TARGET, IN_TARGETS)}),
a AS (SELECT n // 5 AS sheet, mark, count(*) AS k FROM calls WHERE mark IS NOT NULL GROUP BY ALL), b AS (SELECT n // 5 AS sheet, mark, count(*) AS k FROM goals WHERE mark IS NOT NULL GROUP BY ALL)
SELECT coalesce(a.sheet, b.sheet) AS sheet, coalesce(a.mark, b.mark) AS mark, 'COUNT_MISMATCH' AS code, 'warning' AS severity,
  coalesce(a.mark, b.mark) || ': ' || coalesce(b.k, 0) || ' in the model, ' || coalesce(a.k, 0) || ' drawn' AS message
FROM a FULL JOIN b ON a.sheet = b.sheet AND a.mark = b.mark WHERE coalesce(a.k, 0) <> coalesce(b.k, 0)"""
)
def count_findings(spark: SparkSession, d: str) -> DataFrame:
    from spanwright.operators import blockers as K

    by = lambda df: df.select(F.expr("n div 5").alias("sheet"), "mark")
    return K.count_findings(by(_spark(places(spark, d), CALLOUT, IN_CALLOUTS)), by(targets(spark, d)))
