"""Scans of strokes and words, walls, benchmarks and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.config import Gates
from spanwright.functions import texts as T
from spanwright.operators import benchmarks as B
from spanwright.operators import crosshairs as H
from spanwright.operators import evidence as E
from spanwright.operators import scans as X
from spanwright.operators import summaries as U
from spanwright.operators import walls as W
from spanwright.operators.cluster import leader_clusters

from .matching_queries import ASSIGNED, CANDIDATES, RECURSIVE, _assigned, in_order
from .registrar import query
from .report_queries import VERDICT_SQL
from .views import PRELUDE, callouts, elements, places, targets

STROKES = """, strokes AS (SELECT n // 30 AS page, n AS seq, px AS ax, py AS ay, px + n % 23 * 11.0 AS ex, py + n % 7 * 6.0 AS ey,
  CASE WHEN n % 5 = 0 THEN 'c' ELSE 'l' END AS kind, CASE WHEN n % 3 > 0 THEN n % 4 * 0.125 END AS fill, CASE WHEN n % 4 > 0 THEN n % 6 * 0.125 END AS color,
  px AS x0, py AS y0, px + n % 24 AS x1, py + n % 9 AS y1 FROM places)"""


def _strokes(spark: SparkSession, d: str) -> DataFrame:
    return places(spark, d).selectExpr(
        "n div 30 AS page", "n AS seq", "px AS ax", "py AS ay", "px + n % 23 * 11.0D AS bx", "py + n % 7 * 6.0D AS by", "CASE WHEN n % 5 = 0 THEN 'c' ELSE 'l' END AS kind",
        "CASE WHEN n % 3 > 0 THEN array(0.0D, n % 4 * 0.125D) END AS fill", "CASE WHEN n % 4 > 0 THEN array(n % 6 * 0.125D, 0.0D) END AS color",
        "px AS x0", "py AS y0", "px + n % 24 AS x1", "py + n % 9 AS y1",
    )


LENGTH = "sqrt((ex - ax) ** 2 + (ey - ay) ** 2)"


@query(PRELUDE + STROKES + f"SELECT seq, round({LENGTH}, 6) AS length FROM strokes WHERE kind = 'l' AND {LENGTH} BETWEEN 8 AND 220")
def leader_sized_strokes(spark: SparkSession, d: str) -> DataFrame:
    return X.leader_segments(_strokes(spark, d)).select("seq", F.round("length", 6).alias("length"))


@query(PRELUDE + STROKES + "SELECT seq, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y FROM strokes WHERE fill IS NOT NULL AND x1 - x0 <= 7 AND y1 - y0 <= 7")
def filled_dots(spark: SparkSession, d: str) -> DataFrame:
    return X.dots(_strokes(spark, d)).select("seq", "x", "y")


@query(
    PRELUDE + STROKES + """, m AS (SELECT *, x1 - x0 AS w, y1 - y0 AS h FROM strokes)
SELECT seq, w AS width, h AS height FROM m WHERE fill < 0.25 AND w <= 22 AND h <= 22 AND (w >= 4 AND h >= 4 OR w >= 5 AND h >= 2 OR w >= 2 AND h >= 5)"""
)
def dark_marker_scan(spark: SparkSession, d: str) -> DataFrame:
    return X.dark_markers(_strokes(spark, d)).select("seq", "width", "height")


@query(
    PRELUDE + STROKES + f"""SELECT seq FROM strokes WHERE kind = 'l' AND coalesce(color, 0) <= 0.25 AND ex - ax >= 8 AND ey - ay >= 8 AND {LENGTH} BETWEEN 10 AND 220
AND (ey - ay) / (ex - ax) BETWEEN 0.25 AND 4"""
)
def diagonal_strokes(spark: SparkSession, d: str) -> DataFrame:
    return X.diagonals(_strokes(spark, d)).select("seq")


STAMPS = """, notes AS (SELECT n // 50 AS page, n, CASE n % 4 WHEN 0 THEN 'Stamp' WHEN 1 THEN 'Circle' WHEN 2 THEN 'FreeText' ELSE 'Square' END AS kind,
  CASE WHEN n % 25 = 0 THEN 'BM-1' WHEN n % 25 = 1 THEN 'bm 2' WHEN n % 175 = 3 THEN 'old BM_1' ELSE 'note ' || n END AS subject, px, py FROM places),
s AS (SELECT page, 'BM-' || regexp_extract(subject, '(?i)\\bBM[-_ ]?(\\d)\\b', 1) AS mark, avg(px + 2) AS x, avg(py + 3) AS y, count(*) AS n
  FROM notes WHERE kind <> 'FreeText' AND regexp_matches(subject, '(?i)\\bBM[-_ ]?(\\d)\\b') GROUP BY 1, 2)"""


def _stamps(spark: SparkSession, d: str) -> DataFrame:
    return X.annotated_benchmarks(places(spark, d).selectExpr(
        "n div 50 AS page", "CASE n % 4 WHEN 0 THEN 'Stamp' WHEN 1 THEN 'Circle' WHEN 2 THEN 'FreeText' ELSE 'Square' END AS kind",
        "CASE WHEN n % 25 = 0 THEN 'BM-1' WHEN n % 25 = 1 THEN 'bm 2' WHEN n % 175 = 3 THEN 'old BM_1' ELSE concat('note ', n) END AS subject",
        "'' AS title", "cast(NULL AS string) AS content", "px AS x0", "px + 4 AS x1", "py AS y0", "py + 6 AS y1",
    ))


@query(PRELUDE + STAMPS + "SELECT page, mark, x, y, n FROM s")
def benchmark_stamps(spark: SparkSession, d: str) -> DataFrame:
    return _stamps(spark, d).select("page", "mark", "x", "y", "n")


@query(PRELUDE + STAMPS + "SELECT mark, min(page) AS page, count(DISTINCT page) AS pages, CASE WHEN max(n) > 1 THEN 'duplicate' WHEN count(DISTINCT page) > 1 THEN 'several pages' END AS problem FROM s GROUP BY 1")
def benchmark_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return X.benchmark_pages(_stamps(spark, d))


#: Symbols of every tenth of a turn or so: directions with whole-number slopes, the second line a
#: right angle away, or nearly, or not; each line a little off the middle, some far from it.
SLOPES = ((12, 5), (5, 12), (1, 0), (3, -4), (-8, 15), (7, 24))
_slope = lambda k, of: "CASE {0} ".format(of) + " ".join(f"WHEN {i} THEN {s[k]}" for i, s in enumerate(SLOPES)) + " END"
_TURN = "CASE n % 7 WHEN 0 THEN 0.0 WHEN 1 THEN 0.125 WHEN 2 THEN -0.25 WHEN 3 THEN 0.0625 ELSE 0.0 END"
CIRCLES = {"page": "n // 40", "seq": "n", "x": "px + n % 5 * 0.5", "y": "py + n % 3 * 0.25", "r": "6.0 + n % 9"}
_off = "((n * 7919) % 23 - 11) * 0.25"
_far = "CASE WHEN n % 6 = 5 THEN 3.0 ELSE 0.5 END"
STROKES = [
    {"page": "n // 40", "ax": f"x - ({_far} - 1) * u", "ay": f"y + ({_off}) - ({_far} - 1) * v", "bx": f"x + {_far} * u", "by": f"y + ({_off}) + {_far} * v"},
    {"page": "n // 40", "ax": "x + 1.25 * (v + w * u)", "ay": "y - 1.25 * (u - w * v)", "bx": "x - 0.75 * (v + w * u)", "by": "y + 0.75 * (u - w * v)"},
]
_U, _V = f"({_slope(0, 'n % 6')}) * (2.0 + n % 4)", f"({_slope(1, 'n % 6')}) * (2.0 + n % 4)"
WORDS = {"page": "n // 40", "seq": "n", "x": "px + n % 13 * 3", "y": "py + 7", "text": "CASE n % 4 WHEN 0 THEN concat('BM-', n % 3 + 1) WHEN 1 THEN concat('see bm ', n % 2 + 1) ELSE 'grid' END"}


def _list(columns: dict[str, str], sql: bool) -> str:
    return ", ".join(f'{e} AS "{c}"' if sql else f"{e} AS `{c}`" for c, e in ((c, e if sql else e.replace("//", "div")) for c, e in columns.items()))


SYMBOLS = f"""spots AS (SELECT n, CAST({CIRCLES['x']} AS DOUBLE) AS x, CAST({CIRCLES['y']} AS DOUBLE) AS y, CAST({_U} AS DOUBLE) AS u, CAST({_V} AS DOUBLE) AS v, CAST({_TURN} AS DOUBLE) AS w FROM places)"""


@query(
    PRELUDE + f""", {SYMBOLS},
circles AS (SELECT {_list(CIRCLES, True)} FROM places),
strokes AS (SELECT {_list(STROKES[0], True)} FROM spots UNION ALL SELECT {_list(STROKES[1], True)} FROM spots WHERE n % 8 <> 3),
words AS (SELECT {_list(WORDS, True)} FROM places),
sized AS (SELECT *, "bx" - ax AS dx, "by" - ay AS dy, sqrt(("bx" - ax) ** 2 + ("by" - ay) ** 2) AS size FROM strokes),
hits AS (SELECT c.page, c.seq, (degrees(atan2(s.dy, s.dx)) + 360) % 180 AS angle FROM circles c JOIN sized s ON c.page = s.page
         WHERE s.size >= 2.6 * c.r AND abs(s.dy * (c.x - s.ax) - s.dx * (c.y - s.ay)) / s.size <= 0.25 * c.r),
crossed AS (SELECT DISTINCT a.page, a.seq FROM hits a JOIN hits b ON a.page = b.page AND a.seq = b.seq
            WHERE abs(least(abs(a.angle - b.angle), 180 - abs(a.angle - b.angle)) - 90) <= 10),
found AS (SELECT c.* FROM circles c JOIN crossed USING (page, seq)),
named AS (SELECT page, seq, x, y, regexp_extract(text, '{H.BENCHMARK}', 1) AS digit FROM words),
near AS (SELECT f.page, f.seq, arg_min(w.digit, (sqrt((f.x - w.x) ** 2 + (f.y - w.y) ** 2), w.seq)) AS digit FROM found f JOIN named w ON w.page = f.page AND w.digit <> ''
         WHERE sqrt((f.x - w.x) ** 2 + (f.y - w.y) ** 2) < 60 GROUP BY ALL)
SELECT f.page, f.seq, f.x, f.y, f.r, 'BM-' || digit AS mark, digit IS NOT NULL AND row_number() OVER (PARTITION BY f.page, digit ORDER BY f.seq) = 1 AS assigned
FROM found f LEFT JOIN near USING (page, seq)"""
)
def crosshair_symbols(spark: SparkSession, d: str) -> DataFrame:
    """A circle at each place with a line at a slope of its own and one across it."""
    p = places(spark, d)
    double = lambda df: df.select(*[F.col(c).cast("double") if t.startswith("decimal") else F.col(c) for c, t in df.dtypes])
    spots = double(p.selectExpr("n", f"{CIRCLES['x']} AS x", f"{CIRCLES['y']} AS y", f"{_U} AS u", f"{_V} AS v", f"{_TURN} AS w"))
    rows = lambda df, cols: double(df.selectExpr(*[f"{e.replace('//', 'div')} AS `{c}`" for c, e in cols.items()]))
    strokes = rows(spots, STROKES[0]).unionByName(rows(spots.where("n % 8 <> 3"), STROKES[1]))
    return H.crosshairs(rows(p, CIRCLES), strokes, rows(p, WORDS))


@query(PRELUDE + "SELECT n AS seq FROM places WHERE px < 400 * 0.88 AND py <= 3000")
def words_left_of_title_strip(spark: SparkSession, d: str) -> DataFrame:
    return X.plan_words(places(spark, d).selectExpr("n AS seq", "px AS x", "py AS y"), 400.0, 3000.0).select("seq")


@query(
    PRELUDE + """SELECT n // 30 AS page, n AS label, 2 * n AS seq, px + CASE WHEN n % 3 = 0 THEN 44.0 ELSE 40.0 END AS x, py + 1000.0 * (n // 30) AS y FROM places WHERE n % 6 < 4 AND n % 30 % 6 = 0
UNION ALL SELECT n // 30, n, 2 * n + 1, px - 48, py + 1000.0 * (n // 30) FROM places WHERE n % 30 % 12 = 0"""
)
def leader_target_points(spark: SparkSession, d: str) -> DataFrame:
    """Labels far from each other, each with a leader to the right and some with one to the left;
    markers stand at every third label's right end."""
    p = places(spark, d).withColumn("page", F.expr("n div 30")).withColumn("py", F.col("py") + 1000.0 * F.col("page")).where("n % 30 % 6 = 0")
    labels = p.selectExpr("page", "n AS label", "px AS x", "py AS y")
    right = p.selectExpr("page", "2 * n AS seq", "px + 5 AS ax", "py AS ay", "px + 40 AS bx", "py AS by")
    left = p.where("n % 30 % 12 = 0").selectExpr("page", "2 * n + 1 AS seq", "px - 48 AS ax", "py AS ay", "px - 5 AS bx", "py AS by")
    markers = p.where("n % 3 = 0").selectExpr("page", "n AS seq", "px + 44 AS x", "py AS y")
    return X.leader_targets(labels, right.unionByName(left), markers)


@query(PRELUDE + "SELECT n, 'HD' || (n % 12) AS mark, CAST(CASE n % 4 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 1 END AS INTEGER) AS count FROM places WHERE n % 4 <> 3 AND n % 12 IN (0, 1, 2, 10)")
def label_grammar(spark: SparkSession, d: str) -> DataFrame:
    words = places(spark, d).selectExpr("n", "CASE n % 4 WHEN 0 THEN concat(' HD', n % 12) WHEN 1 THEN concat('(2) HD', n % 12) WHEN 2 THEN concat('3HD', n % 12) ELSE concat('HD', n % 12, 'x') END AS text")
    return X.label_hits(words, ["HD0", "HD1", "HD2", "HD10"]).select("n", "mark", "count")


@query(
    PRELUDE + """, c AS (SELECT n // 4 AS t, n % 4 * 50.0 AS x0, n % 4 * 50.0 + 20 + n % 3 AS x1 FROM keys)
SELECT t, coalesce((lag(x1) OVER w + x0) / 2, x0 - 10) AS x0, coalesce((x1 + lead(x0) OVER w) / 2, x1 + 10) AS x1 FROM c WINDOW w AS (PARTITION BY t ORDER BY x0)"""
)
def column_bounds(spark: SparkSession, d: str) -> DataFrame:
    c = places(spark, d).selectExpr("n div 4 AS t", "n % 4 * 50.0D AS x0", "n % 4 * 50.0D + 20 + n % 3 AS x1")
    return X.widened_columns(c, "t")


@query(PRELUDE + "SELECT n, CASE WHEN n % 3 = 0 THEN 4.0 ELSE n % 5 * 10.0 END AS z, n % 3 > 0 AS z_inferred FROM keys")
def detection_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = places(spark, d).selectExpr("n", "CASE WHEN n % 3 = 0 THEN 4.0D END AS z", "n % 5 * 10.0D AS base")
    return X.detections_to_rows(rows, F.col("base")).select("n", "z", "z_inferred")


WALL_SQL = (
    RECURSIVE + """, w AS (SELECT n, 'SW' || (n % 3) AS mark, px * 20 AS x, py * 20 + 10 AS ay, py * 20 + 60 AS ey FROM places WHERE n % 4 > 0),
c AS (SELECT n, 'SW' || (n % 3) AS mark, px * 20 + n % 5 * 30.0 AS x, py * 20 + 30 AS y, 'P' || (n % 4) AS sheet FROM places),
a AS (SELECT n, mark, x, y, 0 AS rank FROM c WHERE sheet <> 'P3' UNION ALL SELECT n, mark, x - 20, y, 1 FROM c WHERE n % 2 = 0 AND sheet <> 'P3'),
j AS (SELECT a.n AS d, w.n AS t, sqrt((a.x - w.x) ** 2 + (a.y - greatest(ay, least(ey, a.y))) ** 2) AS dist, rank FROM a JOIN w USING (n, mark)),
e AS (SELECT d AS n, d, t, min(dist) AS dist, min_by(rank, (dist, rank)) AS rank, false AS off FROM j WHERE dist <= 120 GROUP BY ALL),
"""
    + in_order("e", "won")
    + """, r AS (SELECT c.n, c.sheet, won.t, e.dist, e.rank FROM c LEFT JOIN won ON c.n = won.d LEFT JOIN e ON e.d = won.d AND e.t = won.t)
SELECT n AS callout, t AS wall, round(dist, 6) AS dist, CASE rank WHEN 1 THEN 'leader_tip' WHEN 0 THEN 'bubble' END AS anchor,
  CASE WHEN sheet = 'P3' THEN 'NEEDS_REVIEW' WHEN t IS NULL THEN 'PDF_ONLY' WHEN sheet = 'P2' THEN 'NEEDS_REVIEW' WHEN dist <= 60 THEN 'MATCH' ELSE 'LOCATION_MISMATCH' END AS status FROM r
UNION ALL SELECT NULL, n, NULL, NULL, 'REVIT_ONLY' FROM w WHERE n NOT IN (SELECT t FROM won)"""
)


@query(WALL_SQL)
def shear_wall_matches(spark: SparkSession, d: str) -> DataFrame:
    """Sheets without a transform, and one whose transform may not decide."""
    p = places(spark, d).withColumn("sheet", F.expr("concat('P', n % 4)")).withColumn("mark", F.expr("concat('SW', n % 3)"))
    c = p.selectExpr("n AS seq", "sheet", "mark", "px * 20 + n % 5 * 30.0D AS x", "py * 20 + 30 AS y")
    walls = p.where("n % 4 > 0").selectExpr("n AS seq", "sheet", "mark", "px * 20 AS ax", "py * 20 + 10 AS ay", "px * 20 AS bx", "py * 20 + 60 AS by")
    tips = c.where("seq % 2 = 0").selectExpr("seq AS callout", "x - 20 AS x", "y")
    sheets = spark.sql("SELECT * FROM VALUES ('P0', true, true), ('P1', true, true), ('P2', true, false), ('P3', false, false) AS t(sheet, projected, usable)")
    return W.match_walls(c, tips, walls, sheets).select("callout", "wall", F.round("dist", 6).alias("dist"), "anchor", "status")


@query(
    RECURSIVE + """, e AS (SELECT n, n AS d, n AS t, greatest(n % 9 * 2.0 - 0.5, 0) AS dist, false AS off FROM keys WHERE n % 9 * 2.0 - 0.5 <= 12),
""" + in_order("e", "won") + "SELECT d, t, dist, CASE WHEN dist <= 4 THEN 'MATCH' ELSE 'LOCATION_MISMATCH' END AS status FROM won JOIN e USING (n, d, t)"
)
def wall_devices(spark: SparkSession, d: str) -> DataFrame:
    """The second category of devices, by the distance to walls a foot thick."""
    p = places(spark, d)
    devices = p.selectExpr("n AS seq", "mark", "px * 10 + n % 9 * 2 AS x", "py * 10 + 5 AS y")
    walls = p.selectExpr("n AS seq", "mark", "px * 10 AS ax", "py * 10 AS ay", "px * 10 AS bx", "py * 10 + 10 AS by", "px * 10 AS x", "py * 10 + 5 AS y", "1.0D AS thickness")
    return W.match_category(devices, walls, W.wall_adapter("shear_wall"), 20.0)


def _grid(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = places(spark, d)
    return p.where("n % 7 <> 0").selectExpr("concat('G', n) AS id", "100 + 4 * px AS x", "900 - 4 * py AS y"), p.where("n % 5 <> 0").selectExpr("concat('G', n) AS id", "px AS x", "py AS y")


GRID = ", g AS (SELECT 'G' || n AS id, px, py FROM places WHERE n % 7 <> 0 AND n % 5 <> 0)"


@query(
    PRELUDE + GRID + """, q AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY py ORDER BY px) = 1 OR row_number() OVER (PARTITION BY py ORDER BY px DESC) = 1),
b AS (SELECT max((a.px - b.px) ** 2 + (a.py - b.py) ** 2) AS far FROM q a JOIN q b ON a.id < b.id)
SELECT count(*) AS n, round(4 * sqrt(any_value(far)), 4) AS separation FROM (VALUES (1), (2)) v, b"""
)
def benchmark_proposal(spark: SparkSession, d: str) -> DataFrame:
    p = B.propose(*_grid(spark, d))
    return p.agg(F.count("*").alias("n"), F.round(F.hypot(F.max("x") - F.min("x"), F.max("y") - F.min("y")), 4).alias("separation"))


@query(
    PRELUDE + GRID + """SELECT 'BM-' || (1 + n % 3) AS mark, 'G' || n AS grid_id,
CASE WHEN n % 3 = 2 THEN 'unknown mark' WHEN n % 7 = 0 OR n % 5 = 0 THEN 'not on both sides' END AS problem FROM keys"""
)
def benchmark_picks(spark: SparkSession, d: str) -> DataFrame:
    picks = places(spark, d).selectExpr("concat('BM-', 1 + n % 3) AS mark", "concat('G', n) AS grid_id")
    return B.picked(*_grid(spark, d), picks).select("mark", "grid_id", "problem")


@query(PRELUDE + "SELECT 'B' || n AS mark, CASE WHEN n % 4 > 0 THEN round_even(sqrt((n % 4) ** 2 + 1), 3) END AS delta, n % 4 BETWEEN 1 AND 2 AS ok FROM keys")
def stamp_verification(spark: SparkSession, d: str) -> DataFrame:
    p = places(spark, d)
    return B.verified_stamps(p.selectExpr("concat('B', n) AS mark", "px AS x", "py AS y"), p.where("n % 4 > 0").selectExpr("concat('B', n) AS mark", "px + n % 4 AS x", "py + 1 AS y"))


@query(PRELUDE + "SELECT 'T' || (n % 3) AS sheet, true AS reflected, 0.25 AS scale, 'high' AS confidence, count(*) AS n FROM places GROUP BY 1")
def grid_auto_calibration(spark: SparkSession, d: str) -> DataFrame:
    p = places(spark, d)
    sheet = p.selectExpr("concat('T', n % 3) AS sheet", "concat('G', n) AS id", "100 + 4 * px AS x", "900 - 4 * py AS y")
    out = B.grid_calibration(sheet, p.selectExpr("concat('G', n) AS id", "px AS x", "py AS y"))
    return out.select("sheet", "reflected", F.round("scale", 6).alias("scale"), "confidence", "n")


@query(
    ASSIGNED + """, c AS (SELECT status, count(*) AS n, sum(CASE WHEN n % 3 = 0 THEN 2 ELSE 1 END) AS rows FROM final GROUP BY 1)
SELECT sum(rows)::BIGINT AS callout_rows, sum(n)::BIGINT AS devices, string_agg(status || '=' || n, ',' ORDER BY status) AS by_status,
  (SELECT count(*) FROM targets) AS targets, (SELECT count(*) FROM targets WHERE id NOT IN (SELECT target_id FROM final WHERE target_id IS NOT NULL)) AS revit_only FROM c"""
)
def device_summary(spark: SparkSession, d: str) -> DataFrame:
    found, t = _assigned(spark, d)
    s = U.device_summary(found.withColumn("category", F.lit("holdown")), t.withColumn("category", F.lit("holdown")))
    by = F.concat_ws(",", F.transform(F.map_entries("by_status"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))))
    return s.select("callout_rows", "devices", by.alias("by_status"), "targets", "revit_only")


PLACEHOLDERS = """, r AS (SELECT CASE WHEN n % 4 = 0 THEN 'revit_only_' || n ELSE 'e' || n END AS id, CASE n % 3 WHEN 0 THEN 'holdown' WHEN 1 THEN 'shear_wall' ELSE 'post' END AS category,
  CASE WHEN n % 2 = 0 THEN 'REVIT_ONLY' ELSE 'MATCH' END AS status FROM keys)"""


@query(PRELUDE + PLACEHOLDERS + "SELECT * FROM r WHERE NOT (category <> 'post' AND status = 'REVIT_ONLY' AND id LIKE 'revit_only_%') UNION ALL SELECT 'revit_only_d' || n, CASE WHEN n % 2 = 0 THEN 'holdown' ELSE 'shear_wall' END, 'REVIT_ONLY' FROM keys WHERE n % 50 = 0 OR n % 50 = 1")
def replaced_placeholders(spark: SparkSession, d: str) -> DataFrame:
    p = places(spark, d)
    rows = p.selectExpr("CASE WHEN n % 4 = 0 THEN concat('revit_only_', n) ELSE concat('e', n) END AS id", "CASE n % 3 WHEN 0 THEN 'holdown' WHEN 1 THEN 'shear_wall' ELSE 'post' END AS category", "CASE WHEN n % 2 = 0 THEN 'REVIT_ONLY' ELSE 'MATCH' END AS status")
    fresh = p.where("n % 50 < 2").selectExpr("concat('revit_only_d', n) AS id", "CASE WHEN n % 2 = 0 THEN 'holdown' ELSE 'shear_wall' END AS category", "'REVIT_ONLY' AS status")
    return U.replaced(rows, ("revit_only_", "revit_wall_"), fresh)


@query(PRELUDE + "SELECT v.value, count(e.id) AS n FROM (VALUES ('holdown'), ('shear_wall'), ('column')) v(value) LEFT JOIN elements e ON e.category = v.value GROUP BY 1")
def category_counts(spark: SparkSession, d: str) -> DataFrame:
    return U.counts_of(elements(spark, d), "category", ("holdown", "shear_wall", "column"))


@query(PRELUDE + "SELECT mark FROM callouts UNION SELECT mark FROM targets")
def union_of_marks(spark: SparkSession, d: str) -> DataFrame:
    return U.marks_of(callouts(spark, d), targets(spark, d))


@query(
    PRELUDE + """, r AS (SELECT CASE n % 5 WHEN 0 THEN 'body' WHEN 1 THEN 'evidence_member' ELSE 'other' END AS kind, 'f' || (n % 40) AS family, CASE WHEN n % 3 > 0 THEN 'HD' || (n % 4) END AS token FROM keys)
SELECT NULL AS token, count(*) AS records, count(*) FILTER (kind = 'body') AS bodies, count(*) FILTER (kind = 'evidence_member') AS members, count(DISTINCT family) AS families FROM r
UNION ALL SELECT token, NULL, count(*), NULL, NULL FROM r WHERE kind = 'body' AND token IS NOT NULL GROUP BY 1"""
)
def learned_key_points(spark: SparkSession, d: str) -> DataFrame:
    r = places(spark, d).selectExpr("CASE n % 5 WHEN 0 THEN 'body' WHEN 1 THEN 'evidence_member' ELSE 'other' END AS kind", "concat('f', n % 40) AS family", "CASE WHEN n % 3 > 0 THEN concat('HD', n % 4) END AS token")
    return U.key_points(r).select("token", "records", "bodies", "members", "families")


@query(
    PRELUDE + """, f AS (SELECT mark, count(*) AS found FROM targets GROUP BY 1), b(mark, expected) AS (VALUES ('H0', 100), ('H1', 7), ('H9', 3))
SELECT mark, coalesce(found, 0) AS found, expected, coalesce(found, 0) - coalesce(expected, 0) AS delta,
  CASE WHEN expected IS NULL THEN 'not expected' WHEN coalesce(found, 0) <> expected THEN 'count differs' END AS warning FROM f FULL JOIN b USING (mark)"""
)
def assembly_count_deltas(spark: SparkSession, d: str) -> DataFrame:
    expected = spark.sql("SELECT * FROM VALUES ('H0', 100L), ('H1', 7L), ('H9', 3L) AS t(mark, expected)")
    return U.count_deltas(targets(spark, d), expected)


@query(PRELUDE + "SELECT count(*) FILTER (n % 3 = 0) AS systematic, count(*) AS sampled FROM (SELECT n FROM keys WHERE n % 2 = 1 ORDER BY n LIMIT 30)")
def systematic_first_rows(spark: SparkSession, d: str) -> DataFrame:
    return U.systematic_sample(places(spark, d).where("n % 2 = 1").selectExpr("n AS seq", "n % 3 = 0 AS systematic"))


@query(
    PRELUDE + """SELECT n AS id, CASE WHEN n % 3 > 0 AND n % 5 < 3 THEN 'a' || n END AS assembly_id, CASE WHEN n % 3 > 0 AND n % 5 < 3 THEN CASE WHEN n % 2 = 0 THEN 'MATCH' ELSE 'NOT_EVALUATED' END END AS status FROM keys"""
)
def connection_statuses(spark: SparkSession, d: str) -> DataFrame:
    p = places(spark, d)
    live = p.select(F.col("n").alias("id"), F.array(F.col("px") - 1, F.col("py") - 1, F.lit(0.0), F.col("px") + 1, F.col("py") + 1, F.lit(2.0)).alias("box"))
    made = p.selectExpr("n AS seq", "concat('a', n) AS id", "px + n % 5 AS x", "py")
    found = p.where("n % 3 > 0").selectExpr("n AS seq", "concat('a', n) AS target_id", "CASE WHEN n % 2 = 0 THEN 'MATCH' END AS status")
    return U.with_connection_status(live, made.withColumnRenamed("py", "y"), found, 2.5).select("id", "assembly_id", "status")


@query(
    PRELUDE + """, x AS (SELECT n, CASE WHEN n % 4 < 2 THEN 'a' || n WHEN n % 4 = 2 AND n % 6 <> 0 THEN 'a' || n END AS a, CASE WHEN n % 5 > 1 THEN CASE WHEN n % 2 = 0 THEN 'MATCH' ELSE 'LOCATION_MISMATCH' END END AS s FROM keys)
SELECT n AS element, a AS assembly_id, CASE WHEN a IS NOT NULL THEN 'H' || (n % 4) END AS mark, CASE WHEN a IS NOT NULL THEN s END AS status,
  CASE WHEN a IS NULL THEN 'Element ' || n || ' is in no assembly of the model.' WHEN s IS NULL THEN 'Part of assembly ' || a || ' (H' || (n % 4) || '). No drawn device is paired with it.'
       WHEN s = 'MATCH' THEN 'Part of assembly ' || a || ' (H' || (n % 4) || '). Drawn ' || (n % 3) || '.50 ft away, within 2 ft: a match.'
       ELSE 'Part of assembly ' || a || ' (H' || (n % 4) || '). Its status is ' || s || '.' END AS text FROM x"""
)
def element_explanations(spark: SparkSession, d: str) -> DataFrame:
    """By place, by membership, or not at all."""
    p = places(spark, d)
    e = p.selectExpr("n AS element", "CASE WHEN n % 4 < 2 THEN px END AS x", "CASE WHEN n % 4 < 2 THEN py END AS y")
    a = p.selectExpr("n AS seq", "concat('a', n) AS id", "mark", "px + 0.5 AS x", "py AS y", "CASE WHEN n % 4 = 2 AND n % 6 <> 0 THEN array(n) ELSE array() END AS members")
    v = p.where("n % 5 > 1").selectExpr("n AS seq", "concat('a', n) AS target_id", "CASE WHEN n % 2 = 0 THEN 'MATCH' ELSE 'LOCATION_MISMATCH' END AS status", "n % 3 + 0.5D AS distance_ft")
    return U.explained(e, a, v, 2.0, Gates().match_ft)


@query(
    PRELUDE + """, s AS (SELECT n, CASE seq % 10 WHEN 0 THEN CASE WHEN n % 4 = 0 THEN 'MATCH' WHEN n % 4 = 1 THEN 'PDF_ONLY' ELSE 'LOCATION_MISMATCH' END ELSE 'PDF_ONLY' END AS status FROM (SELECT seq, seq // 10 AS n FROM callouts)),
f AS (SELECT n, bool_or(status = 'MATCH') AS hit, bool_or(status = 'LOCATION_MISMATCH') AS off, count(*) FILTER (status <> 'MATCH') AS again FROM s GROUP BY 1)
SELECT CASE WHEN hit THEN 'MATCH' WHEN off THEN 'LOCATION_MISMATCH' ELSE 'PDF_ONLY' END AS verdict, count(*) AS devices, sum(CASE WHEN hit THEN again ELSE 0 END)::BIGINT AS reappearances FROM f GROUP BY 1"""
)
def dedup_probe(spark: SparkSession, d: str) -> DataFrame:
    members = leader_clusters(callouts(spark, d), 3.0)
    status = F.expr("CASE seq % 10 WHEN 0 THEN CASE founder div 10 % 4 WHEN 0 THEN 'MATCH' WHEN 1 THEN 'PDF_ONLY' ELSE 'LOCATION_MISMATCH' END ELSE 'PDF_ONLY' END")
    return U.reappearances(members.withColumn("status", status))


@query(
    PRELUDE + """SELECT n, CASE n % 3 WHEN 0 THEN 'caf? - 1/2" ok ' || n WHEN 1 THEN 'plain ' || n ELSE '''x'' 45 deg ' || n END AS folded, n % 2 = 0 AS lettered,
  CASE WHEN n % 4 = 0 THEN 'before  after' ELSE 'text ' || n END AS clean, CASE WHEN n % 4 = 0 THEN 'look_up' END AS call, CASE WHEN n % 4 = 0 THEN CAST(n AS VARCHAR) END AS argument,
  CASE WHEN n % 5 > 0 THEN 1.5 END AS x, CASE WHEN n % 4 = 1 THEN 'note' END AS kind FROM keys"""
)
def text_repairs(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n")
    raw = F.when(n % 3 == 0, F.concat(F.lit('café – ½" ok '), n)).when(n % 3 == 1, F.concat(F.lit("plain "), n)).otherwise(F.concat(F.lit("‘x’ 45° "), n))
    call = F.concat(F.lit('before <invoke name="look_up"><parameter name="id"> '), n, F.lit(" </parameter></invoke> after"))
    told = F.when(n % 4 == 0, call).otherwise(F.concat(F.lit("text "), n))
    said = F.when(n % 4 == 1, F.lit('Sure: {"kind": "note"} and {"kind": "x"}')).when(n % 4 == 2, F.lit("no object")).otherwise(F.lit(None).cast("string"))
    first = T.leaked_calls(told)
    at = F.get(first, F.lit(0))
    pair = F.when(n % 5 > 0, F.array(F.lit(1.5), F.lit(2.5))).otherwise(F.array(F.lit(1.0)))
    return places(spark, d).select(
        "n", T.ascii_folded(raw).alias("folded"), T.is_letter_label(F.when(n % 2 == 0, F.concat(F.lit(" A"), n)).otherwise(n.cast("string"))).alias("lettered"), T.without_calls(told).alias("clean"),
        at["name"].alias("call"), at["arguments"]["id"].alias("argument"), T.point_of(pair)["x"].alias("x"), T.first_object(said, "kind string")["kind"].alias("kind"),
    )


@query(PRELUDE + f"SELECT id, CASE WHEN seq % 40 = 0 THEN 'NEEDS_REVIEW' ELSE {VERDICT_SQL} END AS verdict FROM elements")
def backfilled_products(spark: SparkSession, d: str) -> DataFrame:
    """A fourth of the rows were written with a product block; one of an older verdict stays."""
    made = U.with_products(elements(spark, d))
    old = F.when(F.col("seq") % 40 == 0, F.col("product").withField("verdict", F.lit("NEEDS_REVIEW")))
    return U.with_products(made.withColumn("product", old)).select("id", "product.verdict")


@query(PRELUDE + """, c AS (SELECT CASE n % 3 WHEN 0 THEN 'holdown' WHEN 1 THEN 'wall_type' ELSE 'post' END AS category, n, n % 4 AS plan_count, n % 5 > 0 AS listed FROM keys)
SELECT category, n, NOT listed OR plan_count = 0 AS flagged FROM c WHERE category <> 'wall_type'""")
def count_panel(spark: SparkSession, d: str) -> DataFrame:
    c = places(spark, d).selectExpr("CASE n % 3 WHEN 0 THEN 'holdown' WHEN 1 THEN 'wall_type' ELSE 'post' END AS category", "n", "n % 4 AS plan_count", "n % 5 > 0 AS schedule_listed")
    return U.panel_rows(c).select("category", "n", "flagged")


@query(PRELUDE + """SELECT n, CASE n % 6 WHEN 0 THEN 'unknown field' WHEN 2 THEN 'not a choice' WHEN 4 THEN 'too long' END AS problem,
CASE n % 6 WHEN 1 THEN 'active' WHEN 3 THEN 'Tower ' || n END AS clean FROM keys""")
def project_edits(spark: SparkSession, d: str) -> DataFrame:
    e = places(spark, d).selectExpr(
        "n", "CASE n % 6 WHEN 0 THEN 'colour' WHEN 1 THEN 'status' WHEN 2 THEN 'status' ELSE 'name' END AS field",
        "CASE n % 6 WHEN 1 THEN ' active ' WHEN 3 THEN concat(' Tower ', n) WHEN 4 THEN repeat('x', 90) WHEN 5 THEN '  ' ELSE 'red' END AS value",
    )
    return U.checked_fields(e, {"name": 80}, {"status": ("active", "archived")}).select("n", "problem", "clean")


@query(PRELUDE + "SELECT 'c' || (n % 3) AS category, n AS id, px + 1 AS x, py + 2 AS y FROM places WHERE n % 5 > 0")
def live_scene_rows(spark: SparkSession, d: str) -> DataFrame:
    box = F.array(F.col("px"), F.col("py"), F.lit(0.0), F.col("px") + 2, F.col("py") + 4, F.lit(1.0))
    items = F.array(F.struct(F.col("n").alias("id"), F.when(F.col("n") % 5 > 0, box).alias("bbox_ft")))
    live = places(spark, d).select(F.expr("concat('c', n % 3)").alias("category"), items.alias("items"))
    return U.live_scene(live).select("category", "id", F.col("middle")[0].alias("x"), F.col("middle")[1].alias("y"))


@query(
    ASSIGNED + f""", k AS (SELECT x.d, coalesce(least((f.deg - x.deg + 360) % 180, 180 - (f.deg - x.deg + 360) % 180) <= 20, true) AS fits, x.claimed
  FROM ({CANDIDATES.format("final")}) x JOIN final f USING (d) WHERE f.deg IS NOT NULL),
e AS (SELECT d, CASE WHEN count(*) FILTER (fits) = 0 THEN 'drawn_orientation_matches_no_candidate' WHEN count(*) FILTER (fits AND NOT claimed) = 0 THEN 'orientation_match_claimed_by_other_device' END AS evidence_conflict FROM k GROUP BY d)
SELECT founder, status, evidence_conflict, CASE status
  WHEN 'MATCH' THEN 'Mark ' || mark || ' is ' || printf('%.2f', distance_ft) || ' ft from ' || target_id || ', inside its gate.'
  WHEN 'LOCATION_MISMATCH' THEN 'Mark ' || mark || ' is ' || printf('%.2f', distance_ft) || ' ft from ' || target_id || ', outside its gate.'
  WHEN 'MARK_MISMATCH' THEN 'Drawn as ' || mark || ', modelled as ' || target_mark || ' (' || target_id || ').'
  WHEN 'PDF_ONLY' THEN 'No ' || mark || ' within 6 ft of (' || printf('%.1f', x) || ', ' || printf('%.1f', y) || ').'
  ELSE CASE WHEN first IS NOT NULL THEN 'Tied between ' || first || ' and ' || second || '.' ELSE 'Right place, another level.' END END AS reason FROM final LEFT JOIN e USING (d)"""
)
def device_reasons(spark: SparkSession, d: str) -> DataFrame:
    assigned, t = _assigned(spark, d)
    out = E.with_reasons(E.with_conflicts(assigned, t, Gates()), Gates())
    return out.select("founder", "status", "reason", "evidence_conflict")
