"""Schedules on the page of each forty places: three kinds, titles on two staggered lines, as many
rows as the page's number says, jittered heights, wrapped lines, plan words beside, and an end by a
note, by a gap or by the next header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.operators import schedules as S

from .registrar import query
from .views import PRELUDE, places

#: Words of a page: (condition, x, y, text) over p, the page, and i, a row of up to five.
WORDS = (
    ("i = 0", "100", "50", "CASE p % 3 WHEN 0 THEN 'HOLDOWN' WHEN 1 THEN 'SHEAR' ELSE 'POST' END"),
    ("i = 0 AND p % 3 = 1", "140", "51", "'WALL'"), ("i = 0", "CASE WHEN p % 3 = 1 THEN 180 ELSE 140 END", "50", "'SCHEDULE'"),
    ("i = 0", "100", "70 + p % 3", "CASE WHEN p % 2 = 0 THEN 'MARK' ELSE 'S.NO.' END"), ("i = 0", "200", "78", "'TYPE'"), ("i = 0", "240", "71", "'of'"), ("i = 0", "300", "76", "'REMARKS'"),
    ("i <= 1 + p % 4", "101", "100 + 22 * i + (p * 7 + i * 3) % 4 * 0.5", "concat(CASE p % 3 WHEN 0 THEN 'h' WHEN 1 THEN 'SW-' ELSE 'P' END, i + 1)"),
    ("i <= 1 + p % 4", "205", "100 + 22 * i + (p * 5 + i) % 3 * 0.5", "concat('HDU', p % 9)"),
    ("i <= 1 + p % 4 AND (p + i) % 3 = 0", "206", "108 + 22 * i", "'tall'"), ("i <= 1 + p % 4 AND i % 2 = 1", "310", "100 + 22 * i", "'x'"),
    ("i <= 1 + p % 4", "700", "101 + 22 * i", "'plan'"),
    ("i = 0 AND p % 3 <> 2", "100", "122 + 22 * (1 + p % 4)", "'NOTES'"), ("i = 0 AND p % 3 = 2", "100", "190 + 22 * (1 + p % 4)", "'stray'"),
    ("i = 0 AND p % 5 = 0", "100", "400", "'COLUMN'"), ("i = 0 AND p % 5 = 0", "140", "400", "'SCHEDULE'"), ("i = 0 AND p % 5 = 0", "100", "420", "'SYMBOL'"),
    ("i <= 1 AND p % 5 = 0", "100", "450 + 20 * i", "concat('C', i + 1)"), ("i = 0 AND p % 10 = 0", "100", "500", "'DOOR SCHEDULE'"),
)


def words(spark: SparkSession, d: str) -> DataFrame:
    pages = places(spark, d).selectExpr("n div 40 AS p").distinct()
    rows = pages.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(4))))
    each = [F.when(F.expr(c), F.struct(F.lit(k).alias("k"), F.expr(x).cast("double").alias("x"), F.expr(y).cast("double").alias("y"), F.expr(t).alias("text"))) for k, (c, x, y, t) in enumerate(WORDS)]
    return rows.select("p", "i", F.explode(F.array_compact(F.array(*each))).alias("w")).selectExpr("p AS page", "20 * i + w.k AS seq", "w.x AS x0", "w.y AS y0", "w.x + 30 AS x1", "w.y + 8 AS y1", "w.text")


PAGES = PRELUDE + """, pages AS (SELECT DISTINCT n // 40 AS p FROM keys), rows AS (SELECT p, unnest(range(2 + p % 4)) AS i FROM pages),
cells AS (
  SELECT p, 0 AS t, i + 1 AS row_no, CASE p % 3 WHEN 0 THEN 'h' WHEN 1 THEN 'SW-' ELSE 'P' END || (i + 1) AS c0, 'HDU' || (p % 9) || CASE WHEN (p + i) % 3 = 0 THEN ' tall' ELSE '' END AS c1,
    'HDU' || (p % 9) AS b1, CASE WHEN (p + i) % 3 = 0 THEN 'tall' END AS wrapped, CASE WHEN i % 2 = 1 THEN 'x' END AS c2, CASE p % 3 WHEN 0 THEN 'holdown' WHEN 1 THEN 'shear_wall' ELSE 'post' END AS category FROM rows
  UNION ALL SELECT p, 1, i, 'C' || i, NULL, NULL, NULL, NULL, 'steel_column' FROM pages, (SELECT unnest([1, 2]) AS i) WHERE p % 5 = 0)"""


@query(
    PAGES + """SELECT p AS page, CAST(t AS INTEGER) AS table_no, category, CAST(row_no AS INTEGER) AS row_no, upper(c0) AS mark,
  concat_ws(' ', c0, b1, c2, wrapped) AS row_text FROM cells"""
)
def schedule_rows(spark: SparkSession, d: str) -> DataFrame:
    return S.schedule_rows(words(spark, d)).select("page", "table_no", "category", "row_no", "mark", "row_text")


@query(
    PAGES + """, flat AS (SELECT p, t, row_no, unnest([0, 1, 2]) AS col, unnest([c0, c1, c2]) AS text FROM cells)
SELECT p AS page, CAST(t AS INTEGER) AS table_no, CAST(row_no AS INTEGER) AS row_no, CAST(col AS INTEGER) AS "column",
  CASE WHEN t = 1 THEN 'SYMBOL' WHEN col = 0 THEN CASE WHEN p % 2 = 0 THEN 'MARK' ELSE 'S.NO.' END WHEN col = 1 THEN 'of TYPE' ELSE 'REMARKS' END AS name, text FROM flat WHERE text IS NOT NULL"""
)
def schedule_cells(spark: SparkSession, d: str) -> DataFrame:
    return S.read_schedules(words(spark, d))["cells"].select("page", "table_no", "row_no", "column", "name", "text")


@query(
    PAGES + """, all_tables AS (
  SELECT p, 0 AS t, CASE p % 3 WHEN 0 THEN 'holdown' WHEN 1 THEN 'shear_wall' ELSE 'post' END AS category, CASE p % 3 WHEN 0 THEN 'HOLDOWN SCHEDULE' WHEN 1 THEN 'SHEAR WALL SCHEDULE' ELSE 'POST SCHEDULE' END AS header_text, 50 AS y0, 3 AS n_columns FROM pages
  UNION ALL SELECT p, 1, 'steel_column', 'COLUMN SCHEDULE', 400, 1 FROM pages WHERE p % 5 = 0 UNION ALL SELECT p, 2, 'unknown', 'DOOR SCHEDULE', 500, 0 FROM pages WHERE p % 10 = 0)
SELECT p AS page, CAST(t AS INTEGER) AS table_no, category, header_text, CAST(y0 AS DOUBLE) AS y0, n_columns, (SELECT count(*) FROM cells c WHERE c.p = a.p AND c.t = a.t) AS n_rows FROM all_tables a"""
)
def schedule_tables(spark: SparkSession, d: str) -> DataFrame:
    return S.read_schedules(words(spark, d))["tables"].select("page", "table_no", "category", "header_text", "y0", "n_columns", "n_rows")


# ---- a schedule at known places: three bands and four columns on the page of each forty places

BANDS = [("H1", 100.0, 118.0), ("H2", 119.0, 137.0), ("H3", 138.0, 156.0)]
COLUMNS = {"holdown_type": (50.0, 110.0), "fasteners": (111.0, 180.0), "embedment": (200.0, 240.0)}
CELL = "CASE n % 4 WHEN 0 THEN concat('HDU', n % 9) WHEN 1 THEN '(4)' WHEN 2 THEN '3' ELSE '4\"' END"


@query(
    PRELUDE + f""", w AS (SELECT n // 40 AS page, n AS seq, n * 7919 % 251 AS x, 95.0 + n * 6277 % 67 AS y, {CELL} AS text FROM keys),
bands(row_no, mark, a, b) AS (VALUES {", ".join(f"({k}, '{m}', {a}, {b})" for k, (m, a, b) in enumerate(BANDS, 1))}),
i AS (SELECT w.*, row_no, mark, x + 10 AS xc FROM w JOIN bands ON y + 4 BETWEEN a AND b WHERE x + 10 BETWEEN 50 AND 245),
rows AS (SELECT page, row_no, mark, {", ".join(f"coalesce(string_agg(text, ' ' ORDER BY y, x, seq) FILTER (xc BETWEEN {a} AND {b}), '') AS {c}" for c, (a, b) in COLUMNS.items())} FROM i GROUP BY ALL)
SELECT page, row_no, mark, {", ".join(f"regexp_replace({c}, '\\b(\\d) (\\d{{1,2}}\\\")', '\\1/\\2', 'g') AS {c}" for c in COLUMNS)} FROM rows WHERE holdown_type <> ''"""
)
def banded_schedules(spark: SparkSession, d: str) -> DataFrame:
    rows = places(spark, d).selectExpr("n div 40 AS page", "n AS seq", "cast(n * 7919 % 251 AS double) AS x0", "95D + n * 6277 % 67 AS y0", f"{CELL} AS text")
    words = rows.selectExpr("page", "seq", "x0", "y0", "x0 + 20 AS x1", "y0 + 8 AS y1", "text")
    return S.banded_rows(words, BANDS, COLUMNS, "holdown_type", 50.0, 245.0)


@query(
    PRELUDE + """, w AS (SELECT n // 400 AS doc, n // 40 % 10 AS page, CASE WHEN n % 40 = 3 AND n // 40 % 3 > 0 THEN 's201' WHEN n * 7919 % 11 < n // 40 % 5 THEN 'H' || (n % 6) ELSE 'x' END AS text FROM keys),
p AS (SELECT doc, page, bool_or(text = 's201') AS named, count(*) FILTER (regexp_matches(text, '^H[1-4]$')) AS marks FROM w GROUP BY ALL)
SELECT doc, page, marks FROM p WHERE named AND marks > 0 QUALIFY row_number() OVER (PARTITION BY doc ORDER BY marks DESC, page) = 1"""
)
def located_pages(spark: SparkSession, d: str) -> DataFrame:
    words = places(spark, d).selectExpr("n div 400 AS doc", "n div 40 % 10 AS page", "CASE WHEN n % 40 = 3 AND n div 40 % 3 > 0 THEN 's201' WHEN n * 7919 % 11 < n div 40 % 5 THEN concat('H', n % 6) ELSE 'x' END AS text")
    return S.located_page(words, r"(?i)S-?201", r"\bH[1-4]\b")
