"""Deterministic drawing and model tables derived from all ``orders`` and ``events``, with the
same rules as SQL. All numbers are multiples of a quarter, so both engines get the same results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The same views for DuckDB, to put before a query.
PRELUDE = """
WITH keys AS (SELECT o_orderkey AS n FROM orders),
places AS (SELECT n, 'H' || (n % 4) AS mark, CAST(n % 30 * 20 AS DOUBLE) AS px, CAST(n // 30 * 20 AS DOUBLE) AS py FROM keys),
callouts AS (
  SELECT 10 * n AS seq, 'c' || (10 * n) AS id, 'S1' AS sheet, mark, px AS x, py AS y FROM places
  UNION ALL SELECT 10 * n + 1, 'c' || (10 * n + 1), 'S2', mark, px + 0.25, py - 0.25 FROM places WHERE n % 3 = 0),
targets AS (
  SELECT 10 * n + 5 AS seq, 't' || (10 * n + 5) AS id, CASE WHEN n % 11 = 0 THEN 'H' || ((n + 1) % 4) ELSE mark END AS mark,
    px + CASE WHEN n % 11 = 0 THEN 0.5 WHEN n % 5 = 0 THEN 3.75 ELSE 0.5 END AS x, py + 0.25 AS y,
    (n % 3) * 10.0 AS z, (n % 2) * 90.0 AS orientation_deg, 'L' || (n % 3) AS level FROM places WHERE n % 7 <> 0
  UNION ALL SELECT 10 * n + 6, 't' || (10 * n + 6), mark, px - 0.75, py, (n % 3) * 10.0, ((n + 1) % 2) * 90.0, 'L' || ((n + 1) % 3) FROM places WHERE n % 17 = 0
  UNION ALL SELECT 10 * n + 7, 't' || (10 * n + 7), mark, px + 10, py + 10, (n % 3) * 10.0, 0.0, 'L' || (n % 3) FROM places WHERE n % 13 = 0),
elements AS (
  SELECT 10 * n AS seq, 'e' || n AS id, CASE n % 3 WHEN 0 THEN 'holdown' WHEN 1 THEN 'shear_wall' ELSE 'post' END AS category,
    mark, CASE WHEN n % 13 = 0 THEN NULL ELSE 'S' || (n % 5) END AS sheet, px AS x, py AS y,
    CASE WHEN n % 19 = 0 THEN NULL WHEN n % 17 = 0 THEN 'NEEDS_REVIEW' WHEN n % 13 = 0 THEN 'SPEC_ONLY' WHEN n % 11 = 0 THEN 'MARK_MISMATCH'
      WHEN n % 7 = 0 THEN 'PDF_ONLY' WHEN n % 5 = 0 THEN 'LOCATION_MISMATCH' WHEN n % 23 = 0 THEN 'NO_REVIT_DATA' ELSE 'MATCH' END AS status,
    CASE WHEN n % 5 = 0 THEN NULL ELSE (n % 40) * 0.25 END AS distance_ft, 'note ' || n AS reason FROM places)
"""


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey AS n")
    return n.selectExpr("n", "concat('H', n % 4) AS mark", "cast(n % 30 * 20 AS double) AS px", "cast(n div 30 * 20 AS double) AS py")


def spread_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``places`` dealt to all tasks by key: keys pack to so few bytes that a file of them is one
    partition, and what views make of a key costs far more than its shuffle."""
    return places(spark, sf_dir).repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "n")


def once(*columns: Column) -> Column:
    """Named columns made once a row: later filters and columns can't take in their expressions, which
    would repeat them until the code is too long for the JVM to compile."""
    return F.inline(F.array(F.struct(*columns)))


def callouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = places(spark, sf_dir)
    first = p.selectExpr("10 * n AS seq", "concat('c', 10 * n) AS id", "'S1' AS sheet", "mark", "px AS x", "py AS y")
    return first.unionByName(p.where("n % 3 = 0").selectExpr("10 * n + 1 AS seq", "concat('c', 10 * n + 1) AS id", "'S2' AS sheet", "mark", "px + 0.25D AS x", "py - 0.25D AS y"))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = places(spark, sf_dir)
    level = "cast(n % 3 * 10 AS double) AS z"
    main = p.where("n % 7 <> 0").selectExpr(
        "10 * n + 5 AS seq", "concat('t', 10 * n + 5) AS id", "CASE WHEN n % 11 = 0 THEN concat('H', (n + 1) % 4) ELSE mark END AS mark",
        "px + CASE WHEN n % 11 = 0 THEN 0.5D WHEN n % 5 = 0 THEN 3.75D ELSE 0.5D END AS x", "py + 0.25D AS y", level, "cast(n % 2 * 90 AS double) AS orientation_deg", "concat('L', n % 3) AS level",
    )
    tied = p.where("n % 17 = 0").selectExpr("10 * n + 6 AS seq", "concat('t', 10 * n + 6) AS id", "mark", "px - 0.75D AS x", "py AS y", level, "cast((n + 1) % 2 * 90 AS double) AS orientation_deg", "concat('L', (n + 1) % 3) AS level")
    extra = p.where("n % 13 = 0").selectExpr("10 * n + 7 AS seq", "concat('t', 10 * n + 7) AS id", "mark", "px + 10 AS x", "py + 10 AS y", level, "0.0D AS orientation_deg", "concat('L', n % 3) AS level")
    return main.unionByName(tied).unionByName(extra)


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(spark, sf_dir).selectExpr(
        "10 * n AS seq", "concat('e', n) AS id", "CASE n % 3 WHEN 0 THEN 'holdown' WHEN 1 THEN 'shear_wall' ELSE 'post' END AS category", "mark",
        "CASE WHEN n % 13 = 0 THEN NULL ELSE concat('S', n % 5) END AS sheet", "px AS x", "py AS y",
        "CASE WHEN n % 19 = 0 THEN NULL WHEN n % 17 = 0 THEN 'NEEDS_REVIEW' WHEN n % 13 = 0 THEN 'SPEC_ONLY' WHEN n % 11 = 0 THEN 'MARK_MISMATCH' "
        "WHEN n % 7 = 0 THEN 'PDF_ONLY' WHEN n % 5 = 0 THEN 'LOCATION_MISMATCH' WHEN n % 23 = 0 THEN 'NO_REVIT_DATA' ELSE 'MATCH' END AS status",
        "CASE WHEN n % 5 = 0 THEN NULL ELSE n % 40 * 0.25D END AS distance_ft", "concat('note ', n) AS reason",
    )


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")
