"""Groups as large as the input, and steps that one task ends: no task gets all rows."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from spanwright.operators import benchmarks, fit, spatial


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_corners_of_hulls_meet_in_one_task(spark):
    points = spark.range(400).select(F.col("id").alias("seq"), F.col("id").cast("string").alias("id"), (F.col("id") % 20).cast("double").alias("x"), F.expr("cast(id div 20 as double)").alias("y"))
    far = spatial.farthest_pair(points)
    assert "Coalesce 1" not in plan(far)
    assert tuple(far.first())[:2] == ("0", "399")


def test_few_groups_are_sent_to_their_rows(spark, monkeypatch):
    from spanwright.sources import scratch

    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    rows = spark.range(60).selectExpr("concat('S', id % 2) AS sheet", "cast(id AS double) AS x", "cast(id * id % 7 AS double) AS y").selectExpr("sheet", "x", "y", "2 * x + 1 AS u", "3 - 2 * y AS v")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = fit.similarity_fits(rows, "sheet")
        assert re.search(r"BroadcastHashJoin", plan(few))
        monkeypatch.setattr(scratch, "SENT_GROUPS", 1)
        many = scratch.by_group(rows, rows.groupBy("sheet").agg(F.count("*").alias("n")), "sheet")
        assert "Broadcast" not in plan(many) and many.count() == 60
        assert few.where("reflected").agg(F.max("worst")).first()[0] == pytest.approx(0, abs=1e-9)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)


def test_sheets_with_few_points_are_left_out_without_a_shuffle_by_sheet(spark):
    model = spark.range(50).selectExpr("concat('G', id) AS id", "cast(id % 7 AS double) AS x", "cast(id div 7 AS double) AS y")
    sheet = model.selectExpr("CASE WHEN id IN ('G1', 'G2') THEN 'few' ELSE 'T' END AS sheet", "id", "4 * x AS x", "-4 * y AS y")
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = benchmarks.grid_calibration(sheet, model)
        # only one-row-a-sheet tables are joined so, once for each variant of the fit
        assert plan(out).count("SortMergeJoin [sheet") == 2
        assert [(r.sheet, r.n, r.reflected) for r in out.collect()] == [("T", 48, True)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)


def test_marks_are_summed_up_without_a_join(spark):
    from spanwright.plans.catalogue import QUERIES

    found = QUERIES["mark_intersection"](spark, "/root/testdata/sf0.001")
    assert "Join" not in plan(found)
    assert sorted(r.mark for r in found.collect()) == ["H0", "H1", "H2", "H3"]
