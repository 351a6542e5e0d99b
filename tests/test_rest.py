"""What stretches leave open goes to one task where it is little; views deal keys to all tasks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from test_tiles import plane, rows

from spanwright.operators import categories as C
from spanwright.operators import claims, cluster
from spanwright.plans import category_queries


def refuse(*_, **__):
    pytest.fail("few open rows went by joins")


def test_few_open_devices_and_claims_need_no_joins(spark, monkeypatch):
    callouts, targets = plane(spark)
    sheets = spark.createDataFrame([("S0", 3.0, 4.0), ("S1", 40.0, 4.0)], "sheet string, rms double, scale double")
    want = rows(cluster.rest_clusters(callouts.withColumn("mark", F.coalesce("mark", F.lit("-"))), 3.0).select("seq", "founder"))
    assert want == rows(cluster.leader_clusters(callouts.withColumn("mark", F.coalesce("mark", F.lit("-"))), 3.0).select("seq", "founder"))
    nulls = callouts.where("mark IS NULL").limit(50)
    assert rows(cluster.rest_clusters(nulls, 3.0).select("seq", "founder")) == rows(cluster.leader_clusters(nulls, 3.0).select("seq", "founder"))

    devices = C.devices_of(callouts, 3.0)
    ruled = C.gated(devices.join(C.rules_table(spark, C.RULES).select("category", "match_ft", "ceiling"), "category", "left"), sheets).drop("match_ft", "ceiling")
    columns = ["seq", "status", "target_id", "target_mark", "first", "second"]
    by_joins = rows(C._matched(ruled, C._segments(targets), C.RULES).select(*columns))
    monkeypatch.setattr(C, "_matched", refuse)
    monkeypatch.setattr(cluster, "leader_clusters", refuse)
    _, some, goals = claims.within_tiles(ruled, targets, C.RULES, C._segments)
    assert some.count() and goals.count()
    assert rows(C.matched(C.devices_of(callouts, 3.0), targets, sheets).select(*columns)) == by_joins


def test_category_views_deal_keys(spark):
    made = category_queries.targets(spark, "/root/testdata/sf0.001")
    assert made.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = made.where("abs(ax) < 10 AND abs(bx) < 10")._jdf.queryExecution().optimizedPlan().toString()
    assert sum("71993" in line for line in plan.splitlines()) == 1


def test_ends_of_targets_are_made_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(claims.tiles, "dealt", lambda rows, at: seen.append(rows) or rows.withColumn("_key", at))
    callouts, targets = plane(spark)
    sheets = spark.createDataFrame([("S0", 3.0, 4.0)], "sheet string, rms double, scale double")
    ruled = C.gated(callouts.withColumns({"match_ft": F.lit(2.0), "ceiling": F.lit(3.0), "sheets": F.array("sheet")}), sheets).drop("match_ft", "ceiling")
    claims.within_tiles(ruled, targets.withColumn("ax", F.expr("CASE WHEN seq < 777 THEN ax ELSE ax END + 0")), C.RULES, C._segments)
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert not any("777" in line for line in plan.splitlines() if "Filter" in line)
