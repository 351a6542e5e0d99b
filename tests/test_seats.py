"""Open seats go to one task where they are few; hardware deals its keys and tries patterns once a row."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from spanwright.operators import assemblies as A
from spanwright.operators import tiles
from spanwright.plans.assembly_queries import records

SMALL = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def refuse(*_, **__):
    pytest.fail("few open rows went by joins")


def test_few_open_seats_need_no_joins(spark, monkeypatch):
    hardware = A.hardware_records(records(spark, SMALL)).select("seq", "family", "x", "y")
    columns = ["seq", "founder", "seat", "split"]
    with monkeypatch.context() as m:
        m.setattr(tiles, "TILE_ROWS", 40)  # too many for one task
        want = rows(A._seated_by_joins(hardware.withColumn("body", A.is_body(F.col("family"))), 2.0).select(*columns))
        assert rows(A.seated(hardware, 2.0).select(*columns)) == want
    monkeypatch.setattr(A, "leader_clusters", refuse)
    assert rows(A.seated(hardware, 2.0).select(*columns)) == want


def test_hardware_deals_keys_and_tries_patterns_once(spark):
    assert records(spark, SMALL).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = A.hardware_records(records(spark, SMALL)).where("key <> ''")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert sum("104729" in line for line in plan) == 1
    assert not any("HTT|HD[UB]" in line for line in plan if "Filter" in line)
