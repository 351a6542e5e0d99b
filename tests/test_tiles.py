"""Stretches of the plane give what joins give, and leave few rows to them."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from spanwright.operators import categories as C
from spanwright.operators import claims, cluster, tiles


def plane(spark):
    rng = random.Random(7)
    spot = lambda: (rng.randrange(0, 1600) * 0.25, rng.randrange(0, 48000) * 0.25)
    calls, goals = [], []
    for n in range(2500):
        kind, (x, y) = ("holdown", "shear_wall", "other", None)[n % 40 // 18], spot()
        for j in range(rng.randrange(1, 4)):
            at = (x + rng.randrange(-16, 17) * 0.25, y + rng.randrange(-16, 17) * 0.25)
            at = (None, None) if n % 97 == 0 else at
            calls.append((10 * n + j, f"c{n}-{j}", kind, None if n % 83 == 0 else f"M{n % 2}", f"S{rng.randrange(3)}", *at, rng.choice([None, 0.0, 20.0]), rng.choice([None, 0.0, 90.0])))
            mid = (x + rng.randrange(-24, 25) * 0.25, y + rng.randrange(-24, 25) * 0.25)
            half = rng.choice([(1.0, 0.0), (0.0, 30.0), (2.0, 2.0)]) if kind == "shear_wall" else (0.0, 0.0)
            ends = (mid[0] - half[0], mid[1] - half[1], mid[0] + half[0], mid[1] + half[1])
            goals.append((10 * n + j, f"t{10 * n + j}", kind, rng.choice([None, "M0", "M1", "M1"]), *ends, rng.choice([None, 0.0, 20.0])))
    callouts = spark.createDataFrame(calls, "seq long, id string, category string, mark string, sheet string, x double, y double, z double, orientation_deg double")
    return callouts, spark.createDataFrame(goals, "seq long, id string, category string, mark string, ax double, ay double, bx double, by double, z double")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_devices_and_claims_of_stretches(spark, monkeypatch):
    monkeypatch.setattr(tiles, "TILE_ROWS", 700)
    callouts, targets = plane(spark)
    left = []

    def by_joins(rest):
        left.append(rest.count())
        keyed = rest.withColumn("_mark", F.col("mark")).withColumn("mark", F.concat_ws("/", F.coalesce("category", F.lit("-")), F.coalesce("mark", F.lit("-"))))
        return cluster.leader_clusters(keyed, 3.0).drop("mark").withColumnRenamed("_mark", "mark")

    made = cluster.device_rows(callouts, 3.0, ["category", "mark"], by_joins, nulls_meet=True)
    whole = by_joins(callouts).groupBy("category", "mark", "founder").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.array_sort(F.collect_list("id")).alias("ids"))
    assert rows(made.select("category", "mark", "founder", "x", "y", F.array_sort("appearances"))) == rows(whole)
    assert 0 < left[0] < left[1] // 3

    devices = made.withColumn("seq", F.col("founder"))
    sheets = spark.createDataFrame([("S0", 3.0, 4.0), ("S1", 40.0, 4.0)], "sheet string, rms double, scale double")
    ruled = C.gated(devices.join(C.rules_table(spark, C.RULES).select("category", "match_ft", "ceiling"), "category", "left"), sheets).drop("match_ft", "ceiling")
    columns = ["seq", "status", "target_id", "target_mark", "first", "second", F.round("dist", 9)]
    want = rows(C._matched(ruled, C._segments(targets), C.RULES).select(*columns))
    done, some, _ = claims.within_tiles(ruled, targets, C.RULES, C._segments)
    assert 0 < some.count() < len(want) // 3
    assert {w[1] for w in want} == set(claims.STATUSES)
    got = C.matched(devices, targets, sheets).select(*columns[:-1])
    assert rows(got) == sorted((w[:-1] for w in want), key=str)
    settled = {w[0]: w for w in want}
    assert all(tuple(r) == settled[r[0]] for r in done.select(*columns).collect())


def test_crowded_level_is_left_to_joins(spark, monkeypatch):
    monkeypatch.setattr(tiles, "TILE_ROWS", 20)
    crowd = spark.range(300).select(F.col("id").alias("seq"), F.concat(F.lit("c"), "id").alias("id"), F.lit("M").alias("mark"), (F.col("id") % 7).cast("string").alias("sheet"), F.lit(5.0).alias("x"), F.when(F.col("id") < 200, 5.0).otherwise(F.col("id") * 0.5).alias("y"))
    made = cluster.device_rows(crowd, 3.0, ["mark"], lambda left: cluster.leader_clusters(left, 3.0))
    whole = cluster.leader_clusters(crowd, 3.0).groupBy("founder").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    assert rows(made.select("founder", F.array_sort("appearances"))) == rows(whole)
