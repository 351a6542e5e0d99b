"""Tables that grow with the input stay in shuffles, however few bytes Spark thinks they have."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwright.operators import cluster, spatial


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_near_pairs_and_clusters_are_never_broadcast(spark):
    rows = spark.range(40).select(F.col("id").alias("seq"), F.lit("m").alias("mark"), F.lit("s").alias("sheet"), (F.col("id") * 3.0).alias("x"), F.lit(0.0).alias("y"))
    segments = rows.select("seq", "mark", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("x").alias("bx"), F.col("y").alias("by"))
    assert "Broadcast" not in plan(spatial.within(rows, rows, 3.0, "mark"))
    assert "Broadcast" not in plan(spatial.segments_within(rows, segments, 3.0, "mark"))
    assert "Broadcast" not in plan(cluster.single_link(rows, 3.0))
    assert "Broadcast" not in plan(cluster.leader_clusters(rows, 3.0))


def test_near_pairs_equal_all_pairs(spark):
    """Also at exactly the gate, on cell edges, below zero and far out."""
    at = [(i, x, y) for i, (x, y) in enumerate((a * 0.1 + off, b * 0.3 - off) for off in (-0.7, 0.0, 12345.3) for a in range(-6, 7, 2) for b in range(-3, 4))]
    rows = spark.createDataFrame(at, "seq long, x double, y double")
    for box in (False, True):
        far = (lambda dx, dy: max(abs(dx), abs(dy))) if box else (lambda dx, dy: (dx * dx + dy * dy) ** 0.5)
        got = [(r.seq, r.r_seq) for r in spatial.within(rows, rows, 0.6, box=box).collect()]
        must = {(i, j) for i, x, y in at for j, u, v in at if far(x - u, y - v) < 0.6 - 1e-9}
        may = {(i, j) for i, x, y in at for j, u, v in at if far(x - u, y - v) <= 0.6 + 1e-9}
        assert len(got) == len(set(got)) and must <= set(got) <= may
        assert {(i, i) for i, _, _ in at} <= set(got)


def test_schedules_are_never_broadcast(spark):
    from spanwright.operators import schedules as S

    words = spark.createDataFrame([(1, 0, 100.0, 50.0, 130.0, 58.0, "POST"), (1, 1, 140.0, 50.0, 170.0, 58.0, "SCHEDULE"), (1, 2, 100.0, 70.0, 130.0, 78.0, "MARK"), (1, 3, 100.0, 100.0, 130.0, 108.0, "P1")], "page long, seq long, x0 double, y0 double, x1 double, y1 double, text string")
    made = S.read_schedules(words)
    assert made["cells"].collect() and not [n for n, t in made.items() if "Broadcast" in plan(t)]
    rows = S.lined(words)
    found = S.headers(rows)
    cols = S.columns(S.bands(rows, found))
    assert "Broadcast" not in plan(cols) and "Broadcast" not in plan(S.body(rows, cols))


def test_pages_of_few_lines_take_no_curves(spark):
    """A circle goes out once where lines are few, and finds what it finds by its curve."""
    from spanwright.operators import crosshairs as H

    circles = spark.createDataFrame([(1, i, 100.0 + 37 * i, 80.0 + 11 * i, 12.0) for i in range(6)], "page long, seq long, x double, y double, r double")
    lines = spark.createDataFrame([(1, 20.0 * k, 5.0 * k, 20.0 * k + 90, 7.0 * k + (60 if k % 3 else 0)) for k in range(40)], "page long, ax double, ay double, bx double, by double")
    few = H.lines_through(circles, lines)
    rows = lambda df: sorted((r.page, r.seq, round(r.angle, 9)) for r in df.collect())
    many, H.FEW = H.FEW, 0
    try:
        by_curve = rows(H.lines_through(circles, lines))
    finally:
        H.FEW = many
    assert rows(few) == by_curve and by_curve
    assert "Broadcast" not in plan(few)
