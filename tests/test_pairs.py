"""Pairs, parts and pickers against plain versions."""

from __future__ import annotations

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from spanwright.operators import matching as M
from spanwright.operators import reports as R
from spanwright.operators import scans as X
from spanwright.operators import summaries as U
from spanwright.operators.parts import over_parts
from spanwright.operators.spatial import closest_pair, farthest_pair, outside_boxes


def points(seed, n, grid=False):
    rng = random.Random(seed)
    at = (lambda: float(rng.randint(0, 6))) if grid else (lambda: rng.uniform(-50, 50))
    return [(i, f"p{i}", f"k{i % 3}", at(), at()) for i in range(n)]


@pytest.mark.parametrize(("seed", "grid"), [(1, False), (2, True), (3, True)])
def test_farthest_and_closest_pairs(spark, seed, grid):
    rows = points(seed, 60, grid)
    df = spark.createDataFrame(rows, "seq long, id string, k string, x double, y double").repartition(5)
    far = max(((math.hypot(a[3] - b[3], a[4] - b[4]), -a[0], -b[0], a[1], b[1]) for a in rows for b in rows if a[0] < b[0]))
    got = farthest_pair(df).first()
    assert got.dist == pytest.approx(far[0])
    if not grid:
        assert (got.a, got.b) == far[3:]
    for r in closest_pair(df, "k").collect():
        own = [p for p in rows if p[2] == r.k]
        best = min((math.hypot(a[3] - b[3], a[4] - b[4]), a[0], b[0]) for a in own for b in own if a[0] < b[0])
        assert (r.a, r.b) == best[1:] and r.dist == pytest.approx(best[0])


def test_pairs_of_too_few_points(spark):
    one = spark.createDataFrame(points(1, 1), "seq long, id string, k string, x double, y double")
    assert farthest_pair(one).count() == 0 and closest_pair(one, "k").count() == 0


def test_a_chain_of_falling_distances_takes_few_rounds(spark):
    """One round would take one edge of such a chain."""
    edges = [(i, i, 1000.0 - 2 * i) for i in range(200)] + [(i, i + 1, 999.0 - 2 * i) for i in range(200)]
    df = spark.createDataFrame(edges, "d long, t long, dist double")
    used_d, used_t, want = set(), set(), set()
    for d, t, _ in sorted(edges, key=lambda e: (e[2], e[0], e[1])):
        if d not in used_d and t not in used_t:
            want.add((d, t))
            used_d.add(d)
            used_t.add(t)
    assert {(r.d, r.t) for r in M.greedy_pairs(df).collect()} == want


def test_parts_are_whole(spark):
    """Groups that reach over Arrow batches, and many small ones, each come in one piece."""
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        sizes = {g: n for g, n in enumerate([1, 2, 30, 1, 1, 7, 7, 14, 1, 3])}
        df = spark.createDataFrame([(g, i) for g, n in sizes.items() for i in range(n)], "g long, i long")

        def count(pdf: pd.DataFrame) -> pd.DataFrame:
            assert pdf.groupby("g")["i"].apply(lambda s: s.tolist() == sorted(s)).all()
            return pdf.groupby("g", as_index=False)["i"].count().rename(columns={"i": "n"})

        got = over_parts(df, "g", ["i"], ["i"], count, "g long, n long").collect()
        assert sorted((r.g, r.n) for r in got) == sorted(sizes.items())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_boxes_larger_and_smaller_than_cells(spark):
    rng = random.Random(4)
    pts = [(i, "a" if i % 2 else "b", rng.uniform(0, 300), rng.uniform(0, 300)) for i in range(200)]
    boxes = [("a", 10.0, 10.0, 200.0, 160.0), ("b", 40.0, 40.0, 41.0, 41.0), ("b", 0.0, 250.0, 299.0, 260.0)]
    out = outside_boxes(spark.createDataFrame(pts, "id long, k string, x double, y double"), spark.createDataFrame(boxes, "k string, x0 double, y0 double, x1 double, y1 double"), 2.0, "k")
    want = {i for i, k, x, y in pts if not any(k == b and x0 - 2 <= x <= x1 + 2 and y0 - 2 <= y <= y1 + 2 for b, x0, y0, x1, y1 in boxes)}
    assert {r.id for r in out.collect()} == want


def test_shifts_of_all_vectors(spark):
    rng = random.Random(5)
    rows = [(i, "m", "LOCATION_MISMATCH", rng.gauss(0, 3), rng.gauss(0, 3), 0.0, 0.0) for i in range(80)] + [(99, "m", "LOCATION_MISMATCH", 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "seq long, mark string, status string, x double, y double, target_x double, target_y double")

    def alike(a, b):
        na, nb = math.hypot(*a), math.hypot(*b)
        return na > 0 and nb > 0 and (a[0] * b[0] + a[1] * b[1]) / (na * nb) >= 0.8 and 0.5 <= nb / na <= 2

    for r in R.systematic_shift(df, "mark").collect():
        me = next(x for x in rows if x[0] == r.seq)
        assert (r.peers, r.aligned) == (80, sum(alike(me[3:5], x[3:5]) for x in rows if x[0] != r.seq))


def test_listings_and_segments(spark):
    files = spark.createDataFrame([("file:/w/out/a.json", 5), ("file:/w/out/b.json", 7), ("file:/w/in/c.pdf", 9), ("file:/x/a.json", 1)], "path string, length long")
    assert {tuple(r) for r in U.folder_sizes(files, "file:/w").collect()} == {("out", 2, 12), ("in", 1, 9)}
    known = spark.createDataFrame([("a.json",), ("z.json",)], "name string")
    assert {tuple(r) for r in U.artifact_states(known, files).collect()} == {("a.json", True, 5), ("z.json", False, None)}
    p = spark.createDataFrame([("p", 0.0, 3.0), ("q", 90.0, 90.0)], "id string, x double, y double")
    s = spark.createDataFrame([(1, -5.0, 0.0, 5.0, 0.0), (2, 0.0, 8.0, 9.0, 8.0)], "seq long, ax double, ay double, bx double, by double")
    assert [tuple(r) for r in X.nearest_segment(p, s, 10.0).select("id", "segment", F.round("dist", 6)).collect()] == [("p", 1, 3.0)]


def test_farthest_pairs_of_each_sheet(spark):
    from spanwright.operators.spatial import farthest_pairs

    rng = random.Random(21)
    rows = [(rng.choice(["a", "b", None]), k, f"p{k}", float(rng.randint(0, 40)), float(rng.randint(0, 40))) for k in range(300)]
    got = {r["sheet"]: (r["a"], r["b"], r["dist"]) for r in farthest_pairs(spark.createDataFrame(rows, "sheet string, seq long, id string, x double, y double").repartition(5), "sheet").collect()}
    for sheet in ("a", "b", None):
        mine = [r for r in rows if r[0] == sheet]
        far = max(math.hypot(p[3] - q[3], p[4] - q[4]) for p in mine for q in mine)
        a, b = min((p[1], q[1]) for p in mine for q in mine if p[1] < q[1] and math.isclose(math.hypot(p[3] - q[3], p[4] - q[4]), far))
        assert got[sheet] == (f"p{a}", f"p{b}", pytest.approx(far))


def test_systematic_shifts_of_many_vectors(spark):
    rng = random.Random(31)

    def vector():
        if rng.random() < 0.3:
            return 3 + rng.gauss(0, 0.01), -2 + rng.gauss(0, 0.01)  # a shift that many share
        far, turn = 10 ** rng.uniform(-3, 3), rng.choice([rng.uniform(0, 7), math.acos(0.8) - 1e-9, math.acos(0.8) + 1e-9, 0.0])
        return far * math.cos(turn), far * math.sin(turn)

    rows = [(k, rng.choice("ab"), "LOCATION_MISMATCH", *vector(), 0.0, 0.0) for k in range(500)]
    rows += [(500, "a", "LOCATION_MISMATCH", 0.0, 0.0, 0.0, 0.0), (501, "a", "MATCH", 1.0, 1.0, 0.0, 0.0), (502, "c", "LOCATION_MISMATCH", 1.0, 1.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "seq long, mark string, status string, x double, y double, target_x double, target_y double")

    def alike(p, q):
        a, b = math.hypot(*p), math.hypot(*q)
        return a > 0 and b > 0 and (p[0] * q[0] + p[1] * q[1]) / (a * b) >= 0.8 and 0.5 <= b / a <= 2

    got = {r["seq"]: (r["peers"], r["aligned"]) for r in R.systematic_shift(df, "mark").collect()}
    held = [r for r in rows if r[2] == "LOCATION_MISMATCH"]
    for r in held:
        peers = [q for q in held if q[1] == r[1] and q[0] != r[0]]
        assert got[r[0]] == (len(peers), sum(alike(r[3:5], q[3:5]) for q in peers))
    assert R.systematic_shift(df.limit(0), "mark").count() == 0
