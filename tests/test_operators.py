from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spanwright.functions import geometry as G
from spanwright.functions import marks as K
from spanwright.functions import verdicts as V
from spanwright.operators import extract as X
from spanwright.operators import consensus, fit
from spanwright.operators.graph import connected_components
from spanwright.plans import tools
from spanwright.plans.reconcile import Run
from spanwright.sources import exports as E
from spanwright.streaming import progress as S


def test_components_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)]
    got = {r.v: r.root for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rounds_and_the_last_task_find_the_same_components(spark):
    rng = np.random.default_rng(8)
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 300, (250, 2))] + [(i, i + 1) for i in range(300, 400)] + [(None, 3), (4, 4)], "a long, b long")
    plain = sorted(connected_components(edges).collect())
    assert plain == sorted(connected_components(edges, last=0).collect()) == sorted(connected_components(edges, last=60).collect())


def test_calibration_finds_the_mirrored_fit(spark):
    pairs = spark.createDataFrame([("S", float(x), float(y), 100 + 4.0 * x, 900 - 4.0 * y) for x, y in ((0, 0), (30, 0), (0, 20), (25, 18))], "sheet string, x double, y double, u double, v double")
    r = fit.calibrate(pairs, "sheet").first()
    assert (r.reflected, r.confidence, r.match_allowed) == (True, "high", True)
    assert r.scale == pytest.approx(4) and r.rms == pytest.approx(0, abs=1e-6)
    few = fit.calibrate(pairs.limit(2), "sheet").first()
    assert few.confidence == "failed" and not few.match_allowed


def test_ransac_ignores_strays(spark):
    good = [("A", float(x), float(y)) for x, y in ((0, 0), (30, 0), (0, 20), (25, 18))]
    moved = [(m, 100 + 4 * x, 900 - 4 * y) for m, x, y in good] + [("A", 400.0, 20.0)]
    frame = lambda rows, sheet: spark.createDataFrame([(sheet, *r) for r in rows], "sheet string, mark string, x double, y double")
    left = frame(good + [("A", 77.0, 3.0)], "S1").unionByName(frame(good, "S2")).unionByName(frame(good[:2], "S3"))
    right = frame(moved, "S1").unionByName(frame([(m, 2 * x, 2 * y) for m, x, y in good], "S2")).unionByName(frame(moved[:2], "S3"))
    got = {r.sheet: r for r in consensus.ransac(left, right, "sheet", "mark", 2.0, tries=600).collect()}
    assert set(got) == {"S1", "S2"}
    assert (got["S1"].inliers, got["S1"].reflected) == (4, True) and got["S1"].scale == pytest.approx(4)
    assert got["S2"].inliers == 4 and got["S2"].scale == pytest.approx(2)


def test_geometry_columns(spark):
    row = spark.range(1).select(
        G.segment_distance(F.lit(5.0), F.lit(3.0), F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(0.0)).alias("middle"),
        G.segment_distance(F.lit(-3.0), F.lit(4.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("point"),
        G.angle_delta(F.lit(175.0), F.lit(5.0)).alias("angle"),
        G.compass(G.bearing(F.lit(-1.0), F.lit(0.0))).alias("west"),
        G.invert_affine(F.array(*[F.lit(0.0)] * 6)).alias("singular"),
    ).first()
    assert row.asDict() == {"middle": 3.0, "point": 5.0, "angle": 10.0, "west": "W", "singular": None}


@pytest.mark.parametrize(("status", "verdict"), [("MATCH", "LOCATION_MATCH"), ("PDF_ONLY", "LOCATION_MISMATCH"), ("SPEC_ONLY", "NOT_APPLICABLE"), ("what", "NEEDS_REVIEW"), (None, "NEEDS_REVIEW")])
def test_unknown_statuses_need_review(spark, status, verdict):
    df = spark.createDataFrame([(status,)], "status string")
    assert df.select(V.product_verdict(F.col("status")).alias("v")).first().v == verdict


def test_marks(spark):
    got = spark.createDataFrame([("P-01", "S/HDU15S w/"), ("C2-01-02", "bracket"), ("", "HTT 4")], "mark string, name string").select(K.point_mark(F.col("mark")).alias("m"), K.variant_key(F.col("name")).alias("k")).collect()
    assert [(r.m, r.k) for r in got] == [("P-1", "HD15S"), ("C-2", None), ("", "HTT4")]


def test_counts_and_detail_references(spark):
    words = [(0, 1, 100.0, 50.0, "(2)"), (0, 2, 120.0, 50.0, "H1"), (0, 3, 300.0, 50.0, "H2"), (0, 4, 320.0, 50.0, "5/S-501"), (0, 5, 500.0, 50.0, "(3)P-4")]
    got = X.plan_marks(spark.createDataFrame(words, "page int, seq int, x double, y double, text string")).collect()
    assert sorted((r.mark, r.total) for r in got) == [("H1", 2), ("P-4", 3)]


def test_hatch_runs_follow_a_band(spark):
    ticks = [(0, i, i * 5.0, 0.0, i * 5.0 + 3, 3.0) for i in range(10)] + [(0, 99, 500.0, 500.0, 503.0, 503.0)]
    runs = X.hatch_runs(spark.createDataFrame(ticks, "page int, seq long, ax double, ay double, bx double, by double")).collect()
    assert len(runs) == 1 and runs[0].length == pytest.approx(45)


def test_exports_of_both_versions(spark, tmp_path):
    new = {"schema_version": "3.1", "source_model": "Tower_v2.rvt", "elements": [{"id": "1", "category": "Connections", "family": "S/HDU2", "mark": "H1", "location": {"point": [1.0, 2.0, 3.0]}}], "levels": [{"name": "A", "elevation_ft": 0.0}, {"name": "B", "elevation_ft": 10.0}], "walls": [{"id": "w", "base_line": [[0.0, 0.0, 0.0], [5.0, 0.0, 0.0]]}]}
    old = {"schema_version": "2", "holdowns": [{"element_id": "9", "family": "HDU5 anchor", "location": [4.0, 5.0], "elevation": 1.0}]}
    for name, doc in (("a", new), ("b", old)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "export.json").write_text(json.dumps(doc))
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "export.json").write_text('{"schema_version": ')
    raw = E.read_exports(spark, f"{tmp_path}/*/export.json")
    rows = {r.id: (r.x, r.y, r.z) for r in E.element_rows(raw).collect()}
    assert rows == {"1": (1.0, 2.0, 3.0), "9": (4.0, 5.0, 1.0)}
    assert [r.project for r in E.torn(raw).collect()] == ["c"]
    assert {r.id: r.part for r in E.holdown_rows(E.element_rows(raw)).collect()} == {"1": "body", "9": "evidence_member"}
    assert [(r.name, r.height_ft) for r in E.level_rows(raw).orderBy("elevation_ft").collect()] == [("A", 10.0), ("B", None)]
    assert E.wall_rows(raw).first().bx == 5.0
    seen = E.changed_files(spark, f"{tmp_path}/*", spark.createDataFrame([], "sha string"))
    assert seen.count() == 3
    assert E.changed_files(spark, f"{tmp_path}/*", seen.select("sha")).count() == 0


def test_live_rows(spark):
    lines = spark.createDataFrame([("id 12: (1.5, -2.0, 0)",), ("nothing",)], "value string")
    assert [tuple(r) for r in E.live_rows(lines).collect()] == [(12, 1.5, -2.0)]


def test_workflow_stream_keeps_state(spark, tmp_path):
    schema = "project string, seq long, to_state string"
    steps = [("p", 1, "proposing"), ("p", 2, "stamping"), ("q", 1, "done"), ("p", 3, "awaiting_pdf_approval")]
    batches = [steps[:3], steps[3:]]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/b{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = S.follow_workflow(stream, "project").writeStream.outputMode("update").format("memory").queryName("flow").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = {(r.project, r.state, r.refused) for r in spark.table("flow").collect()}
    assert ("p", "awaiting_pdf_approval", 1) in rows and ("q", "idle", 1) in rows
    folded = {(r.project, r.state, r.refused) for r in S.workflow_states(spark.createDataFrame(steps, schema), "project").collect()}
    assert folded <= rows


def test_file_watch_and_windows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"kind": "x"}')
    q = S.watch_files(spark, f"{tmp_path}/in", "kind string").writeStream.format("memory").queryName("files").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r.kind for r in spark.table("files").collect()] == ["x"]


def test_a_whole_run(spark):
    model = [(0, "t0", "H1", 0.0, 0.0), (1, "t1", "H1", 40.0, 0.0), (2, "t2", "H2", 0.0, 30.0), (3, "t3", "H2", 40.0, 30.0)]
    sheet = lambda x, y: (100 + 4 * x, 900 - 4 * y)
    pairs = spark.createDataFrame([("S1", x, y, *sheet(x, y)) for _, _, _, x, y in model], "sheet string, x double, y double, u double, v double")
    drawn = [(0, "m0", "S1", "H1", *sheet(0.5, 0.0)), (1, "m1", "S1", "H1", *sheet(44.0, 0.0)), (2, "m2", "S1", "H2", *sheet(0.0, 30.0)), (3, "m3", "S9", "H2", 1.0, 1.0)]
    tables = {
        "point_pairs": pairs,
        "marks": spark.createDataFrame([(*d[:4], "holdown", *d[4:]) for d in drawn], "seq long, id string, sheet string, mark string, category string, px double, py double"),
        "targets": spark.createDataFrame([(*m, "L1") for m in model], "seq long, id string, mark string, x double, y double, level string"),
    }
    run = Run(tables)
    out = run.go()
    got = {r.id: (r.status, r.target_id) for r in out["elements"].collect()}
    assert got == {"m0": ("MATCH", "t0"), "m1": ("LOCATION_MISMATCH", "t1"), "m2": ("MATCH", "t2"), "m3": ("NOT_EVALUATED", None), "t3": ("REVIT_ONLY", "t3")}
    assert [x["kind"] for x in run.log] == ["done"] * 5
    assert tools.explain_element(out, "h1").count() == 2
    run.invalidate("devices")
    assert set(run.tables) == {"point_pairs", "marks", "targets", "calibrations", "projected"}
    assert math.isclose(out["calibrations"].first().scale, 4.0)


def test_a_whole_run_of_two_categories(spark):
    sheet = lambda x, y: (100 + 4 * x, 900 - 4 * y)
    pairs = spark.createDataFrame([("S1", x, y, *sheet(x, y)) for x, y in ((0.0, 0.0), (40.0, 0.0), (0.0, 30.0), (40.0, 30.0))], "sheet string, x double, y double, u double, v double")
    drawn = [(0, "m0", "holdown", "H1", *sheet(0.5, 0.0)), (1, "m1", "shear_wall", "SW-1", *sheet(20.0, 13.0)), (2, "m2", "shear_wall", "H1", *sheet(0.0, 0.0)), (3, "m3", None, "H1", *sheet(0.0, 0.0))]
    targets = [
        (0, "t0", "holdown", "H1", 0.0, 0.0, None, None, None, None), (1, "w1", "shear_wall", "SW-1", None, None, 10.0, 10.0, 30.0, 10.0), (2, "w2", "shear_wall", "SW-1", None, None, 30.0, 10.0, 34.0, 10.0),
        (3, "t3", "holdown", "H2", 40.0, 30.0, None, None, None, None),
    ]
    tables = {
        "point_pairs": pairs,
        "marks": spark.createDataFrame([(k, i, "S1", c, m, x, y) for k, i, c, m, x, y in drawn], "seq long, id string, sheet string, category string, mark string, px double, py double"),
        "targets": spark.createDataFrame(targets, "seq long, id string, category string, mark string, x double, y double, ax double, ay double, bx double, by double"),
    }
    out = Run(tables).go()
    got = {r.id: (r.status, r.target_id) for r in out["elements"].collect()}
    # the wall's second segment is part of the drawn run; rows without a category match nothing
    assert got == {"m0": ("MATCH", "t0"), "m1": ("MATCH", "w1"), "m2": ("PDF_ONLY", None), "m3": ("PDF_ONLY", None), "t3": ("REVIT_ONLY", "t3")}


def scattered(rng, n, spread=3000.0):
    return [(f"H{i % 4}", float(rng.uniform(0, spread)), float(rng.uniform(0, spread))) for i in range(n)]


def plain_inliers(z, w, mirrored, left, right, gate):
    own = [(m, complex(x, -y if mirrored else y)) for m, x, y in left]
    near = sorted((abs(z * s + w - complex(x, y)), i, j) for i, (m, s) in enumerate(own) for j, (k, x, y) in enumerate(right) if m == k and abs(z * s + w - complex(x, y)) <= gate)
    used_i, used_j = set(), set()
    for _, i, j in near:
        if i not in used_i and j not in used_j:
            used_i.add(i)
            used_j.add(j)
    return len(used_i)


def test_consensus_counts_equal_a_plain_pass():
    """Dense points and a wide gate, so that most points have several partners."""
    rng = np.random.default_rng(11)
    left, right = scattered(rng, 60, 100.0), scattered(rng, 60, 100.0)
    names = sorted({m for m, _, _ in left})
    side = lambda rows: (np.array([names.index(m) for m, _, _ in rows]), np.array([complex(x, y) for _, x, y in rows]))
    (lk, la), (rk, ra) = side(left), side(right)
    grid = consensus._Grid(rk, ra, 12.0)
    for _ in range(40):
        z, w, mirrored = complex(*rng.normal(0, 1, 2)), complex(*rng.uniform(-60, 60, 2)), bool(rng.integers(2))
        i, j, far = grid.inliers(lk, z * (la.conj() if mirrored else la) + w)
        assert len(set(i.tolist())) == len(i) == len(set(j.tolist())) and (far <= 12).all()
        assert len(i) == plain_inliers(z, w, mirrored, left, right, 12.0)


def test_draws_are_three_different_pairs_of_equal_key(spark):
    left = [("S", "A", 0.0, 0.0), ("S", "A", 1.0, 0.0), ("S", "B", 5.0, 5.0), ("S", None, 1.0, 1.0), ("T", "A", 0.0, 0.0), (None, "A", 0.0, 0.0)]
    right = [("S", "A", 9.0, 0.0), ("S", "B", 8.0, 0.0), ("S", "C", 7.0, 0.0), ("T", "A", 6.0, 0.0)]
    frame = lambda rows: spark.createDataFrame(rows, "sheet string, mark string, x double, y double")
    rows = consensus.drawn_pairs(frame(left), frame(right), "sheet", "mark", 50, 1).collect()
    assert {r["by"] for r in rows} == {"S"} and len(rows) == 150  # sheet T has one pair only
    for h in range(50):
        assert {(r["sx"], r["dx"]) for r in rows if r["h"] == h} == {(0.0, 9.0), (1.0, 9.0), (5.0, 8.0)}
    assert consensus.ransac(frame(left).limit(0), frame(right), "sheet", "mark", 2.0, tries=5).count() == 0


def test_ransac_finds_a_planted_transform(spark):
    rng = np.random.default_rng(12)
    model = [(f"H{i % 12}", x, y) for i, (_, x, y) in enumerate(scattered(rng, 60, 200.0))]
    drawn = [(m, 100 + 18 * y + float(rng.normal(0, 2)), 50 + 18 * x + float(rng.normal(0, 2))) for m, x, y in model[:50]] + scattered(rng, 10)
    frame = lambda rows: spark.createDataFrame([("S", *r) for r in rows], "sheet string, mark string, x double, y double")
    best = consensus.ransac(frame(model), frame(drawn), "sheet", "mark", 16.0, tries=3000).first()
    assert best["reflected"] and best["inliers"] >= 50 and best["scale"] == pytest.approx(18, abs=0.05)
    again = consensus.ransac(frame(model).repartition(3), frame(drawn).repartition(2), "sheet", "mark", 16.0, tries=3000).first()
    assert again == best


def test_tries_of_equal_inliers_tie_on_far_sheets():
    """Sheets 400,000 ft out, where sums in another order differ in the ninth place: the first try
    of those with the same inliers is the best, as in SQL."""

    def at(n):
        j = lambda a: ((n * a) % 41 - 20) * 0.25
        x, y = float(n % 30 * 20), float(n // 30 * 20)
        return x, y, 100 + 18 * y + j(7919) + (400.0 if n % 11 == 0 else 0.0), 50 + 18 * x + j(6277)

    for sheet, first in ((3597, 4), (3604, 16), (3640, 12), (3707, 4), (3740, 12)):
        places = [(n, f"H{n % 4}", at(n)) for n in range(240 * sheet, 240 * sheet + 240)]
        pts = pd.DataFrame([(k, 0, p[0], p[1]) for _, k, p in places] + [(k, 1, p[2], p[3]) for n, k, p in places if n % 7], columns=["k", "side", "x", "y"])
        tries = []
        for h in range(40):
            a = [(h * 37 + r * 101 + h * h % 29) % 240 for r in range(3)]
            b = [(a[r] + (0 if h % 4 == 0 or (h % 4 == 1 and r < 2) else 4 * (1 + (h + r * 7) % 50))) % 240 for r in range(3)]
            if all((240 * sheet + n) % 7 for n in b):
                tries.append([h] + [v for r in range(3) for v in (*at(240 * sheet + a[r])[:2], *at(240 * sheet + b[r])[2:])])
        names = ["h"] + [f"{c}{k}" for k in range(3) for c in ("sx", "sy", "dx", "dy")]
        best = consensus._best_of(pd.DataFrame(tries, columns=names), pts, 16.0)
        assert (best[0], best[-2]) == (first, 187)


def test_near_numbers_are_contracted_without_rounds(spark, monkeypatch):
    """Three rounds and more of shuffles for each search are what made large tables costly."""
    from spanwright.operators import graph

    monkeypatch.setattr(graph, "CHUNK_EDGES", 50)
    calls = []
    monkeypatch.setattr(graph, "_in_rounds", lambda e, last: calls.append(1))
    rows = spark.range(4000).selectExpr("id", "id div 10 * 10 AS root")
    edges = rows.where("id % 10 <> 0").selectExpr("id AS a", "id - 1 AS b")
    got = graph.connected_components(edges.unionByName(edges.selectExpr("b AS a", "a AS b")), last=50)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect())) and not calls
