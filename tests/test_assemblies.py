from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from spanwright.operators import assemblies as A
from spanwright.operators import counts as N
from spanwright.operators import crosshairs as H
from spanwright.operators import detections as D
from spanwright.sources.connector import ConnectorText, parsed, rows_of

FAMILIES = ["SHDU5-WITH BOLT", "Anchor_Bolt_SHDU5", "HTT4", "S_HD15S offset", "J-BOLT HTT4", "HD 9 PAB"]
RECORDS = "seq long, id string, family string, x double, y double"


def plain_assemblies(records, tolerance):
    """One record after another into the first near cluster, then bodies apart."""
    clusters = []
    for r in sorted(records):
        home = next((c for c in clusters if abs(c[0][3] - r[3]) <= tolerance and abs(c[0][4] - r[4]) <= tolerance), None)
        if home:
            home.append(r)
        else:
            clusters.append([r])
    body = lambda r: not any(w in r[2].upper() for w in ("ANCHOR_BOLT", "J-BOLT")) and "offset" not in r[2].lower()
    groups = []
    for c in clusters:
        bodies = [r for r in c if body(r)]
        if len(bodies) < 2:
            groups.append((bodies[0] if bodies else c[0], c))
            continue
        split = [[b] for b in bodies]
        for r in c:
            if not body(r):
                far = [(b[3] - r[3]) ** 2 + (b[4] - r[4]) ** 2 for b in bodies]
                split[far.index(min(far))].append(r)
        groups += [(s[0], s) for s in split]
    return [(f"rev_asm_{k:03d}", head[1], [r[1] for r in members]) for k, (head, members) in enumerate(groups, 1)]


@pytest.mark.parametrize("side", [6.0, 30.0])
def test_assemblies_equal_a_plain_search(spark, side):
    rng = random.Random(side)
    at = [(rng.randint(0, int(side * 2)) / 2, rng.randint(0, int(side * 2)) / 2) for _ in range(60)]
    records = [(k, f"e{k}", rng.choice(FAMILIES), *rng.choice(at)) for k in range(120)]
    specs = spark.createDataFrame([("HTT4", "HD2"), ("HTT4", "HD1")], "key string, mark string")
    made, members, evidence = A.built(spark.createDataFrame(records, RECORDS).repartition(3), specs)
    got = {r["id"]: (r["primary_id"], r["n_members"], r["mark"]) for r in made.collect()}
    inside = {}
    for r in sorted(members.collect(), key=lambda r: (r["assembly"], r["place"])):
        inside.setdefault(r["assembly"], []).append(r["element"])
    family = {r[1]: r[2] for r in records}
    wanted = plain_assemblies(records, 2.0)
    assert {k: (h, len(m), "HD1" if "HTT4" in family[h] else None) for k, h, m in wanted} == got
    assert {k: m for k, _, m in wanted} == inside
    assert sum(r["n"] for r in evidence.collect()) == len(records)


def test_assemblies_of_nothing(spark):
    empty = spark.createDataFrame([], RECORDS)
    assert [t.count() for t in A.built(empty, spark.createDataFrame([], "key string, mark string"))] == [0, 0, 0]


def test_converted_records_and_what_is_left(spark):
    rows = [
        (1, "b1", "body", "HDU5", "H1", 0.0, 0.0, "SHDU5"), (2, "b2", "body", "", None, 10.0, 0.0, "odd"), (3, "m1", "evidence_member", "HDU5", None, 1.0, 0.0, "bolt"),
        (4, "m2", "evidence_member", "HDU2", None, 1.0, 0.0, "bolt"), (5, "m3", "evidence_member", "", None, 9.0, 0.0, "plate"), (6, "m4", "evidence_member", "HDU5", None, None, None, "bolt"),
    ]
    made, members, left = A.converted(spark.createDataFrame(rows, "seq long, id string, kind string, token string, mark string, x double, y double, family string"), 3.0)
    assert [(r["assembly"], r["primary_id"], r["confidence"]) for r in made.orderBy("no").collect()] == [("rev_asm_001", "b1", 0.9), ("rev_asm_002", "b2", 0.4)]
    assert {(r["assembly"], r["element"], r["attach_ft"]) for r in members.collect()} == {("rev_asm_001", "b1", None), ("rev_asm_001", "m1", 1.0), ("rev_asm_002", "b2", None), ("rev_asm_002", "m3", 1.0)}
    assert {r["id"] for r in left.collect()} == {"m2", "m4", "b2"}


def test_a_chain_counts_what_it_writes(spark):
    chain = N.Chain()
    raw = chain.write("raw", spark.createDataFrame([(1, None, "H1"), (2, None, None), (3, None, "H1")], "id int, level string, mark string"))
    made = chain.write("made", raw.where("mark IS NOT NULL"))
    report = {(r["step"], r["key"]): (r["n"], r["delta"], r["warning"]) for r in N.chain_report(spark, chain, made, spark.createDataFrame([("H1", 2), ("H2", 1)], "mark string, expected long")).collect()}
    assert report[("stage 0", "raw")] == (3, None, "no level in any row") and report[("mark", "H1")] == (2, 0, None)
    assert report[("mark", "H2")][:2] == (0, -1) and report[("mark", "H2")][2].startswith("H2: 0 assemblies, 1 expected")
    alone = N.chain_report(spark, chain, made, None).where("step = 'mark'").collect()
    assert [(r["key"], r["n"], r["expected"]) for r in alone] == [("H1", 2, None)]


# ---- detections


def placed(spark, hits, targets=(), pairs=()):
    h = spark.createDataFrame(hits, "page int, hit int, label string, count int, x0 double, y0 double, x1 double, y1 double")
    t = spark.createDataFrame(list(targets), "page int, hit int, k int, x double, y double")
    p = spark.createDataFrame(list(pairs), "page int, hit int, pair_key int, score double, ax double, ay double, bx double, by double")
    rows = D.instances(D.plans(h, t, p)).orderBy("hit", "instance").collect()
    return {hit: [(r["x"], r["y"]) for r in rows if r["hit"] == hit] for hit in {r["hit"] for r in rows}}, rows


def test_points_of_plans(spark):
    box = (0.0, 0.0, 10.0, 4.0)
    hits = [(1, k, "h1", c, *box) for k, c in enumerate((1, 3, 2, 1, 1, 3, None, 0), 1)]
    targets = [(1, 3, 0, 5.0, 5.0), (1, 3, 1, 6.0, 6.0), (1, 3, 2, 7.0, 7.0), (1, 4, 0, 0.0, 0.0), (1, 4, 1, 100.0, 0.0), (1, 4, 2, 50.0, 0.0)]
    pairs = [(1, 5, 9, 2.0, 1.0, 1.0, 30.0, 1.0), (1, 6, 9, 1.0, 1.0, 1.0, 30.0, 1.0), (1, 4, 9, 0.0, 1.0, 1.0, 30.0, 1.0)]
    got, rows = placed(spark, hits, targets, pairs)
    assert got[1] == [(5.0, 2.0)] and got[2] == [(-13.0, 2.0), (5.0, 2.0), (23.0, 2.0)]
    assert got[3] == [(5.0, 5.0), (6.0, 6.0)]
    assert got[4] == [(0.0, 0.0), (50.0, 0.0)]  # of three targets the nearest two; with several it wants no pair
    assert got[5] == [(5.0, 2.0)]  # the pair went to the lower score
    assert got[6] == [(-17.0, 1.0), (1.0, 1.0), (19.0, 1.0)]  # a pair is too few for three
    assert got[7] == got[8] == [(5.0, 2.0)]
    assert {r["hit"]: r["method"] for r in rows}[6] == "paired_hardware_markers"
    assert placed(spark, [])[1] == []


def test_rows_say_where_their_product_is_from(spark):
    found = spark.createDataFrame([("a", "H1"), ("b", "H2")], "id string, mark string")
    table = spark.createDataFrame([("h1", "HDU2", None, "x", "8")], "mark string, type string, fasteners string, anchor string, embedment string")
    source = lambda s: {r["id"]: (r["schedule_source"], r["type"]) for r in D.normalized_rows(found, s, {"H1": "HDU2"}, "S1").collect()}
    assert source(table) == {"a": ("detected", "HDU2"), "b": ("not_in_schedule", "")}
    assert source(table.limit(0)) == {"a": ("none", ""), "b": ("none", "")}
    assert source(None) == {"a": ("schedule_not_parsed", ""), "b": ("schedule_not_parsed", "")}


# ---- crosshairs


def crosses(spark, circles, lines, words=()):
    c = spark.createDataFrame(circles, "page int, seq int, x double, y double, r double")
    s = spark.createDataFrame(lines, "page int, ax double, ay double, bx double, by double")
    w = spark.createDataFrame(list(words), "page int, seq int, x double, y double, text string")
    return {(r["page"], r["seq"]): (r["mark"], r["assigned"]) for r in H.crosshairs(c, s, w).collect()}


def test_crosshairs_at_any_rotation(spark):
    import math

    lines = []
    for page in range(36):
        t = math.radians(5 * page + 0.1)
        for turn in (t, t + math.pi / 2 + math.radians(8)):
            lines.append((page, 500 + 300 * math.cos(turn), 500 + 300 * math.sin(turn), 500 + 330 * math.cos(turn), 500 + 330 * math.sin(turn)))  # far from the middle
    circles = [(page, 1, 500.0, 500.0, 8.0) for page in range(36)] + [(0, 2, 505.0, 505.0, 8.0), (1, 3, None, 1.0, 8.0)]
    assert set(crosses(spark, circles, lines)) == {(page, 1) for page in range(36)}
    assert crosses(spark, circles, [(p, *a) for p, *a in lines[::2]]) == {}  # one line is no cross
    assert crosses(spark, [], []) == {}


def test_the_first_crosshair_of_a_mark_is_assigned(spark):
    lines = [(1, -100.0, y, 100.0, y) for y in (0.0, 50.0)] + [(1, 0.0, -100.0, 0.0, 100.0)]
    circles = [(1, 1, 0.0, 0.0, 8.0), (1, 2, 0.0, 50.0, 8.0)]
    words = [(1, 1, 10.0, 0.0, "bm 1"), (1, 2, 10.0, 50.0, "BM-1"), (1, 3, 0.0, 60.0, None)]
    assert crosses(spark, circles, lines, words) == {(1, 1): ("BM-1", True), (1, 2): ("BM-1", False)}


# ---- connector text

ANSWER = """model_title: 10510 Tower
timestamp: 2024 12345
- Category: OST_Walls
  ElementIdsOfCategory[3]: 1234, 99999, 5
- Category: OST_Columns
  ElementIdsOfCategory[28]{SubsetId,IdsCount,SampleElementId}:
    -9000017,28,2804799
2897203,LocationPoint,"(38.05, 32.52, 1.50)"
1029591,"[(82.50, 55.75, -0.27), (83.00, 56.25, 12.48)]"
1029592,"[(82.50, x, -0.27), (83.00, 56.25, 12.48)]"
copied to 3000001 and 3000002
nothing here
"""


def test_answers_are_read_line_by_line():
    rows = [(r[0], r[1], r[2], r[3]) for r in parsed(iter(ANSWER.splitlines()))]
    assert rows == [
        ("title", None, "10510 Tower", None), ("category", None, "OST_Walls", None), ("listed", 1234, "OST_Walls/ElementIdsOfCategory", 3), ("listed", 99999, "OST_Walls/ElementIdsOfCategory", 3),
        ("listed", 5, "OST_Walls/ElementIdsOfCategory", 3), ("category", None, "OST_Columns", None), ("subset", -9000017, "OST_Columns/ElementIdsOfCategory", 28), ("location", 2897203, "OST_Columns", None),
        ("box", 1029591, "OST_Columns", None), ("bad", None, '1029592,"[(82.50, x, -0.27), (83.00, 56.25, 12.48)]"', None), ("loose", 3000001, "OST_Columns", None), ("loose", 3000002, "OST_Columns", None),
    ]


def test_the_data_source_reads_files_side_by_side(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"answer{k}.txt").write_text(ANSWER)
    spark.dataSource.register(ConnectorText)
    df = spark.read.format("connector_text").option("paths", f"{tmp_path}/*.txt").load()
    assert df.rdd.getNumPartitions() == 3
    assert {r["kind"]: r["count"] for r in df.groupBy("kind").count().collect()} == {"title": 3, "category": 6, "listed": 9, "subset": 3, "location": 3, "box": 3, "bad": 3, "loose": 6}
    assert spark.read.format("connector_text").load().count() == 0
    kept = rows_of(spark.createDataFrame([(1, ANSWER), (2, None), (3, "")], "k int, t string"), "k", "t")
    assert kept.groupBy("k").agg(F.count("*").alias("n")).collect()[0]["n"] == 12


def test_seats_of_stretches_equal_those_by_joins(spark, monkeypatch):
    """Most clusters are settled where they lie; before, all rows went through joins and rounds."""
    monkeypatch.setattr(A.tiles, "TILE_ROWS", 300)
    rng = random.Random(4)
    records = []
    for k in range(1500):
        x, y = rng.randrange(0, 1200) * 0.5, rng.randrange(0, 4000) * 0.5
        for j in range(rng.randrange(1, 5)):
            at = (None, None) if k % 90 == 0 else (x + rng.randrange(-8, 9) * 0.25, y + rng.randrange(-8, 9) * 0.25)
            records.append((10 * k + j, f"e{k}-{j}", None if k % 70 == 0 else rng.choice(FAMILIES), *at))
    rng.shuffle(records)
    rows, left = spark.createDataFrame(records, RECORDS), []
    joined = A._seated_by_joins
    monkeypatch.setattr(A, "_seated_by_joins", lambda r, tolerance: left.append(r.count()) or joined(r, tolerance))
    got = A.seated(rows, 2.0)
    want = joined(rows.withColumn("body", A.is_body(F.col("family"))), 2.0).select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert 0 < left[0] < len(records) // 2


def test_a_chain_counts_without_writing(spark):
    rows = spark.createDataFrame([(1, None, "H1"), (2, None, None)], "id int, level string, mark string")
    one, two = N.Chain(), N.Chain()
    one.write("raw", rows)
    assert two.count("raw", rows) is rows and two.counts() == one.counts()
