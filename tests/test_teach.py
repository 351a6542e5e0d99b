from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from spanwright.operators import teach as T
from spanwright.sources.memory import KeyedTable

COLUMNS = "id string, v bigint, note string"


def rows(table):
    return {r["id"]: (r["v"], r["note"]) for r in table.read().collect()}


def test_merges_keep_what_is_last(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", COLUMNS)
    assert table.version == 0 and rows(table) == {}
    frame = lambda data: spark.createDataFrame(data, "seq long, op string, id string, v bigint, note string")
    table.merge(frame([(1, "upsert", "a", 1, "x"), (2, "upsert", "b", 2, None), (3, "delete", "b", None, None), (4, "upsert", "c", 3, "y")]))
    assert rows(table) == {"a": (1, "x"), "c": (3, "y")}
    table.merge(frame([(9, "upsert", "a", 5, None), (8, "delete", "a", None, None), (1, "delete", "missing", None, None)]))
    assert rows(table) == {"a": (5, "x"), "c": (3, "y")}  # a null keeps what was there
    assert table.version == 2 and {r["id"] for r in table.read(1).collect()} == {"a", "c"}
    table.merge(frame([]))
    assert rows(table) == {"a": (5, "x"), "c": (3, "y")}


def test_unfinished_versions_are_passed_over(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", COLUMNS)
    frame = spark.createDataFrame([(1, "upsert", "a", 1, "x")], "seq long, op string, id string, v bigint, note string")
    table.merge(frame)
    (tmp_path / "t" / "v000002").mkdir()  # a writer that died
    (tmp_path / "t" / "v000002" / "part-0.parquet").write_bytes(b"half")
    assert table.version == 1 and rows(table) == {"a": (1, "x")}
    assert table.merge(frame.withColumn("v", F.lit(7).cast("long"))) == 3
    assert rows(table) == {"a": (7, "x")}


def test_new_ids_go_on_after_the_highest(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", COLUMNS)
    add = lambda *v: table.append(spark.createDataFrame([(x, "n") for x in v], "v long, note string"), "v", "mem")
    add(10, 20, 30)
    table.merge(spark.createDataFrame([(1, "delete", "mem_002", None, None)], "seq long, op string, id string, v bigint, note string"))
    add(40)
    assert rows(table) == {"mem_001": (10, "n"), "mem_003": (30, "n"), "mem_004": (40, "n")}


def test_an_old_store_is_adopted_once(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", COLUMNS)
    old = spark.createDataFrame([("mem_007", 1), (None, 2), (None, 3)], "id string, v long")
    table.adopt(old, "v", "mem")
    assert rows(table) == {"mem_007": (1, None), "mem_008": (2, None), "mem_009": (3, None)}
    assert table.adopt(old, "v", "mem") is None and len(rows(table)) == 3


RULES = [
    ("m1", 1, None, "mark_alias", "holdown", "ab1", "h3", None),
    ("m2", 2, "global", "mark_alias", "post", "AB1", "", None),
    ("m3", 3, "project:b", "mark_alias", "post", "AB2", "P-1", None),
    ("m4", 4, "project:a", "exclude", "holdown", "h9", None, None),
    ("m5", 5, None, "mark_pattern", "post", None, None, r"zz\d+"),
    ("m6", 6, None, "mark_pattern", "shear_wall", None, None, r"z"),
    ("m7", 7, None, "mark_pattern", "post", None, None, r"(["),
    ("m8", 8, None, "mark_alias", "roof", "AB3", "H1", None),
    ("m9", 9, None, "note", None, None, None, None),
    ("m10", 10, None, "mark_pattern", "post", None, None, None),
    (None, None, None, None, None, None, None, None),
]


@pytest.fixture(scope="module")
def rules(spark):
    return spark.createDataFrame(RULES, "id string, seq long, scope string, kind string, category string, token string, maps_to string, regex string")


def test_what_holds_in_a_project(rules):
    got = {(r["kind"], r["key"], r["value"], r["taught_by"], r["place"]) for r in T.overrides_of(rules, "a").collect()}
    assert got == {
        ("mark_alias", "AB1", "AB1", "m2", 1), ("exclude", "H9", None, "m4", 1), ("mark_pattern", "post", r"zz\d+", "m5", 1), ("mark_pattern", "shear_wall", "z", "m6", 1),
    }
    assert ("mark_alias", "AB2", "P-1", "m3", 1) in {(r["kind"], r["key"], r["value"], r["taught_by"], r["place"]) for r in T.overrides_of(rules, "b").collect()}


def test_five_sources_in_their_order(spark, rules):
    vocabulary = spark.createDataFrame([("holdown", "AB1", 1), ("post", "ZZ5", 2), ("wall_type", "7", 3), ("holdown", "H9", 4), ("post", "AB1", 5)], "category string, mark string, rank int")
    tokens = spark.createDataFrame([(t,) for t in ("ab1", " H9", "zz5", "ZZ6", "zx", "H4", "7", "none", None, "")], "token string")
    got = {r["token"]: (r["category"], r["mark"], r["schedule_listed"], r["source"]) for r in T.classified(tokens, vocabulary, rules, "a").collect()}
    assert got == {
        "ab1": ("post", "AB1", True, "alias"), " H9": (None, "H9", False, "exclude"), "zz5": ("post", "ZZ5", True, "vocabulary"), "ZZ6": ("post", "ZZ6", False, "pattern"),
        "zx": ("shear_wall", "ZX", False, "pattern"), "H4": ("holdown", "H4", False, "built_in"), "7": (None, "7", False, None), "none": (None, "NONE", False, None),
        None: (None, None, None, None), "": (None, "", False, None),
    }
    bare = T.classified(tokens, vocabulary, rules.limit(0), "a").where("token = 'ZZ6'").first()
    assert bare["category"] is None


def test_rules_told_in_words_are_remembered(spark, tmp_path):
    told = spark.createDataFrame([(1, "AB1 means HD3"), (2, "please ignore H9"), (3, "look at the roof")], "seq long, text string")
    table = KeyedTable(spark, f"file://{tmp_path}/t", T.MEMORY)
    table.append(T.taught(told, F.lit("project:a")), "seq", "mem")
    got = {r["id"]: (r["kind"], r["token"], r["maps_to"]) for r in table.read().collect()}
    assert got == {"mem_001": ("mark_alias", "AB1", "HD3"), "mem_002": ("exclude", "H9", None), "mem_003": ("note", None, None)}
    assert T.overrides_of(table.read(), "a").count() == 2 and T.overrides_of(table.read(), "b").count() == 0
