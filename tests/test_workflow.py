from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from spanwright.streaming import workflow as W
from spanwright.streaming.progress import FOLLOWS
from spanwright.streaming.sink import EventLog, server_sent

STEPS = "key string, seq long, kind string, name string, actor string, note string"


def made(spark, rows):
    return spark.createDataFrame([(k, i, kind, name, "me", None) for i, (k, kind, name) in enumerate(rows)], STEPS)


def trail(df, key="a"):
    return [(r["seq"], r["outcome"], r["from_state"], r["to_state"]) for r in sorted((r for r in df.collect() if r["key"] == key), key=lambda r: r["n"])]


def test_reports_wait_behind_a_gate(spark):
    steps = [("step", "proposing"), ("step", "awaiting_pdf_approval"), ("advance", "stamped"), ("advance", "calibrated"), ("advance", "stamped"), ("approve", None), ("advance", "revit_connected")]
    got = trail(W.history(made(spark, [("a", *s) for s in steps]), "key"))
    assert got == [
        (0, "applied", "idle", "proposing"), (1, "applied", "proposing", "awaiting_pdf_approval"), (2, "held", "awaiting_pdf_approval", None), (3, "refused", "awaiting_pdf_approval", None),
        (4, "held", "awaiting_pdf_approval", None), (5, "applied", "awaiting_pdf_approval", "stamping"), (2, "released", "stamping", "awaiting_revit"), (4, "refused", "awaiting_revit", None),
        (6, "applied", "awaiting_revit", "placing_markers"),
    ]


def test_a_refused_gate_refuses_what_waits(spark):
    steps = [("approve", None), ("step", "proposing"), ("step", "awaiting_pdf_approval"), ("advance", "stamped"), ("reject", None), ("reject", None), ("step", "done"), ("step", None), (None, None), ("step", "proposing")]
    got = trail(W.history(made(spark, [("a", *s) for s in steps]), "key"))
    assert [g[1] for g in got] == ["refused", "applied", "applied", "held", "applied", "refused", "refused", "refused", "refused", "refused", "applied"]
    assert got[4] == (4, "applied", "awaiting_pdf_approval", "failed") and got[-1][3] == "proposing"


def random_steps(n, seed):
    rng = random.Random(seed)
    rows, states = [], {}
    for _ in range(n):
        key = rng.choice("aaaab") if rng.random() < 0.9 else None
        now = states.setdefault(key, "idle")
        kind = rng.choice(["step", "step", "advance", "approve", "reject"])
        name = rng.choice([*W.REPORTS, *FOLLOWS.get(now, ()), "nowhere"]) if kind in ("step", "advance") else None
        if kind == "step" and name in FOLLOWS.get(now, ()):
            states[key] = name
        rows.append((key, kind, name))
    # key a waits behind a gate from the first slice of forty into the second
    rows[:50] = [("b" if k == "a" else k, kind, name) for k, kind, name in rows[:50]]
    rows[0], rows[1], rows[30], rows[50] = ("a", "step", "proposing"), ("a", "step", "awaiting_pdf_approval"), ("a", "advance", "stamped"), ("a", "approve", None)
    return rows


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def test_stream_and_table_leave_the_same_history(spark, tmp_path, rocks):
    steps = made(spark, random_steps(160, 3))
    whole = {tuple(r) for r in W.history(steps.repartition(3), "key").collect()}
    assert {r[4] for r in whole} == {"applied", "held", "released", "refused"}
    (tmp_path / "in").mkdir()
    seen = set()
    for part in range(4):  # a query for each slice goes on from the checkpoint of the last
        steps.where(F.col("seq").between(40 * part, 40 * part + 39)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = W.follow(spark.readStream.schema(steps.schema).parquet(str(tmp_path / "in")), "key")
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        seen = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(*W.history(steps, "key").columns).collect()}
    assert seen == whole


def test_history_of_nothing_and_of_long_keys(spark):
    assert W.history(made(spark, []).limit(0), "key").count() == 0
    steps = spark.range(30_000).selectExpr("'a' AS key", "id AS seq", "'step' AS kind", "CASE id % 2 WHEN 0 THEN 'proposing' ELSE 'failed' END AS name", "'me' AS actor", "cast(null AS string) AS note")
    final = W.final_states(W.history(steps, "key"), "key").first()
    assert (final["applied"], final["refused"], final["state"]) == (30_000, 0, "failed")


COLUMNS = "tenant string, id long, ts timestamp, kind string"


def events(spark, ids, tenant="x"):
    return spark.createDataFrame([(tenant, i, i) for i in ids], "tenant string, id long, at long").selectExpr("tenant", "id", "timestamp_seconds(at) AS ts", "'info' AS kind")


def numbers(log):
    return {(r["tenant"], r["id"]): r["seq"] for r in log.read().collect()}


def test_numbers_are_given_once(spark, tmp_path):
    log = EventLog(spark, f"file://{tmp_path}/log", COLUMNS)
    log.append(events(spark, [3, 1, 2, 2]).unionByName(events(spark, [1], "y")).unionByName(events(spark, [5], None)), 0)
    log.append(events(spark, [2, 4, 9]).unionByName(events(spark, [7], "y")), 1)
    wanted = {("x", 1): 1, ("x", 2): 2, ("x", 3): 3, ("y", 1): 1, (None, 5): 1, ("x", 4): 4, ("x", 9): 5, ("y", 7): 2}
    assert numbers(log) == wanted
    log.append(events(spark, [100]), 1)  # a batch that was finished is left alone
    assert numbers(log) == wanted
    assert [r["seq"] for r in server_sent(log.read(), "x", 3).collect()] == [4, 5]


def test_heads_are_written_together_now_and_then(spark, tmp_path, monkeypatch):
    from spanwright.streaming import sink

    monkeypatch.setattr(sink, "TOGETHER", 2)
    log = EventLog(spark, f"file://{tmp_path}/log", COLUMNS)
    for k in range(5):
        log.append(events(spark, [2 * k, 2 * k + 1], "x" if k != 2 else "y"), k)
    assert log._done("all") == [1, 3]
    assert sorted(v for (t, _), v in numbers(log).items() if t == "x") == list(range(1, 9))


def test_a_stream_that_is_killed_and_resumed_leaves_the_same_log(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        events(spark, range(10 * k, 10 * k + 10)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    log = EventLog(spark, f"file://{tmp_path}/log", COLUMNS)
    died = []

    def dies_once(batch, batch_id):
        log.append(batch, batch_id)
        if batch_id == 1 and not died:  # written, but not yet known to the checkpoint
            died.append(batch_id)
            raise RuntimeError("executor lost")

    def start():
        stream = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        return stream.writeStream.foreachBatch(dies_once).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()

    with pytest.raises(Exception, match="executor lost"):
        start().awaitTermination(120)
    start().awaitTermination(120)
    got = numbers(log)
    assert sorted(got.values()) == list(range(1, 31)) and len(got) == 30
