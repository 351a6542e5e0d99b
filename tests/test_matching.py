"""Matching against plain restatements of the rules, on random small drawings."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest

from spanwright.config import Gates
from spanwright.operators import matching as M
from spanwright.operators.cluster import leader_clusters


def greedy(edges):
    taken_d, taken_t, out = set(), set(), set()
    for _, d, t in sorted(edges):
        if d not in taken_d and t not in taken_t:
            taken_d.add(d)
            taken_t.add(t)
            out.add((d, t))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_greedy_equals_one_pass(spark, seed):
    rng = random.Random(seed)
    edges = list({(float(rng.randint(1, 6)), d, t) for d in range(8) for t in range(8) if rng.random() < 0.5})
    df = spark.createDataFrame(edges, "dist double, d long, t long")
    assert {(r.d, r.t) for r in M.greedy_pairs(df).collect()} == greedy(edges)


def test_optimal_equals_permutations():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 5))
        m = int(rng.integers(n, 6))
        cost = rng.integers(0, 9, (n, m)).astype(float)
        got = M.least_total({i: [(j, cost[i, j]) for j in range(m)] for i in range(n)}, 1000.0)
        best = min(sum(cost[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(m), n))
        assert len(set(got.values())) == n
        assert sum(cost[i, c] for i, c in got.items()) == best


def test_least_total_on_few_options_equals_all_ways():
    rng = random.Random(9)
    for _ in range(200):
        options = {d: [(t, float(rng.randint(0, 9))) for t in range(5) if rng.random() < 0.4] for d in range(5)}
        got = M.least_total(options, 100.0)
        total = sum(dict(options[d])[t] for d, t in got.items()) + 100.0 * (5 - len(got))
        ways = itertools.product(*[[(None, 100.0), *options[d]] for d in options])
        held = [w for w in ways if len({t for t, _ in w if t is not None}) == sum(t is not None for t, _ in w)]
        assert len(set(got.values())) == len(got)
        assert total == min(sum(c for _, c in w) for w in held)


def plain_assign(devices, targets, gates):
    """Status and target of each device, by the rules, one after another."""
    dist = lambda d, t: math.hypot(d["x"] - t["x"], d["y"] - t["y"])
    out, claimed, tied = {}, set(), set()
    for d in devices:
        near = sorted((dist(d, t), t["id"]) for t in targets if t["mark"] == d["mark"])
        if len(near) > 1 and near[0][0] <= gates.mismatch_ft and near[1][0] - near[0][0] < gates.ambiguity_ft:
            tied.add(d["id"])
    for far, i, j in sorted((dist(d, t), i, j) for i, d in enumerate(devices) for j, t in enumerate(targets) if d["mark"] == t["mark"]):
        d, t = devices[i], targets[j]
        if d["id"] in out or far > gates.mismatch_ft:
            continue
        if d["id"] in tied:
            out[d["id"]] = ("NEEDS_REVIEW", None)
        elif t["id"] not in claimed:
            if far <= gates.match_ft and d["z"] is not None and t["z"] is not None and abs(d["z"] - t["z"]) > gates.level_ft:
                out[d["id"]] = ("NEEDS_REVIEW", None)
                continue
            claimed.add(t["id"])
            out[d["id"]] = ("MATCH" if far <= gates.match_ft else "LOCATION_MISMATCH", t["id"])
    for far, i, j in sorted((dist(d, t), i, j) for i, d in enumerate(devices) for j, t in enumerate(targets)):
        d, t = devices[i], targets[j]
        if d["id"] not in out and far <= gates.match_ft and t["id"] not in claimed:
            claimed.add(t["id"])
            out[d["id"]] = ("MARK_MISMATCH", t["id"])
    return {d["id"]: out.get(d["id"], ("PDF_ONLY", None)) for d in devices}


@pytest.mark.parametrize("seed", range(2))
def test_assign_equals_plain_rules(spark, seed):
    rng = random.Random(seed)
    place = lambda: {"x": rng.randint(0, 60) / 4, "y": rng.randint(0, 60) / 4, "mark": rng.choice("AB"), "z": rng.choice([None, 0.0, 20.0])}
    devices = [{"seq": i, "id": f"d{i}", "sheets": ["S"], **place()} for i in range(25)]
    targets = [{"seq": i, "id": f"t{i}", **place()} for i in range(25)]
    d = spark.createDataFrame([tuple(x[k] for k in ("seq", "id", "sheets", "x", "y", "mark", "z")) for x in devices], "seq long, id string, sheets array<string>, x double, y double, mark string, z double")
    t = spark.createDataFrame([tuple(x[k] for k in ("seq", "id", "x", "y", "mark", "z")) for x in targets], "seq long, id string, x double, y double, mark string, z double")
    sheets = spark.createDataFrame([], "sheet string, rms double, scale double")
    got = {r.id: (r.status, r.target_id) for r in M.assign(d, t, sheets, Gates()).collect()}
    assert got == plain_assign(devices, targets, Gates())


def test_adaptive_gate_widens_to_the_ceiling(spark):
    d = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"]), (3, ["z"])], "seq long, sheets array<string>")
    s = spark.createDataFrame([("a", 4.0, 4.0), ("b", 2.0, 4.0), ("c", 90.0, 4.0)], "sheet string, rms double, scale double")
    assert {r.d: r.gate for r in M.adaptive_gate(d, s, Gates()).collect()} == {1: 3.0, 2: 6.0, 3: 2.0}


def test_ties_go_in_device_order(spark):
    """Two devices want one target: the first takes it, the second keeps its tie."""
    a = spark.createDataFrame(
        [(1, "d1", 0.0, 0.0, 0.0, "NEEDS_REVIEW", None, None, None, None, None, None, "t1", "t2", 2.0), (2, "d2", 0.0, 0.0, 0.0, "NEEDS_REVIEW", None, None, None, None, None, None, "t1", "t2", 2.0)],
        "seq long, id string, x double, y double, orientation_deg double, status string, target_id string, target_mark string, target_x double, target_y double, target_z double, distance_ft double, first string, second string, gate double",
    )
    t = spark.createDataFrame([(1, "t1", "H", 1.0, 0.0, 0.0, "L1"), (2, "t2", "H", 0.0, 1.5, 90.0, "L1")], "seq long, id string, mark string, x double, y double, orientation_deg double, level string")
    got = {r.id: (r.status, r.target_id, r.resolved_by) for r in M.settle_by_orientation(a, t, Gates()).collect()}
    assert got == {"d1": ("MATCH", "t1", "orientation"), "d2": ("NEEDS_REVIEW", None, None)}


def test_leader_clusters_do_not_drift(spark):
    """A chain of near rows: only rows near the founder join it, one a sheet."""
    rows = [(0, "H", "S1", 0.0, 0.0), (1, "H", "S2", 2.5, 0.0), (2, "H", "S3", 5.0, 0.0), (3, "H", "S1", 0.5, 0.0), (4, "K", "S2", 0.0, 0.0)]
    df = spark.createDataFrame(rows, "seq long, mark string, sheet string, x double, y double")
    assert {r.seq: r.founder for r in leader_clusters(df, 3.0).collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4}
