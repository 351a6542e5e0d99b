"""All tries of a block are looked up together, and no side that grows is sent through the driver."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd

from spanwright.operators import consensus
from spanwright.plans import consensus_queries


def greedy(keys, at, rk, right, gate):
    """Pairs of one try, nearest first, by all pairs."""
    far = sorted((abs(a - b), i, j) for i, a in enumerate(at) for j, b in enumerate(right) if keys[i] == rk[j] and abs(a - b) <= gate)
    used_l, used_r, out = set(), set(), []
    for _, i, j in far:
        if i not in used_l and j not in used_r:
            used_l.add(i)
            used_r.add(j)
            out.append((i, j))
    return sorted(out)


def test_tries_looked_up_together_equal_all_pairs(monkeypatch):
    rng = np.random.default_rng(5)
    lk, rk = rng.integers(0, 3, 60), rng.integers(0, 3, 50)
    right = rng.integers(0, 80, 50) * 0.25 + 1j * rng.integers(0, 80, 50) * 0.25
    at = rng.integers(-8, 90, (12, 60)) * 0.25 + 1j * rng.integers(-8, 90, (12, 60)) * 0.25  # many shared partners
    at[7] = 1e9
    grid = consensus._Grid(rk, right, 2.0)
    for points in (200_000, 130, 1):
        monkeypatch.setattr(consensus, "POINTS", points)
        mine, i, j = grid.inliers(lk, at)
        for t in range(len(at)):
            assert list(zip(i[mine == t].tolist(), j[mine == t].tolist(), strict=True)) == greedy(lk, at[t], rk, right, 2.0)


def test_best_try_is_the_same_in_any_parts(monkeypatch):
    rng = random.Random(3)
    model = [("k" + str(n % 4), rng.randrange(400) * 0.5, rng.randrange(400) * 0.5) for n in range(80)]
    drawn = [(k, 100 + 18 * y + rng.randrange(-8, 9) * 0.25, 50 + 18 * x + rng.randrange(-8, 9) * 0.25) for k, x, y in model]
    pts = pd.DataFrame([(*p, 0) for p in model] + [(*p, 1) for p in drawn], columns=["k", "x", "y", "side"])
    picks = [[rng.randrange(80) for _ in range(3)] for _ in range(60)]
    tries = pd.DataFrame([(h, *[v for n in p for v in (*model[n][1:], *drawn[(n + (h % 5 == 1)) % 80][1:])]) for h, p in enumerate(picks)], columns=["h"] + [f"{c}{k}" for k in range(3) for c in ("sx", "sy", "dx", "dy")])
    whole = consensus._best_of(tries, pts, 16.0)
    assert whole[1] is True and whole[-2] > 60
    monkeypatch.setattr(consensus, "POINTS", 100)
    assert consensus._best_of(tries, pts, 16.0) == whole


def test_draws_and_points_are_not_sent_through_the_driver(spark):
    plan = consensus_queries.ransac_fit(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan
