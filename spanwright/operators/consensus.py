"""Registration by consensus: hypotheses as a table, each counted against a sheet's points.

A hypothesis is three drawn pairs of equal key; both variants of the similarity through them are
counted. Hypotheses go out in blocks with the points of their sheet, so that any number of tries
is spread over tasks and a task holds one sheet's points and one block; the best of all blocks
is an aggregate."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanwright.sources.scratch import large, stash

#: Hypotheses of a block.
BLOCK = 500
#: Moved points that are looked up at once; each may offer eight pairs, else the tries are halved.
POINTS = 200_000
# Scales (points a foot) that a transform may have, the least inliers, and the
# scatter without a second axis.
SCALES, LEAST, FLAT = (1.0, 200.0), 3, 1e-6


def _sited(points: DataFrame, by: str, key: str) -> DataFrame:
    return points.select(F.col(by).alias("by"), F.col(key).alias("k"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL AND k IS NOT NULL AND by IS NOT NULL")


def drawn_pairs(left: DataFrame, right: DataFrame, by: str, key: str, tries: int, seed: int) -> DataFrame:
    """(by, h, r, sx, sy, dx, dy): for each sheet ``tries`` times three different pairs of equal
    key. Pairs are numbered, not made: a number stands for a key and a place on either side."""
    a, b = _sited(left, by, key), _sited(right, by, key)
    w = Window.partitionBy("by", "k").orderBy("x", "y")
    a, b = a.withColumn("i", F.row_number().over(w) - 1), b.withColumn("j", F.row_number().over(w) - 1)
    sizes = a.groupBy("by", "k").agg(F.count("*").alias("n")).join(b.groupBy("by", "k").agg(F.count("*").alias("m")), ["by", "k"])
    each = F.array_sort(F.collect_list(F.struct("k", "n", "m")))
    start = F.aggregate(
        each,
        F.expr("cast(array() AS array<struct<upto:bigint,k:string,m:bigint>>)"),
        lambda done, s: F.concat(done, F.array(F.struct((F.coalesce(F.try_element_at(done, F.lit(-1))["upto"], F.lit(0)) + s["n"] * s["m"]).alias("upto"), s["k"].cast("string").alias("k"), s["m"].alias("m")))),
    )
    keys = sizes.groupBy("by").agg(start.alias("keys")).withColumn("total", F.element_at("keys", -1)["upto"]).where("total >= 3")
    rand = lambda r: F.xxhash64(F.lit(seed), F.col("by"), F.col("h"), F.lit(r))
    tried = keys.withColumn("h", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tries - 1).cast("long"))))
    tried = tried.withColumn("u0", F.pmod(rand(0), F.col("total"))).withColumn("u1", F.pmod(F.col("u0") + 1 + F.pmod(rand(1), F.col("total") - 1), F.col("total")))
    low, high = F.least("u0", "u1"), F.greatest("u0", "u1")
    third = F.pmod(rand(2), F.col("total") - 2)
    third = third + F.when(third >= low, 1).otherwise(0)
    tried = tried.withColumn("u2", third + F.when(third >= high, 1).otherwise(0))
    one = tried.select("by", "h", "keys", F.posexplode(F.array("u0", "u1", "u2")).alias("r", "u"))
    one = one.withColumn("at", F.size(F.filter("keys", lambda s: s["upto"] <= F.col("u")))).withColumn("cell", F.get("keys", F.col("at")))
    before = F.when(F.col("at") > 0, F.get("keys", F.col("at") - 1)["upto"]).otherwise(0)
    inside = F.col("u") - before
    one = one.select("by", "h", "r", F.col("cell.k").alias("k"), F.floor(inside / F.col("cell.m")).cast("int").alias("i"), F.pmod(inside, F.col("cell.m")).cast("int").alias("j"))
    a, b = (p.withColumn("k", F.col("k").cast("string")) for p in (a, b))
    one = one.join(a.select("by", "k", "i", F.col("x").alias("sx"), F.col("y").alias("sy")), ["by", "k", "i"])
    return one.join(b.select("by", "k", "j", F.col("x").alias("dx"), F.col("y").alias("dy")), ["by", "k", "j"]).select("by", "h", "r", "sx", "sy", "dx", "dy")


def best_fits(draws: DataFrame, left: DataFrame, right: DataFrame, by: str, key: str, gate: float) -> DataFrame:
    """For each sheet the similarity from ``left`` to ``right`` with the most inliers within
    ``gate``, one to one by key, nearest first; then the least rms, the first try, the plain
    variant. A try with at least three inliers is fitted again to them, and counted again.
    Columns: ``by``, h, reflected, scale, p, q, e, f (x' = p x - q y + e and y' = q x + p y + f;
    reflected ones take -y), inliers, rms."""
    three = draws.groupBy("by", "h").agg(*[F.min(F.when(F.col("r") == k, F.struct("sx", "sy", "dx", "dy"))).alias(f"p{k}") for k in range(3)]).where("p0 IS NOT NULL AND p1 IS NOT NULL AND p2 IS NOT NULL")
    flat = three.select("by", "h", *[F.col(f"p{k}.{c}").alias(f"{c}{k}") for k in range(3) for c in ("sx", "sy", "dx", "dy")])
    flat = stash(flat.withColumn("block", F.floor(F.col("h") / BLOCK)), "hypotheses")
    sides = _sited(left, by, key).withColumn("side", F.lit(0)).unionByName(_sited(right, by, key).withColumn("side", F.lit(1)))
    points = large(flat.select("by", "block").distinct()).join(large(sides.withColumn("k", F.col("k").cast("string"))), "by")
    kind = dict(flat.dtypes)["by"]
    schema = f"by {kind}, h long, reflected boolean, scale double, p double, q double, e double, f double, inliers long, rms double"

    def count(name: tuple, tries: pd.DataFrame, pts: pd.DataFrame) -> pd.DataFrame:
        best = _best_of(tries.sort_values("h"), pts.rename(columns=lambda c: c[2:]), gate)
        return pd.DataFrame([(name[0], *best)] if best else [], columns=["by", "h", "reflected", "scale", "p", "q", "e", "f", "inliers", "rms"])

    points = points.toDF(*[f"p_{c}" for c in points.columns])  # names of its own beside the tries
    blocks = flat.groupBy("by", "block").cogroup(points.groupBy("p_by", "p_block")).applyInPandas(count, schema)
    row = [c for c in blocks.columns if c != "by"]
    return blocks.groupBy("by").agg(F.min_by(F.struct(*row), F.struct((-F.col("inliers")).alias("n"), "rms", "h", "reflected")).alias("b")).select(F.col("by").alias(by), "b.*")


def ransac(left: DataFrame, right: DataFrame, by: str, key: str, gate: float, tries: int = 80_000, seed: int = 42) -> DataFrame:
    """``best_fits`` of ``tries`` seeded draws for each sheet (20 restarts of 4,000 by default).
    Sheets with fewer than three pairs of equal key, or without a fit, have no row."""
    return best_fits(drawn_pairs(left, right, by, key, tries, seed), left, right, by, key, gate)


class _Grid:
    """The right points by key and cell; cells are a gate wide."""

    def __init__(self, keys: np.ndarray, at: np.ndarray, gate: float) -> None:
        self.gate, self.size = gate, max(gate, 1e-9)
        self.low = np.floor(np.array([at.real.min(), at.imag.min()]) / self.size) - 2
        span = np.floor(np.array([at.real.max(), at.imag.max()]) / self.size) - self.low + 4
        self.columns, self.rows = int(span[0]), int(span[1])
        code = self._code(keys, at, 0)
        order = np.argsort(code, kind="stable")
        self.code, self.at, self.order = code[order], at[order], order

    def _code(self, keys: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
        x = np.clip(np.floor(at.real / self.size) - self.low[0] + step, 0, self.columns)
        y = np.clip(np.floor(at.imag / self.size) - self.low[1], 0, self.rows)
        return ((keys * (self.columns + 2) + x.astype(np.int64)) * (self.rows + 4)) + y.astype(np.int64) + 1

    def inliers(self, keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(try, left, right) of pairs, one to one in each try, nearest first; ``at`` has a row of the left
        points for each try. Sorted by try, then left."""
        tries, n = at.shape
        if tries > 1 and tries * n > POINTS:
            return self._halves(keys, at)
        flat, codes, found = at.ravel(), np.tile(keys, tries), []
        for step in (-1, 0, 1):
            code = self._code(codes, flat, step)
            low, high = np.searchsorted(self.code, code - 1, "left"), np.searchsorted(self.code, code + 1, "right")
            found.append((low, high - low))
        if tries > 1 and sum(int(many.sum()) for _, many in found) > 8 * POINTS:
            return self._halves(keys, at)
        left = np.concatenate([np.repeat(np.arange(len(flat)), many) for _, many in found])
        right = np.concatenate([np.repeat(low - np.cumsum(many) + many, many) + np.arange(int(many.sum())) for low, many in found])
        far = np.abs(flat[left] - self.at[right])
        near = far <= self.gate
        pairs, first = np.unique(left[near] * len(self.at) + right[near], return_index=True)  # edges of clipping can offer a pair twice
        left, right, far = pairs // len(self.at), pairs % len(self.at), far[near][first]
        mine = left // n
        order = np.lexsort((self.order[right], left, far, mine))
        left, right, mine = left[order], right[order], mine[order]
        met = mine * len(self.at) + right
        shared = np.zeros(tries, dtype=bool)  # tries in which a point has two partners
        for ends in (left, met):
            names, counts = np.unique(ends, return_counts=True)
            shared[names[counts > 1] // (n if ends is left else len(self.at))] = True
        if shared.any():
            used_l, used_r, keep = set(), set(), ~shared[mine]
            for k in np.flatnonzero(~keep).tolist():
                i, j = int(left[k]), int(met[k])
                if i not in used_l and j not in used_r:
                    used_l.add(i)
                    used_r.add(j)
                    keep[k] = True
            left, right, mine = left[keep], right[keep], mine[keep]
        order = np.argsort(left, kind="stable")
        return mine[order], left[order] % n, self.order[right[order]]

    def _halves(self, keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        half = len(at) // 2
        a, b = self.inliers(keys, at[:half]), self.inliers(keys, at[half:])
        return np.concatenate([a[0], b[0] + half]), np.concatenate([a[1], b[1]]), np.concatenate([a[2], b[2]])


def _fit(s: np.ndarray, d: np.ndarray) -> tuple[complex, complex] | None:
    s0, d0 = s - s.mean(), d - d.mean()
    spread = float((np.abs(s0) ** 2).sum())
    if spread <= 0:
        return None
    z = complex((s0.conj() * d0).sum() / spread)
    return z, complex(d.mean() - z * s.mean())


def _best_of(tries: pd.DataFrame, pts: pd.DataFrame, gate: float) -> tuple | None:
    names, codes = np.unique(pts["k"].to_numpy(dtype=str), return_inverse=True)
    side, at = pts["side"].to_numpy(), pts["x"].to_numpy() + 1j * pts["y"].to_numpy()
    order = np.lexsort((at.imag, at.real, codes))  # the same whatever order rows come in
    side, at, codes = side[order], at[order], codes[order].astype(np.int64)
    left, lk, right, rk = at[side == 0], codes[side == 0], at[side == 1], codes[side == 1]
    if not len(left) or not len(right):
        return None
    grid, best = _Grid(rk, right, gate), None
    drawn = tries[[f"{c}{k}" for k in range(3) for c in ("sx", "sy", "dx", "dy")]].to_numpy(dtype=float).reshape(-1, 3, 4)
    firsts = []
    for h, v in zip(tries["h"].tolist(), drawn, strict=True):
        s, d = v[:, 0] + 1j * v[:, 1], v[:, 2] + 1j * v[:, 3]
        c = v[:, :2] - v[:, :2].mean(axis=0)
        xx, yy, xy = (c[:, 0] ** 2).sum(), (c[:, 1] ** 2).sum(), (c[:, 0] * c[:, 1]).sum()
        if xx + yy <= 0 or (xx * yy - xy * xy) / (xx + yy) ** 2 < FLAT:
            continue
        for mirrored in (False, True):
            fit = _fit(s.conj() if mirrored else s, d)
            if fit is not None and SCALES[0] <= abs(fit[0]) <= SCALES[1]:
                firsts.append((int(h), mirrored, fit))
    some = max(1, POINTS // len(left))
    for lo in range(0, len(firsts), some):  # in order of tries
        part, again = firsts[lo : lo + some], []
        which, i, j = grid.inliers(lk, _moved(left, [(m, fit) for _, m, fit in part]))
        starts = np.searchsorted(which, np.arange(len(part) + 1))
        for k, (h, mirrored, _) in enumerate(part):
            a, b = starts[k], starts[k + 1]
            if b - a < LEAST:
                continue
            # equal inliers are summed in one order and about their middle, so they tie on any sheet
            mine, theirs = left[i[a:b]], right[j[a:b]]
            mine = mine.conj() if mirrored else mine
            fit = _fit(mine, theirs)
            if fit is not None:
                rms = round(float(np.sqrt(np.mean(np.abs(fit[0] * (mine - mine.mean()) - (theirs - theirs.mean())) ** 2))), 9)
                again.append((h, mirrored, fit, rms))
        if not again:
            continue
        counts = np.bincount(grid.inliers(lk, _moved(left, [(m, fit) for _, m, fit, _ in again]))[0], minlength=len(again))
        for (h, mirrored, (z, w), rms), n in zip(again, counts.tolist(), strict=True):
            if best is None or (-n, rms) < (-best[-2], best[-1]):
                best = (h, mirrored, abs(z), z.real, z.imag, w.real, w.imag, n, rms)
    return best


def _moved(left: np.ndarray, fits: list[tuple[bool, tuple[complex, complex]]]) -> np.ndarray:
    """The left points under each (mirrored, similarity), a row for each."""
    mirrored, z, w = np.array([m for m, _ in fits]), np.array([f[0] for _, f in fits]), np.array([f[1] for _, f in fits])
    return z[:, None] * np.where(mirrored[:, None], left.conj()[None, :], left[None, :]) + w[:, None]
