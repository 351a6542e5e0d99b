"""One-to-one claims inside stretches of the plane: what ``categories.matched`` does by joins, for
devices and targets whose neighbours all lie in one stretch."""

from __future__ import annotations

from collections.abc import Callable
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.operators import tiles
from spanwright.operators.graph import _contracted
from spanwright.sources.scratch import stash

#: What a target gives its device, by the target's column.
HIT = {"target_id": "id", "target_mark": "mark", "target_x": "x", "target_y": "y", "target_z": "z"}
STATUSES = ("PDF_ONLY", "NEEDS_REVIEW", "MATCH", "LOCATION_MISMATCH", "MARK_MISMATCH")


def within_tiles(devices: DataFrame, targets: DataFrame, rules: tuple, segments: Callable[[DataFrame], DataFrame], by: str = "category") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Devices (with gate) with status, dist, first, second and ``HIT`` that are settled where they
    lie; then the devices and the targets that aren't. ``segments`` gives targets (seq,
    id, ``by``, mark, x, y, z) their ends; they are shuffled without. ``by`` names the rule."""
    size = _width(rules)
    spot = lambda c: tiles.cell(F.col(c), size)
    d = devices.select("seq", F.struct(*devices.columns).alias("_d"), tiles.key(spot("x"), spot("y")).alias("_at"), F.lit(True).alias("_one"))
    own, kinds = ("seq", "id", by, "mark", "x", "y", "z", "ax", "ay", "bx", "by"), dict(segments(targets).dtypes)
    t = segments(targets.withColumn("_raw", F.struct(*targets.columns))).select("seq", "_raw", F.explode(F.array(F.struct(*own))).alias("_t"))  # made once, not again in each filter
    met = t.where(" AND ".join(f"abs(_t.{e}{axis}) < double('inf')" for e in "ab" for axis in "xy"))
    for axis in "xy":
        low, high = spot(f"_t.a{axis}"), spot(f"_t.b{axis}")
        met = met.withColumn(f"_{axis}0", F.least(low, high)).withColumn(f"_{axis}1", F.greatest(low, high))
        met = met.withColumn(f"_{axis}", F.explode(F.sequence(f"_{axis}0", f"_{axis}1")))
    met = met.select("seq", "_raw", tiles.key(F.col("_x"), F.col("_y")).alias("_at"), F.expr("_x = _x0 AND _y = _y0").alias("_one"))
    both = d.unionByName(met, allowMissingColumns=True)
    ready = tiles.dealt(both, F.col("_at")).select("_key", "_one", "_d", "_raw.*")
    ready = segments(ready).select("_key", "_one", "_d", F.when(F.col("_d").isNull(), F.struct(*own)).alias("_t"))
    out = stash(tiles.over_tiles(ready, _settled(rules, size, by), _schema(devices.dtypes, [(c, kinds[c]) for c in own])), "tiles")
    return out.where("NOT open").select("_d.*", "status", "dist", "first", "second", *HIT), out.where("open AND _d IS NOT NULL").select("_d.*"), out.where("open AND _t IS NOT NULL").select("_t.*")


def _width(rules: tuple) -> float:
    return tiles.width(max(max(r.mismatch_ft + r.ambiguity_ft, r.match_ft) for r in rules))


def _schema(device: list[tuple[str, str]], target: list[tuple[str, str]]) -> str:
    kind, kinds = lambda fields: "struct<" + ", ".join(f"`{c}`: {k}" for c, k in fields) + ">", dict(target)
    return f"_d {kind(device)}, _t {kind(target)}, status string, dist double, first {kinds['id']}, second {kinds['id']}, " + ", ".join(f"{n} {kinds[c]}" for n, c in HIT.items()) + ", open boolean"


def rest_of(devices: DataFrame, targets: DataFrame, rules: tuple, columns: list[str], by_joins: Callable[[], DataFrame], by: str = "category") -> DataFrame:
    """The open devices of ``within_tiles``, settled with the open targets: by one task where they are
    few, else ``by_joins``."""
    size = _width(rules)
    each = [devices.select(F.struct(*devices.columns).alias("_d")), targets.select(F.struct(*targets.columns).alias("_t"))]
    both = each[0].unionByName(each[1], allowMissingColumns=True).withColumn("_one", F.lit(True))
    made = tiles.in_one(both, _settled(rules, size, by), _schema(devices.dtypes, targets.dtypes))
    return stash(by_joins(), "rest") if made is None else made.select("_d.*", "status", "dist", "first", "second", *HIT).select(*columns)


def _far(px: np.ndarray, py: np.ndarray, ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray) -> np.ndarray:
    """``geometry.segment_distance``."""
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    along = np.where(square != 0, ((px - ax) * dx + (py - ay) * dy) / np.where(square != 0, square, 1.0), 0.0)
    t = np.maximum(0.0, np.minimum(1.0, along))
    return np.hypot(px - (ax + t * dx), py - (ay + t * dy))


def _settled(rules: tuple, size: float, by: str) -> tiles.Kernel:
    from spanwright.operators.matching import least_total

    each = lambda name: np.array([getattr(r, name) for r in rules])
    match, outer, margin, level, optimal, blind = (each(n) for n in ("match_ft", "mismatch_ft", "ambiguity_ft", "level_ft", "optimal", "mark_blind"))
    place = {r.category: i for i, r in enumerate(rules)}

    def ruled(column: pa.Array) -> np.ndarray:
        return pc.index_in(column, value_set=pa.array(list(place), type=column.type)).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)

    def kernel(table: pa.Table, low: int, high: int) -> pa.Table:
        is_d = table["_d"].is_valid().to_numpy()
        one = table["_one"].to_numpy()
        d_at, t_at = np.flatnonzero(is_d), np.flatnonzero(~is_d)
        col = lambda side, name: pc.struct_field(side, name)
        ds, ts = table["_d"].combine_chunks().take(pa.array(d_at)), table["_t"].combine_chunks().take(pa.array(t_at))
        t_seq = col(ts, "seq").to_numpy(zero_copy_only=False)
        only = np.unique(t_seq, return_index=True)[1]  # a target is in each of its cells
        mine = np.zeros(len(only), dtype=bool)
        np.logical_or.at(mine, np.searchsorted(t_seq[only], t_seq), one[t_at])  # whether the copy that stands for it is here
        ts, t_seq = ts.take(pa.array(only)), t_seq[only]
        d_seq, nd, nt = col(ds, "seq").to_numpy(zero_copy_only=False), len(d_at), len(only)
        dc, tc = ruled(col(ds, by)), ruled(col(ts, by))
        x, y, dz, gate = (tiles.numbers(col(ds, n)) for n in ("x", "y", "z", "gate"))
        ends = {n: tiles.numbers(col(ts, n)) for n in ("ax", "ay", "bx", "by")}
        tz = tiles.numbers(col(ts, "z"))
        alone = ~(np.isfinite(x) & np.isfinite(y)) | (dc < 0)
        marks = tiles.codes(pa.concat_arrays([col(ds, "mark"), col(ts, "mark")]))
        dm, tm = marks[:nd], marks[nd:]

        # candidates: devices by their cell, targets by all of theirs
        lo, hi = ({a: tiles.cells(np.minimum(ends[f"a{a}"], ends[f"b{a}"]) if k == 0 else np.maximum(ends[f"a{a}"], ends[f"b{a}"]), size) for a in "xy"} for k in (0, 1))
        wide, tall = hi["x"] - lo["x"] + 1, hi["y"] - lo["y"] + 1
        many = wide * tall
        which = np.repeat(np.arange(nt), many)
        step = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
        kept = tc[which] >= 0
        which, step = which[kept], step[kept]
        at = np.flatnonzero(~alone)
        cx, cy = tiles.cells(x[at], size), tiles.cells(y[at], size)
        met = tiles.neighbours(dc[at], cx, cy, tc[which], lo["x"][which] + step % wide[which], lo["y"][which] + step // wide[which])
        bounds = [np.concatenate(v) for v in zip(tiles.around((cx, cy), (cx, cy)), tiles.around((lo["x"], lo["y"]), (hi["x"], hi["y"])), strict=True)]
        inside = np.ones(nd + nt, dtype=bool)
        inside[np.concatenate([at, np.arange(nd, nd + nt)])] = (bounds[0] >= low) & (bounds[1] <= high)
        if met is None:
            met, inside = (np.empty(0, np.int64),) * 2, np.concatenate([alone, np.zeros(nt, dtype=bool)])
        pair = np.unique(at[met[0]] * (nt + 1) + which[met[1]])
        i, j = pair // (nt + 1), pair % (nt + 1)
        dist = _far(x[i], y[i], *[ends[n][j] for n in ("ax", "ay", "bx", "by")])
        c = dc[i]
        same = (dm[i] == tm[j]) & (dm[i] >= 0) & (dist <= outer[c] + margin[c])
        loose = blind[c] & (dist <= match[c])
        undone = tiles.open_ones(nd + nt, inside, np.stack([i, j + nd], axis=1)[same | loose], _contracted)
        good = (same | loose) & ~undone[i]
        i, j, dist, c, same, loose = (v[good] for v in (i, j, dist, c, same, loose))

        names = pc.sort_indices(col(ts, "id")).to_numpy()
        by_name = np.empty(nt, np.int64)
        by_name[names] = np.arange(nt)
        state, hit, far = np.zeros(nd, np.int64), np.full(nd, -1), np.full(nd, np.nan)
        first, second = np.full(nd, -1), np.full(nd, -1)

        # the two nearest of the same mark
        s = np.flatnonzero(same)
        s = s[np.lexsort((by_name[j[s]], dist[s], i[s]))]
        if len(s):
            starts = np.flatnonzero(np.concatenate([[True], i[s][1:] != i[s][:-1]]))
            two = np.diff(np.append(starts, len(s))) > 1
            head, nxt = s[starts], s[np.minimum(starts + 1, len(s) - 1)]
            tie = two & (dist[head] <= outer[c[head]]) & (dist[nxt] - dist[head] < margin[c[head]])
            who = i[head[tie]]
            first[who], second[who], state[who] = j[head[tie]], j[nxt[tie]], 1
        tied = state == 1

        # least totals: decisive devices first, in order, then the rest
        planned: set[tuple[int, int]] = set()
        e = np.flatnonzero(same & optimal[c])
        for rule in np.unique(c[e]):
            own = e[c[e] == rule]
            own = own[np.lexsort((t_seq[j[own]], dist[own], d_seq[i[own]]))]
            pinned, rest = set(), {}
            rows = zip(i[own].tolist(), j[own].tolist(), dist[own].tolist(), strict=True)
            for dev, near in groupby(rows, key=itemgetter(0)):
                near = list(near)
                if near[0][2] <= gate[dev] and (len(near) == 1 or near[1][2] - near[0][2] >= margin[rule]) and near[0][1] not in pinned:
                    pinned.add(near[0][1])
                    planned.add((dev, near[0][1]))
                else:
                    rest[dev] = near
            options = {int(d_seq[dev]): [(int(t_seq[g]), w) for _, g, w in near if w <= outer[rule] and g not in pinned] for dev, near in rest.items()}
            d_of, t_of = {int(d_seq[dev]): dev for dev in rest}, {int(t_seq[g]): g for near in rest.values() for _, g, _ in near}
            planned |= {(d_of[a], t_of[b]) for a, b in least_total({a: o for a, o in options.items() if o}, 1000 * float(outer[rule])).items()}

        # claims in order of distance, planned pairs first
        e = np.flatnonzero(same & (dist <= outer[c]) & ~tied[i])
        rank = np.array([(a, b) not in planned for a, b in zip(i[e].tolist(), j[e].tolist(), strict=True)], dtype=np.int64)
        e = e[np.lexsort((t_seq[j[e]], d_seq[i[e]], dist[e], rank))]
        off = (np.abs(dz[i[e]] - tz[j[e]]) > level[c[e]]) & (dist[e] <= gate[i[e]])
        used_d, used_t = set(), set()
        for k, a, b, away in zip(e.tolist(), i[e].tolist(), j[e].tolist(), off.tolist(), strict=True):
            if a not in used_d and b not in used_t:
                used_d.add(a)
                far[a] = dist[k]
                if away:
                    state[a] = 1
                else:
                    used_t.add(b)
                    hit[a], state[a] = b, 2 if dist[k] <= gate[a] else 3

        # what is left, whatever its mark
        e = np.flatnonzero(loose)
        e = e[np.lexsort((t_seq[j[e]], d_seq[i[e]], dist[e]))]
        for k, a, b in zip(e.tolist(), i[e].tolist(), j[e].tolist(), strict=True):
            if state[a] == 0 and b not in used_t:
                used_t.add(b)
                hit[a], far[a], state[a] = b, dist[k], 4

        d_open, t_open = undone[:nd], np.flatnonzero(undone[nd:] & mine)
        ids, nothing = col(ts, "id"), lambda kind: pa.nulls(len(t_open), type=kind)
        chosen = lambda values, index: pa.concat_arrays([values.take(pa.array(index, mask=index < 0)), nothing(values.type)])
        out = {
            "_d": pa.concat_arrays([ds, nothing(ds.type)]), "_t": pa.concat_arrays([pa.nulls(nd, type=ts.type), ts.take(pa.array(t_open))]),
            "status": pa.concat_arrays([pa.array(STATUSES).take(pa.array(state)), nothing(pa.string())]),
            "dist": pa.concat_arrays([pa.array(far, mask=np.isnan(far)), nothing(pa.float64())]),
            "first": chosen(ids, first), "second": chosen(ids, second), **{n: chosen(col(ts, k), hit) for n, k in HIT.items()},
            "open": pa.array(np.concatenate([d_open, np.ones(len(t_open), dtype=bool)])),
        }
        return pa.table(out)

    return kernel
