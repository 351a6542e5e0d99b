"""One-to-one matching of devices with targets, and the evidence that settles ties.

Devices have seq, id, mark, x, y and may have z, orientation_deg, sheets; targets have seq, id,
mark, x, y and may have z, orientation_deg, level. Candidate pairs come from grid joins.
"""

from __future__ import annotations

import functools
import heapq
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwright.config import Gates
from spanwright.functions.geometry import angle_delta, segment_distance
from spanwright.operators.claims import rest_of, within_tiles
from spanwright.operators.graph import connected_components
from spanwright.operators.parts import over_parts
from spanwright.operators.spatial import within
from spanwright.sources.scratch import stash


#: Rounds of mutual least edges before what is left is taken in order by connected parts.
ROUNDS = 3


def greedy_pairs(edges: DataFrame) -> DataFrame:
    """Edges (d, t, dist, ...) that a greedy pass in the order (dist, d, t) would take.

    An edge that is the least of both its ends is taken by greedy whatever came before; those
    are taken together, edges at their ends are dropped, and so on for some rounds. Minima are
    aggregates, so an end with many edges is summed on the map side. What is left then, chains
    of falling distances, is taken in order inside connected parts."""
    return claimed(edges.withColumn("off", F.lit(False))).drop("off")


def ambiguous(pairs: DataFrame, gates: Gates) -> DataFrame:
    """(d, first, second, best, clear) for devices whose two nearest targets of the same mark
    are closer to each other in distance than the margin, the best within the outer gate.
    ``pairs`` must reach to the outer gate plus the margin."""
    near = pairs.groupBy("d").agg(F.slice(F.array_sort(F.collect_list(F.struct("dist", "target"))), 1, 2).alias("two"))
    two = F.col("two")
    return near.where((F.size(two) == 2) & (two[0]["dist"] <= gates.mismatch_ft) & (two[1]["dist"] - two[0]["dist"] < gates.ambiguity_ft)).select("d", two[0]["target"].alias("first"), two[1]["target"].alias("second"))


def adaptive_gate(devices: DataFrame, sheets: DataFrame, gates: Gates) -> DataFrame:
    """(d, gate): the match gate, widened by the worst registration residual (rms / scale) of
    the device's sheets, up to ``ceiling`` times."""
    each = devices.select(F.col("seq").alias("d"), F.explode_outer("sheets").alias("sheet")).join(sheets.select("sheet", "rms", "scale"), "sheet", "left")
    worst = F.max(F.when(F.col("scale") > 0, F.col("rms") / F.col("scale")))
    return each.groupBy("d").agg(F.least(gates.match_ft + F.coalesce(worst, F.lit(0.0)), F.lit(gates.match_ft * gates.ceiling)).alias("gate"))


def least_total(options: dict[int, list[tuple[int, float]]], alone: float) -> dict[int, int]:
    """The columns that rows get so that the sum is least: ``options`` are a row's (column, cost),
    and ``alone`` is what a row without a column costs. Shortest augmenting paths over the
    options only, with dual prices and a heap, so rows far from each other cost nothing. Costs
    count in billionths, as whole numbers, so equal sums tie; then fewer rows are moved, and
    earlier rows keep what they have."""
    whole = lambda cost: round(cost * 10**9)
    row_price: dict[int, int] = dict.fromkeys(options, 0)
    col_price: dict[tuple, int] = {}
    owner: dict[tuple, int] = {}
    for start in sorted(options):
        dist: dict[tuple, tuple[int, int]] = {}
        before: dict[tuple, tuple | None] = {}
        done: set[tuple] = set()
        heap: list[tuple[tuple[int, int], tuple]] = []
        row, here, base, moved = start, None, 0, 0
        while True:
            for col, cost in [*(((0, c), w) for c, w in options[row]), ((1, row), alone)]:
                far = (base + whole(cost) - row_price[row] - col_price.get(col, 0), moved)
                if col not in done and (col not in dist or far < dist[col]):
                    dist[col], before[col] = far, here
                    heapq.heappush(heap, (far, col))
            (base, moved), here = heapq.heappop(heap)
            while here in done:
                (base, moved), here = heapq.heappop(heap)
            moved += 1
            done.add(here)
            if here not in owner:
                break
            row = owner[here]
        for col in done - {here}:
            row_price[owner[col]] += base - dist[col][0]
            col_price[col] = col_price.get(col, 0) - (base - dist[col][0])
        row_price[start] += base
        while here is not None:
            back = before[here]
            owner[here] = start if back is None else owner[back]
            here = back
    return {row: col for (kind, col), row in owner.items() if kind == 0}


def optimal_pairs(edges: DataFrame, gates: Gates) -> DataFrame:
    """(d, t) pairs of least total distance for each mark, after decisive devices (best within
    their gate and clear of the next by the margin) have taken theirs in device order.
    ``edges`` (d, t, dist, gate and, where they differ by row, outer and margin) reach to the
    outer gate plus the margin. Devices and targets that share no edge don't affect each other,
    so the kernel runs on connected parts, and in a part only along its edges."""
    for name, value in (("outer", gates.mismatch_ft), ("margin", gates.ambiguity_ft)):
        edges = edges if name in edges.columns else edges.withColumn(name, F.lit(value))
    links = edges.select((F.col("d") * 2).alias("a"), (F.col("t") * 2 + 1).alias("b"))
    roots = connected_components(links)
    parts = edges.join(roots.select(F.col("v").alias("_v"), "root"), edges.d * 2 == F.col("_v")).drop("_v")

    def solve(part: list[tuple]) -> list[tuple[int, int]]:
        """``part``: (d, t, dist, gate, outer, margin) by d, then distance."""
        chosen, pinned, rest = [], set(), {}
        for d, group in groupby(part, key=itemgetter(0)):
            near = list(group)
            _, t, dist, gate, _, margin = near[0]
            if dist <= gate and (len(near) == 1 or near[1][2] - dist >= margin) and t not in pinned:
                chosen.append((d, t))
                pinned.add(t)
            else:
                rest[d] = near
        options = {d: [(t, dist) for _, t, dist, _, outer, _ in near if dist <= outer and t not in pinned] for d, near in rest.items()}
        alone = 1000 * max((near[0][4] for near in rest.values()), default=0.0)
        return chosen + list(least_total(options, alone).items())

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = zip(*[pdf[c].tolist() for c in ("root", "d", "t", "dist", "gate", "outer", "margin")], strict=True)
        chosen = [x for _, part in groupby(rows, key=itemgetter(0)) for x in solve([r[1:] for r in part])]
        return pd.DataFrame(chosen, columns=["d", "t"], dtype="int64")

    return over_parts(parts, "root", ["d", "dist", "t"], ["d", "t", "dist", "gate", "outer", "margin"], each, "d long, t long")


def assign(devices: DataFrame, targets: DataFrame, sheets: DataFrame, gates: Gates, mark_blind: bool = True, optimal: bool = False) -> DataFrame:
    """Devices with status, target_id, target_mark, distance_ft and the tied candidates.

    First targets of the same mark: ambiguous devices are set aside for review; the others
    claim greedily (or optimally first); a winner on another level sends the device to review
    and leaves the target free. Then, if ``mark_blind``, what is left claims by distance alone
    within the base gate, as a mismatch of marks."""
    from spanwright.operators.categories import Rule, gated

    devices, targets = filled(devices).drop("level"), filled(targets)
    rule = Rule("", gates.match_ft, gates.mismatch_ft, gates.ambiguity_ft, gates.level_ft, gates.ceiling, mark_blind, optimal)
    mine = gated(devices.withColumns({"_rule": F.lit(""), "match_ft": F.lit(rule.match_ft), "ceiling": F.lit(rule.ceiling)}), sheets).drop("match_ft", "ceiling")
    points = lambda t: t.withColumns({f"{end}{axis}": F.col(axis) for end in "ab" for axis in "xy"})
    done, left_d, left_t = within_tiles(mine, targets.select("seq", "id", F.lit("").alias("_rule"), "mark", "x", "y", "z"), (rule,), points, "_rule")
    rest = rest_of(left_d, left_t, (rule,), done.columns, lambda: _assigned(left_d, left_t, gates, mark_blind, optimal), "_rule")
    distance = F.when(F.col("target_id").isNotNull(), F.bround("dist", 2))
    return done.unionByName(rest).withColumn("distance_ft", distance).drop("dist", "_rule")


def _assigned(devices: DataFrame, targets: DataFrame, gates: Gates, mark_blind: bool, optimal: bool) -> DataFrame:
    """The same by joins, for any devices (with gate), with ``dist``."""
    reach = gates.mismatch_ft + gates.ambiguity_ft
    limits = devices.select(F.col("seq").alias("d"), "gate")
    pairs = within(devices.select("seq", "mark", "x", "y", "z"), targets.select("seq", "id", "mark", "x", "y", "z"), reach, "mark")
    pairs = pairs.select(F.col("seq").alias("d"), F.col("r_seq").alias("t"), F.col("r_id").alias("target"), "dist", "z", F.col("r_z").alias("tz")).join(limits, "d")
    pairs = stash(pairs, "pairs")
    tied = stash(ambiguous(pairs, gates), "tied")
    open_ = pairs.join(tied, "d", "left_anti").where(F.col("dist") <= gates.mismatch_ft)
    off = F.coalesce((F.abs(F.col("z") - F.col("tz")) > gates.level_ft) & (F.col("dist") <= F.col("gate")), F.lit(False))
    edges = open_.select("d", "t", "dist", "gate", off.alias("off"))
    if optimal:
        first = optimal_pairs(pairs, gates).withColumn("_rank", F.lit(0.0))
        edges = edges.join(first, ["d", "t"], "left").withColumn("dist", F.struct(F.coalesce("_rank", F.lit(1.0)).alias("r"), F.col("dist").alias("x"))).drop("_rank")
    won = stash(claimed(edges), "claims")
    far = F.col("dist.x") if optimal else F.col("dist")
    same = won.select("d", F.when(~F.col("off"), F.col("t")).alias("t"), far.alias("dist"), F.when(F.col("off"), "NEEDS_REVIEW").when(far <= F.col("gate"), "MATCH").otherwise("LOCATION_MISMATCH").alias("status"))
    review = tied.select("d", F.lit(None).cast("long").alias("t"), F.lit(None).cast("double").alias("dist"), F.lit("NEEDS_REVIEW").alias("status"))
    done = stash(same.unionByName(review), "done")
    if mark_blind:
        rest_d = devices.join(done.select(F.col("d").alias("seq")), "seq", "left_anti").select("seq", "x", "y")
        rest_t = targets.join(done.where("t IS NOT NULL").select(F.col("t").alias("seq")), "seq", "left_anti").select("seq", "x", "y")
        blind = greedy_pairs(within(rest_d, rest_t, gates.match_ft).select(F.col("seq").alias("d"), F.col("r_seq").alias("t"), "dist"))
        done = done.unionByName(blind.select("d", "t", "dist", F.lit("MARK_MISMATCH").alias("status")))
    mine = targets.select(F.col("seq").alias("t"), F.col("id").alias("target_id"), F.col("mark").alias("target_mark"), F.col("x").alias("target_x"), F.col("y").alias("target_y"), F.col("z").alias("target_z"))
    joined = devices.join(done.withColumnRenamed("d", "seq"), "seq", "left").join(mine, "t", "left").drop("t").join(tied.withColumnRenamed("d", "seq"), "seq", "left")
    return joined.withColumn("status", F.coalesce("status", F.lit("PDF_ONLY")))


def filled(df: DataFrame) -> DataFrame:
    """With null for evidence that the table doesn't have."""
    for name, kind in (("z", "double"), ("orientation_deg", "double"), ("level", "string")):
        df = df if name in df.columns else df.withColumn(name, F.lit(None).cast(kind))
    return df


def claimed(edges: DataFrame) -> DataFrame:
    """Greedy claims in which a winning edge that is ``off`` (another level) ends its device but
    leaves its target: rounds as in ``greedy_pairs``, but only claims use up targets."""
    order = F.struct("dist", "d", "t")
    left, taken = stash(edges, "edges"), []
    for _ in range(ROUNDS):
        least_d = left.groupBy("d").agg(F.min(order).alias("o"))
        least_t = left.groupBy("t").agg(F.min(order).alias("o"))
        tops = least_d.join(least_t.select(F.col("t").alias("tt"), F.col("o").alias("ot")), F.col("o.t") == F.col("tt")).where(F.col("o") == F.col("ot")).select(F.col("o.d").alias("d"), F.col("o.t").alias("t"))
        won = stash(left.join(tops, ["d", "t"]), "won")
        taken.append(won)
        left = stash(left.join(won.select("d"), "d", "left_anti").join(won.where("NOT off").select("t"), "t", "left_anti"), "edges")
        if left.isEmpty():
            break
    else:
        taken.append(_in_order(left))
    return functools.reduce(DataFrame.unionByName, taken)


def _in_order(left: DataFrame) -> DataFrame:
    """The rows of ``left`` that one pass in order takes, by connected parts."""
    roots = connected_components(left.select((F.col("d") * 2).alias("a"), (F.col("t") * 2 + 1).alias("b")))
    parts = left.join(roots.select(F.col("v").alias("_v"), "root"), left.d * 2 == F.col("_v"))

    def one_pass(pdf: pd.DataFrame) -> pd.DataFrame:
        used_d, used_t, out = set(), set(), []  # ids are not shared between parts
        for d, t, off in zip(pdf["d"].tolist(), pdf["t"].tolist(), pdf["off"].tolist(), strict=True):
            if d not in used_d and t not in used_t:
                out.append((d, t))
                used_d.add(d)
                if not off:
                    used_t.add(t)
        return pd.DataFrame(out, columns=["d", "t"], dtype="int64")

    took = over_parts(parts, "root", ["dist", "d", "t"], ["d", "t", "off"], one_pass, "d long, t long")
    return left.join(took, ["d", "t"])


#: Devices that a pass over ties can change.
TIED = "coalesce(status = 'NEEDS_REVIEW' AND first IS NOT NULL, false)"


def tie_candidates(assigned: DataFrame, targets: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """One row for each tied device and candidate, with the candidate's properties and whether
    it is claimed (in ``claims``, if ``assigned`` are only some devices)."""
    claimed = (assigned if claims is None else claims).where("target_id IS NOT NULL").select(F.col("target_id").alias("_c")).distinct()
    each = assigned.where("status = 'NEEDS_REVIEW' AND first IS NOT NULL").withColumn("candidate", F.explode(F.array("first", "second")))
    named = {"id": "_id", "level": "c_level", "orientation_deg": "c_deg", "x": "cx", "y": "cy", "mark": "c_mark"}
    line = [c for c in ("ax", "ay", "bx", "by") if c in targets.columns]
    t = filled(targets).select(*[F.col(c).alias(n) for c, n in named.items()], *[F.col(c).alias(f"_{c}") for c in line])
    joined = each.join(t, each.candidate == t["_id"]).join(claimed, F.col("candidate") == F.col("_c"), "left")
    far = segment_distance(F.col("x"), F.col("y"), *[F.col(f"_{c}") for c in line]) if line else F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy"))
    return joined.withColumn("claimed", F.col("_c").isNotNull()).withColumn("dist", far).drop("_id", "_c", *[f"_{c}" for c in line])


def _settle(assigned: DataFrame, targets: DataFrame, agrees: Column, usable: Column, name: str, gates: Gates, split: bool = False, tied: DataFrame | None = None) -> DataFrame:
    """Gives tied devices their only agreeing, unclaimed candidate within the outer gate, in
    device order, as each claim can take another device's candidate. Only devices that share
    a candidate meet, so the ordered kernel runs on connected parts. ``split``: a tie whose
    candidates all agree, claimed or not, stays open. Only tied devices are joined (``tied``, if they
    have more columns); the others stay as they are."""
    tied = assigned.where(TIED) if tied is None else tied
    cands = stash(tie_candidates(tied, targets, assigned).select("seq", "candidate", "c_mark", "cx", "cy", "dist", "claimed", agrees.alias("agrees"), usable.alias("usable")), "cands")
    links = cands.groupBy("candidate").agg(F.min("seq").alias("b")).join(cands, "candidate").select(F.col("seq").alias("a"), "b")
    parts = cands.join(connected_components(links).withColumnRenamed("v", "seq"), "seq", "left").withColumn("root", F.coalesce("root", "seq"))
    outer = gates.mismatch_ft

    def in_order(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(pdf.loc[pdf["claimed"], "candidate"]), []  # candidates are not shared between parts
        rows = zip(*[pdf[c].tolist() for c in ("seq", "candidate", "agrees", "usable", "dist")], strict=True)
        for seq, two in groupby(rows, key=itemgetter(0)):
            two = list(two)
            fits = [r for r in two if r[2] and r[1] not in taken]
            if len(two) == 2 and len(fits) == 1 and all(r[3] for r in two) and fits[0][4] <= outer and not (split and all(r[2] for r in two)):
                out.append((seq, fits[0][1]))
                taken.add(fits[0][1])
        return pd.DataFrame(out, columns=["seq", "candidate"])

    won = over_parts(parts, "root", ["seq", "candidate"], ["seq", "candidate", "agrees", "usable", "claimed", "dist"], in_order, "seq long, candidate string")
    take = won.join(cands.select("seq", "candidate", "c_mark", "cx", "cy", "dist"), ["seq", "candidate"]).withColumnRenamed("seq", "_s")
    old = tied.join(take, tied.seq == take["_s"], "left")
    hit = F.col("_s").isNotNull()
    new = {
        "status": F.when(F.col("dist") <= F.coalesce("gate", F.lit(gates.match_ft)), "MATCH").otherwise("LOCATION_MISMATCH"),
        "target_id": F.col("candidate"), "target_mark": F.col("c_mark"), "target_x": F.col("cx"), "target_y": F.col("cy"),
        "distance_ft": F.bround("dist", 2), "resolved_by": F.lit(name),
    }
    settled = stash(old.select(*[(F.when(hit, new[c]).otherwise(F.col(c)) if c in new else F.col(c)).alias(c) for c in assigned.columns]), "settled")
    return assigned.where(f"NOT {TIED}").unionByName(settled)


def settle_by_orientation(assigned: DataFrame, targets: DataFrame, gates: Gates) -> DataFrame:
    known = F.col("orientation_deg").isNotNull() & F.col("c_deg").isNotNull()
    agrees = F.coalesce(angle_delta(F.col("orientation_deg"), F.col("c_deg")) <= gates.orientation_deg, F.lit(False))
    return _settle(with_resolved(assigned), targets, agrees, known, "orientation", gates)


def consensus(assigned: DataFrame, targets: DataFrame, gates: Gates) -> DataFrame:
    """(sheet, value): the level that a sheet's own matches agree on. Matches decide (the first
    seen on equal counts, and only with the needed share); location mismatches may back the
    winner, never overturn it. Devices that were ever tied don't vote."""
    voters = assigned.where("first IS NULL AND status IN ('MATCH', 'LOCATION_MISMATCH')").join(filled(targets).select(F.col("id").alias("target_id"), F.col("level").alias("value")), "target_id").where("value IS NOT NULL")
    votes = voters.select("seq", "status", "value", F.explode("sheets").alias("sheet")).groupBy("sheet", "value").agg(F.count_if(F.col("status") == "MATCH").alias("sure"), F.count_if(F.col("status") != "MATCH").alias("weak"), F.min(F.when(F.col("status") == "MATCH", F.col("seq"))).alias("seen"))
    top = votes.groupBy("sheet").agg(F.sum("sure").alias("all"), F.max_by(F.struct("value", "sure", "weak"), F.struct("sure", -F.col("seen"))).alias("top"))
    good = (F.col("top.sure") > 0) & (F.col("top.sure") >= gates.context_share * F.col("all")) & (F.col("top.sure") + F.col("top.weak") >= gates.context_samples)
    return top.where(good).select("sheet", F.col("top.value").alias("value"))


def settle_by_context(assigned: DataFrame, targets: DataFrame, gates: Gates) -> DataFrame:
    """The sheets' consensus is taken once, before any claim of this pass."""
    agreed = stash(consensus(assigned, targets, gates), "consensus")
    assigned = with_resolved(assigned)
    tied = assigned.where(TIED)
    places = tied.select("seq", F.posexplode("sheets").alias("pos", "sheet")).join(agreed, "sheet").groupBy("seq").agg(F.min_by("value", "pos").alias("_value"))
    known = stash(tied.join(places, "seq", "left"), "known")
    agrees = F.coalesce(F.col("c_level") == F.col("_value"), F.lit(False))
    return _settle(assigned, targets, agrees, F.col("_value").isNotNull(), "level", gates, split=True, tied=known)


def with_resolved(df: DataFrame) -> DataFrame:
    return df if "resolved_by" in df.columns else df.withColumn("resolved_by", F.lit(None).cast("string"))


def absorb(matched: DataFrame, free: DataFrame, gate: float) -> DataFrame:
    """(target, device, dist): unclaimed targets next to a matched device of their mark."""
    near = within(free.select("id", "mark", "x", "y"), matched.select("id", "mark", "x", "y"), gate, "mark")
    return near.groupBy("id").agg(F.min(F.struct("dist", F.col("r_id").alias("device"))).alias("b")).select(F.col("id").alias("target"), "b.device", "b.dist")
