"""Walls on sheets: callouts and the tips of their leaders against wall centre lines."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwright.config import Gates
from spanwright.functions.geometry import distance
from spanwright.operators.matching import greedy_pairs
from spanwright.operators.spatial import segments_within, within


def match_walls(callouts: DataFrame, tips: DataFrame, walls: DataFrame, sheets: DataFrame, gates: Gates = Gates()) -> DataFrame:
    """(kind, sheet, callout, wall, dist, anchor, status) of each callout, and of walls that no
    callout has.

    ``callouts``: seq, sheet, mark, x, y. ``tips``: callout, x, y of leader ends. ``walls``: seq,
    sheet, mark, ax, ay, bx, by on the sheet. ``sheets``: sheet, projected (has a transform),
    usable (good enough for verdicts). A callout's distance to a wall of its mark is the least
    over its bubble and its tips; pairs within the outer gate are claimed one to one, nearest
    first."""
    known = sheets.where("projected")
    bubble = callouts.select("seq", "sheet", "mark", "x", "y", F.lit(0).alias("rank"))
    ends = tips.select(F.col("callout").alias("seq"), "x", "y").join(callouts.select("seq", "sheet", "mark"), "seq").select("seq", "sheet", "mark", "x", "y", F.lit(1).alias("rank"))
    place = F.concat_ws("|", "sheet", "mark")
    anchors = bubble.unionByName(ends).join(known.select("sheet"), "sheet").withColumn("place", place)
    near = segments_within(anchors, walls.withColumn("place", place), gates.wall_mismatch_pt, "place")
    pairs = near.groupBy(F.col("seq").alias("d"), F.col("r_seq").alias("t")).agg(F.min(F.struct("dist", "rank")).alias("b")).select("d", "t", "b.dist", "b.rank")
    won = greedy_pairs(pairs)
    verdict = F.when(~F.col("usable"), "NEEDS_REVIEW").when(F.col("dist") <= gates.wall_match_pt, "MATCH").otherwise("LOCATION_MISMATCH")
    status = F.when(~F.coalesce("projected", F.lit(False)), "NEEDS_REVIEW").when(F.col("t").isNull(), "PDF_ONLY").otherwise(verdict)
    rows = callouts.select(F.col("seq").alias("d"), "sheet").join(won, "d", "left").join(sheets, "sheet", "left")
    mine = rows.select("sheet", F.col("d").alias("callout"), F.col("t").alias("wall"), "dist", F.when(F.col("rank") == 1, "leader_tip").when(F.col("rank") == 0, "bubble").alias("anchor"), status.alias("status"))
    free = walls.join(won.select(F.col("t").alias("seq")), "seq", "left_anti").select("sheet", F.lit(None).cast("long").alias("callout"), F.col("seq").alias("wall"), F.lit(None).cast("double").alias("dist"), F.lit(None).cast("string").alias("anchor"), F.lit("REVIT_ONLY").alias("status"))
    return mine.unionByName(free)


@dataclass(frozen=True)
class Adapter:
    """How a category is matched: its gates in feet, and ``far``, a builder of the column of the
    distance between a device (x, y) and a target's columns under ``r_``."""

    category: str
    match_ft: float
    mismatch_ft: float
    far: Callable[[], Column]


def point_adapter(category: str, gates: Gates = Gates()) -> Adapter:
    return Adapter(category, gates.match_ft, gates.mismatch_ft, lambda: distance(F.col("x"), F.col("y"), F.col("r_x"), F.col("r_y")))


def wall_adapter(category: str, gates: Gates = Gates()) -> Adapter:
    """Distance to a wall's centre line less half its thickness, none inside."""
    from spanwright.functions.geometry import segment_distance

    line = lambda: segment_distance(F.col("x"), F.col("y"), F.col("r_ax"), F.col("r_ay"), F.col("r_bx"), F.col("r_by"))
    return Adapter(category, gates.wall_match_ft, gates.wall_mismatch_ft, lambda: F.greatest(line() - F.coalesce(F.col("r_thickness"), F.lit(0.0)) / 2, F.lit(0.0)))


def match_category(devices: DataFrame, targets: DataFrame, adapter: Adapter, reach: float) -> DataFrame:
    """(d, t, dist, status): one-to-one by mark under the adapter's distance and gates.
    ``reach``: how far a target's place (x, y) can be from a device that its distance admits."""
    near = within(devices, targets, reach, "mark").withColumn("dist", adapter.far()).where(F.col("dist") <= adapter.mismatch_ft)
    won = greedy_pairs(near.select(F.col("seq").alias("d"), F.col("r_seq").alias("t"), "dist"))
    return won.withColumn("status", F.when(F.col("dist") <= adapter.match_ft, "MATCH").otherwise("LOCATION_MISMATCH"))
