"""Distance joins by grid cells: equal-key joins on cells instead of joins on an inequality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanwright.functions.geometry import distance, segment_distance
from spanwright.sources.scratch import large


def _cell(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("long")


def within(left: DataFrame, right: DataFrame, gate: float, key: str | None = None, box: bool = False) -> DataFrame:
    """Pairs of rows at most ``gate`` apart (both need x, y), with equal ``key`` if given.

    Cells are two gates wide; left rows are sent to the cells that a square of a gate around
    them touches (four on average), right rows to their own, so each pair meets once. Columns of
    ``left`` keep their names, those of ``right`` get the prefix ``r_``; ``dist`` is added.
    ``box``: the larger of |dx| and |dy| instead of the distance. Rows without coordinates, or
    with a null key, meet nothing."""
    size = 2 * gate

    def touched(c: str) -> Column:
        reach = F.lit(gate) + (F.abs(F.col(c)) + gate) * 1e-12  # more than rounding can take off
        return F.sequence(_cell(F.col(c) - reach, size), _cell(F.col(c) + reach, size))

    a = left.where("x IS NOT NULL AND y IS NOT NULL").withColumn("_cx", F.explode(touched("x"))).withColumn("_cy", F.explode(touched("y")))
    b = right.where("x IS NOT NULL AND y IS NOT NULL").select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    b = b.withColumn("_rx", _cell(F.col("r_x"), size)).withColumn("_ry", _cell(F.col("r_y"), size))
    on = (F.col("_cx") == F.col("_rx")) & (F.col("_cy") == F.col("_ry"))
    if key:
        on &= F.col(key) == F.col(f"r_{key}")
    far = F.greatest(F.abs(F.col("x") - F.col("r_x")), F.abs(F.col("y") - F.col("r_y"))) if box else distance(F.col("x"), F.col("y"), F.col("r_x"), F.col("r_y"))
    return large(a).join(large(b), on).withColumn("dist", far).where(F.col("dist") <= gate).drop("_cx", "_cy", "_rx", "_ry")


def nearest_k(left: DataFrame, right: DataFrame, gate: float, k: int, by: str, key: str | None = None) -> DataFrame:
    """The ``k`` nearest right rows of each left row (named by ``by``), with their rank."""
    w = Window.partitionBy(by).orderBy("dist", f"r_{by}")
    return within(left, right, gate, key).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def segments_within(points: DataFrame, segments: DataFrame, gate: float, key: str | None = None) -> DataFrame:
    """Pairs of points (x, y) and segments (ax, ay, bx, by) at most ``gate`` apart, with
    ``dist``. A segment is sent to all cells of its bounding box, grown by the gate; cells are
    four gates wide, so a segment of length L goes to about (L / (4 gate) + 2) squared cells.
    """
    size = 4 * gate
    low = lambda a, b: _cell(F.least(a, b) - gate, size)
    high = lambda a, b: _cell(F.greatest(a, b) + gate, size)
    b = segments.select(*[F.col(c).alias(f"r_{c}") for c in segments.columns])
    ax, ay, bx, by = (F.col(f"r_{c}") for c in ("ax", "ay", "bx", "by"))
    b = b.withColumn("_rx", F.explode(F.sequence(low(ax, bx), high(ax, bx)))).withColumn("_ry", F.explode(F.sequence(low(ay, by), high(ay, by))))
    on = (_cell(points["x"], size) == F.col("_rx")) & (_cell(points["y"], size) == F.col("_ry"))
    if key:
        on &= points[key] == F.col(f"r_{key}")
    far = segment_distance(points["x"], points["y"], ax, ay, bx, by)
    return large(points).join(large(b), on).withColumn("dist", far).where(F.col("dist") <= gate).drop("_rx", "_ry")


def attach_nearest(members: DataFrame, bodies: DataFrame, gate: float, token: str = "token") -> DataFrame:
    """Each member's nearest body within ``gate`` whose token is equal, or blank on either
    side; orphans keep a null body. Ties go to the later body."""
    pairs = within(members, bodies, gate).where((F.col(token) == F.col(f"r_{token}")) | (F.coalesce(F.col(token), F.lit("")) == "") | (F.coalesce(F.col(f"r_{token}"), F.lit("")) == ""))
    best = pairs.groupBy("id").agg(F.min_by(F.struct(F.col("r_id").alias("body"), "dist"), F.struct("dist", (-F.col("r_seq")).alias("n"))).alias("b"))
    return members.join(best.select("id", "b.*"), "id", "left")


def outside_boxes(points: DataFrame, boxes: DataFrame, pad: float, on: str, cell: float = 50.0) -> DataFrame:
    """The points in none of the boxes (x0, y0, x1, y1) of the same ``on``, edges included. A
    box is sent to all cells that it touches, grown by the pad; cells are ``cell`` wide."""
    b = boxes.select(F.col(on).alias("_on"), (F.col("x0") - pad).alias("_x0"), (F.col("y0") - pad).alias("_y0"), (F.col("x1") + pad).alias("_x1"), (F.col("y1") + pad).alias("_y1"))
    b = b.withColumn("_cx", F.explode(F.sequence(_cell(F.col("_x0"), cell), _cell(F.col("_x1"), cell))))
    b = b.withColumn("_cy", F.explode(F.sequence(_cell(F.col("_y0"), cell), _cell(F.col("_y1"), cell))))
    same = (points[on] == b["_on"]) & (_cell(points["x"], cell) == b["_cx"]) & (_cell(points["y"], cell) == b["_cy"])
    hit = same & points["x"].between(b["_x0"], b["_x1"]) & points["y"].between(b["_y0"], b["_y1"])
    return points.join(b, hit, "left_anti")


def farthest_pair(points: DataFrame) -> DataFrame:
    """One row (a, b, dist): the two of ``points`` (seq, id, x, y) that are farthest apart, the
    least seqs on ties. They are corners of the convex hull; each task sends on the corners of
    its own rows' hull, which are few, and one task pairs the corners of those (they are dealt anew:
    a plain coalesce would hull all rows in that task)."""
    least = points.where("x IS NOT NULL AND y IS NOT NULL").groupBy("x", "y").agg(F.min_by(F.struct("seq", "id"), "seq").alias("p")).select("p.seq", "p.id", "x", "y")

    def corners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for batch in batches:
            rows = batch if kept is None else pd.concat([kept, batch])
            kept = rows.iloc[_hull(rows["x"].to_numpy(), rows["y"].to_numpy())]
        if kept is not None:
            yield kept

    schema = least.schema
    few = least.mapInPandas(corners, schema).repartition(1).mapInPandas(corners, schema)
    a, b = few.select(*[F.col(c).alias(f"a_{c}") for c in few.columns]), few.select(*[F.col(c).alias(f"b_{c}") for c in few.columns])
    far = F.hypot(F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y"))
    best = a.join(b, F.col("a_seq") < F.col("b_seq")).select(far.alias("dist"), "a_seq", "b_seq", F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    return best.orderBy(F.desc("dist"), "a_seq", "b_seq").limit(1).select("a", "b", "dist")


def farthest_pairs(points: DataFrame, by: str) -> DataFrame:
    """``farthest_pair`` of each ``by``: each task sends on the corners of its own rows' hulls, and
    those of one ``by`` meet in one task. Rows without it are a group, too."""
    least = points.where("x IS NOT NULL AND y IS NOT NULL").groupBy(by, "x", "y").agg(F.min_by(F.struct("seq", "id"), "seq").alias("p")).select(by, "p.seq", "p.id", "x", "y")

    def corners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for batch in batches:
            rows = batch if kept is None else pd.concat([kept, batch])
            hulls = [g.iloc[_hull(g["x"].to_numpy(), g["y"].to_numpy())] for _, g in rows.groupby(by, dropna=False)]
            kept = pd.concat(hulls) if hulls else rows
        if kept is not None:
            yield kept

    schema = least.schema
    few = least.mapInPandas(corners, schema).repartition(F.col(by)).mapInPandas(corners, schema)
    a, b = few.select(*[F.col(c).alias(f"a_{c}") for c in few.columns]), few.select(*[F.col(c).alias(f"b_{c}") for c in few.columns])
    far = F.hypot(F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y"))
    pairs = a.join(b, F.col(f"a_{by}").eqNullSafe(F.col(f"b_{by}")) & (F.col("a_seq") < F.col("b_seq"))).withColumn("dist", far)
    order = F.struct((-F.col("dist")).alias("d"), "a_seq", "b_seq")
    best = pairs.groupBy(f"a_{by}").agg(F.min_by(F.struct("a_id", "b_id", "dist"), order).alias("p"))
    return best.select(F.col(f"a_{by}").alias(by), F.col("p.a_id").alias("a"), F.col("p.b_id").alias("b"), "p.dist")


def _hull(x: np.ndarray, y: np.ndarray) -> list[int]:
    """Places of the corners of the convex hull, by a sweep from left to right and back."""
    order = np.lexsort((y, x)).tolist()
    xs, ys = x.tolist(), y.tolist()

    def side(places: list[int]) -> list[int]:
        out: list[int] = []
        for k in places:
            while len(out) > 1 and (xs[out[-1]] - xs[out[-2]]) * (ys[k] - ys[out[-2]]) <= (ys[out[-1]] - ys[out[-2]]) * (xs[k] - xs[out[-2]]):
                out.pop()
            out.append(k)
        return out

    return sorted({*side(order), *side(order[::-1])})


def closest_pair(points: DataFrame, by: str) -> DataFrame:
    """(``by``, a, b, dist): the two points (seq, x, y) of each ``by`` that are nearest, the
    least seqs on ties. The least step in order of x, or of y, bounds the distance; points then
    meet in cells of that width, of which none holds many."""
    at = points.where("x IS NOT NULL AND y IS NOT NULL").select(by, "seq", "x", "y")
    steps = []
    for first, second in (("x", "y"), ("y", "x")):
        w = Window.partitionBy(by).orderBy(first, second, "seq")
        steps.append(at.select(by, F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)).alias("step")))
    gate = steps[0].unionByName(steps[1]).groupBy(by).agg(F.greatest(F.min("step"), F.lit(1e-9)).alias("gate")).where("gate IS NOT NULL")
    rows = at.join(gate, by)
    cell = lambda c: F.floor(F.col(c) / F.col("gate")).cast("long")
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    a = rows.select(by, F.col("seq").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), cell("x").alias("cx"), cell("y").alias("cy"))
    b = rows.withColumn("i", F.explode(near)).withColumn("j", F.explode(near)).select(by, F.col("seq").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by_"), (cell("x") + F.col("i")).alias("cx"), (cell("y") + F.col("j")).alias("cy"))
    pairs = large(a).join(large(b), [by, "cx", "cy"]).where("a < b")
    dist = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by_"))
    return pairs.groupBy(by).agg(F.min(F.struct(dist.alias("dist"), "a", "b")).alias("p")).select(by, "p.a", "p.b", "p.dist")


def inside_intervals(rows: DataFrame, intervals: DataFrame, value: Column, low: str, high: str, on: list[str], width: float) -> DataFrame:
    """Rows with the intervals [low, high] of equal ``on`` that hold ``value``, ends included:
    an interval goes to the bins of ``width`` that it touches, a row to its own, so each pair
    meets once. Columns of ``intervals`` get the prefix ``i_``."""
    b = intervals.select(*[F.col(c).alias(f"i_{c}") for c in intervals.columns])
    b = b.withColumn("_bin", F.explode(F.sequence(_cell(F.col(f"i_{low}"), width), _cell(F.col(f"i_{high}"), width))))
    a = rows.withColumn("_at", value).withColumn("_mine", _cell(value, width))
    same = F.col("_mine") == F.col("_bin")
    for c in on:
        same &= F.col(c) == F.col(f"i_{c}")
    return a.join(b, same).where(F.col("_at").between(F.col(f"i_{low}"), F.col(f"i_{high}"))).drop("_at", "_mine", "_bin")
