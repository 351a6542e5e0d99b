"""Crosshairs at any rotation: circles with two long lines through their middle at right angles.

A line passes a middle if its infinite extension does, so it may stand anywhere on the page.
Lines are points (direction, offset) and a circle is a curve over the directions; both go to
classes of direction and bins of offset, and a line goes to one bin, however long it is."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanwright.operators.spatial import within
from spanwright.sources.scratch import large, stash

# Radii in points, how round, how long lines are in radii, how near they pass, the
# slack of the right angle, how near the word stands, and the words.
R_MIN, R_MAX, ROUND, LONG, NEAR, SLACK_DEG, WORD_PT = 6.0, 30.0, 0.25, 2.6, 0.25, 10.0, 60.0
BENCHMARK = r"(?i)\bBM[-_ ]?(\d)\b"
#: Classes of direction in half a turn, and the width of an offset bin in points. On pages with
#: no more lines than FEW a circle meets them all, as that takes no more rows than its curve.
CLASSES, BIN, FEW = 180, 16.0, 180


def round_shapes(shapes: DataFrame) -> DataFrame:
    """(page, seq, x, y, r) of shapes (page, seq, x0, y0, x1, y1, curved) that are about circles of
    the right size."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    good = F.col("curved") & (w > 0) & (h > 0) & w.between(2 * R_MIN, 2 * R_MAX) & (F.abs(w - h) <= ROUND * F.greatest(w, h))
    return shapes.where(good).select("page", "seq", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"), (F.greatest(w, h) / 2).alias("r"))


def lines_through(circles: DataFrame, lines: DataFrame) -> DataFrame:
    """(page, seq, angle): for each circle the directions, in degrees from 0 up to 180, of lines
    (page, ax, ay, bx, by) of at least LONG radii whose extension passes its middle within NEAR
    radii. Pages are moved to the middle of their circles first, so offsets stay small."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    lines = lines.withColumn("dx", dx).withColumn("dy", dy).withColumn("size", F.hypot("dx", "dy")).where(F.col("size") >= LONG * R_MIN)
    many = lines.groupBy("page").agg(F.count("*").alias("many"))
    middle = large(circles.groupBy("page").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))).join(large(many), "page").withColumn("few", F.col("many") <= FEW).drop("many")
    c = large(circles).join(large(middle), "page").withColumn("u", F.col("x") - F.col("mx")).withColumn("v", F.col("y") - F.col("my"))
    step = 180.0 / CLASSES
    # over a class the curve u sin t - v cos t moves by no more than radius * step
    wide = F.hypot("u", "v") * math.radians(step) + F.col("r") * NEAR
    t = F.radians((F.col("class") + 0.5) * step)
    at = F.col("u") * F.sin(t) - F.col("v") * F.cos(t)
    c = c.withColumn("class", F.explode(F.sequence(F.lit(0), F.when(F.col("few"), 0).otherwise(CLASSES - 1))))
    none = F.lit(0).cast("long")
    c = c.withColumn("bin", F.explode(F.when(F.col("few"), F.array(none)).otherwise(F.sequence(F.floor((at - wide) / BIN), F.floor((at + wide) / BIN)))))
    l = large(lines).join(large(middle), "page")  # noqa: E741
    angle = F.pmod(F.degrees(F.atan2("dy", "dx")), F.lit(180.0))
    l = l.withColumn("angle", F.when(angle >= 180.0, 0.0).otherwise(angle)).withColumn("class", F.when(F.col("few"), 0).otherwise(F.least(F.floor(F.col("angle") / step), F.lit(CLASSES - 1)).cast("int")))  # noqa: E741
    turn = F.radians("angle")
    offset = (F.col("ax") - F.col("mx")) * F.sin(turn) - (F.col("ay") - F.col("my")) * F.cos(turn)
    l = l.withColumn("bin", F.when(F.col("few"), none).otherwise(F.floor(offset / BIN))).select("page", "class", "bin", "ax", "ay", "dx", "dy", "size", "angle")  # noqa: E741
    met = large(c.select("page", "seq", "x", "y", "r", "class", "bin")).join(large(l), ["page", "class", "bin"])
    far = F.abs(F.col("dy") * (F.col("x") - F.col("ax")) - F.col("dx") * (F.col("y") - F.col("ay"))) / F.col("size")
    return met.where((F.col("size") >= LONG * F.col("r")) & (far <= NEAR * F.col("r"))).select("page", "seq", "angle").distinct()


def crossed(through: DataFrame) -> DataFrame:
    """(page, seq) of circles with two directions that are upright to each other within the
    slack. No pairs: directions and directions turned by a quarter are sorted together, and each
    is held to the nearest turned one on either side."""
    quarter = F.col("angle") + 90.0
    turned = F.explode(F.array(quarter - 180.0, quarter, quarter - 360.0, quarter + 180.0))
    both = through.select("page", "seq", "angle", F.lit(False).alias("turned")).unionByName(through.select("page", "seq", turned.alias("angle"), F.lit(True).alias("turned")))
    w = Window.partitionBy("page", "seq").orderBy("angle", "turned")
    mark = F.when(F.col("turned"), F.col("angle"))
    below = F.last(mark, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    above = F.first(mark, ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    near = F.least(F.col("angle") - below, above - F.col("angle"))
    return both.withColumn("near", near).where((~F.col("turned")) & (F.col("near") <= SLACK_DEG)).select("page", "seq").distinct()


def crosshairs(circles: DataFrame, lines: DataFrame, words: DataFrame) -> DataFrame:
    """(page, seq, x, y, r, mark, assigned): crossed circles (page, seq, x, y, r) with the nearest
    benchmark word (page, seq, x, y, text) nearer than WORD_PT, or none; the first circle of a
    mark on a page is assigned it."""
    whole = circles.where("x IS NOT NULL AND y IS NOT NULL AND r > 0")
    found = stash(large(whole).join(large(crossed(lines_through(whole, lines))), ["page", "seq"]), "crossed")
    named = words.withColumn("digit", F.regexp_extract("text", BENCHMARK, 1)).where("digit <> ''")
    met = within(found.select("page", "seq", "x", "y"), named.select("page", "x", "y", "digit", "seq"), WORD_PT, "page").where(F.col("dist") < WORD_PT)
    best = met.groupBy("page", "seq").agg(F.min_by("r_digit", F.struct("dist", "r_seq")).alias("digit"))
    out = large(found).join(large(best), ["page", "seq"], "left").withColumn("mark", F.concat(F.lit("BM-"), "digit")).drop("digit")
    first = F.row_number().over(Window.partitionBy("page", "mark").orderBy("seq")) == 1
    return out.withColumn("assigned", F.coalesce(F.col("mark").isNotNull() & first, F.lit(False))).select("page", "seq", "x", "y", "r", "mark", "assigned")
