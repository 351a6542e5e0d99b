"""From label hits to placed instances: the plan of each hit, its points, its evidence, its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwright.operators.evidence import location_evidence

# Fixed values, in points: how far instances without a place of their own stand apart, and the
# distance of the two of three targets that are one pair.
SPACING, PAIR = 18.0, (40.0, 75.0)
POINTS = "array<struct<x:double,y:double>>"


def spread(base: Column, total: Column) -> Column:
    """``total`` points on a level line through ``base``, SPACING apart, around it."""
    start = base["x"] + (-SPACING * (total - 1) / 2)
    return F.when(total <= 1, F.array(base)).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(total, F.lit(2)) - 1), lambda i: F.struct((start + SPACING * i).alias("x"), base["y"].alias("y"))))


def plans(hits: DataFrame, targets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Hits (page, hit, label, count, x0, y0, x1, y1) with ``targets``, the points of their leaders in
    order (page, hit, k, x, y), and ``pair``, where they have won it. ``pairs`` (page, hit,
    pair_key, score, ax, ay, bx, by) are wanted by hits with one target at most; the lowest
    score gets a pair, the first hit on a tie. A label has few leaders."""
    each = targets.groupBy("page", "hit").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x", "y"))), lambda t: F.struct(t["x"].alias("x"), t["y"].alias("y"))).alias("targets"))
    planned = hits.join(each, ["page", "hit"], "left").withColumn("targets", F.coalesce("targets", F.expr(f"cast(array() AS {POINTS})")))
    wanted = pairs.join(planned.where(F.size("targets") <= 1).select("page", "hit"), ["page", "hit"])
    won = wanted.groupBy("page", "pair_key").agg(F.min_by(F.struct("hit", "ax", "ay", "bx", "by"), F.struct("score", "hit")).alias("w"))
    point = lambda a: F.struct(F.col(f"w.{a}x").alias("x"), F.col(f"w.{a}y").alias("y"))
    mine = won.select("page", F.col("w.hit").alias("hit"), F.array(point("a"), point("b")).alias("pair"))
    return planned.join(mine, ["page", "hit"], "left")


def _points(count: Column, targets: Column, pair: Column, middle: Column) -> Column:
    """The points that a plan says, before they are made as many as the count."""
    n, first = F.size(targets), F.coalesce(F.get(targets, 0), middle)
    at = lambda i: F.get(targets, i)
    ways = F.array(*[F.struct(F.hypot(at(i)["x"] - at(j)["x"], at(i)["y"] - at(j)["y"]).alias("far"), F.lit(3 * i + j).alias("rank"), F.array(at(i), at(j)).alias("two")) for i, j in ((0, 1), (0, 2), (1, 2))])
    closest = F.array_min(ways)
    several = F.when(n >= count, F.slice(targets, 1, count)).when(pair.isNotNull(), F.slice(pair, 1, count)).otherwise(spread(first, count))
    single = F.when(n == 2, targets).when((n == 3) & closest["far"].between(*PAIR), closest["two"]).when(pair.isNotNull(), pair).otherwise(F.array(first))
    return F.when(count > 1, several).otherwise(single)


def instances(planned: DataFrame, sheet: str = "sheet") -> DataFrame:
    """One row for each instance: id, page, hit, instance, total, x, y, method, uncertainty_pt,
    confidence, leader_found, marker_found, count_found."""
    middle = F.struct(((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    count = F.greatest(F.coalesce("count", F.lit(1)), F.lit(1))
    out = planned.withColumn("_n", count).withColumn("_p", _points(F.col("_n"), F.col("targets"), F.col("pair"), middle))
    out = out.withColumn("total", F.greatest("_n", F.size("_p")))
    out = out.withColumn("_p", F.when(F.size("_p") < F.col("total"), spread(F.get("_p", 0), F.col("total"))).otherwise(F.slice("_p", 1, F.col("total"))))
    proof = location_evidence(F.col("pair").isNotNull(), F.size("targets"), F.col("total"), F.col("_n"))
    out = out.withColumn("_e", proof).select("*", F.posexplode("_p").alias("_i", "_at"))
    tag = F.lower(F.coalesce(F.col(sheet).cast("string"), F.lit("sheet"))) if sheet in planned.columns else F.lit("sheet")
    identity = F.concat_ws("_", tag, F.lower("label"), F.format_string("%03d", "hit"), (F.col("_i") + 1).cast("string"))
    return out.select(
        identity.alias("id"), "page", "hit", F.upper("label").alias("mark"), (F.col("_i") + 1).alias("instance"), "total", F.bround("_at.x", 2).alias("x"), F.bround("_at.y", 2).alias("y"), "_e.method", "_e.uncertainty_pt", "_e.confidence",
        (F.size("targets") > 0).alias("leader_found"), F.col("pair").isNotNull().alias("marker_found"), (F.col("_n") > 1).alias("count_found"),
    )


def normalized_rows(found: DataFrame, schedule: DataFrame | None, tokens: dict[str, str], sheet: str) -> DataFrame:
    """Instances as rows of a plan view: the product of their schedule row (mark, type, fasteners,
    anchor, embedment), where from, the core token of the mark, and no elevation but an inferred
    one. ``schedule``: None where none could be read; an empty table where there is none."""
    columns = ("type", "fasteners", "anchor", "embedment")
    if schedule is None:
        listed = found.withColumns({c: F.lit("") for c in columns}).withColumn("schedule_source", F.lit("schedule_not_parsed"))
    else:
        first = schedule.groupBy(F.upper("mark").alias("mark")).agg(*[F.min(F.coalesce(c, F.lit(""))).alias(c) for c in columns], F.lit(True).alias("_listed"))
        some = F.broadcast(schedule.agg((F.count("*") > 0).alias("_any")))
        source = F.when(~F.col("_any"), "none").when(F.col("_listed"), "detected").otherwise("not_in_schedule")
        listed = found.join(first, "mark", "left").join(some).withColumn("schedule_source", source).withColumns({c: F.coalesce(c, F.lit("")) for c in columns}).drop("_any", "_listed")
    token = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for pair in tokens.items() for v in pair]), F.col("mark")), F.lit("")) if tokens else F.lit("")
    return listed.withColumn("core_token", token).withColumn("z", F.lit(None).cast("double")).withColumn("z_inferred", F.lit(True)).withColumn("z_source", F.concat(F.lit(f"inferred_from_sheet_{sheet}_plan_view")))
