"""All categories in one run: callouts to devices, devices to targets, ties, runs of targets.

What differs by category (gates, whether marks may be ignored, whether the total distance
decides, which evidence settles ties) is a row of a small table that is joined to the rows it
rules; point targets are segments of no length, so one join by cells finds all pairs.
"""

from __future__ import annotations

from dataclasses import astuple, dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanwright.config import Gates
from spanwright.functions.geometry import segment_distance
from spanwright.functions.verdicts import product_verdict
from spanwright.operators import matching as M
from spanwright.operators.claims import rest_of, within_tiles
from spanwright.operators.cluster import device_rows, numbered, rest_clusters
from spanwright.sources.scratch import stash


@dataclass(frozen=True)
class Rule:
    """How a category is matched; distances in feet."""

    category: str
    match_ft: float = 2.0
    mismatch_ft: float = 6.0
    ambiguity_ft: float = 1.0
    level_ft: float = 8.0
    ceiling: float = 3.0
    mark_blind: bool = False
    optimal: bool = False
    by_direction: bool = False
    by_storey: bool = False
    runs: bool = False  # one drawn run may stand for several targets


# Gates and evidence of the two categories.
RULES = (
    Rule("holdown", mark_blind=True),
    Rule("shear_wall", match_ft=4.0, mismatch_ft=12.0, optimal=True, by_direction=True, by_storey=True, runs=True),
)


def rules_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    kinds = {"str": "string", "float": "double", "bool": "boolean"}
    return spark.createDataFrame([astuple(r) for r in rules], ", ".join(f"{f.name} {kinds[str(f.type)]}" for f in fields(Rule)))


def devices_of(callouts: DataFrame, tolerance: float) -> DataFrame:
    """Devices (seq, id, category, mark, x, y, z, orientation_deg, appearances, sheets) of callouts
    (seq, id, category, mark, sheet, x, y): first-fit clusters inside a category and mark, one
    row of a sheet in each; numbered by category in the order of their founders."""
    def clusters(left: DataFrame) -> DataFrame:
        keyed = left.withColumn("_mark", F.col("mark")).withColumn("mark", F.concat_ws("\x1f", F.coalesce("category", F.lit("\x00")), F.coalesce("mark", F.lit("\x00"))))
        return rest_clusters(keyed, tolerance).drop("mark").withColumnRenamed("_mark", "mark")

    made = device_rows(M.filled(callouts), tolerance, ["category", "mark"], clusters, nulls_meet=True)
    ranked = numbered(made.withColumn("_o", F.struct("category", "founder")), "_o", "seq").drop("_o")
    before = ranked.groupBy(F.col("category").alias("_c")).agg((F.min("seq") - 1).alias("_before"))
    named = ranked.join(F.broadcast(before), F.col("category").eqNullSafe(F.col("_c")))  # a row for each category
    return named.withColumn("id", F.format_string("%s_dev_%03d", F.coalesce("category", F.lit("none")), F.col("seq") - F.col("_before"))).drop("_c", "_before")


def _segments(targets: DataFrame) -> DataFrame:
    """With ends for points, and a place for segments."""
    t = M.filled(targets)
    for c in ("x", "y", "ax", "ay", "bx", "by"):
        t = t if c in t.columns else t.withColumn(c, F.lit(None).cast("double"))
    for axis in ("x", "y"):
        a, b = f"a{axis}", f"b{axis}"
        t = t.withColumn(a, F.coalesce(a, axis)).withColumn(b, F.coalesce(b, axis)).withColumn(axis, F.coalesce(axis, (F.col(a) + F.col(b)) / 2))
    return t


def candidate_pairs(devices: DataFrame, targets: DataFrame, reach: str, widest: float, mark: bool = True) -> DataFrame:
    """Pairs (d, t, dist) of one category, and one mark if ``mark``, at most ``reach`` (a column of
    ``devices``, never above ``widest``) apart. Segments go to all cells of their box grown by
    ``widest``, devices to their own, so each pair meets once."""
    size = 4 * max(widest, 1e-6)
    cell = lambda c: F.floor(c / size).cast("long")
    t = targets.select("category", "mark", F.col("seq").alias("t"), F.col("id").alias("target"), F.col("z").alias("tz"), "ax", "ay", "bx", "by")
    for axis in ("x", "y"):
        low, high = F.least(f"a{axis}", f"b{axis}") - widest, F.greatest(f"a{axis}", f"b{axis}") + widest
        t = t.where(low.isNotNull()).withColumn(f"_{axis}", F.explode(F.sequence(cell(low), cell(high))))
    d = devices.where("x IS NOT NULL AND y IS NOT NULL").withColumn("_x", cell(F.col("x"))).withColumn("_y", cell(F.col("y"))).withColumnRenamed("seq", "d")
    on = ["category", "_x", "_y"] + (["mark"] if mark else [])
    far = segment_distance(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    met = d.join(t if mark else t.drop("mark"), on).withColumn("dist", far)
    return met.where(F.col("dist") <= F.col(reach)).select("d", "t", "target", "dist", "z", "tz")


def matched(devices: DataFrame, targets: DataFrame, sheets: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Devices with gate, status, target_id, target_mark, distance_ft and tied candidates.

    As ``matching.assign``, for all categories at once: ambiguous devices are set aside; the
    others claim in order of distance, pairs of the least total first where the category says
    so; another storey ends a device and leaves the target; then distance alone, within the
    match gate, where marks may be ignored."""
    plan = F.broadcast(rules_table(devices.sparkSession, rules)).select("category", "match_ft", "ceiling")
    ruled = gated(devices.join(plan, "category", "left"), sheets).drop("match_ft", "ceiling")
    own = ("seq", "id", "category", "mark", "x", "y", "z", "ax", "ay", "bx", "by")
    done, left_d, left_t = within_tiles(ruled, targets.select(*[c for c in own if c in targets.columns]), rules, _segments)
    rest = rest_of(left_d, left_t, rules, done.columns, lambda: _matched(left_d, left_t, rules))
    both = done.unionByName(rest)
    return both.withColumn("distance_ft", F.when(F.col("target_id").isNotNull(), F.bround("dist", 2))).drop("dist")


#: Sheets whose residuals are sent to the devices as one map, at most.
SENT_SHEETS = 1_000


def gated(devices: DataFrame, sheets: DataFrame) -> DataFrame:
    """With ``gate``: ``match_ft``, widened by the worst registration residual (rms / scale) of the
    device's sheets, up to ``ceiling`` times."""
    worst = F.max(F.when(F.col("scale") > 0, F.col("rms") / F.col("scale")))
    each = sheets.where("sheet IS NOT NULL").groupBy("sheet").agg(worst.alias("worst")).where("worst IS NOT NULL")
    gate = F.least(F.col("match_ft") + F.coalesce("_worst", F.lit(0.0)), F.col("match_ft") * F.col("ceiling"))
    if each.limit(SENT_SHEETS + 1).count() <= SENT_SHEETS:
        sent = each.agg(F.map_from_entries(F.collect_list(F.struct("sheet", "worst"))).alias("_of"))
        mine = F.array_max(F.transform("sheets", lambda s: F.try_element_at("_of", s)))
        return devices.crossJoin(F.broadcast(sent)).withColumn("_worst", mine).withColumn("gate", gate).drop("_of", "_worst")
    mine = devices.select("seq", F.explode("sheets").alias("sheet")).join(each, "sheet").groupBy("seq").agg(F.max("worst").alias("_worst"))
    return devices.join(mine, "seq", "left").withColumn("gate", gate).drop("_worst")


def _matched(devices: DataFrame, segments: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """The same by joins, for any devices (with gate) and segments, with ``dist``."""
    spark = devices.sparkSession
    plan = F.broadcast(rules_table(spark, rules))
    widest = max(r.mismatch_ft + r.ambiguity_ft for r in rules)
    ruled = devices.join(plan, "category").withColumn("reach", F.col("mismatch_ft") + F.col("ambiguity_ft"))
    limits = devices.select(F.col("seq").alias("d"), "gate")
    mine = ruled.select(F.col("seq").alias("d"), F.col("mismatch_ft").alias("outer"), F.col("ambiguity_ft").alias("margin"), "level_ft", "optimal")
    pairs = stash(candidate_pairs(ruled, segments, "reach", widest).join(mine, "d").join(limits, "d"), "pairs")

    w = Window.partitionBy("d").orderBy("dist", "target")
    two = pairs.withColumn("r", F.row_number().over(w)).where("r <= 2").groupBy("d", "outer", "margin").agg(*[F.min(F.when(F.col("r") == k, F.struct("dist", "target"))).alias(f"n{k}") for k in (1, 2)])
    tied = stash(two.where("n1.dist <= outer AND n2.dist - n1.dist < margin").select("d", F.col("n1.target").alias("first"), F.col("n2.target").alias("second")), "tied")

    first = M.optimal_pairs(pairs.where("optimal").select("d", "t", "dist", "gate", "outer", "margin"), Gates()).withColumn("_first", F.lit(0.0))
    open_ = pairs.where("dist <= outer").join(tied, "d", "left_anti").join(first, ["d", "t"], "left")
    off = F.coalesce((F.abs(F.col("z") - F.col("tz")) > F.col("level_ft")) & (F.col("dist") <= F.col("gate")), F.lit(False))
    edges = open_.select("d", "t", F.struct(F.coalesce("_first", F.lit(1.0)).alias("r"), F.col("dist").alias("x")).alias("dist"), "gate", off.alias("off"))
    won = stash(M.claimed(edges), "claims")
    far = F.col("dist.x")
    verdict = F.when(F.col("off"), "NEEDS_REVIEW").when(far <= F.col("gate"), "MATCH").otherwise("LOCATION_MISMATCH")
    same = won.select("d", F.when(~F.col("off"), F.col("t")).alias("t"), far.alias("dist"), verdict.alias("status"))
    review = tied.select("d", F.lit(None).cast("long").alias("t"), F.lit(None).cast("double").alias("dist"), F.lit("NEEDS_REVIEW").alias("status"))
    done = stash(same.unionByName(review), "done")

    rest_d = ruled.where("mark_blind").join(done.select(F.col("d").alias("seq")), "seq", "left_anti")
    rest_t = segments.join(done.where("t IS NOT NULL").select(F.col("t").alias("seq")), "seq", "left_anti")
    blind = M.greedy_pairs(candidate_pairs(rest_d, rest_t, "match_ft", widest, mark=False).select("d", "t", "dist"))
    done = done.unionByName(blind.select("d", "t", "dist", F.lit("MARK_MISMATCH").alias("status")))

    found = segments.select(F.col("seq").alias("t"), F.col("id").alias("target_id"), F.col("mark").alias("target_mark"), F.col("x").alias("target_x"), F.col("y").alias("target_y"), F.col("z").alias("target_z"))
    joined = devices.join(done.withColumnRenamed("d", "seq"), "seq", "left").join(found, "t", "left").drop("t")
    joined = joined.join(tied.withColumnRenamed("d", "seq"), "seq", "left")
    return joined.withColumn("status", F.coalesce("status", F.lit("PDF_ONLY")))


def settled(assigned: DataFrame, targets: DataFrame, rules: tuple[Rule, ...] = RULES, gates: Gates = Gates()) -> DataFrame:
    """Ties settled by drawn direction, then by storey, in the categories whose rules say so."""
    segments = _segments(targets)
    out = M.with_resolved(assigned)
    for rule in rules:  # a pass for each category that has this evidence
        if not (rule.by_direction or rule.by_storey):
            continue
        own = Gates(**{f.name: getattr(rule, f.name, getattr(gates, f.name)) for f in fields(Gates)})
        here, there = out.where(F.col("category") == rule.category), segments.where(F.col("category") == rule.category)
        if rule.by_direction:
            here = M.settle_by_orientation(here, there, own)
        if rule.by_storey:
            here = M.settle_by_context(here, there, own)
        out = out.where(F.coalesce(F.col("category") != rule.category, F.lit(True))).unionByName(here)
    return out


def left_over(assigned: DataFrame, targets: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Each target that no device has (category, id, mark): ``covered_by``, the nearest matched
    device of its mark within the outer gate where one drawn run may stand for several targets;
    else ``cause``: unclassified where it has no mark, or unmatched."""
    plan = F.broadcast(rules_table(assigned.sparkSession, rules))
    free = _segments(targets).join(assigned.where("target_id IS NOT NULL").select(F.col("target_id").alias("id")), "id", "left_anti")
    free = stash(free, "free")
    runs = assigned.where("status = 'MATCH'").join(plan, "category").where("runs")
    widest = max(r.mismatch_ft for r in rules)
    near = candidate_pairs(runs, free, "mismatch_ft", widest)
    best = near.groupBy("t").agg(F.min(F.struct("dist", "d")).alias("b")).select(F.col("t").alias("seq"), F.col("b.d").alias("_d"))
    names = assigned.select(F.col("seq").alias("_d"), F.col("id").alias("covered_by"))
    out = free.join(best, "seq", "left").join(names, "_d", "left")
    cause = F.when(F.col("covered_by").isNotNull(), None).when(F.col("mark").isNull(), "unclassified").otherwise("unmatched")
    return out.select("category", "id", "mark", "covered_by", cause.alias("cause"))


def row_overrides(assigned: DataFrame) -> DataFrame:
    """Each callout with its device's verdict: row, category, device_id, status, verdict,
    distance_ft, target_id, n_sheets."""
    each = assigned.select(F.explode("appearances").alias("row"), "category", F.col("id").alias("device_id"), "status", product_verdict(F.col("status")).alias("verdict"), "distance_ft", "target_id", F.size(F.array_distinct("sheets")).alias("n_sheets"))
    return each


#: Marks of targets that are sent to the devices, at most.
SENT_MARKS = 100_000


def run(callouts: DataFrame, targets: DataFrame, sheets: DataFrame, tolerance: float = 3.0, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Devices with their verdicts, of all categories."""
    final = settled(matched(devices_of(callouts, tolerance), targets, sheets, rules), targets, rules)
    known = stash(targets.select("category", "mark").where("mark IS NOT NULL").distinct().withColumn("_known", F.lit(True)), "marks")
    known = F.broadcast(known) if known.count() <= SENT_MARKS else known
    return final.join(known, ["category", "mark"], "left").withColumn("vocabulary_gap", (F.col("status") == "PDF_ONLY") & F.col("_known").isNull()).drop("_known")
