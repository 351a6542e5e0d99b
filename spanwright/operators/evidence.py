"""Evidence around a verdict: how sure a place is, what speaks against it, and the words for it;
and small pickers over sets of points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanwright.config import Gates
from spanwright.functions.geometry import angle_delta
from spanwright.operators.spatial import within

# How a detection was located, its uncertainty in points and its confidence, the
# first condition that holds.
LOCATED = (
    ("paired_hardware_markers", 4.0, 0.94),
    ("multiple_leader_targets", 7.0, 0.9),
    ("leader_target", 10.0, 0.84),
    ("leader_plus_synthetic_count_expansion", 15.0, 0.74),
    ("label_center_synthetic_count_expansion", 20.0, 0.62),
    ("label_center_fallback", 24.0, 0.55),
)


def location_evidence(paired: Column, targets: Column, total: Column, count: Column) -> Column:
    """(method, uncertainty_pt, confidence) from a marker pair, leader targets and counts."""
    holds = (paired, (targets >= total) & (total > 1), (targets > 0) & (total == 1), targets > 0, count > 1, F.lit(True))
    out = None
    for (method, pt, sure), c in zip(reversed(LOCATED), reversed(holds), strict=True):
        value = F.struct(F.lit(method).alias("method"), F.lit(pt).alias("uncertainty_pt"), F.lit(sure).alias("confidence"))
        out = value if out is None else F.when(c, value).otherwise(out)
    return out


def cleaned_points(rows: DataFrame, numbers: tuple[str, ...], prefix: str) -> DataFrame:
    """Rows whose ``numbers`` all are numbers; a missing id is the prefix and the row's seq."""
    out = rows.withColumns({n: F.col(n).try_cast("double") for n in numbers}).dropna(subset=list(numbers))
    return out.withColumn("id", F.coalesce("id", F.concat(F.lit(f"{prefix}_"), F.col("seq").cast("string"))))


def lowest_claims(plans: DataFrame) -> DataFrame:
    """Of the plans (seq, pair_key, score) that want one pair, the one with the lowest score,
    the first on a tie."""
    return plans.where("pair_key IS NOT NULL").groupBy("pair_key").agg(F.min(F.struct("score", "seq")).alias("b")).select("pair_key", "b.seq", "b.score")


def aligned_pairs(labels: DataFrame, markers: DataFrame, near: float = 25.0, far: float = 85.0) -> DataFrame:
    """For each label the pair of markers side by side (20 to 45 apart, less than 12 off the
    level) with the least mean distance to it. Markers around one label are few."""
    m = within(labels, markers.select("seq", "x", "y"), far).where((F.col("dist") > near) & (F.col("dist") < far))
    a = m.select("id", F.col("r_seq").alias("a"), F.col("r_x").alias("ax"), F.col("r_y").alias("ay"), F.col("dist").alias("da"))
    b = m.select(F.col("id").alias("_id"), F.col("r_seq").alias("b"), F.col("r_x").alias("bx"), F.col("r_y").alias("by"), F.col("dist").alias("db"))
    wide = F.abs(F.col("ax") - F.col("bx")).between(20, 45) & (F.abs(F.col("ay") - F.col("by")) < 12) & F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")).between(20, 45)
    pairs = a.join(b, (F.col("id") == F.col("_id")) & (F.col("a") < F.col("b"))).where(wide).withColumn("score", (F.col("da") + F.col("db")) / 2)
    return pairs.groupBy("id").agg(F.min(F.struct("score", "a", "b")).alias("p")).select("id", "p.*")


def richest_line(labels: DataFrame, axis: str, tolerance: float = 6.0) -> DataFrame:
    """Of all bands of labels (page, seq, text, x, y) within the tolerance of one label on
    ``axis``, the one with the most texts that occur once: (page, text, seq) of those. A page's
    labels meet by cells of the axis."""
    cell = F.floor(F.col(axis) / tolerance).cast("long")
    a = labels.select("page", F.col("seq").alias("anchor"), F.col(axis).alias("_at"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("_c"))
    b = labels.select(F.col("page").alias("_p"), "text", "seq", F.col(axis).alias("_b"), cell.alias("_d"))
    band = a.join(b, (F.col("page") == F.col("_p")) & (F.col("_c") == F.col("_d")) & (F.abs(F.col("_at") - F.col("_b")) <= tolerance))
    once = band.groupBy("page", "anchor", "text").agg(F.count("*").alias("n"), F.min("seq").alias("seq")).where("n = 1")
    best = once.groupBy("page", "anchor").agg(F.count("*").alias("k")).groupBy("page").agg(F.max_by("anchor", F.struct("k", -F.col("anchor"))).alias("anchor"))
    return once.join(best, ["page", "anchor"]).select("page", "text", "seq")


def distinct_within(points: DataFrame, by: str, tolerance: float) -> DataFrame:
    """Points in order of seq, without those within the tolerance of one that was kept; a fold,
    so ``by`` must hold few points (the hits of a label)."""
    points_in_order = F.array_sort(F.collect_list(F.struct("seq", "x", "y")))
    near = lambda kept, p: F.exists(kept, lambda q: F.hypot(q["x"] - p["x"], q["y"] - p["y"]) <= tolerance)
    start = F.array().cast("array<struct<seq:bigint,x:double,y:double>>")
    kept = F.aggregate(points_in_order, start, lambda acc, p: F.when(near(acc, p), acc).otherwise(F.concat(acc, F.array(p))))
    return points.groupBy(by).agg(kept.alias("kept")).select(by, F.inline("kept"))


def modal_first_seen(rows: DataFrame, by: str, value: str) -> DataFrame:
    """The most common value of each key, the first seen on equal counts, and the row count."""
    counts = rows.groupBy(by, value).agg(F.count("*").alias("k"), F.min("seq").alias("seen"))
    top = F.max_by(value, F.when(F.col(value).isNotNull(), F.struct("k", (-F.col("seen")).alias("s"))))
    return counts.groupBy(by).agg(F.sum("k").alias("n"), top.alias("modal"))


def usage_rollup(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("entries"), F.count_if("called").alias("attempted"), F.count_if("ok").alias("successful"), F.coalesce(F.sum(F.when(F.col("ok"), F.col("tokens"))), F.lit(0)).alias("tokens"), F.max_by("model", "seq").alias("last_model"))


def specification_marks(rows: DataFrame) -> DataFrame:
    """The first schedule row's mark for each product key."""
    return rows.where("key IS NOT NULL AND mark IS NOT NULL").groupBy("key").agg(F.min_by("mark", "seq").alias("mark"))


def subset_check(want: DataFrame, have: DataFrame, by: str, item: str) -> DataFrame:
    """For each ``by`` the wanted items that are missing; complete if there are none."""
    w = want.groupBy(by).agg(F.collect_set(item).alias("w"))
    h = have.groupBy(by).agg(F.collect_set(item).alias("h"))
    missing = F.array_sort(F.array_except("w", F.coalesce("h", F.array().cast("array<string>"))))
    return w.join(h, by, "left").select(by, F.concat_ws(",", missing).alias("missing"), (F.size(missing) == 0).alias("complete"))


def with_conflicts(assigned: DataFrame, targets: DataFrame, gates: Gates) -> DataFrame:
    """Adds ``evidence_conflict`` to devices that stayed tied: their direction fits neither
    candidate, or only one that another device has. No status changes."""
    from spanwright.operators.matching import tie_candidates

    c = tie_candidates(assigned, targets).where("orientation_deg IS NOT NULL")
    fits = F.coalesce(angle_delta(F.col("orientation_deg"), F.col("c_deg")) <= gates.orientation_deg, F.lit(True))
    found = c.groupBy("seq").agg(F.count_if(fits).alias("fit"), F.count_if(fits & ~F.col("claimed")).alias("free"))
    kind = F.when(F.col("fit") == 0, "drawn_orientation_matches_no_candidate").when(F.col("free") == 0, "orientation_match_claimed_by_other_device")
    return assigned.join(found.select("seq", kind.alias("evidence_conflict")), "seq", "left")


def with_reasons(assigned: DataFrame, gates: Gates) -> DataFrame:
    """Adds ``reason``: one sentence for each status, distances with two decimals."""
    d, at = F.format_string("%.2f", "distance_ft"), F.format_string("(%.1f, %.1f)", "x", "y")
    text = (
        F.when(F.col("status") == "MATCH", F.concat(F.lit("Mark "), "mark", F.lit(" is "), d, F.lit(" ft from "), "target_id", F.lit(", inside its gate.")))
        .when(F.col("status") == "LOCATION_MISMATCH", F.concat(F.lit("Mark "), "mark", F.lit(" is "), d, F.lit(" ft from "), "target_id", F.lit(", outside its gate.")))
        .when(F.col("status") == "MARK_MISMATCH", F.concat(F.lit("Drawn as "), "mark", F.lit(", modelled as "), "target_mark", F.lit(" ("), "target_id", F.lit(").")))
        .when(F.col("status") == "PDF_ONLY", F.concat(F.lit("No "), "mark", F.lit(f" within {gates.mismatch_ft:g} ft of "), at, F.lit(".")))
        .when(F.col("first").isNotNull(), F.concat(F.lit("Tied between "), "first", F.lit(" and "), "second", F.lit(".")))
        .otherwise("Right place, another level.")
    )
    return assigned.withColumn("reason", text)


def review_items(rows: DataFrame, width: float, height: float, size: float = 12.0) -> DataFrame:
    """What to draw for each pair row (px, py on the sheet; tx, ty the model's place on it): a
    box, a line from one to the other, or a circle; ``drawable`` if that is on the page."""
    on = lambda x, y: F.coalesce(F.col(x).between(0, width) & F.col(y).between(0, height), F.lit(False))
    shape = F.when(F.col("verdict") == "LOCATION_MISMATCH", "connector").when(F.col("verdict") == "REVIT_ONLY", "circle").otherwise("box")
    x, y = F.when(shape == "circle", F.col("tx")).otherwise(F.col("px")), F.when(shape == "circle", F.col("ty")).otherwise(F.col("py"))
    drawable = F.when(shape == "circle", on("tx", "ty")).when(shape == "connector", on("px", "py") & on("tx", "ty")).otherwise(on("px", "py"))
    return rows.withColumn("shape", shape).withColumn("drawable", drawable).withColumn("box", F.when(drawable, F.array(x - size, y - size, x + size, y + size)))


def scene_boxes(rows: DataFrame) -> DataFrame:
    """Elements with a bounding box as six numbers, least corner first, to the hundredth."""
    side = lambda f, i: F.bround(f(*[F.get(F.get("bbox", F.lit(k)), F.lit(i)) for k in (0, 1)]), 2)
    return rows.where(F.size("bbox") == 2).select("id", "category", F.array(*[side(f, i) for f in (F.least, F.greatest) for i in (0, 1, 2)]).alias("box"))


def readiness(projects: DataFrame, inputs: tuple[str, ...], result: str) -> DataFrame:
    """ready with a result, runnable with all inputs, else incomplete, with what is missing."""
    missing = F.array_compact(F.array(*[F.when(~F.coalesce(F.col(n), F.lit(False)), n) for n in inputs]))
    state = F.when(F.col(result), "ready").when(F.size(missing) == 0, "runnable").otherwise("incomplete")
    return projects.withColumn("state", state).withColumn("missing_inputs", F.concat_ws(",", missing))


def narrative(elements: DataFrame) -> DataFrame:
    """One line of facts for each category, as a stage reports them."""
    facts = elements.groupBy("category").agg(F.count("*").alias("n"), F.count_distinct("mark").alias("marks"), F.count_if(F.col("status") == "MATCH").alias("matched"))
    return facts.select("category", F.format_string("%d elements, %d marks, %d matched", "n", "marks", "matched").alias("line"))


def ranked_sheets(marks: DataFrame) -> DataFrame:
    """The primary sheet: the first with a hold-down, else the first with any mark."""
    w = Window.partitionBy(F.lit(1)).orderBy(F.when(F.col("category") == "holdown", 0).otherwise(1), "seq")
    first = marks.groupBy("sheet", "category").agg(F.min("seq").alias("seq"))
    return first.withColumn("r", F.row_number().over(w)).where("r = 1").select("sheet")
