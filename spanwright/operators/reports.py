"""Counts, filters, sorts, unions and comparisons over element and device tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanwright.functions import verdicts as V


def counts_by_dimension(elements: DataFrame, dims: tuple[str, ...] = ("category", "status", "sheet")) -> DataFrame:
    """(dim, value, n) for the total and each dimension, null values left out: one pass."""
    sets = elements.groupingSets([[], *[[d] for d in dims]], *dims).agg(F.count("*").cast("long").alias("n"), F.grouping_id().alias("g"), *[F.grouping(d).alias(f"_{d}") for d in dims])
    total = F.col("g") == 2 ** len(dims) - 1
    dim, value = F.when(total, "total"), F.lit(None).cast("string")
    for d in dims:
        dim, value = dim.when(F.col(f"_{d}") == 0, d), F.when(F.col(f"_{d}") == 0, F.col(d)).otherwise(value)
    out = sets.select(dim.alias("dim"), value.alias("value"), "n")
    return out.where((F.col("dim") == "total") | F.col("value").isNotNull())


def verdict_counts(elements: DataFrame) -> DataFrame:
    """One row for each verdict, zeros included."""
    flags = [F.count_if(V.product_verdict(F.col("status")) == v).alias(v) for v in V.VERDICTS]
    return elements.agg(*flags).select(F.explode(F.array(*[F.struct(F.lit(v).alias("verdict"), F.col(v).alias("n")) for v in V.VERDICTS])).alias("r")).select("r.*")


def accuracy(elements: DataFrame) -> DataFrame:
    got = elements.agg(F.count("*").alias("total"), F.count_if(F.col("status").isin(*V.EVALUABLE)).alias("evaluable"), F.count_if(F.col("status") == "MATCH").alias("matched"))
    ratio = lambda a, b: F.bround(F.try_divide(F.col(a).cast("double"), F.col(b)), 4)
    return got.withColumn("accuracy", ratio("matched", "evaluable")).withColumn("coverage", ratio("evaluable", "total"))


def filtered(elements: DataFrame, status: str | None = None, category: str | None = None, sheet: str | None = None, mark: str | None = None) -> DataFrame:
    """Rows that meet all the given conditions; the mark in either case."""
    for name, want in (("status", status), ("category", category), ("sheet", sheet)):
        elements = elements.where(F.col(name) == want) if want else elements
    return elements.where(F.upper("mark") == mark.upper()) if mark else elements


def page_of(elements: DataFrame, limit: int = 25) -> DataFrame:
    """The first rows, 1 to 100 of them, in input order."""
    return elements.orderBy("seq").limit(max(1, min(100, limit)))


def searched(elements: DataFrame, text: str) -> DataFrame:
    line = F.lower(F.concat_ws(" ", "id", "mark", "category", "sheet", "status"))
    return elements.where(line.contains(text.lower().strip()))


def sorted_rows(elements: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Nulls last in either direction; "verdict" by severity; ties in input order."""
    key = V.severity(V.product_verdict(F.col("status"))) if column == "verdict" else F.col(column)
    return elements.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), "seq")


def placed_rows(elements: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """With ``place``, from 1, in the order of ``sorted_rows`` by a number: a sort whose places are
    columns, counted by ranges so that no task gets all rows."""
    from spanwright.operators.cluster import numbered

    key = F.struct(F.col(column).isNull().alias("none"), (-F.col(column) if descending else F.col(column)).alias("value"), "seq")
    return numbered(elements.withColumn("_order", key), "_order", "place").drop("_order")


def rank_aligned(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The i-th row of a key with the i-th of the other side, the surplus of either alone."""
    w = Window.partitionBy(key).orderBy("seq")
    a = left.where(F.col(key).isNotNull()).select(key, F.col("id").alias("left_id"), F.row_number().over(w).alias("rank"))
    b = right.where(F.col(key).isNotNull()).select(key, F.col("id").alias("right_id"), F.row_number().over(w).alias("rank"))
    verdict = F.when(F.col("right_id").isNull(), "PDF_ONLY").when(F.col("left_id").isNull(), "REVIT_ONLY").otherwise("NEEDS_REVIEW")
    return a.join(b, [key, "rank"], "full_outer").withColumn("verdict", verdict)


def label_join(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """side: both, left_only or right_only for each label of either table."""
    a, b = left.select(key).distinct().withColumn("_l", F.lit(1)), right.select(key).distinct().withColumn("_r", F.lit(1))
    return a.join(b, key, "full_outer").select(key, F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").otherwise("both").alias("side"))


def device_key(category: str | Column) -> Column:
    """Lasts over runs while the pairing does; without one it is the rounded place."""
    place = F.concat(F.lit("@"), F.bround("x", 0).cast("long"), F.lit(","), F.bround("y", 0).cast("long"))
    return F.concat_ws(":", category if isinstance(category, Column) else F.lit(category), "mark", F.coalesce("target_id", place))


def run_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, change, old_status, new_status) of devices that are new, gone or of another status.
    The last row of a key counts."""
    last = lambda df, n: df.groupBy("key").agg(F.max_by("status", "seq").alias(n), F.lit(1).alias(f"_{n}"))
    both = last(before, "old_status").join(last(after, "new_status"), "key", "full_outer")
    change = F.when(F.col("_old_status").isNull(), "added").when(F.col("_new_status").isNull(), "removed").when(~F.col("old_status").eqNullSafe(F.col("new_status")), "changed")
    return both.withColumn("change", change).where("change IS NOT NULL").select("key", "change", "old_status", "new_status")


def status_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    count = lambda df, n: df.where("status IS NOT NULL").groupBy("status").agg(F.count("*").alias(n))
    both = count(before, "before").join(count(after, "after"), "status", "full_outer").na.fill(0)
    return both.withColumn("delta", F.col("after") - F.col("before"))


def review_queue(elements: DataFrame, comments: DataFrame, dispositions: DataFrame) -> DataFrame:
    """Rows to be looked at, with the count and text of their comments and the last decision."""
    said = comments.groupBy("element_id").agg(F.count("*").alias("n_comments"), F.concat_ws(" | ", F.transform(F.array_sort(F.collect_list(F.struct("seq", "comment"))), lambda c: c["comment"])).alias("comments"))
    decided = dispositions.groupBy("element_id").agg(F.max_by("disposition", "seq").alias("disposition"))
    queue = elements.where(F.col("status").isin("LOCATION_MISMATCH", "NEEDS_REVIEW")).withColumnRenamed("id", "element_id")
    return queue.join(said, "element_id", "left").join(decided, "element_id", "left").na.fill({"n_comments": 0, "comments": ""})


def punch_list(elements: DataFrame, comments: DataFrame, dispositions: DataFrame) -> DataFrame:
    rows = elements.where(~F.coalesce(F.col("status").isin(*V.NOT_LISTED), F.lit(False))).withColumnRenamed("id", "element_id")
    said = comments.groupBy("element_id").agg(F.concat_ws(" | ", F.transform(F.array_sort(F.collect_list(F.struct("seq", "comment"))), lambda c: c["comment"])).alias("comments"))
    decided = dispositions.groupBy("element_id").agg(F.max_by("disposition", "seq").alias("disposition"))
    out = rows.join(said, "element_id", "left").join(decided, "element_id", "left")
    text = lambda c, n: F.substring(F.coalesce(F.col(c), F.lit("")), 1, n)
    return out.select(
        F.coalesce("sheet", F.lit("")).alias("sheet"), "category", "mark", V.product_verdict(F.col("status")).alias("verdict"), F.coalesce("status", F.lit("")).alias("status"), "distance_ft",
        F.col("x").alias("pdf_x"), F.col("y").alias("pdf_y"), text("reason", 200).alias("reason"), F.coalesce("disposition", F.lit("")).alias("reviewer_disposition"), text("comments", 300).alias("reviewer_comments"),
    )


def resolved_again(elements: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Stored human decisions put back on rows that still disagree, by their natural key."""
    key = F.concat_ws(":", "category", "mark", F.coalesce("target_id", F.lit("")))
    r = resolutions.groupBy("key").agg(F.max_by("status", "seq").alias("_status"))
    open_ = F.col("status").isin("LOCATION_MISMATCH", "NEEDS_REVIEW") & F.col("_status").isNotNull()
    out = elements.withColumn("key", key).join(r, "key", "left")
    return out.withColumn("resolved", open_).withColumn("status", F.when(open_, F.col("_status")).otherwise(F.col("status"))).drop("_status", "key")


#: Cells of direction in a turn and of length in a doubling; a vector's peers are alike within
#: acos(0.8) of direction and one doubling.
TURN_CELLS, SIZE_CELLS = 234, 24
_REACH = int(math.acos(0.8) * TURN_CELLS / (2 * math.pi))


def systematic_shift(devices: DataFrame, by: str = "category") -> DataFrame:
    """For each mismatched device: peers of its ``by`` and how many are shifted alike (cosine at
    least 0.8, length half to twice).

    Exact and without pairs of all rows: alike vectors are a box of direction and logarithm of
    length. Cells that lie in a vector's box whole are counted together, by sums over the grid
    of cells, whose size doesn't depend on the rows; only vectors in the cells on the box's edge
    are held to it one by one. A shift that all share lies in few cells, none on an edge."""
    v = devices.where("status = 'LOCATION_MISMATCH' AND target_x IS NOT NULL").withColumn("vx", F.col("x") - F.col("target_x")).withColumn("vy", F.col("y") - F.col("target_y"))
    kinds = v.groupBy(by, "vx", "vy").agg(F.count("*").alias("k"))
    size = F.floor(F.log2(F.hypot("vx", "vy")) * SIZE_CELLS).cast("int")  # null for no shift, which is like none
    turn = F.pmod(F.floor((F.atan2("vy", "vx") / (2 * math.pi) + 0.5) * TURN_CELLS).cast("int"), F.lit(TURN_CELLS))
    placed = kinds.withColumn("size", size).withColumn("turn", F.when(F.col("size").isNotNull(), turn))
    cells = placed.where("size IS NOT NULL").groupBy(by, "turn", "size").agg(F.sum("k").alias("k"))
    kind = dict(cells.dtypes)[by]

    def whole(key: tuple, grid: pd.DataFrame) -> pd.DataFrame:
        low = int(grid["size"].min())
        count = np.zeros((TURN_CELLS, int(grid["size"].max()) - low + 1), dtype=np.int64)
        turn, at = grid["turn"].to_numpy(), grid["size"].to_numpy() - low
        np.add.at(count, (turn, at), grid["k"].to_numpy())
        inner, reach = _REACH - 1, SIZE_CELLS - 2
        rows = np.cumsum(np.vstack([np.zeros_like(count[:1]), count[TURN_CELLS - inner :], count, count[:inner]]), axis=0)
        both = np.cumsum(np.hstack([np.zeros((len(rows), 1), dtype=np.int64), rows]), axis=1)
        left, right = np.maximum(at - reach, 0), np.minimum(at + reach + 1, count.shape[1])
        top, bottom = turn, turn + 2 * inner + 1
        sums = both[bottom, right] - both[top, right] - both[bottom, left] + both[top, left]
        return pd.DataFrame({by: [key[0]] * len(grid), "turn": turn, "size": grid["size"], "inside": sums})

    inside = cells.groupBy(by).applyInPandas(whole, f"{by} {kind}, turn int, size int, inside long")
    ring = [(i, j) for i in range(-_REACH - 1, _REACH + 2) for j in range(-SIZE_CELLS - 1, SIZE_CELLS + 2) if abs(i) > _REACH - 1 or abs(j) > SIZE_CELLS - 2]
    edge = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ring]))
    near = cells.select(F.col(by).alias("_by"), "turn", "size", edge.alias("s"))
    near = near.select("_by", F.col("turn").alias("t0"), F.col("size").alias("s0"), F.pmod(F.col("turn") + F.col("s.i"), F.lit(TURN_CELLS)).alias("turn"), (F.col("size") + F.col("s.j")).alias("size"))
    other = placed.select(F.col(by).alias("_by"), "turn", "size", F.col("vx").alias("wx"), F.col("vy").alias("wy"), F.col("k").alias("k2"))
    beside = near.join(other, ["_by", "turn", "size"]).select("_by", F.col("t0").alias("turn"), F.col("s0").alias("size"), "wx", "wy", "k2")
    met = placed.join(beside.withColumnRenamed("_by", by), [by, "turn", "size"])
    na, nb = F.hypot("vx", "vy"), F.hypot("wx", "wy")
    alike = F.coalesce((F.try_divide(F.col("vx") * F.col("wx") + F.col("vy") * F.col("wy"), na * nb) >= 0.8) & F.try_divide(nb, na).between(0.5, 2.0), F.lit(False))
    edges = met.where(alike).groupBy(by, "vx", "vy").agg(F.sum("k2").alias("edge"))
    sums = placed.join(inside, [by, "turn", "size"]).join(edges, [by, "vx", "vy"], "left")
    sums = sums.select(by, "vx", "vy", (F.col("inside") - 1 + F.coalesce("edge", F.lit(0))).alias("aligned"))
    all_ = kinds.groupBy(by).agg((F.sum("k") - 1).alias("peers"))
    out = v.join(all_, by).join(sums, [by, "vx", "vy"], "left").withColumn("aligned", F.coalesce("aligned", F.lit(0).cast("long")))
    return out.withColumn("systematic", (F.col("peers") > 0) & (F.col("aligned") >= F.greatest(F.lit(2), F.floor(F.col("peers") / 2))))


def registry(*sources: DataFrame) -> DataFrame:
    """An ordered bag union of row sources; a column missing in one is null there."""
    out = None
    for rank, s in enumerate(sources):
        s = s.withColumn("source_rank", F.lit(rank))
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    return out


def first_and_last(rows: DataFrame, key: str, value: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min_by(value, "seq").alias("first"), F.max_by(value, "seq").alias("last"))


def count_consistency(marks: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Plan counts against the schedule, marks of either side kept."""
    plan = marks.groupBy("category", "mark").agg(F.count("*").alias("plan_count"))
    listed = vocabulary.select("category", "mark").distinct().withColumn("schedule_listed", F.lit(True))
    return plan.join(listed, ["category", "mark"], "full_outer").na.fill({"plan_count": 0, "schedule_listed": False})


def scope_warnings(callouts: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """Keys with callouts but no target at all."""
    return callouts.groupBy(key).agg(F.count("*").alias("callouts")).join(targets.select(key).distinct(), key, "left_anti")


def shares(elements: DataFrame) -> DataFrame:
    """Each verdict's share of the rows in scope."""
    n = verdict_counts(elements).where("verdict <> 'NOT_APPLICABLE'")
    return n.withColumn("share", F.bround(F.try_divide(F.col("n").cast("double"), F.sum("n").over(Window.partitionBy(F.lit(1)))), 6))


def group_dots(elements: DataFrame) -> DataFrame:
    return elements.groupBy("category", "mark", V.product_verdict(F.col("status")).alias("verdict")).agg(F.count("*").alias("n"))


def newest_until(files: DataFrame, cap: int) -> DataFrame:
    """Files in order from the newest whose sizes pass the cap: what a clean-up deletes. The
    running sum goes by day first, so no window holds more than one day's files."""
    day = F.to_date("mtime")
    days = files.groupBy(day.alias("day")).agg(F.sum("size").alias("day_size"))
    before = days.withColumn("newer", F.sum("day_size").over(Window.orderBy(F.desc("day"))) - F.col("day_size"))
    run = F.sum("size").over(Window.partitionBy("day").orderBy(F.desc("mtime"), "path").rowsBetween(Window.unboundedPreceding, 0))
    return files.withColumn("day", day).join(before.select("day", "newer"), "day").withColumn("upto", F.col("newer") + run).where(F.col("upto") > cap).select("path", "mtime", "size")
