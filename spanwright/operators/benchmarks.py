"""Benchmarks: two grid points known on the sheet and in the model, proposed, checked, used."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.operators.fit import calibrate
from spanwright.operators.spatial import farthest_pair
from spanwright.sources.scratch import by_group, stash


def joined_points(sheet: DataFrame, model: DataFrame) -> DataFrame:
    """Grid points (id, x, y) that both sides have; the model's as u, v."""
    return sheet.select("id", "x", "y").join(model.select("id", F.col("x").alias("u"), F.col("y").alias("v")), "id")


def propose(sheet: DataFrame, model: DataFrame) -> DataFrame:
    """(mark, grid_id, x, y, u, v): the two common points farthest apart on the sheet, named in
    the order of their places in the model."""
    both = joined_points(sheet, model)
    pair = farthest_pair(both.select(F.xxhash64("id").alias("seq"), "id", "x", "y")).select(F.explode(F.array("a", "b")).alias("id"))
    two = both.join(F.broadcast(pair), "id")  # two rows
    ends = two.agg(F.sort_array(F.collect_list(F.struct("u", "v", "id", "x", "y"))).alias("p"))
    return ends.select(F.posexplode("p").alias("i", "p")).select(F.concat(F.lit("BM-"), F.col("i") + 1).alias("mark"), F.col("p.id").alias("grid_id"), "p.x", "p.y", "p.u", "p.v")


def picked(sheet: DataFrame, model: DataFrame, picks: DataFrame) -> DataFrame:
    """The proposal of a reviewer's ``picks`` (mark, grid_id): the same columns and ``problem``,
    null if the pick can be used."""
    both = joined_points(sheet, model).withColumnRenamed("id", "grid_id")
    twice = picks.groupBy("grid_id").agg(F.count("*").alias("uses"))
    out = picks.join(both, "grid_id", "left").join(twice, "grid_id", "left")
    problem = F.when(~F.col("mark").isin("BM-1", "BM-2"), "unknown mark").when(F.col("x").isNull(), "not on both sides").when(F.col("uses") > 1, "point picked twice")
    return out.select("mark", "grid_id", "x", "y", "u", "v", problem.alias("problem"))


def verified_stamps(proposal: DataFrame, found: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """(mark, delta, ok): how far each stamp that was read back is from where it was approved;
    a missing one is not ok."""
    got = found.select("mark", F.col("x").alias("fx"), F.col("y").alias("fy"))
    delta = F.hypot(F.col("fx") - F.col("x"), F.col("fy") - F.col("y"))
    return proposal.join(got, "mark", "left").select("mark", F.bround(delta, 3).alias("delta"), F.coalesce(delta <= tolerance, F.lit(False)).alias("ok"))


def grid_calibration(sheet: DataFrame, model: DataFrame, least: int = 3) -> DataFrame:
    """Calibration of each sheet by its labelled grid points (sheet, id, x, y); the model's are
    (id, x, y). Sheets with fewer common points than ``least`` have no row."""
    pairs = stash(sheet.join(model.select("id", F.col("x").alias("u"), F.col("y").alias("v")), "id"), "pairs")
    enough = pairs.groupBy("sheet").agg(F.count("*").alias("k")).where(F.col("k") >= least).select("sheet")
    return calibrate(by_group(pairs, enough, "sheet"), "sheet")
