"""Registration: similarity transforms between sheet points and model points, by aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwright.functions.geometry import apply_affine, distance
from spanwright.functions.verdicts import fit_quality
from spanwright.sources.scratch import by_group, stash


def _matrix(reflect: bool) -> Column:
    """Least squares from (x, y) to (u, v) as an aggregate column: [a, b, c, d, e, f]."""
    spread = F.var_pop("x") + F.var_pop("y")
    sign = -1 if reflect else 1
    p = F.try_divide(F.covar_pop("x", "u") + sign * F.covar_pop("y", "v"), spread)
    q = F.try_divide(F.covar_pop("x", "v") - sign * F.covar_pop("y", "u"), spread)
    a, b, c, d = (p, q, q, -p) if reflect else (p, -q, q, p)
    e = F.avg("u") - a * F.avg("x") - b * F.avg("y")
    f = F.avg("v") - c * F.avg("x") - d * F.avg("y")
    return F.array(a, b, c, d, e, f)


def residual(m: Column) -> Column:
    return distance(*apply_affine(m, F.col("x"), F.col("y")), F.col("u"), F.col("v"))


def similarity_fits(pairs: DataFrame, by: str) -> DataFrame:
    """Both variants for each ``by``: reflected, matrix, rms, worst, n. Two aggregates."""
    solved = stash(pairs.groupBy(by).agg(_matrix(False).alias("plain"), _matrix(True).alias("mirrored"), F.count("*").alias("n")), "solved")
    off = by_group(pairs, solved, by)
    sums = off.groupBy(by).agg(
        *[f.alias(n) for k in ("plain", "mirrored") for f, n in ((F.sqrt(F.avg(F.pow(residual(F.col(k)), 2))), f"{k}_rms"), (F.max(residual(F.col(k))), f"{k}_worst"))]
    )
    both = solved.join(sums, by)
    part = lambda k, flag: both.select(by, F.lit(flag).alias("reflected"), F.col(k).alias("matrix"), F.col(f"{k}_rms").alias("rms"), F.col(f"{k}_worst").alias("worst"), "n")
    return part("plain", False).unionByName(part("mirrored", True))


def calibrate(pairs: DataFrame, by: str, held: DataFrame | None = None) -> DataFrame:
    """The variant with the lower rms for each ``by`` (the plain one on a tie), with scale,
    rotation and confidence; with held-out pairs also their rms, and match_allowed."""
    fits = similarity_fits(pairs, by)
    best = fits.groupBy(by).agg(F.min_by(F.struct("reflected", "matrix", "rms", "worst", "n"), F.struct("rms", "reflected")).alias("s")).select(by, "s.*")
    m = F.col("matrix")
    out = best.withColumn("scale", F.hypot(m[0], m[2])).withColumn("rotation_deg", F.degrees(F.atan2(m[2], m[0]))).withColumn("confidence", fit_quality(F.col("rms"), F.col("worst"), F.col("n")))
    if held is None:
        return out.withColumn("match_allowed", F.col("confidence").isin("high", "medium"))
    checks = by_group(held, out.select(by, "matrix"), by).groupBy(by).agg(F.sqrt(F.avg(F.pow(residual(m), 2))).alias("held_rms"), F.max(residual(m)).alias("held_worst"), F.count("*").alias("n_held"))
    out = out.join(checks, by, "left")
    return out.withColumn("match_allowed", F.col("confidence").isin("high", "medium") & (F.coalesce("held_rms", F.lit(0.0)) <= 16.0))


def two_point(pairs: DataFrame, by: str, expected_scale: float, least_span: float = 20.0) -> DataFrame:
    """Exact mirrored fit of two benchmarks for each ``by``; quality rests on their span in
    the model and on the drift from the expected scale, and is medium at best."""
    solved = pairs.groupBy(by).agg(_matrix(True).alias("matrix"), F.count("*").alias("n"), F.hypot(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("span"))
    scale = F.hypot(F.col("matrix")[0], F.col("matrix")[2])
    drift = F.abs(scale / expected_scale - 1)
    return solved.withColumn("scale", scale).withColumn("drift", drift).withColumn("confidence", F.when((F.col("n") != 2) | (F.col("span") < least_span), "failed").when(drift <= 0.02, "medium").otherwise("low"))


def is_collinear() -> Column:
    """Aggregate over (x, y): fewer than three points, or a scatter without a second axis."""
    trace = F.var_pop("x") + F.var_pop("y")
    det = F.var_pop("x") * F.var_pop("y") - F.pow(F.covar_pop("x", "y"), 2)
    return (F.count("*") < 3) | F.coalesce(F.try_divide(det, trace * trace) < 1e-6, F.lit(True))


def principal_segments(points: DataFrame, by: str) -> DataFrame:
    """The main axis of each point set and its extent along it, as a segment."""
    axis = points.groupBy(by).agg((0.5 * F.atan2(2 * F.covar_pop("x", "y"), F.var_pop("x") - F.var_pop("y"))).alias("t"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    along = (F.col("x") - F.col("mx")) * F.cos("t") + (F.col("y") - F.col("my")) * F.sin("t")
    ends = by_group(points, axis, by).groupBy(by, "t", "mx", "my").agg(F.min(along).alias("lo"), F.max(along).alias("hi"))
    at = lambda m, f, s: F.col(m) + f("t") * F.col(s)
    return ends.select(by, at("mx", F.cos, "lo").alias("ax"), at("my", F.sin, "lo").alias("ay"), at("mx", F.cos, "hi").alias("bx"), at("my", F.sin, "hi").alias("by"), (F.col("hi") - F.col("lo")).alias("length"), F.pmod(F.degrees("t"), F.lit(180.0)).alias("angle"))
