"""Statuses of the engine, the verdicts they stand for, and ratios over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Statuses by verdict. Anything else, null included, needs review.
VERDICT_OF = {
    "MATCH": "LOCATION_MATCH",
    "LOCATION_MISMATCH": "LOCATION_MISMATCH",
    "MARK_MISMATCH": "LOCATION_MISMATCH",
    "PDF_ONLY": "LOCATION_MISMATCH",
    "REVIT_ONLY": "LOCATION_MISMATCH",
    "NO_REVIT_DATA": "NOT_APPLICABLE",
    "SPEC_ONLY": "NOT_APPLICABLE",
    "NOT_IN_SCHEDULE": "NOT_APPLICABLE",
    "NOT_EVALUATED": "NOT_APPLICABLE",
}
VERDICTS = ("LOCATION_MATCH", "LOCATION_MISMATCH", "NEEDS_REVIEW", "NOT_APPLICABLE")
#: Severity rank by verdict, worst first.
SEVERITY = ("LOCATION_MISMATCH", "NEEDS_REVIEW", "LOCATION_MATCH", "NOT_APPLICABLE")
#: Statuses that a punch list leaves out.
NOT_LISTED = ("MATCH", "SPEC_ONLY", "NOT_EVALUATED")
#: Statuses in which drawing and model both had their say.
EVALUABLE = ("MATCH", "LOCATION_MISMATCH", "PDF_ONLY", "REVIT_ONLY", "MARK_MISMATCH")
#: Evidence fields that a product block carries where they are known.
EVIDENCE = (
    "reason", "distance_ft", "distance_pdf_points", "confidence", "device_id", "revit_ref", "sheet", "sheet_status",
    "mark", "category", "resolved_by", "evidence_conflict", "spec", "target_mark", "level",
)


def product_verdict(status: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in VERDICT_OF.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.coalesce(status, F.lit(""))), F.lit("NEEDS_REVIEW"))


def product_block(columns: list[str], status: str = "status") -> Column:
    """verdict, is_certain, in_scope and the evidence that is not null, as strings."""
    verdict = product_verdict(F.col(status))
    there = [n for n in EVIDENCE if n in columns]
    evidence = F.map_from_arrays(F.array(F.lit("internal_status"), *[F.lit(n) for n in there]), F.array(F.col(status), *[F.col(n).cast("string") for n in there]))
    return F.struct(
        verdict.alias("verdict"),
        verdict.isin("LOCATION_MATCH", "LOCATION_MISMATCH").alias("is_certain"),
        (verdict != "NOT_APPLICABLE").alias("in_scope"),
        F.map_filter(evidence, lambda k, v: v.isNotNull()).alias("evidence"),
    )


def severity(verdict: Column) -> Column:
    out = F.lit(len(SEVERITY))
    for rank, name in reversed(list(enumerate(SEVERITY))):
        out = F.when(verdict == name, F.lit(rank)).otherwise(out)
    return out


def fit_quality(rms: Column, worst: Column, used: Column) -> Column:
    """high, medium or low by residuals in points; failed for fewer than three pairs."""
    return F.when(used < 3, "failed").when((rms <= 8) & (worst <= 16), "high").when((rms <= 16) & (worst <= 32), "medium").otherwise("low")


def registration_state(source: Column, confidence: Column, allowed: Column) -> Column:
    return (
        F.when(source.isNull(), "missing")
        .when(confidence == "failed", "failed")
        .when(source == "diagnostic", "diagnostic_only")
        .when((confidence == "low") | ~F.coalesce(allowed, F.lit(False)), "low_confidence")
        .otherwise("available")
    )


def rules(table: list[tuple[Column, str, str, str]]) -> Column:
    """The rules (condition, code, severity, message) that hold, as an array of structs."""
    return F.array_compact(F.array(*[F.when(c, F.struct(F.lit(code).alias("code"), F.lit(level).alias("severity"), F.lit(text).alias("message"))) for c, code, level, text in table]))
