"""What keeps a comparison from being trusted: findings by rule tables, one row for each.

Registrations have sheet, status (missing, failed, diagnostic_only, low_confidence or usable),
source, solve_rms, solve_max, held_rms, held_max, held_failed, n_held and reason; what isn't known
is null. Rules are data: a condition, a code, a severity, and what to say and do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Codes of findings and their severities.
BLOCKING, WARNING = "blocking", "warning"
MISSING, FAILED, DIAGNOSTIC = "REGISTRATION_MISSING", "REGISTRATION_FAILED", "AUTO_EXTENT_CALIBRATION_DIAGNOSTIC_ONLY"
HELD_FAILED, LOW, UNVALIDATED, COUNTS = "REGISTRATION_VALIDATION_FAILED", "REGISTRATION_LOW_CONFIDENCE", "REGISTRATION_UNVALIDATED", "COUNT_MISMATCH"

Rule = tuple[Column, str, str, Column, str]


def _pt(c: str) -> Column:
    return F.concat(F.coalesce(F.col(c).cast("string"), F.lit("unknown")), F.lit(" pt"))


def registration_rules() -> list[Rule]:
    """(condition, code, severity, message, fix), in the order in which findings are told."""
    is_ = lambda s: F.coalesce("status", F.lit("missing")) == s
    held = F.coalesce("held_failed", F.lit(False))
    limits = lambda a, b, what: F.concat(F.lit(f"{what} residuals of "), _pt(a), F.lit(" rms and "), _pt(b), F.lit(" at most are beyond the limits."))
    return [
        (is_("missing"), MISSING, BLOCKING, F.lit("The sheet has no registration to the model."), "Give three or more point pairs that aren't in line."),
        (is_("failed"), FAILED, BLOCKING, F.coalesce("reason", F.lit("The registration has no solution.")), "Give three or more pairs that belong together and aren't in line."),
        (is_("diagnostic_only"), DIAGNOSTIC, BLOCKING, F.lit("Extents were fitted to each other; distances are shown, matches aren't given."), "Give verified pairs at shared grid points or anchors."),
        (is_("low_confidence") & held, HELD_FAILED, BLOCKING, limits("held_rms", "held_max", "Held-out"), "Pick the pairs anew and see that they belong together."),
        (is_("low_confidence") & ~held, LOW, BLOCKING, limits("solve_rms", "solve_max", "Solved"), "Pick the pairs more precisely, or give more."),
        (is_("usable") & (F.coalesce("n_held", F.lit(0)) == 0), UNVALIDATED, WARNING, F.lit("The registration was taken without held-out pairs."), "Give pairs that the solution doesn't use."),
    ]


def findings(rows: DataFrame, rules: list[Rule], *keys: str) -> DataFrame:
    """(keys, place, code, severity, message, fix): the rules that hold for each row, in order."""
    each = [F.when(c, F.struct(F.lit(code).alias("code"), F.lit(level).alias("severity"), text.alias("message"), F.lit(fix).alias("fix"))) for c, code, level, text, fix in rules]
    return rows.select(*keys, F.posexplode(F.array_compact(F.array(*each))).alias("place", "f")).select(*keys, (F.col("place") + 1).alias("place"), "f.*")


def registration_findings(registrations: DataFrame) -> DataFrame:
    return findings(registrations, registration_rules(), "sheet")


def count_findings(drawn: DataFrame, modelled: DataFrame) -> DataFrame:
    """(sheet, code, severity, message): the marks of a sheet whose counts differ on both sides; of
    rows (sheet, mark). One row for each mark, so a sheet with very many marks is no long string."""
    a = drawn.where("mark IS NOT NULL").groupBy("sheet", "mark").agg(F.count("*").alias("drawn"))
    b = modelled.where("mark IS NOT NULL").groupBy("sheet", "mark").agg(F.count("*").alias("modelled"))
    both = a.join(b, ["sheet", "mark"], "full_outer").na.fill({"drawn": 0, "modelled": 0}).where("drawn <> modelled")
    text = F.format_string("%s: %d in the model, %d drawn", "mark", "modelled", "drawn")
    return both.select("sheet", "mark", F.lit(COUNTS).alias("code"), F.lit(WARNING).alias("severity"), text.alias("message"))


def comparison_modes(registrations: DataFrame) -> DataFrame:
    """(sheet, mode, match_allowed): by place where the registration is usable, by place for insight
    only where extents were fitted, else by mark and count alone."""
    s = F.coalesce("status", F.lit("missing"))
    mode = F.when(s == "usable", "located").when((s == "diagnostic_only") & F.coalesce("has_transform", F.lit(False)), "diagnostic").otherwise("type_and_count")
    return registrations.select("sheet", mode.alias("mode"), (mode == "located").alias("match_allowed"))
