"""Rules that people teach, as data: which hold for a project, and what they make of tokens.

Rules (id, seq, scope, kind, category, token, maps_to, regex) come from a memory table; patterns
are columns, so a new convention needs no new code."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanwright.functions.marks import MARK_PATTERNS, parsed_rule

# Categories that rules may name, kinds of rules, and the categories whose marks on
# plans are no callouts.
CATEGORIES = ("holdown", "shear_wall", "post", "steel_column", "wall_type")
KINDS = ("mark_alias", "mark_pattern", "category_header", "exclude", "note")
NOT_ON_PLANS = ("wall_type", "unknown")
MEMORY = "id string, seq bigint, scope string, origin string, instruction string, kind string, category string, token string, maps_to string, regex string"


def _compiles(pattern: Column) -> Column:
    """Whether a pattern can be used; asked of distinct patterns only."""

    @F.pandas_udf("boolean")
    def usable(patterns: pd.Series) -> pd.Series:
        def one(p: str | None) -> bool:
            try:
                return p is not None and bool(re.compile(p))
            except re.error:
                return False

        return patterns.map(one)

    return usable(pattern)


def checked(rules: DataFrame) -> DataFrame:
    """With ``valid``: a known kind and category, a token or a pattern that compiles, as the kind
    asks; notes are valid, and do nothing."""
    kinds = rules.select("regex").where("regex IS NOT NULL").distinct()
    good = kinds.withColumn("_compiles", _compiles(F.col("regex")))
    known = F.coalesce(F.col("category").isin(*CATEGORIES), F.lit(False))
    token, pattern = F.coalesce(F.col("token") != "", F.lit(False)), F.coalesce(F.col("_compiles"), F.lit(False)) & (F.col("regex") != "")
    valid = F.when(F.col("kind").isin("mark_alias", "exclude"), known & token).when(F.col("kind").isin("mark_pattern", "category_header"), known & pattern).otherwise(F.col("kind") == "note")
    return rules.join(good, "regex", "left").withColumn("valid", F.coalesce(valid, F.lit(False))).drop("_compiles")


def taught(instructions: DataFrame, scope: Column) -> DataFrame:
    """Rules told in words (seq, text): kind, category, token, maps_to as the words say."""
    told = instructions.withColumn("r", parsed_rule(F.col("text")))
    return told.select("seq", scope.alias("scope"), F.lit(None).cast("string").alias("origin"), F.col("text").alias("instruction"), "r.kind", "r.category", "r.token", "r.maps_to", F.lit(None).cast("string").alias("regex"))


def overrides_of(rules: DataFrame, project: str) -> DataFrame:
    """(kind, key, category, value, taught_by, place) that hold in a project: global ones and its
    own. Of aliases and excludes of a token the last counts; patterns and headers of a category
    add up, in order."""
    scope = F.coalesce("scope", F.lit("global"))
    here = checked(rules).where(F.col("valid") & ((scope == "global") | (scope == f"project:{project}")))
    upper = F.upper("token")
    one = here.where(F.col("kind").isin("mark_alias", "exclude")).groupBy("kind", upper.alias("key")).agg(F.max_by(F.struct("category", F.upper(F.coalesce(F.nullif("maps_to", F.lit("")), "token")).alias("value"), F.col("id").alias("taught_by")), "seq").alias("o"))
    one = one.select("kind", "key", "o.category", F.when(F.col("kind") == "mark_alias", F.col("o.value")).alias("value"), "o.taught_by", F.lit(1).alias("place"))
    # rules of one kind and category are what people wrote for it
    many = here.where(F.col("kind").isin("mark_pattern", "category_header")).withColumn("place", F.row_number().over(Window.partitionBy("kind", "category").orderBy("seq")))
    return one.unionByName(many.select("kind", F.col("category").alias("key"), "category", F.col("regex").alias("value"), F.col("id").alias("taught_by"), "place"))


def _one_row(patterns: DataFrame, kind: str) -> DataFrame:
    """All patterns of a kind as one array, by category in the order they were first taught."""
    rows = patterns.where(F.col("kind") == kind)
    first = rows.groupBy("category").agg(F.min("taught_seq").alias("rank"))
    rows = rows.groupBy("category", "value").agg(F.min("place").alias("place"))  # a pattern told again tells nothing
    return rows.join(first, "category").agg(F.array_sort(F.collect_list(F.struct("rank", "place", "category", F.concat(F.lit("(?i)^(?:"), "value", F.lit(")")).alias("regex")))).alias("patterns")).withColumn("_one", F.lit(1))


def classified(tokens: DataFrame, vocabulary: DataFrame, rules: DataFrame, project: str) -> DataFrame:
    """``tokens`` (token) with category, mark, schedule_listed, source and taught_by. Excluded ones
    have no category; else a taught alias, the schedules' vocabulary (category, mark, rank), a
    taught pattern, or a built-in pattern decides, in this order. Each distinct token is judged
    once."""
    held = overrides_of(rules, project)
    seqs = rules.select(F.col("id").alias("taught_by"), F.col("seq").alias("taught_seq"))
    held = held.join(seqs, "taught_by", "left")
    distinct = tokens.select(F.upper(F.trim("token")).alias("t")).where("t IS NOT NULL").distinct()
    out = held.where("kind = 'exclude'").select(F.col("key").alias("t"), F.lit(True).alias("excluded"))
    alias = held.where("kind = 'mark_alias'").select(F.col("key").alias("t"), F.col("category").alias("a_cat"), F.col("value").alias("a_mark"), F.col("taught_by").alias("a_by"))
    listed = vocabulary.where(~F.col("category").isin(*NOT_ON_PLANS)).groupBy(F.upper("mark").alias("t")).agg(F.min_by("category", "rank").alias("v_cat"))
    each = distinct.join(out, "t", "left").join(alias, "t", "left").join(listed, "t", "left")
    taught_patterns = _one_row(held, "mark_pattern")
    each = each.withColumn("_one", F.lit(1)).join(F.broadcast(taught_patterns), "_one", "left")  # what people taught, one row
    hit = F.get(F.filter("patterns", lambda p: F.rlike(F.col("t"), p["regex"])), 0)["category"]
    built_in = F.lit(None).cast("string")
    for category, pattern in reversed([x for x in MARK_PATTERNS.items() if x[0] != "wall_type"]):
        built_in = F.when(F.col("t").rlike(f"(?i){pattern}"), category).otherwise(built_in)
    each = each.withColumn("p_cat", hit).withColumn("b_cat", built_in).withColumn("excluded", F.coalesce("excluded", F.lit(False)))
    free = ~F.col("excluded")
    each = each.withColumn("category", F.when(free, F.coalesce("a_cat", "v_cat", "p_cat", "b_cat"))).withColumn("mark", F.when(free & F.col("a_cat").isNotNull(), F.col("a_mark")).otherwise(F.col("t")))
    source = F.when(~free, "exclude").when(F.col("a_cat").isNotNull(), "alias").when(F.col("v_cat").isNotNull(), "vocabulary").when(F.col("p_cat").isNotNull(), "pattern").when(F.col("b_cat").isNotNull(), "built_in")
    by = F.when(free & F.col("a_cat").isNotNull(), F.col("a_by")).when(source == "pattern", "taught_pattern")
    each = each.withColumn("source", source).withColumn("taught_by", by)
    words = vocabulary.select("category", F.upper("mark").alias("mark")).distinct().withColumn("schedule_listed", F.lit(True))
    each = each.join(words, ["category", "mark"], "left").withColumn("schedule_listed", F.coalesce("schedule_listed", F.lit(False)))
    judged = each.select("t", "category", "mark", "schedule_listed", "source", "taught_by")
    return tokens.withColumn("t", F.upper(F.trim("token"))).join(judged, "t", "left").drop("t")


def headers_of(titles: DataFrame, rules: DataFrame, project: str, built_in: dict[str, str]) -> DataFrame:
    """``titles`` (title) with the category of the schedule: taught headers first, then built-in
    ones; "unknown" for other schedules, null for other titles."""
    held = overrides_of(rules, project)
    seqs = rules.select(F.col("id").alias("taught_by"), F.col("seq").alias("taught_seq"))
    arrays = _one_row(held.join(seqs, "taught_by", "left"), "category_header").withColumn("patterns", F.transform("patterns", lambda p: F.struct(p["category"].alias("category"), F.replace(p["regex"], F.lit("(?i)^"), F.lit("(?i)")).alias("regex"))))
    hit = F.get(F.filter("patterns", lambda p: F.rlike(F.col("title"), p["regex"])), 0)["category"]
    other = F.when(F.col("title").rlike(r"(?i)\bSCHEDULE\b"), "unknown")
    for category, pattern in reversed(built_in.items()):
        other = F.when(F.col("title").rlike(f"(?i){pattern}"), category).otherwise(other)
    return titles.withColumn("_one", F.lit(1)).join(F.broadcast(arrays), "_one", "left").withColumn("category", F.coalesce(hit, other)).drop("_one", "patterns")
