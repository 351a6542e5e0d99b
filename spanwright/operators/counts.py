"""The chain of counts of a conversion: raw records, canonical assemblies, marks, against what was
expected. Stages that others read are counted while they are written; those that cost little to derive
again are only counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from spanwright.sources.scratch import stash


class Chain:
    """Stages written one after another, each observed."""

    def __init__(self) -> None:
        self.seen: list[tuple[str, dict | Observation]] = []

    @staticmethod
    def _counts(rows: DataFrame) -> list[Column]:
        blank = [F.count_if(F.col(c).isNull()).alias(f"no_{c}") for c in ("level", "view", "mark") if c in rows.columns]
        return [F.count("*").alias("rows"), *blank]

    def write(self, stage: str, rows: DataFrame) -> DataFrame:
        """The written table; its count, and counts of rows without level, view and mark where it has
        them, are taken on the way."""
        note = Observation()
        out = stash(rows.observe(note, *self._counts(rows)), stage)
        self.seen.append((stage, note))
        return out

    def count(self, stage: str, rows: DataFrame) -> DataFrame:
        """The same counts of rows that aren't written: those are read, or derived, once more."""
        self.seen.append((stage, rows.agg(*self._counts(rows)).first().asDict()))
        return rows

    def counts(self) -> list[tuple[int, str, str, int]]:
        """(place, stage, what, n) of all stages so far."""
        return [(k, stage, what, n) for k, (stage, note) in enumerate(self.seen) for what, n in sorted((note if isinstance(note, dict) else note.get).items())]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.counts(), "place int, stage string, what string, n long")


def chain_report(spark: SparkSession, chain: Chain, assemblies: DataFrame, baseline: DataFrame | None) -> DataFrame:
    """(step, key, n, expected, delta, warning): the stages' counts, then each mark's assemblies
    against ``baseline`` (mark, expected). Without a baseline marks stand alone; with one its
    marks are those reported. A stage all of whose rows lack a level, or a view, can't be
    scoped by it."""
    stages = chain.table(spark).groupBy("place", "stage").agg(*[F.max(F.when(F.col("what") == w, F.col("n"))).alias(w) for w in ("rows", "no_level", "no_view")])
    unscoped = F.concat_ws(", ", *[F.when((F.col("rows") > 0) & (F.col(f"no_{c}") == F.col("rows")), F.lit(f"no {c} in any row")) for c in ("level", "view")])
    steps = stages.select(F.concat(F.lit("stage "), F.col("place").cast("string")).alias("step"), F.col("stage").alias("key"), F.col("rows").alias("n"), F.lit(None).cast("long").alias("expected"), F.lit(None).cast("long").alias("delta"), F.nullif(unscoped, F.lit("")).alias("warning"))
    have = assemblies.where("mark IS NOT NULL").groupBy("mark").agg(F.count("*").alias("n"))
    if baseline is None:
        marks = have.select(F.lit("mark").alias("step"), F.col("mark").alias("key"), "n", F.lit(None).cast("long").alias("expected"), F.lit(None).cast("long").alias("delta"), F.lit(None).cast("string").alias("warning"))
    else:
        both = baseline.select("mark", F.col("expected").cast("long").alias("expected")).join(have, "mark", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        delta = F.col("n") - F.col("expected")
        text = F.when(delta != 0, F.concat("mark", F.lit(": "), F.col("n").cast("string"), F.lit(" assemblies, "), F.col("expected").cast("string"), F.lit(" expected; review, don't force")))
        marks = both.select(F.lit("mark").alias("step"), F.col("mark").alias("key"), "n", "expected", delta.alias("delta"), text.alias("warning"))
    return steps.unionByName(marks)
