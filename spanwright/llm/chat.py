"""Multi-party perspective rotation of dialogues.

For every participant of a conversation the dialogue is rendered with that speaker as the
assistant and all others as named users; the mask covers what the assistant says. The result
is one segment for each turn and perspective, with its place in the rendered text, so that a
conversation of any length is never gathered into one row: a dialogue's text is its segments
in order of ``at``. Offsets are sums by blocks of turns, then within a block.

Speakers are told apart by ``role``; "system" turns set the scene: they are rendered under
their own name from every perspective, and nobody takes their part. A null role counts as a
speaker named "unknown", null text as empty. Turns are ordered by turn, role, text (null
first), so ties have a fixed order; repeated rows are rendered each. A null conv_id is a
conversation of its own. An empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import blank, table

SCENE = "system"
#: Turns of a conversation that one window holds at most, but for ties.
BLOCK = 64


def rotate(turns: DataFrame) -> DataFrame:
    """(conv_id, perspective, turn, at, header, text, masked_from, masked_to): places are code
    points in the rendered dialogue; masked_from is masked_to where nothing is masked."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), blank(F.col("text")).alias("text"))
    parts = rows.where(F.col("role") != SCENE).select(F.col("conv_id").alias("c"), F.col("role").alias("perspective")).distinct()
    each = rows.join(parts, rows.conv_id.eqNullSafe(parts.c)).drop("c")
    own = F.col("role") == F.col("perspective")
    header = F.when(own, "<|assistant|>\n").when(F.col("role") == SCENE, "<|system|>\n").otherwise(F.concat(F.lit("<|user|> name="), "role", F.lit("\n")))
    each = each.withColumn("header", header).withColumn("length", F.length("header") + F.length("text") + 1).withColumn("block", F.floor(F.col("turn") / BLOCK))
    key = ["conv_id", "perspective"]
    sums = each.groupBy(*key, "block").agg(F.sum("length").alias("inside"))
    before = F.sum("inside").over(Window.partitionBy(*key).orderBy("block")) - F.col("inside")
    sums = sums.select(*[F.col(k).alias(f"_{k}") for k in (*key, "block")], before.alias("before"))
    within = Window.partitionBy(*key, "block").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = each.withColumn("within", F.sum("length").over(within) - F.col("length"))
    same = placed.conv_id.eqNullSafe(sums._conv_id) & placed.perspective.eqNullSafe(sums._perspective) & placed.block.eqNullSafe(sums._block)
    at = (F.col("before") + F.col("within")).cast("long")
    start = at + F.length("header")
    return placed.join(sums, same).select(
        "conv_id", "perspective", "turn", at.alias("at"), "header", "text", start.alias("masked_from"),
        F.when(F.col("role") == F.col("perspective"), start + F.length("text")).otherwise(start).alias("masked_to"),
    )


def op6_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


ORACLE_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id AS c, role AS perspective FROM t WHERE role <> '{SCENE}'),
e AS (SELECT conv_id, perspective, turn, role, text,
  CASE WHEN role = perspective THEN '<|assistant|>' || chr(10) WHEN role = '{SCENE}' THEN '<|system|>' || chr(10)
       ELSE '<|user|> name=' || role || chr(10) END AS header
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.c),
s AS (SELECT *, length(header) + length(text) + 1 AS n, sum(length(header) + length(text) + 1)
  OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM e)
SELECT conv_id, perspective, turn, CAST(upto - n AS BIGINT) AS at, header, text,
  CAST(upto - n + length(header) AS BIGINT) AS masked_from,
  CAST(upto - n + length(header) + CASE WHEN role = perspective THEN length(text) ELSE 0 END AS BIGINT) AS masked_to FROM s
"""
