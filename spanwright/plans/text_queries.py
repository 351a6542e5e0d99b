"""Marks, tokens, rules and titles; schedules and plan words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.functions import marks as K
from spanwright.operators import extract as X

from .registrar import query
from .views import PRELUDE, places

VOCABULARY = {"HD3": "H1", "HD9": "H2", "HD15": "H3", "HTT4": "H4"}


def _names(spark: SparkSession, d: str) -> DataFrame:
    return places(spark, d).select(
        "n",
        F.expr("CASE n % 5 WHEN 0 THEN concat('S/HDU', n % 20, 'S w/ bolt') WHEN 1 THEN concat('shtt', n % 9) WHEN 2 THEN concat('BHH-', n % 7) WHEN 3 THEN concat('Anchor_Bolt_SHD', n % 16, 'WithBolt1') ELSE concat('post ', n) END").alias("name"),
        F.expr("CASE n % 4 WHEN 0 THEN concat('P-0', n % 12) WHEN 1 THEN concat('c', n % 9, '-01-02') WHEN 2 THEN concat('bp', n % 30) ELSE concat('x', n, '?') END").alias("mark"),
    )


NAMES = ", names AS (SELECT n, CASE n % 5 WHEN 0 THEN 'S/HDU' || (n % 20) || 'S w/ bolt' WHEN 1 THEN 'shtt' || (n % 9) WHEN 2 THEN 'BHH-' || (n % 7) WHEN 3 THEN 'Anchor_Bolt_SHD' || (n % 16) || 'WithBolt1' ELSE 'post ' || n END AS name, CASE n % 4 WHEN 0 THEN 'P-0' || (n % 12) WHEN 1 THEN 'c' || (n % 9) || '-01-02' WHEN 2 THEN 'bp' || (n % 30) ELSE 'x' || n || '?' END AS mark FROM places)"


@query(PRELUDE + NAMES + "SELECT n, CASE n % 5 WHEN 0 THEN 'HD' || (n % 20) || 'S' WHEN 1 THEN 'HTT' || (n % 9) WHEN 3 THEN 'HD' || (n % 16) || 'W' END AS key FROM names")
def variant_keys(spark: SparkSession, d: str) -> DataFrame:
    return _names(spark, d).select("n", K.variant_key(F.col("name")).alias("key"))


@query(PRELUDE + NAMES + "SELECT n, CASE n % 4 WHEN 0 THEN 'P-' || (n % 12) WHEN 1 THEN 'C-' || (n % 9) WHEN 2 THEN 'BP-' || (n % 30) ELSE 'X-' || n END AS mark FROM names")
def point_marks(spark: SparkSession, d: str) -> DataFrame:
    return _names(spark, d).select("n", K.point_mark(F.col("mark")).alias("mark"))


@query(
    PRELUDE + NAMES + ", c AS (SELECT n, regexp_replace(upper(name), '[^A-Z0-9]', '', 'g') AS c FROM names) SELECT n, c AS cleaned, CASE WHEN contains(replace(c, 'HDU', 'zz'), 'HD3') THEN 'HD3' WHEN contains(replace(c, 'HDU', 'zz'), 'HD9') THEN 'HD9' WHEN contains(replace(c, 'HDU', 'zz'), 'HD15') THEN 'HD15' WHEN contains(c, 'HTT4') THEN 'HTT4' ELSE '' END AS core_token, "
    "coalesce('BOLT' || nullif(regexp_extract(c, 'BOLT([12])', 1), ''), '') AS bolt_variant FROM c"
)
def normalize_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _names(spark, d).select("n", K.normalized_type(F.col("name"), VOCABULARY).alias("t")).select("n", "t.cleaned", "t.core_token", "t.bolt_variant")


@query(PRELUDE + "SELECT n, CASE WHEN n % 6 BETWEEN 1 AND 4 THEN 'H' || (n % 6) END AS mapped_mark, CASE WHEN n % 6 BETWEEN 1 AND 4 THEN 0.98 ELSE 0.15 END::DOUBLE AS confidence FROM keys")
def normalize_marks(spark: SparkSession, d: str) -> DataFrame:
    m = K.normalized_mark(F.concat(F.lit("h-"), F.col("n") % 6), VOCABULARY)
    return places(spark, d).select("n", m.alias("m")).select("n", "m.mapped_mark", "m.confidence")


@query(PRELUDE + "SELECT n, n AS element_id FROM keys")
def unique_id_numbers(spark: SparkSession, d: str) -> DataFrame:
    tail = F.lpad(F.hex(F.expr("n ^ 2596069104L")), 8, "0")  # 0x9abcdef0, the end of the part before
    uid = F.concat(F.lit("60f91daf-3dd7-4283-a86d-24139abcdef0-"), tail)
    return places(spark, d).select("n", K.element_number(F.lower(uid)).alias("element_id"))


@query(PRELUDE + "SELECT n, 'GET /x?token=REDACTED&id=' || n || ' api_key=REDACTED' AS line FROM keys")
def redact_lines(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit("GET /x?token=abc"), "n", F.lit("&id="), "n", F.lit(" api_key=k"), "n")
    return places(spark, d).select("n", K.redacted(line).alias("line"))


@query(
    PRELUDE + "SELECT n, CASE n % 4 WHEN 3 THEN 'note' WHEN 0 THEN 'exclude' ELSE 'mark_alias' END AS kind, CASE n % 4 WHEN 0 THEN 'holdown' WHEN 1 THEN 'holdown' WHEN 2 THEN 'post' END AS category, "
    "CASE n % 4 WHEN 0 THEN 'HD' || (n % 30) WHEN 1 THEN 'XY-' || (n % 30) WHEN 2 THEN 'TD-' || (n % 9) END AS token, CASE n % 4 WHEN 1 THEN 'HD' || (n % 8) WHEN 2 THEN 'TD-' || (n % 9) END AS maps_to FROM keys"
)
def rule_parse(spark: SparkSession, d: str) -> DataFrame:
    told = F.expr("CASE n % 4 WHEN 0 THEN concat('please ignore HD', n % 30) WHEN 1 THEN concat('xy ', n % 30, ' means hd', n % 8) WHEN 2 THEN concat('td-', n % 9, ' marks are posts') ELSE 'have a look at the roof' END")
    return places(spark, d).select("n", K.parsed_rule(told).alias("r")).select("n", "r.kind", "r.category", "r.token", "r.maps_to")


@query(PRELUDE + ", r AS (SELECT n AS seq, CASE WHEN n % 3 = 0 THEN 'exclude' ELSE 'mark_alias' END AS kind, 'T' || (n % 50) AS token, 'H' || (n % 9) AS maps_to FROM keys) SELECT kind, token, max_by(maps_to, seq) AS maps_to FROM r GROUP BY 1, 2")
def override_maps(spark: SparkSession, d: str) -> DataFrame:
    rules = places(spark, d).selectExpr("n AS seq", "CASE WHEN n % 3 = 0 THEN 'exclude' ELSE 'mark_alias' END AS kind", "concat('T', n % 50) AS token", "concat('H', n % 9) AS maps_to")
    return X.overrides(rules)


@query(PRELUDE + "SELECT n, CASE WHEN n % 5 = 0 THEN NULL ELSE n % 3 = 0 END AS same FROM keys")
def title_matches(spark: SparkSession, d: str) -> DataFrame:
    live = F.when(F.col("n") % 5 != 0, F.when(F.col("n") % 3 == 0, F.concat(F.lit("Tower "), "n")).otherwise("Annex"))
    return places(spark, d).select("n", K.titles_match(live, K.stem(F.concat(F.lit("C:\\jobs\\TOWER "), "n", F.lit("_v2.rvt")))).alias("same"))


@query(
    r"""SELECT conv_id, turn, CASE WHEN slug = '' THEN 'project' ELSE slug END AS slug FROM (
  SELECT conv_id, turn, left(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g'), 48) AS slug FROM conversations)"""
)
def slugs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", K.slug(F.col("text")).alias("slug"))


@query(
    PRELUDE + ", w AS (SELECT n AS seq, n // 40 AS page, (n % 40) * 12.0 AS x, CASE n % 8 WHEN 0 THEN '(2)' WHEN 1 THEN 'H1' WHEN 4 THEN 'SW-2' WHEN 6 THEN '5/S-501' WHEN 7 THEN 'P1' ELSE 'plan' END AS text FROM keys) "
    "SELECT a.seq, a.text AS mark, CASE WHEN count(*) FILTER (b.text = '(2)') > 0 THEN 2 ELSE 1 END AS total FROM w a LEFT JOIN w b ON a.page = b.page AND abs(a.seq - b.seq) <= 6 AND a.seq <> b.seq AND a.x - b.x > 0 AND a.x - b.x <= 36 AND b.text = '(2)' "
    "WHERE a.text IN ('H1','SW-2','P1') AND NOT EXISTS (SELECT 1 FROM w r WHERE r.page = a.page AND abs(r.seq - a.seq) <= 6 AND r.text = '5/S-501' AND abs(r.x - a.x) <= 36) GROUP BY 1, 2"
)
def plan_marks(spark: SparkSession, d: str) -> DataFrame:
    words = places(spark, d).selectExpr("n AS seq", "n div 40 AS page", "cast(n % 40 * 12 AS double) AS x", "0.0D AS y", "CASE n % 8 WHEN 0 THEN '(2)' WHEN 1 THEN 'H1' WHEN 4 THEN 'SW-2' WHEN 6 THEN '5/S-501' WHEN 7 THEN 'P1' ELSE 'plan' END AS text")
    return X.plan_marks(words).select("seq", "mark", "total")


@query(PRELUDE + ", w AS (SELECT n // 40 AS page, n % 40 AS i, CASE WHEN n % 3 = 0 THEN 'S-' || (100 + n % 40) ELSE 'word' || n END AS text, 10.0 + n % 5 AS h, (n % 7) * 5.0 AS y1 FROM keys) SELECT page, max_by(text, (h, y1, -i)) AS sheet FROM w WHERE text LIKE 'S-%' GROUP BY 1")
def title_strip_pick(spark: SparkSession, d: str) -> DataFrame:
    words = places(spark, d).selectExpr("n div 40 AS page", "n % 40 AS seq", "CASE WHEN n % 3 = 0 THEN concat('S-', 100 + n % 40) ELSE concat('word', n) END AS text", "cast(10 + n % 5 AS double) AS height", "cast(n % 7 * 5 AS double) AS y1")
    return X.sheet_number(words)


@query(PRELUDE + ", s AS (SELECT n, 10 * n AS seq, px + 3 AS ax, py + 4 AS ay, px + 13 AS bx, py + 4 AS by FROM places WHERE n % 2 = 0) SELECT p.n, s.bx AS x, s.by AS y FROM places p JOIN s USING (n)")
def leader_tips(spark: SparkSession, d: str) -> DataFrame:
    p = places(spark, d)
    segments = p.where("n % 2 = 0").selectExpr("n AS seq", "px + 3 AS ax", "py + 4 AS ay", "px + 13 AS bx", "py + 4 AS by")
    return X.leader_tips(p.selectExpr("n AS id", "px AS x", "py AS y"), segments, 6.0).select(F.col("id").alias("n"), "x", "y")
