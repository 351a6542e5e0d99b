"""Taught rules: the memory after changes, what holds in a project, and tokens by their rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.operators import teach as T
from spanwright.operators.schedules import HEADERS
from spanwright.sources.memory import KeyedTable
from spanwright.sources.scratch import scratch_path

from .registrar import query
from .views import PRELUDE, places

KIND = "CASE n % 11 WHEN 0 THEN 'exclude' WHEN 1 THEN 'mark_pattern' WHEN 2 THEN 'category_header' WHEN 3 THEN 'note' WHEN 4 THEN 'other' ELSE 'mark_alias' END"
RULE = {
    "id": "concat('mem_', n)", "seq": "n", "scope": "CASE n % 4 WHEN 0 THEN 'global' WHEN 1 THEN 'project:a' WHEN 2 THEN 'project:b' END", "origin": "'a'", "instruction": "'told'",
    "kind": KIND, "category": "CASE n % 7 WHEN 0 THEN 'holdown' WHEN 1 THEN 'shear_wall' WHEN 2 THEN 'post' WHEN 3 THEN 'roof' WHEN 4 THEN 'steel_column' WHEN 5 THEN 'holdown' END",
    "token": "CASE WHEN n % 13 = 0 THEN '' ELSE concat('tx', n % 37) END", "maps_to": "CASE WHEN n % 3 = 0 THEN concat('h', n % 9) WHEN n % 3 = 1 THEN '' END",
    "regex": "CASE WHEN n % 23 = 0 THEN NULL WHEN n % 5 = 0 THEN '([' WHEN n % 2 = 0 THEN concat('q', n % 10, '[0-9]$') ELSE concat('Z', n % 17, '(SCHED|X)?') END",
}
TOKEN = "CASE n % 6 WHEN 0 THEN concat(' Tx', n % 41, ' ') WHEN 1 THEN concat('q', n % 10, n % 8) WHEN 2 THEN concat('z', n % 19, 'x') WHEN 3 THEN concat('HD', n % 25) WHEN 4 THEN concat('SW-', n % 12) ELSE concat('V', n % 9) END"
TITLE = "CASE n % 5 WHEN 0 THEN concat('z', n % 17, 'sched list') WHEN 1 THEN 'Holdown Schedule' WHEN 2 THEN 'door schedule' WHEN 3 THEN concat('see q', n % 10, '5') ELSE 'plan' END"
VOCABULARY = "(VALUES ('holdown', 'HD3', 1), ('holdown', 'H2', 2), ('unknown', 'V1', 3), ('post', 'V2', 4), ('shear_wall', 'V2', 5), ('wall_type', 'V3', 6), ('post', 'Q33', 7), ('shear_wall', 'SW-1', 8))"


def _list(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {c}" for c, e in columns.items())


RULES = PRELUDE + f""", rules AS (SELECT {_list(RULE)} FROM keys),
here AS (
  SELECT *, upper(token) AS key FROM rules WHERE (scope IS NULL OR scope IN ('global', 'project:a')) AND category IN ('holdown', 'shear_wall', 'post', 'steel_column', 'wall_type')
    AND CASE WHEN kind IN ('mark_alias', 'exclude') THEN coalesce(token, '') <> '' WHEN kind IN ('mark_pattern', 'category_header') THEN regex <> '([' ELSE false END),
last AS (SELECT *, row_number() OVER (PARTITION BY kind, key ORDER BY seq DESC) AS nth FROM here WHERE kind IN ('mark_alias', 'exclude')),
held AS (
  SELECT kind, key, category, CASE WHEN kind = 'mark_alias' THEN upper(coalesce(nullif(maps_to, ''), token)) END AS value, id AS taught_by, 1 AS place, seq FROM last WHERE nth = 1
  UNION ALL SELECT kind, category, category, regex, id, row_number() OVER (PARTITION BY kind, category ORDER BY seq), seq FROM here WHERE kind IN ('mark_pattern', 'category_header')),
ranked AS (SELECT *, min(seq) OVER (PARTITION BY kind, category) AS rank FROM held)"""


def rules(spark: SparkSession, d: str) -> DataFrame:
    return places(spark, d).selectExpr(*[f"{e} AS {c}" for c, e in RULE.items()])


@query(RULES + "SELECT kind, key, category, value, taught_by, CAST(place AS INTEGER) AS place FROM held")
def taught_overrides(spark: SparkSession, d: str) -> DataFrame:
    return T.overrides_of(rules(spark, d), "a")


@query(
    RULES + f""", vocabulary(category, mark, rank) AS {VOCABULARY},
toks AS (SELECT DISTINCT upper(trim({TOKEN})) AS t FROM keys),
hits AS (SELECT t, arg_min(r.category, (r.rank, r.place)) AS p_cat FROM toks JOIN ranked r ON r.kind = 'mark_pattern' AND regexp_matches(t, '(?i)^(?:' || r.value || ')') GROUP BY t),
listed AS (SELECT upper(mark) AS t, arg_min(category, rank) AS v_cat FROM vocabulary WHERE category NOT IN ('wall_type', 'unknown') GROUP BY 1),
judged AS (
  SELECT k.t, x.key IS NOT NULL AS excluded, a.category AS a_cat, a.value AS a_mark, a.taught_by AS a_by, v_cat, p_cat,
    CASE WHEN regexp_matches(k.t, '^(?:H|HD|HDU|HTT|TD)-?[0-9]{{1,2}}$') THEN 'holdown' WHEN regexp_matches(k.t, '^SW-?[0-9]{{1,2}}$') THEN 'shear_wall' END AS b_cat
  FROM toks k LEFT JOIN held x ON x.kind = 'exclude' AND x.key = k.t LEFT JOIN held a ON a.kind = 'mark_alias' AND a.key = k.t LEFT JOIN listed USING (t) LEFT JOIN hits USING (t)),
named AS (
  SELECT t, CASE WHEN NOT excluded THEN coalesce(a_cat, v_cat, p_cat, b_cat) END AS category, CASE WHEN NOT excluded AND a_cat IS NOT NULL THEN a_mark ELSE t END AS mark,
    CASE WHEN excluded THEN 'exclude' WHEN a_cat IS NOT NULL THEN 'alias' WHEN v_cat IS NOT NULL THEN 'vocabulary' WHEN p_cat IS NOT NULL THEN 'pattern' WHEN b_cat IS NOT NULL THEN 'built_in' END AS source, a_by, excluded FROM judged)
SELECT k.n, m.category, m.mark, EXISTS (SELECT 1 FROM vocabulary v WHERE v.category = m.category AND upper(v.mark) = m.mark) AS schedule_listed, m.source,
  CASE WHEN m.source = 'alias' THEN a_by WHEN m.source = 'pattern' THEN 'taught_pattern' END AS taught_by
FROM (SELECT n, upper(trim({TOKEN})) AS t FROM keys) k JOIN named m USING (t)"""
)
def taught_tokens(spark: SparkSession, d: str) -> DataFrame:
    tokens = places(spark, d).selectExpr("n", f"{TOKEN} AS token")
    vocabulary = spark.sql(f"SELECT * FROM {VOCABULARY} AS t(category, mark, rank)")
    return T.classified(tokens, vocabulary, rules(spark, d), "a").select("n", "category", "mark", "schedule_listed", "source", "taught_by")


@query(
    RULES + f""", titles AS (SELECT n, {TITLE} AS title FROM keys),
hits AS (SELECT title, arg_min(r.category, (r.rank, r.place)) AS cat FROM (SELECT DISTINCT title FROM titles) JOIN ranked r ON r.kind = 'category_header' AND regexp_matches(title, '(?i)(?:' || r.value || ')') GROUP BY title)
SELECT n, title, coalesce(cat, CASE WHEN title ILIKE 'holdown schedule' THEN 'holdown' WHEN title ILIKE '%schedule%' THEN 'unknown' END) AS category FROM titles LEFT JOIN hits USING (title)"""
)
def taught_headers(spark: SparkSession, d: str) -> DataFrame:
    return T.headers_of(places(spark, d).selectExpr("n", f"{TITLE} AS title"), rules(spark, d), "a", HEADERS)


@query(
    PRELUDE + """, first AS (SELECT 'mem_' || n AS id, n AS v, 'old' AS note FROM keys WHERE n % 5 < 3),
one AS (SELECT id, v, note FROM first WHERE CAST(substr(id, 5) AS BIGINT) % 11 <> 0 OR CAST(substr(id, 5) AS BIGINT) % 22 = 0),
upd AS (SELECT 'mem_' || n AS id, 1000 + n AS v FROM keys WHERE n % 7 = 0 AND NOT (n % 11 = 0 AND n % 22 <> 0)),
two AS (SELECT coalesce(o.id, u.id) AS id, coalesce(u.v, o.v) AS v, coalesce(CASE WHEN u.id IS NOT NULL AND u.v % 2 = 0 THEN 'new' END, o.note) AS note FROM one o FULL JOIN upd u USING (id)),
more AS (SELECT printf('mem_%03d', row_number() OVER (ORDER BY n) + (SELECT max(CAST(substr(id, 5) AS BIGINT)) FROM two)) AS id, -n AS v, 'added' AS note FROM keys WHERE n % 100 = 0)
SELECT * FROM two UNION ALL SELECT * FROM more"""
)
def memory_after_changes(spark: SparkSession, d: str) -> DataFrame:
    """Rows taken over from an old store, then upserts and deletes (of each key the last holds),
    then new rows under new ids."""
    n = places(spark, d).select("n")
    table = KeyedTable(spark, scratch_path(spark, "memory"), "id string, v bigint, note string")
    table.adopt(n.where("n % 5 < 3").selectExpr("concat('mem_', n) AS id", "n AS v", "'old' AS note"), "v", "mem")
    key = "concat('mem_', n) AS id"
    gone = n.where("n % 11 = 0").selectExpr("2 * n AS seq", key, "'delete' AS op", "cast(null AS bigint) AS v", "cast(null AS string) AS note")
    back = n.where("n % 22 = 0 AND n % 5 < 3").selectExpr("2 * n + 1 AS seq", key, "'upsert' AS op", "n AS v", "'old' AS note")
    table.merge(gone.unionByName(back))
    table.merge(n.where("n % 7 = 0 AND NOT (n % 11 = 0 AND n % 22 <> 0)").selectExpr("n AS seq", key, "'upsert' AS op", "1000 + n AS v", "CASE WHEN n % 2 = 0 THEN 'new' END AS note"))
    table.append(n.where("n % 100 = 0").selectExpr("n AS o", "-n AS v", "'added' AS note"), "o", "mem")
    return table.read()
