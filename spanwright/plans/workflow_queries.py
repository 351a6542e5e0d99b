"""Workflows with gates and their audit, brackets of steps, and the event log that numbers once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.sources.scratch import scratch_path
from spanwright.streaming import workflow as W
from spanwright.streaming.progress import FOLLOWS
from spanwright.streaming.sink import EventLog, server_sent

from .registrar import query
from .views import log_events

K = "(event_id * 7919 % 14)"
KIND = f"CASE WHEN {K} IN (0, 1, 9, 13) THEN 'step' WHEN {K} IN (2, 6, 10, 11) THEN 'approve' WHEN {K} = 12 AND event_id % 3 = 0 THEN 'reject' ELSE 'advance' END"
NAME = f"CASE {K} WHEN 0 THEN 'proposing' WHEN 1 THEN 'awaiting_pdf_approval' WHEN 3 THEN 'stamped' WHEN 4 THEN 'revit_connected' WHEN 5 THEN 'markers_placed' WHEN 7 THEN 'export_received' WHEN 8 THEN 'calibrated' WHEN 9 THEN 'failed' WHEN 12 THEN 'stamped' WHEN 13 THEN 'proposing' END"

_pairs = lambda rows: "VALUES " + ", ".join("(" + ", ".join(f"'{v}'" for v in r) + ")" for r in rows)
_HELD = "STRUCT(seq BIGINT, actor VARCHAR)"
_ROW = "STRUCT(seq BIGINT, actor VARCHAR, outcome VARCHAR, f VARCHAR, t VARCHAR)"
AUDIT = f"""WITH RECURSIVE edges(a, b) AS ({_pairs([(a, b) for a, to in FOLLOWS.items() for b in to])}),
gates(a, b) AS ({_pairs(W.GATES.items())}), reports(name, needs, leads) AS ({_pairs([(n, *v) for n, v in W.REPORTS.items()])}),
steps AS (SELECT user_id AS key, event_id AS seq, {KIND} AS kind, {NAME} AS name, 'u' || (event_id % 5) AS actor,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events WHERE user_id IS NOT NULL),
f(key, i, state, held, rows) AS (
  SELECT DISTINCT key, CAST(0 AS BIGINT), 'idle', CAST([] AS {_HELD}[]), CAST([] AS {_ROW}[]) FROM steps
  UNION ALL
  SELECT key, i,
    CASE WHEN tgt IS NULL THEN state WHEN kind = 'approve' AND len(held) > 0 THEN freed ELSE tgt END,
    CASE WHEN waits THEN list_append(held, {{'seq': seq, 'actor': actor}}) WHEN tgt IS NULL THEN held ELSE CAST([] AS {_HELD}[]) END,
    CASE WHEN tgt IS NULL THEN [{{'seq': seq, 'actor': actor, 'outcome': CASE WHEN waits THEN 'held' ELSE 'refused' END, 'f': state, 't': NULL}}]
      ELSE list_concat([{{'seq': seq, 'actor': actor, 'outcome': 'applied', 'f': state, 't': tgt}}],
        list_transform(held, lambda h, k: CASE WHEN kind = 'approve' AND k = 1 THEN {{'seq': h.seq, 'actor': h.actor, 'outcome': 'released', 'f': tgt, 't': freed}}
          ELSE {{'seq': h.seq, 'actor': h.actor, 'outcome': 'refused', 'f': CASE WHEN kind = 'approve' THEN freed ELSE tgt END, 't': NULL}} END)) END
  FROM (
    SELECT s.key, s.i, s.seq, s.actor, s.kind, f.state, f.held, after.leads AS freed,
      CASE s.kind WHEN 'advance' THEN CASE WHEN r.needs = f.state THEN r.leads END WHEN 'approve' THEN g.b WHEN 'reject' THEN CASE WHEN g.b IS NOT NULL THEN 'failed' END ELSE e.b END AS tgt,
      s.kind = 'advance' AND coalesce(r.needs = g.b, false) AS waits
    FROM f JOIN steps s ON s.key = f.key AND s.i = f.i + 1 LEFT JOIN gates g ON g.a = f.state LEFT JOIN reports r ON r.name = s.name
      LEFT JOIN edges e ON e.a = f.state AND e.b = s.name LEFT JOIN reports after ON after.needs = g.b)),
audit AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY i, k) AS n, r.* FROM (SELECT key, i, unnest(rows) AS r, unnest(range(len(rows))) AS k FROM f))"""


def steps(spark: SparkSession, d: str) -> DataFrame:
    return log_events(spark, d).selectExpr("user_id AS key", "event_id AS seq", f"{KIND} AS kind", f"{NAME} AS name", "concat('u', event_id % 5) AS actor", "cast(null AS string) AS note")


@query(AUDIT + "SELECT key, n, seq, actor, outcome, f AS from_state, t AS to_state FROM audit")
def workflow_audit(spark: SparkSession, d: str) -> DataFrame:
    return W.history(steps(spark, d), "key").drop("note")


@query(
    AUDIT + "SELECT key, arg_max(coalesce(t, f), n) AS state, count(*) FILTER (outcome = 'applied') AS applied, count(*) FILTER (outcome = 'held') AS held, "
    "count(*) FILTER (outcome = 'released') AS released, count(*) FILTER (outcome = 'refused') AS refused FROM audit GROUP BY key"
)
def workflow_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return W.final_states(W.history(steps(spark, d), "key"), "key")


BRACKET = "CASE event_type WHEN 'view' THEN 'start' WHEN 'click' THEN 'done' WHEN 'error' THEN 'error' ELSE 'info' END"


@query(
    f"""WITH e AS (SELECT user_id AS tenant, event_id AS seq, {BRACKET} AS kind FROM events WHERE user_id IS NOT NULL),
n AS (SELECT s.tenant, s.seq AS start_seq, min(x.seq) AS next_seq FROM e s LEFT JOIN e x ON x.tenant = s.tenant AND x.seq > s.seq AND x.kind <> 'info' WHERE s.kind = 'start' GROUP BY ALL)
SELECT n.tenant, start_seq, CASE WHEN x.kind <> 'start' THEN next_seq END AS end_seq, CASE WHEN x.kind IS NULL THEN 'open' WHEN x.kind = 'start' THEN 'superseded' ELSE x.kind END AS outcome
FROM n LEFT JOIN e x ON x.tenant = n.tenant AND x.seq = n.next_seq"""
)
def step_brackets(spark: SparkSession, d: str) -> DataFrame:
    return W.brackets(log_events(spark, d).where("user_id IS NOT NULL").selectExpr("user_id AS tenant", "event_id AS seq", f"{BRACKET} AS kind"), "tenant")


COLUMNS = "tenant bigint, id bigint, ts timestamp, kind string"
SLICES = 3


def _log(spark: SparkSession, d: str) -> EventLog:
    """The events in slices by id; each slice comes with the end of the one before, and the second
    is written twice."""
    rows = log_events(spark, d).selectExpr("user_id AS tenant", "event_id AS id", "ts", "event_type AS kind")
    width = rows.agg(F.max("id").alias("m")).selectExpr(f"m div {SLICES} + 1 AS w").first()["w"]
    log = EventLog(spark, scratch_path(spark, "log"), COLUMNS)
    for k in [0, 1, 1, 2]:
        log.append(rows.where(F.col("id").between(k * width - 50, (k + 1) * width - 1)), k)
    return log


LOGGED = """WITH e AS (SELECT user_id AS tenant, event_id AS id, ts, event_type AS kind, event_id // (SELECT max(event_id) // 3 + 1 FROM events) AS slice FROM events),
log AS (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY slice, ts, id) AS seq FROM e)"""


@query(LOGGED + "SELECT tenant, id, kind, seq FROM log")
def event_sink_log(spark: SparkSession, d: str) -> DataFrame:
    return _log(spark, d).read().select("tenant", "id", "kind", "seq")


@query(LOGGED + """SELECT seq, 'id: ' || seq || chr(10) || 'data: {"tenant":' || tenant || ',"id":' || id || ',"kind":"' || kind || '","seq":' || seq || '}' || chr(10) || chr(10) AS frame FROM log WHERE tenant = 7 AND seq > 3""")
def event_frames(spark: SparkSession, d: str) -> DataFrame:
    return server_sent(_log(spark, d).read().select("tenant", "id", "kind", "seq"), 7, 3)
