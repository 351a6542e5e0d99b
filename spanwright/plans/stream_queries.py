"""Event logs: places, states, limits and windows, over tables of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.streaming import progress as S

from .registrar import query
from .views import PRELUDE, log_events, places


def _log(spark: SparkSession, d: str) -> DataFrame:
    return log_events(spark, d).select(F.col("event_id").alias("seq"), F.col("user_id").alias("tenant"), F.col("event_type").alias("kind"), "ts", "value")


@query("SELECT event_id AS seq, event_type AS kind FROM events WHERE user_id = 7 AND event_id > 500")
def events_since(spark: SparkSession, d: str) -> DataFrame:
    return S.events_since(_log(spark, d), 7, 500).select("seq", "kind")


@query("SELECT user_id AS tenant, event_id AS seq FROM events WHERE user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 5")
def ring_buffer_tail(spark: SparkSession, d: str) -> DataFrame:
    return S.newest(_log(spark, d).where("tenant IS NOT NULL"), "tenant", 5).select("tenant", "seq")


@query("SELECT user_id AS tenant, max_by(event_type, event_id) AS kind, max(event_id) AS seq FROM events GROUP BY 1")
def latest_stage_state(spark: SparkSession, d: str) -> DataFrame:
    return S.latest_states(_log(spark, d), "tenant")


STAGE = "CASE event_type WHEN 'click' THEN 'done' WHEN 'view' THEN 'running' WHEN 'signup' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'pending' END"


@query(f"WITH s AS (SELECT user_id AS run, round_even(value, 0)::INTEGER % 3 AS stage, max_by({STAGE}, event_id) AS kind FROM events GROUP BY 1, 2) SELECT run, CASE WHEN bool_or(kind = 'failed') THEN 'failed' WHEN bool_or(kind = 'running') THEN 'running' WHEN bool_or(kind = 'pending') THEN 'blocked' ELSE 'completed' END AS outcome FROM s GROUP BY 1")
def run_outcomes(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d).select("seq", F.col("tenant").alias("run"), (F.bround("value", 0).cast("int") % 3).alias("stage"), F.expr("CASE kind WHEN 'click' THEN 'done' WHEN 'view' THEN 'running' WHEN 'signup' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'pending' END").alias("kind"))
    return S.run_outcome(S.latest_states(log, "run", "stage"), "run")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS recent, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) <= 2 AS within_limit FROM events")
def rate_limit_window(spark: SparkSession, d: str) -> DataFrame:
    return S.allowed(log_events(spark, d).select("event_id", "user_id", "ts"), "user_id", most=2, seconds=3600).select("event_id", "recent", "within_limit")


def _fsm_sql() -> str:
    """One step of every project after another."""
    allowed = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b" for a, to in S.FOLLOWS.items() for b in to)
    names = ", ".join(f"'{s}'" for s in [*list(S.FOLLOWS)[1:10], "stamping", "failed", "proposing", "failed"])
    return PRELUDE.replace("WITH keys", "WITH RECURSIVE keys") + f""", allowed AS ({allowed}),
steps AS (SELECT n // 13 AS project, row_number() OVER (PARTITION BY n // 13 ORDER BY n) AS i, [{names}][1 + n % 13] AS to_state FROM keys),
f(project, i, state, refused) AS (
  SELECT DISTINCT project, CAST(0 AS BIGINT), 'idle', CAST(0 AS BIGINT) FROM steps
  UNION ALL
  SELECT s.project, s.i, CASE WHEN a.b IS NULL THEN f.state ELSE s.to_state END, f.refused + CASE WHEN a.b IS NULL THEN 1 ELSE 0 END
  FROM f JOIN steps s ON s.project = f.project AND s.i = f.i + 1 LEFT JOIN allowed a ON a.a = f.state AND a.b = s.to_state)
SELECT project, state, refused FROM f QUALIFY row_number() OVER (PARTITION BY project ORDER BY i DESC) = 1"""


@query(_fsm_sql())
def fsm_fold(spark: SparkSession, d: str) -> DataFrame:
    return S.workflow_states(_steps(spark, d), "project")


def _steps(spark: SparkSession, d: str) -> DataFrame:
    order = F.array(*[F.lit(s) for s in [*list(S.FOLLOWS)[1:10], "stamping", "failed", "proposing"]])
    return places(spark, d).selectExpr("n AS seq", "n div 13 AS project", "n % 13 AS i").withColumn("to_state", F.coalesce(F.get(order, F.col("i").cast("int")), F.lit("failed")))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2")
def hourly_event_counts(spark: SparkSession, d: str) -> DataFrame:
    return S.event_counts(_log(spark, d), "1 hour")


@query("WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, k")
def sessions(spark: SparkSession, d: str) -> DataFrame:
    e = log_events(spark, d)
    return e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("start")).select("user_id", "start", "n")


@query("SELECT l.listener, event_id AS seq FROM events JOIN (SELECT DISTINCT user_id % 50 AS u, user_id % 50 AS listener, CASE WHEN user_id % 50 % 2 = 0 THEN 900 END AS since FROM events WHERE user_id IS NOT NULL) l ON user_id = l.u WHERE event_id > coalesce(since, (SELECT max(event_id) - 100 FROM events))")
def resumed_listeners(spark: SparkSession, d: str) -> DataFrame:
    """Every second listener asks for a place; the others joined a hundred events before the end."""
    log = _log(spark, d)
    last = log.agg((F.max("seq") - 100).alias("joined"))
    starts = log.where("tenant IS NOT NULL").select((F.col("tenant") % 50).alias("tenant")).distinct().select(F.col("tenant").alias("listener"), "tenant", F.when(F.col("tenant") % 2 == 0, F.lit(900).cast("long")).alias("since"))
    return S.resumed(log, starts.join(F.broadcast(last))).select("listener", "seq")
