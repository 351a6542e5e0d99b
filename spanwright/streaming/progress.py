"""Progress events: reading on from a place, latest states, folds of a workflow, rate limits.

The batch forms answer over a table of events; the streaming forms keep state by key.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

# States of the workflow and the states that may follow each.
FOLLOWS = {
    "idle": ("proposing",),
    "proposing": ("awaiting_pdf_approval", "failed"),
    "awaiting_pdf_approval": ("stamping", "failed"),
    "stamping": ("awaiting_revit", "failed"),
    "awaiting_revit": ("placing_markers", "failed"),
    "placing_markers": ("awaiting_revit_approval", "failed"),
    "awaiting_revit_approval": ("awaiting_export", "failed"),
    "awaiting_export": ("calibrating", "failed"),
    "calibrating": ("done", "failed"),
    "done": ("proposing",),
    "failed": ("proposing",),
}


def events_since(events: DataFrame, tenant: Any, since: int) -> DataFrame:
    """A tenant's events after a place; events without tenant go to nobody."""
    return events.where((F.col("tenant") == F.lit(tenant)) & (F.col("seq") > since))


def resumed(events: DataFrame, starts: DataFrame, tenant: str = "tenant") -> DataFrame:
    """What each listener (listener, tenant, since, joined) is sent: events of its tenant after
    the place it asks for, or, if it asks for none, after the last one there was when it joined."""
    w = starts.select("listener", F.col(tenant).alias("_t"), F.coalesce("since", "joined").alias("_from"))
    return events.join(w, (events[tenant] == F.col("_t")) & (events["seq"] > F.col("_from"))).drop("_t", "_from")


def newest(events: DataFrame, by: str, n: int) -> DataFrame:
    """The last ``n`` events of each key, as a ring buffer holds them. The n-th largest seq is
    found from the largest of each task's share, so a key with very many events is cut down
    before it is sorted."""
    part = Window.partitionBy(by, F.pmod(F.col("seq"), F.lit(64))).orderBy(F.desc("seq"))
    few = events.withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= n)
    return few.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("seq")))).where(F.col("_r") <= n).drop("_r")


def latest_states(events: DataFrame, *by: str) -> DataFrame:
    return events.groupBy(*by).agg(F.max_by("kind", "seq").alias("kind"), F.max("seq").alias("seq"))


def run_outcome(stages: DataFrame, run: str) -> DataFrame:
    """failed if a stage failed, running while one runs, blocked while one waits, else done."""
    k = F.col("kind")
    bad, busy, wait = F.bool_or(k == "failed"), F.bool_or(k == "running"), F.bool_or(k == "pending")
    return stages.groupBy(run).agg(F.when(bad, "failed").when(busy, "running").when(wait, "blocked").otherwise("completed").alias("outcome"))


def allowed(requests: DataFrame, by: str, most: int = 10, seconds: int = 60) -> DataFrame:
    """Each request of a key with how many it made in the last ``seconds``, itself included;
    it is within the limit if that is at most ``most``. Windows are over blocks of time twice
    as long, each with the block before it, so no window holds a key's whole history."""
    sec = F.unix_micros(F.col("ts").cast("timestamp"))
    width = seconds * 1_000_000
    block = F.floor(sec / (2 * width))
    rows = requests.withColumn("_us", sec).withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_block", block + F.col("_copy"))
    rows = rows.where((F.col("_copy") == 0) | (F.col("_us") >= F.col("_block") * 2 * width - width))
    n = F.count("*").over(Window.partitionBy(by, "_block").orderBy("_us").rangeBetween(-(width - 1), 0))
    return rows.withColumn("recent", n).where("_copy = 0").drop("_us", "_copy", "_block").withColumn("within_limit", F.col("recent") <= most)


def _fold(state: str, steps: list[str]) -> tuple[str, int]:
    refused = 0
    for to in steps:
        if to in FOLLOWS.get(state, ()):
            state = to
        else:
            refused += 1
    return state, refused


def workflow_states(steps: DataFrame, by: str) -> DataFrame:
    """(key, state, refused) after all steps (``by``, seq, to_state) in order; a step that may
    not follow is refused and changes nothing. The fold is a column expression."""
    follows = F.create_map(*[x for k, v in FOLLOWS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "to_state"))), lambda s: s["to_state"])
    move = lambda a, to: F.when(F.array_contains(F.element_at(follows, a["s"]), to), F.struct(to.alias("s"), a["n"].alias("n"))).otherwise(F.struct(a["s"].alias("s"), (a["n"] + 1).alias("n")))
    start = F.struct(F.lit("idle").alias("s"), F.lit(0).cast("long").alias("n"))
    return steps.groupBy(by).agg(F.aggregate(ordered, start, move).alias("f")).select(by, F.col("f.s").alias("state"), F.col("f.n").alias("refused"))


def follow_workflow(steps: DataFrame, by: str) -> DataFrame:
    """The streaming form: one row for each key that had steps in a batch."""

    def move(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, refused = state.get if state.exists else ("idle", 0)
        rows = pd.concat(list(batches)).sort_values("seq")
        now, more = _fold(now, rows["to_state"].tolist())
        state.update((now, refused + more))
        yield pd.DataFrame({by: [key[0]], "state": [now], "refused": [refused + more]})

    kind = dict(steps.dtypes)[by]
    return steps.groupBy(by).applyInPandasWithState(move, f"{by} {kind}, state string, refused long", "state string, refused long", "update", GroupStateTimeout.NoTimeout)


def watch_files(spark: SparkSession, folder: str, schema: str, fmt: str = "json") -> DataFrame:
    """New files of a folder as a stream, the newest first, one in a batch."""
    return spark.readStream.schema(schema).option("latestFirst", "true").option("maxFilesPerTrigger", 1).option("multiLine", "true").format(fmt).load(folder)


def event_counts(events: DataFrame, length: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts by kind in windows of event time; works on streams and tables."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "kind", "n")
