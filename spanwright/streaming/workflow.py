"""A workflow with approval gates and an audit of every step, as a table and as a stream.

Steps (key, seq, kind, name, actor, note): ``step`` asks for the state ``name``; ``advance``
reports what an agent has done; ``approve`` and ``reject`` answer a gate. What an agent reports
while a gate still waits for its answer is held, and counts once the gate is approved; after a
refusal it is refused. Every step leaves audit rows, whatever becomes of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from spanwright.streaming.progress import FOLLOWS

# Gates and the states that approval opens; reports of agents, the states they
# need and those they lead to.
GATES = {"awaiting_pdf_approval": "stamping", "awaiting_revit_approval": "awaiting_export"}
REPORTS = {
    "stamped": ("stamping", "awaiting_revit"),
    "revit_connected": ("awaiting_revit", "placing_markers"),
    "markers_placed": ("placing_markers", "awaiting_revit_approval"),
    "export_received": ("awaiting_export", "calibrating"),
    "calibrated": ("calibrating", "done"),
}
AUDIT = "n long, seq long, actor string, outcome string, from_state string, to_state string, note string"


@dataclass
class Flow:
    """One key's workflow: its state, what waits behind a gate, and how many audit rows it has."""

    state: str = "idle"
    held: list[tuple] = field(default_factory=list)  # (seq, name, actor, note)
    rows: int = 0

    def _target(self, kind: str, name: str | None) -> str | None:
        if kind == "advance":
            needs, leads = REPORTS.get(name, (None, None))
            return leads if needs == self.state else None
        if kind == "approve":
            return GATES.get(self.state)
        if kind == "reject":
            return "failed" if self.state in GATES else None
        return name if kind == "step" and name in FOLLOWS.get(self.state, ()) else None

    def _audit(self, seq: int, actor: str | None, outcome: str, to: str | None, note: str | None) -> tuple:
        self.rows += 1
        row = (self.rows, seq, actor, outcome, self.state, to, note)
        self.state = to if to is not None else self.state
        return row

    def take(self, seq: int, kind: str, name: str | None, actor: str | None, note: str | None) -> Iterator[tuple]:
        """The audit rows of one step."""
        gate = GATES.get(self.state)
        to = self._target(kind, name)
        if to is None:
            waits = kind == "advance" and gate is not None and REPORTS.get(name, (None,))[0] == gate
            yield self._audit(seq, actor, "held" if waits else "refused", None, note)
            if waits:
                self.held.append((seq, name, actor, note))
            return
        yield self._audit(seq, actor, "applied", to, note)
        waiting, self.held = self.held, []
        for seq, name, actor, note in waiting:
            to = self._target("advance", name) if kind == "approve" else None
            yield self._audit(seq, actor, "released" if to else "refused", to, note)


COLUMNS = ("seq", "kind", "name", "actor", "note")


def history(steps: DataFrame, by: str) -> DataFrame:
    """(``by``, and the columns of AUDIT) of all steps, each key's in order of seq. Keys are taken
    one after another from sorted partitions: a task holds one key's flow, however long its
    history is. Steps without a key are dropped."""
    ready = steps.where(F.col(by).isNotNull()).repartition(F.col(by)).sortWithinPartitions(by, "seq").select(by, *COLUMNS)
    kind = dict(steps.dtypes)[by]
    names = [by, *(c.split()[0] for c in AUDIT.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, flow = None, Flow()
        for batch in batches:
            out = []
            for key, *step in zip(*[batch[c].tolist() for c in (by, *COLUMNS)], strict=True):
                if key != now:
                    now, flow = key, Flow()
                out += [(key, *row) for row in flow.take(*[None if v is None or v != v else v for v in step])]
            yield pd.DataFrame(out, columns=names)

    return ready.mapInPandas(run, f"{by} {kind}, {AUDIT}")


class _Follower(StatefulProcessor):
    """The same flow over micro-batches: the state as a value, what waits as a list, and the
    number of audit rows of each outcome as a map."""

    def __init__(self, by: str) -> None:
        self.by = by

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "state string")
        self.held = handle.getListState("held", "seq long, name string, actor string, note string")
        self.counts = handle.getMapState("counts", "outcome string", "n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        counts = {k[0]: v[0] for k, v in self.counts.iterator()}
        flow = Flow(self.state.get()[0] if self.state.exists() else "idle", list(self.held.get()) if self.held.exists() else [], sum(counts.values()))
        out = []
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for step in zip(*[batch[c].tolist() for c in COLUMNS], strict=True):
            out += flow.take(*[None if v is None or v != v else v for v in step])
        for row in out:
            counts[row[3]] = counts.get(row[3], 0) + 1
        self.state.update((flow.state,))
        if flow.held:
            self.held.put([tuple(h) for h in flow.held])
        elif self.held.exists():
            self.held.clear()
        for outcome, n in counts.items():
            self.counts.updateValue((outcome,), (n,))
        yield pd.DataFrame([(key[0], *row) for row in out], columns=[self.by, *(c.split()[0] for c in AUDIT.split(", "))])

    def close(self) -> None:
        pass


def follow(steps: DataFrame, by: str) -> DataFrame:
    """The streaming form of ``history``: audit rows as they arise, in append mode. It needs the
    RocksDB state store (``spark.sql.streaming.stateStore.providerClass``)."""
    kind = dict(steps.dtypes)[by]
    keyed = steps.where(F.col(by).isNotNull()).select(by, *COLUMNS)
    return keyed.groupBy(by).transformWithStateInPandas(_Follower(by), f"{by} {kind}, {AUDIT}", "Append", "None")


def final_states(audit: DataFrame, by: str) -> DataFrame:
    """(``by``, state, and the number of audit rows of each outcome)."""
    now = F.coalesce("to_state", "from_state")
    return audit.groupBy(by).agg(F.max_by(now, "n").alias("state"), *[F.count_if(F.col("outcome") == o).alias(o) for o in ("applied", "held", "released", "refused")])


def brackets(events: DataFrame, *by: str) -> DataFrame:
    """Each start (``by``, seq, kind start, done or error) with how it ended: the next event of its
    key that is a start or an end decides. Outcomes: done, error, superseded by another start,
    or open."""
    marked = events.where(F.col("kind").isin("start", "done", "error"))
    w = Window.partitionBy(*by).orderBy("seq")
    after = marked.withColumn("end_kind", F.lead("kind").over(w)).withColumn("end_seq", F.lead("seq").over(w)).where("kind = 'start'")
    outcome = F.when(F.col("end_kind") == "start", "superseded").otherwise(F.coalesce("end_kind", F.lit("open")))
    return after.select(*by, F.col("seq").alias("start_seq"), F.when(outcome.isin("done", "error"), F.col("end_seq")).alias("end_seq"), outcome.alias("outcome"))
