"""The whole run as stages: what each needs, and the tables it makes.

A stage is a function from tables to a table; a run takes the stages whose needs are there and
writes what they make, so a later run can go on from any of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.config import Gates
from spanwright.functions.geometry import apply_affine, invert_affine
from spanwright.functions.verdicts import product_verdict
from spanwright.operators import categories as C
from spanwright.operators import matching as M
from spanwright.operators.cluster import devices
from spanwright.operators.fit import calibrate
from spanwright.sources.scratch import stash

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Stage:
    name: str
    needs: tuple[str, ...]
    make: Callable[[Tables, Gates], DataFrame]


def _calibrations(t: Tables, gates: Gates) -> DataFrame:
    return calibrate(t["point_pairs"], "sheet", t.get("held_pairs"))


def _projected(t: Tables, gates: Gates) -> DataFrame:
    """Marks in model feet, on sheets whose registration may be used. Calibrations go from the
    model to the sheet, so marks go through the inverse."""
    cal = t["calibrations"].where("match_allowed").select("sheet", invert_affine(F.col("matrix")).alias("inverse"))
    x, y = apply_affine(F.col("inverse"), F.col("px"), F.col("py"))
    return t["marks"].join(cal, "sheet").withColumn("x", x).withColumn("y", y).drop("inverse")


def _by_category(t: Tables, name: str) -> bool:
    return "targets" in t and "category" in t["targets"].columns and "category" in t[name].columns


def _devices(t: Tables, gates: Gates) -> DataFrame:
    """Clustered by category where both sides have one, else as one category."""
    if _by_category(t, "projected"):
        return C.devices_of(t["projected"], gates.cluster_ft)
    return devices(t["projected"], gates.cluster_ft, "device")


def _verdicts(t: Tables, gates: Gates) -> DataFrame:
    sheets = t["calibrations"].select("sheet", "rms", "scale")
    if _by_category(t, "devices"):
        final = C.settled(stash(C.matched(t["devices"], t["targets"], sheets), "matched"), t["targets"], gates=gates)
        return final.withColumn("verdict", product_verdict(F.col("status")))
    assigned = M.assign(t["devices"], t["targets"], sheets, gates)
    settled = M.settle_by_context(M.settle_by_orientation(assigned, t["targets"], gates), t["targets"], gates)
    return settled.withColumn("verdict", product_verdict(F.col("status")))


def _elements(t: Tables, gates: Gates) -> DataFrame:
    """Each mark with its device's status; marks on sheets without registration were not
    evaluated; targets that no device has are rows of their own."""
    v = t["verdicts"].select(F.explode("appearances").alias("mark_id"), F.col("id").alias("device_id"), "status", "target_id", "distance_ft")
    rows = t["marks"].join(v, t["marks"].id == v.mark_id, "left").drop("mark_id").withColumn("status", F.coalesce("status", F.lit("NOT_EVALUATED")))
    if _by_category(t, "verdicts"):
        left = C.left_over(t["verdicts"], t["targets"]).where("covered_by IS NULL")
        free = left.select("category", "id", "mark", F.lit("REVIT_ONLY").alias("status"), F.col("id").alias("target_id"))
        return rows.unionByName(free, allowMissingColumns=True).withColumn("verdict", product_verdict(F.col("status")))
    free = t["targets"].join(t["verdicts"].where("target_id IS NOT NULL").select(F.col("target_id").alias("id")), "id", "left_anti").select("id", "mark", F.lit("REVIT_ONLY").alias("status"), F.col("id").alias("target_id"))
    return rows.unionByName(free, allowMissingColumns=True).withColumn("verdict", product_verdict(F.col("status")))


STAGES = (
    Stage("calibrations", ("point_pairs",), _calibrations),
    Stage("projected", ("marks", "calibrations"), _projected),
    Stage("devices", ("projected",), _devices),
    Stage("verdicts", ("devices", "targets", "calibrations"), _verdicts),
    Stage("elements", ("marks", "targets", "verdicts"), _elements),
)


@dataclass
class Run:
    tables: Tables
    gates: Gates = field(default_factory=Gates)
    log: list[dict] = field(default_factory=list)

    def go(self) -> Tables:
        for s in STAGES:
            missing = [n for n in s.needs if n not in self.tables]
            if s.name in self.tables or missing:
                self.log.append({"seq": len(self.log), "step": s.name, "kind": "skip", "missing": missing})
                continue
            self.tables[s.name] = stash(s.make(self.tables, self.gates), s.name)
            self.log.append({"seq": len(self.log), "step": s.name, "kind": "done", "missing": []})
        return self.tables

    def invalidate(self, name: str) -> None:
        """Forgets a stage's table and all that were made from it."""
        gone = {name}
        for s in STAGES:
            if gone & set(s.needs):
                gone.add(s.name)
        for n in gone & {s.name for s in STAGES}:
            self.tables.pop(n, None)


def refit_if_better(run: Run, pairs: DataFrame, least: int = 8) -> bool:
    """Fits again from the matched devices and keeps the result only if more devices match and
    no fewer are paired: two runs are compared by their counts."""
    count = lambda v: v.agg(F.count_if(F.col("status") == "MATCH").alias("m"), F.count("target_id").alias("p")).first()
    before = count(run.tables["verdicts"])
    if before["m"] < least:
        return False
    trial = Run({n: t for n, t in run.tables.items() if n in ("marks", "targets")} | {"point_pairs": pairs}, run.gates)
    after = count(trial.go()["verdicts"])
    if after["m"] > before["m"] and after["p"] >= before["p"]:
        run.tables = trial.tables
        return True
    return False
