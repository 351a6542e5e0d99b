"""Named reads over the tables of a run, as an assistant or a page would ask for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.operators import reports as R

from .reconcile import Tables


def get_counts(t: Tables) -> DataFrame:
    return R.counts_by_dimension(t["elements"])


def query_elements(t: Tables, status: str | None = None, category: str | None = None, sheet: str | None = None, mark: str | None = None, limit: int = 25) -> DataFrame:
    return R.page_of(R.filtered(t["elements"], status, category, sheet, mark), limit)


def get_device(t: Tables, device_id: str) -> DataFrame:
    return t["verdicts"].where(F.col("id") == device_id).limit(1)


def get_run_comparison(t: Tables, baseline: DataFrame) -> DataFrame:
    return R.status_deltas(baseline, t["elements"])


def explain_element(t: Tables, element_id: str, limit: int = 10) -> DataFrame:
    """The element of that id, else up to ``limit`` with that mark."""
    e = t["elements"]
    own = e.where(F.col("id") == element_id).withColumn("rank", F.lit(0))
    alike = e.where(F.upper("mark") == element_id.upper()).withColumn("rank", F.lit(1))
    both = own.unionByName(alike)
    return both.join(both.agg(F.min("rank").alias("rank")), "rank").limit(limit)


def focus_element(t: Tables, element_id: str) -> DataFrame:
    return t["elements"].where(F.col("id") == element_id).select("id", "sheet", "x", "y")


TOOLS: dict[str, Callable[..., DataFrame]] = {f.__name__: f for f in (get_counts, query_elements, get_device, get_run_comparison, explain_element, focus_element)}
