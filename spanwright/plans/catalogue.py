"""Every query of the reconciliation engine by name, with the SQL it equals."""

from __future__ import annotations

from . import assembly_queries, category_queries, consensus_queries, drawing_queries, evidence_queries, matching_queries, report_queries, scan_queries, schedule_queries, stream_queries, teach_queries, text_queries, workflow_queries  # noqa: F401
from .registrar import ORACLES, QUERIES

FLAGSHIP = "device_verdict_counts"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
