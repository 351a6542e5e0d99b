"""A corpus pipeline of five stages over ``documents``: quality rules, SimHash near-dedup,
benchmark decontamination, secret scans, best-fit packing.

Each stage gets what its predecessor kept, as a table written and read again; all but the last
return the columns of documents. ORACLE_SQL is None: robust estimates, fingerprints, templates
and packing have no plain SQL; tests/llm/test_pipeline.py holds each stage against a plain
version. Every stage takes nulls in any column, empty and very long texts, repeated rows, empty
tables and further columns, as its operator's module says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanwright.llm.common import stash, table
from spanwright.llm.decontaminate import without_leaks
from spanwright.llm.packing import best_fit
from spanwright.llm.quality import good_documents
from spanwright.llm.secrets import redacted
from spanwright.llm.simhash import one_of_each_group

ORACLE_SQL: str | None = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return good_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return best_fit(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
