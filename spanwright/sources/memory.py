"""A keyed table that changes: each merge writes a version beside the ones before.

A version is a folder of Parquet files with the mark of success that Spark's writer leaves last;
readers take the highest finished one, so a merge that dies leaves no trace but an unfinished
folder, whose number the next merge passes over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.operators.cluster import numbered


class KeyedTable:
    """``columns`` as in SQL, with ``key`` as a string column."""

    def __init__(self, spark: SparkSession, path: str, columns: str, key: str = "id") -> None:
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = spark.createDataFrame([], columns).schema

    def _versions(self) -> list[tuple[int, bool]]:
        """(number, finished), of all folders."""
        jvm = self.spark._jvm
        top = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(top):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(top)]
        done = lambda n: fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))
        return sorted((int(n.removeprefix("v")), done(n)) for n in names if n.startswith("v") and n[1:].isdigit())

    @property
    def version(self) -> int:
        """Number of the newest finished version, 0 if there is none."""
        return max((n for n, done in self._versions() if done), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        at = self.version if version is None else version
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{at:06d}") if at else self.spark.createDataFrame([], self.schema)

    def _write(self, rows: DataFrame) -> int:
        number = max((n for n, _ in self._versions()), default=0) + 1
        rows.select(*self.schema.names).write.parquet(f"{self.path}/v{number:06d}")
        return number

    def merge(self, changes: DataFrame, order: str = "seq") -> int:
        """``changes``: the columns of the table, ``op`` (upsert or delete) and ``order``. Of several
        changes of a key the last holds. A column that an upsert leaves null keeps its value."""
        rest = [c for c in self.schema.names if c != self.key]
        last = changes.groupBy(self.key).agg(F.max_by(F.struct("op", *rest), order).alias("_new"))
        both = self.read().withColumn("_old", F.lit(True)).join(last, self.key, "full_outer")
        kept = both.where(F.col("_new").isNull() | (F.col("_new.op") == "upsert"))
        return self._write(kept.select(self.key, *[F.coalesce(F.col("_new")[c], F.col(c)).alias(c) for c in rest]))

    def append(self, rows: DataFrame, order: str, prefix: str) -> int:
        """Adds rows under new keys, ``prefix`` and a number of three digits or more, in the order of
        a unique column, after the highest number in use: a deleted key isn't given again while
        a higher one is there."""
        used = F.regexp_extract(self.key, r"_(\d+)$", 1)
        top = self.read().agg(F.max(F.when(used != "", used.cast("long"))).alias("n")).first()["n"] or 0
        named = numbered(rows, order, "_no").withColumn(self.key, F.format_string(f"{prefix}_%03d", F.col("_no") + top)).drop("_no")
        return self._write(self.read().unionByName(named.select(*self.schema.names)))

    def adopt(self, old: DataFrame, order: str, prefix: str) -> int | None:
        """Takes over the rows of an older store, whose missing columns are null, once: only while
        nothing is here."""
        if self.version:
            return None
        for field in self.schema.fields:
            old = old if field.name in old.columns else old.withColumn(field.name, F.lit(None).cast(field.dataType))
        keyless = old.where(F.col(self.key).isNull())
        number = self._write(old.where(F.col(self.key).isNotNull()))
        return number if keyless.isEmpty() else self.append(keyless, order, prefix)
