"""An event log that numbers each tenant's events once, whatever is written again.

A batch is a folder under its id. Numbers go on from the heads that earlier batches left, so a
batch that is written again after a crash gets the same numbers, and one that was finished is
left alone. The heads of a batch come from what it wrote; now and then all are written together,
so that a batch reads few of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Batches after which all heads are written together.
TOGETHER = 20


class EventLog:
    """``columns``: the columns of an event as in SQL, with ``tenant``, ``id`` and ``ts``; the log
    adds ``seq``. An id that the log or the batch has already is not written again; events
    without tenant or id are kept and number as a tenant of their own."""

    def __init__(self, spark: SparkSession, path: str, columns: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = spark.createDataFrame([], f"{columns}, seq bigint").schema
        self.heads = spark.createDataFrame([], f"tenant {dict(spark.createDataFrame([], columns).dtypes)['tenant']}, last bigint").schema

    def _done(self, kind: str) -> list[int]:
        """Ids of the finished folders of a kind, ascending."""
        jvm = self.spark._jvm
        top = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(top):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(top)]
        return sorted(int(n) for n in names if n.isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/{n}/_SUCCESS")))

    def _folders(self, kind: str, ids: list[int], schema) -> DataFrame:  # noqa: ANN001
        paths = [f"{self.path}/{kind}/{i}" for i in ids]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, before: int | None = None) -> DataFrame:
        return self._folders("events", [i for i in self._done("events") if before is None or i < before], self.schema)

    def _last(self, before: int) -> DataFrame:
        """(tenant, last) after all batches before one."""
        whole = max((i for i in self._done("all") if i < before), default=-1)
        parts = self._folders("heads", [i for i in self._done("heads") if whole < i < before], self.heads)
        base = self._folders("all", [whole] if whole >= 0 else [], self.heads)
        return base.unionByName(parts).groupBy("tenant").agg(F.max("last").alias("last"))

    def append(self, batch: DataFrame, batch_id: int) -> None:
        """For ``writeStream.foreachBatch``; batches come in the order of their ids."""
        if batch_id not in self._done("events"):
            fresh = batch.withColumn("_r", F.row_number().over(Window.partitionBy("tenant", "id").orderBy("ts"))).where("_r = 1 OR id IS NULL").drop("_r")
            known = self.read(batch_id).select(F.col("tenant").alias("_t"), F.col("id").alias("_i"))
            fresh = fresh.join(known, F.col("tenant").eqNullSafe(F.col("_t")) & (F.col("id") == F.col("_i")), "left_anti")
            before = self._last(batch_id).select(F.col("tenant").alias("_t"), "last")
            numbered = fresh.withColumn("_n", F.row_number().over(Window.partitionBy("tenant").orderBy("ts", "id")))
            rows = numbered.join(before, F.col("tenant").eqNullSafe(F.col("_t")), "left").withColumn("seq", (F.coalesce("last", F.lit(0)) + F.col("_n")).cast("long"))
            rows.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/events/{batch_id}")
        if batch_id not in self._done("heads"):
            heads = self._folders("events", [batch_id], self.schema).groupBy("tenant").agg(F.max("seq").alias("last"))
            heads.write.mode("overwrite").parquet(f"{self.path}/heads/{batch_id}")
        if batch_id % TOGETHER == TOGETHER - 1 and batch_id not in self._done("all"):
            self._last(batch_id + 1).write.mode("overwrite").parquet(f"{self.path}/all/{batch_id}")


def server_sent(events: DataFrame, tenant: object, since: int) -> DataFrame:
    """(seq, frame): a tenant's events after a place as frames of a text stream, in no order but
    that of ``seq``; events without tenant go to nobody."""
    body = F.to_json(F.struct(*[c for c in events.columns]))
    mine = events.where((F.col("tenant") == F.lit(tenant)) & (F.col("seq") > since))
    return mine.select("seq", F.concat(F.lit("id: "), F.col("seq").cast("string"), F.lit("\ndata: "), body, F.lit("\n\n")).alias("frame"))
