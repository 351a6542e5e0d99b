"""Tables written to the shared scratch folder, to cut lineage so that lost executors cost
no more than one step."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[str] = []
_own: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Only where the session names none and runs on one machine, as in tests, a temporary folder
    is used; on a cluster that would be each executor's own disk, so it is an error there.
    """
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(f"file://{tempfile.mkdtemp(prefix='spanwright-')}")
    return _own[0]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, which is cleared when the driver's Python ends."""
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_sweep, spark)
    _written.append(path)
    return path


def stash(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared scratch folder and reads it back. The files go when the
    driver's Python ends."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def large(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input. Spark judges tables by the bytes of their files,
    and keys pack to few bytes and explode to many rows, so it would send millions of rows
    through the driver as a broadcast; the hint keeps them in a shuffle."""
    return df.hint("merge")


#: Rows of a table of groups that are sent to every task, at most.
SENT_GROUPS = 100_000


def by_group(rows: DataFrame, groups: DataFrame, by: str) -> DataFrame:
    """``rows`` joined to ``groups``, which has a row for each ``by``. Few groups are sent to the rows,
    as a shuffle would put all rows of a group in one task; many spread the rows themselves."""
    groups = stash(groups, "groups")
    return rows.join(F.broadcast(groups) if groups.count() <= SENT_GROUPS else groups, by)


def discard(table: DataFrame) -> None:
    """Deletes a stashed table that nothing will read again, such as that of a round before."""
    path = getattr(table, "_scratch", None)
    if path in _written:
        spark = table.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        _written.remove(path)


def _sweep(spark: SparkSession) -> None:
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in _written:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
    except Exception:  # the session has ended before; its cluster keeps or clears the folder
        return
