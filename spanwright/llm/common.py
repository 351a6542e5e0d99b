"""What the operators of this package share: reading, shared scratch tables, Arrow maps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.sources.scratch import stash

__all__ = ["WORD_GAP", "arrow_map", "arrow_stream", "blank", "null_key", "sliced", "stash", "table", "texts", "unused"]

#: Characters that part words everywhere in this package: space and U+0009 to U+000D.
#: ``bytes.split()`` and ``bytes.lower()`` use the same ASCII sets.
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """``fn`` turns one Arrow batch into dicts of column lists or arrays of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    parsed = _parse_datatype_string(schema)
    types = to_arrow_schema(parsed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                for out in fn(part):
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in types], schema=types)

    return df.mapInArrow(run, parsed)


def arrow_stream(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """As ``arrow_map``, but ``fn`` gets all of a task's batches in turn."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    parsed = _parse_datatype_string(schema)
    types = to_arrow_schema(parsed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in fn(part for batch in batches for part in sliced(batch)):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in types], schema=types)

    return df.mapInArrow(run, parsed)


#: Rows of an Arrow batch: texts of usual length make a few MB, on either side of the pipe.
BATCH_ROWS = 1000
#: Bytes of an Arrow batch that one call of a map function gets at most, one row at least.
BATCH_BYTES = 16 << 20


def sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about BATCH_BYTES, so that long texts don't pile up."""
    rows = max(1, min(batch.num_rows, int(batch.num_rows * BATCH_BYTES / max(batch.nbytes, 1))))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The column as UTF-8; null is empty."""
    return [v or b"" for v in batch.column(name).cast(pa.binary()).to_pylist()]


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def blank(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def null_key(*names: str) -> Column:
    """One never-null key of some columns; null differs from any value."""
    return F.concat_ws("\x1f", *[F.when(F.col(n).isNull(), F.lit("\x00")).otherwise(F.concat(F.lit("="), F.col(n).cast("string"))) for n in names])
