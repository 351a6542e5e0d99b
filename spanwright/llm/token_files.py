"""Token-id files: documents in ascending doc_id order, coded by the range coder.

``write_token_files`` range-partitions documents by (doc_id, text hash), so that even one
doc_id with very many rows is spread, sorts each partition, and writes segments: rows of
(part, segment, first, doc_ids, lengths, data), where ``first`` counts the part's ids before
the segment and ``data`` is a segment of ``rangecoder``. ``read_token_files`` decodes segments
in any order; the ids of earlier parts are summed from the segments' lengths, one row a part.

Null text counts as empty: the end id alone. Null doc_ids come first; rows of one doc_id come
by the hash of their text. Very long texts are coded whole. Repeated rows are written each. An empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from spanwright.sources.scratch import scratch_path

from .common import arrow_map, sliced, table, texts
from .rangecoder import pack_ids, unpack_ids
from .tokens import pieces_of


#: Bytes of text that are split and encoded at once, one text at least.
PORTION = 4 << 20


def _portions(found: list[bytes]) -> Iterator[list[bytes]]:
    some: list[bytes] = []
    size = 0
    for text in found:
        if some and size + len(text) > PORTION:
            yield some
            some, size = [], 0
        some.append(text)
        size += len(text)
    if some:
        yield some


def _ended(coded: tuple[np.ndarray, np.ndarray], end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and lengths of texts with the end id after each."""
    ids, lengths = coded
    return np.insert(ids, np.cumsum(lengths), end_id), lengths + 1


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    kind = docs.schema["doc_id"].dataType
    schema = StructType(
        [StructField("part", IntegerType()), StructField("segment", IntegerType()), StructField("first", LongType()), StructField("doc_ids", ArrayType(kind)), StructField("lengths", ArrayType(LongType())), StructField("data", BinaryType())]
    )
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, first, segment = pieces_of(tokenizer, spaced=True), 0, 0
        for batch in batches:
            for part in sliced(batch):
                coded = [_ended(pieces.many([t.decode("utf-8", "replace") for t in some]), end_id) for some in _portions(texts(part))]
                ids, lengths = (np.concatenate(x) for x in zip(*coded, strict=True))
                row = [part.column("part")[0].as_py(), segment, first, part.column("doc_id").to_pylist(), lengths.tolist(), pack_ids(ids.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, arrow, strict=True)], schema=arrow)
                first, segment = first + len(ids), segment + 1

    order = ["doc_id", F.xxhash64(F.coalesce("text", F.lit("")))]
    ranged = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(run, schema).write.parquet(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, and ids (array) if ``with_ids``."""
    files = spark.read.parquet(path)
    sizes = files.select("part", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for base, first, docs, lengths, data in zip(*[batch.column(n).to_pylist() for n in ("before", "first", "doc_ids", "lengths", "data")], strict=True):
            ids = unpack_ids(data)
            ends = np.cumsum(lengths)
            starts = ends - lengths
            parts = [ids[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
            out = {"doc_id": docs, "start": starts + base + first, "n_tokens": lengths, "ids_crc32": [zlib.crc32(p.tobytes()) for p in parts]}
            yield out | {"ids": [p.tolist() for p in parts]} if with_ids else out

    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    rows = files.join(before, "part").select("before", "first", "doc_ids", "lengths", "data")
    return arrow_map(rows, run, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids)


def op8_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "token-ids")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_token_files(spark, path)
