"""Best-fit packing of token sequences, bulk-synchronous by length.

Documents are cut into pieces of at most ``capacity`` ids; pieces are packed, longest first,
each into the smallest gap that holds it. Pieces of one length are interchangeable, and so are
sequences with one gap, so the range-sorted pieces and gaps are held as runs: how many of a
length, which sequences of a gap. Each round takes the longest length left, sweeps the sorted
gaps for its successors, resolves the conflict of many equal pieces for a gap by rank (rank r
goes to the r-th place of the run), updates the gaps, and repeats. A round handles all pieces
of a length at once; there are at most ``capacity`` rounds, and the runs are bounded by the
capacity, not by the corpus. Ranks of pieces are counted in Spark: by (length, bucket), with
buckets in proportion to the corpus, so that a length that a third of all pieces have is
ranked by many tasks.

Null text counts as empty: one piece with the end id. Repeated rows are packed each; equal
rows may swap their places. An empty table gives an empty result. Only doc_id and text are
read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_map, stash, table, texts
from .tokens import pieces_of

#: Pieces of one (length, bucket), which a window sorts, on average at most.
BUCKET_ROWS = 50_000


def cut_pieces(docs: DataFrame, path: str, end_id: int, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        pieces = pieces_of(path, spaced=False)
        end = np.array([end_id], dtype="<u4").tobytes()
        ids, out = batch.column("doc_id").to_pylist(), {n: [] for n in ("doc_id", "piece", "start", "length", "ids_crc32")}
        for doc, text in zip(ids, texts(batch), strict=True):
            coded = memoryview(pieces.ids(text.decode("utf-8", "replace")) + end)
            for k in range(0, len(coded), 4 * capacity):
                part = coded[k : k + 4 * capacity]
                for n, v in zip(out, (doc, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                    out[n].append(v)
        yield out

    kind = dict(docs.dtypes)["doc_id"]
    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


@dataclass(frozen=True)
class Run:
    """Pieces of ``length`` with ranks from ``rank``, ``count`` of them: ``per`` to each of the
    sequences from ``sequence`` on, side by side from place ``at``."""

    length: int
    rank: int
    count: int
    per: int
    sequence: int
    at: int


def sweep(counts: dict[int, int], capacity: int) -> list[Run]:
    """Rounds of best fit over the runs; see the module."""
    runs: list[Run] = []
    sizes: list[int] = []  # gaps that are there, ascending
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, how many)
    opened = 0

    def free(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                insort(sizes, gap)
            gaps[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(sizes, length)
            if at == len(sizes):
                gap, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            else:
                gap = sizes[at]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], sizes[at]
            per = gap // length
            whole = min(n, left // per)
            if whole:
                runs.append(Run(length, rank, whole * per, per, first, capacity - gap))
                free(gap - per * length, first, whole)
                rank, left = rank + whole * per, left - whole * per
            first, n = first + whole, n - whole
            if left and n:  # fewer than fill one gap
                runs.append(Run(length, rank, left, left, first, capacity - gap))
                free(gap - left * length, first, 1)
                first, n, left = first + 1, n - 1, 0
            free(gap, first, n)
    return runs


def ranked(pieces: DataFrame, total: int) -> DataFrame:
    """Adds ``rank``, from 0, among the pieces of a length."""
    buckets = max(1, total // BUCKET_ROWS)
    rows = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    sizes = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = sizes.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    return rows.withColumn("inside", inside).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("inside")).drop("bucket", "inside", "before")


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # a row for each length
    runs = sorted(sweep(counts, capacity), key=lambda r: (r.length, r.rank))
    keys = np.array([(r.length << 44) + r.rank for r in runs], dtype=np.int64)
    rest = np.array([(r.rank, r.per, r.sequence, r.at) for r in runs], dtype=np.int64).reshape(-1, 4)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        length, rank = (batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("length", "rank"))
        first, per, sequence, at = rest[np.searchsorted(keys, (length << 44) + rank, side="right") - 1].T
        out = {n: batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")}
        yield out | {"sequence_id": sequence + (rank - first) // per, "offset": at + (rank - first) % per * length}

    kinds = dict(pieces.dtypes)
    schema = ", ".join(f"`{n}` {kinds[n]}" for n in ("doc_id", "piece", "start", "length", "ids_crc32"))
    return arrow_map(ranked(pieces, sum(counts.values())), run, f"{schema}, sequence_id bigint, `offset` bigint")


def best_fit(docs: DataFrame, path: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    return pack(stash(cut_pieces(docs, path, end_id, capacity), "pieces"), capacity)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return best_fit(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
