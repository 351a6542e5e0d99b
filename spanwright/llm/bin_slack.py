"""Minimum bin slack: windows of ``capacity`` tokens filled by subset sums.

Documents are cut into whole windows and one shorter rest. Rests are dealt at random into
buckets of about BUCKET_ROWS, as many as the corpus needs. A bucket is one task's work on narrow
rows: the multiset of its remaining lengths starts each window with the longest, and a subset
sum over the others, as a bitset of reachable sums, finds the multiset closest to what room is
left; walking the bitsets back gives how many of each length. The same multiset is taken again
as often as the counts allow, since taking rows away can't make a better sum reachable. What
stands in windows that no multiset fills is laid end to end and cut at window borders; the last
part of a bucket is cut at powers of two, which aren't padded. So nothing is padded, and only
rests of windows with slack are cut. The ids of those alone are read again for their checksums.

Null text counts as empty: one piece with the end id. Repeated rows are packed each; equal rows
may swap places. An empty table gives an empty result. Very long texts are cut whole. Lengths
tie by row number. Only doc_id and text are read, so others may have any names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, stash, table, texts
from .tokens import pieces_of

#: Rests in a bucket, on average at most.
BUCKET_ROWS = 20_000


def whole_and_rest(docs: DataFrame, path: str, end_id: int, capacity: int) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, and ids of rests, which may be cut later."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        pieces = pieces_of(path, spaced=True, ranked=True)
        end = np.array([end_id], dtype="<u4").tobytes()
        names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")
        ids, out = batch.column("doc_id").to_pylist(), {n: [] for n in names}
        for doc, text in zip(ids, texts(batch), strict=True):
            coded = pieces.ids(text.decode("utf-8", "replace")) + end
            for k in range(0, len(coded), 4 * capacity):
                part = coded[k : k + 4 * capacity]
                kept = part if len(part) < 4 * capacity else None
                for n, v in zip(names, (doc, k // 4, len(part) // 4, zlib.crc32(part), len(coded) // 4, kept), strict=True):
                    out[n].append(v)
        yield out

    kind = dict(docs.dtypes)["doc_id"]
    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, start bigint, length int, ids_crc32 bigint, doc_tokens bigint, ids binary")


def fullest(sizes: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each size make the largest sum that ``room`` holds; ``sizes`` ascend.

    Bit s of ``reach`` says that some of the sizes taken so far add up to s; large sizes come
    first, and the search ends when ``room`` itself is reached."""
    reach, seen, within = 1, [], (1 << (room + 1)) - 1
    for at in range(bisect_right(sizes, room) - 1, -1, -1):
        size = sizes[at]
        seen.append((size, reach))
        n, step = min(counts[size], room // size), 1
        while n > 0:
            step = min(step, n)
            reach |= (reach << (size * step)) & within
            n, step = n - step, step * 2
        if reach >> room:
            break
    total, used = reach.bit_length() - 1, {}
    for size, before in reversed(seen):
        n = 0
        while not (before >> total) & 1:
            total, n = total - size, n + 1
        if n:
            used[size] = n
    return used


def windows(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Multisets of sizes, each with how many windows get it, until nothing is left."""
    counts = {s: n for s, n in counts.items() if n}
    sizes, made = sorted(counts), []
    while sizes:
        longest = sizes[-1]
        counts[longest] -= 1
        if not counts[longest]:
            sizes.pop()
        used = fullest(sizes, counts, capacity - longest)
        counts[longest] += 1
        if counts[longest] == 1:
            insort(sizes, longest)
        used[longest] = used.get(longest, 0) + 1
        times = min(counts[s] // n for s, n in used.items())
        for s, n in used.items():
            counts[s] -= n * times
            if not counts[s]:
                sizes.remove(s)
        made.append((used, times))
    return made


def powers(total: int) -> list[int]:
    return [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]


def placed(lengths: np.ndarray, capacity: int) -> dict[str, np.ndarray]:
    """Pieces as columns: row (of ``lengths``), skip, length, sequence, offset."""
    order = np.argsort(lengths, kind="stable")
    sizes, first, many = np.unique(lengths[order], return_index=True, return_counts=True)
    at = dict(zip(sizes.tolist(), first.tolist(), strict=True))
    out: list[tuple[np.ndarray, ...]] = []
    slack: list[np.ndarray] = []
    sequence = 0
    for used, times in windows(dict(zip(sizes.tolist(), many.tolist(), strict=True)), capacity):
        exact, offset = sum(s * n for s, n in used.items()) == capacity, 0
        for size, n in sorted(used.items(), reverse=True):
            rows = order[at[size] : at[size] + n * times]
            at[size] += n * times
            if exact:
                turn, place = np.divmod(np.arange(n * times), n)
                out.append((rows, np.zeros_like(rows), np.full_like(rows, size), sequence + turn, offset + place * size))
            else:
                slack.append(rows)
            offset += size * n
        sequence += times if exact else 0
    if slack:
        rows = np.concatenate(slack)
        ends = np.cumsum(lengths[rows])
        total = int(ends[-1])
        cuts = np.concatenate([np.arange(0, total, capacity), total // capacity * capacity + np.cumsum(powers(total % capacity), dtype=np.int64), [total]])
        cuts = np.unique(cuts)
        begins = ends - lengths[rows]
        marks = np.unique(np.concatenate([begins, cuts[:-1]]))
        row = np.searchsorted(begins, marks, side="right") - 1
        window = np.searchsorted(cuts, marks, side="right") - 1
        out.append((rows[row], marks - begins[row], np.diff(np.append(marks, total)), sequence + window, marks - cuts[window]))
    names = ("row", "skip", "length", "sequence", "offset")
    return {n: np.concatenate([np.asarray(o[i], dtype=np.int64) for o in out]) for i, n in enumerate(names)}


def minimum_slack(docs: DataFrame, path: str, end_id: int = 0, capacity: int = 1024) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece.

    sequence_id is negative for windows that one document fills alone."""
    kind = dict(docs.dtypes)["doc_id"]
    pieces = stash(whole_and_rest(docs, path, end_id, capacity).withColumn("key", F.monotonically_increasing_id()), "rests")
    rests = pieces.where(F.col("ids").isNotNull())
    buckets = max(1, -(-rests.count() // BUCKET_ROWS))
    narrow = rests.select(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"), "key", "doc_id", "start", "length", "ids_crc32", "doc_tokens")
    schema = f"key bigint, doc_id {kind}, start bigint, skip int, length int, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by("key")
        got = placed(group.column("length").to_numpy().astype(np.int64), capacity)
        rows = group.take(pa.array(got["row"]))
        cut = got["length"] != rows.column("length").to_numpy()
        crc = pa.array(rows.column("ids_crc32").to_numpy(), mask=cut)
        first = rows.column("start").to_numpy() + got["skip"]
        sequence = (rows.column("bucket").to_numpy().astype(np.int64) << 32) + got["sequence"]
        columns = [rows.column("key"), rows.column("doc_id"), first, got["skip"].astype(np.int32), got["length"].astype(np.int32), crc]
        columns += [rows.column("doc_tokens"), sequence, got["offset"]]
        return pa.table(columns, names=["key", "doc_id", "start", "skip", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    packed = stash(narrow.groupBy("bucket").applyInArrow(pack, schema), "windows")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def sums(batch: pa.RecordBatch) -> Iterator[dict]:
        skip, length = (batch.column(n).to_pylist() for n in ("skip", "length"))
        parts = zip(batch.column("ids").to_pylist(), skip, length, strict=True)
        yield {n: batch.column(n) for n in names if n != "ids_crc32"} | {"ids_crc32": [zlib.crc32(i[4 * s : 4 * (s + n)]) for i, s, n in parts]}

    cut = packed.where(F.col("ids_crc32").isNull()).drop("ids_crc32").join(rests.select("key", "ids"), "key")
    alone = pieces.where(F.col("ids").isNull()).withColumn("sequence_id", -1 - F.col("key")).withColumn("offset", F.lit(0).cast("long"))
    types = f"doc_id {kind}, start bigint, length int, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    parts = [packed.where(F.col("ids_crc32").isNotNull()).select(names), arrow_map(cut, sums, types).select(names), alone.select(names)]
    found = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return found.withColumn("length", F.col("length").cast("long"))


def op11_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return minimum_slack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
