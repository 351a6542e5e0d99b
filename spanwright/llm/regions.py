"""Regions of texts that may repeat: the ground that the exact-repeat operators share.

Every window of ``width`` units (words or bytes) is owned by its anchor, the run of ``gram``
units in it whose hash is least (the first of equal ones). A window that occurs twice has the
same anchor at both places, so each text is cut into regions, the stretches of windows that
one anchor owns, and only anchors whose hash is found at two places can own a repeated window.
Equal regions of an anchor are one row; whatever their windows are, they repeat. Where an
anchor has unequal regions, these go to one group and the operator's own kernel compares them;
an anchor of very many unequal regions is split first: windows that hold the anchor at about
the same place share a core of units around it, and only windows with equal cores can be equal,
so the cores' hashes name smaller groups. Groups are sorted by Spark and given to the kernel
one after another, so a task holds a few of them at a time.

Copies of a whole text are known by the 64-bit hash of the text (of n different texts any two
share one with odds of n * n / 2 ** 65) and looked at once; all windows of a text that has
copies repeat. Equal regions are known by 128 bits. What a kernel calls equal it compares
unit by unit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, blank, stash, texts

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of regions in a bucket, on average.
BUCKET_BYTES = 2 << 20
#: Bytes of regions that a kernel gets at once, or one group's if they are more.
CHUNK_BYTES = 384 << 10
#: Unequal regions of an anchor from which on it is split, and into how many parts by place.
HOT_REGIONS, HOT_PARTS = 256, 8
#: Units of a text that are looked at at once; windows are known by their place in them.
STRETCH_BITS = 20


@dataclass(frozen=True)
class Shape:
    """width: units of a window. gram: units of an anchor. unit_bytes: of a usual unit."""

    width: int
    gram: int
    unit_bytes: int = 1

    @property
    def reach(self) -> int:
        """Units of a window before or after an anchor in it, at most."""
        return self.width - self.gram

    @property
    def part(self) -> int:
        """Places of an anchor in a window that one part of a hot anchor has."""
        return -(-(self.reach + 1) // HOT_PARTS)


#: The units of a text as 64-bit codes, and the places in the bytes where each starts, with the
#: text's length last.
Units = Callable[[bytes], tuple[np.ndarray, Callable[[int, int], tuple[int, int]]]]


def text_key() -> Column:
    return F.xxhash64(blank(F.col("text")))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n codes, along the last axis: by doubling, so log n steps."""
    out, done = codes, 1
    parts = []  # (length, hashes) of the powers of two
    while True:
        if n & done:
            parts.append((done, out))
        if 2 * done > n:
            break
        out = out[..., :-done] * (MULTIPLIER ** np.uint64(done)) + out[..., done:]
        done *= 2
    size = codes.shape[-1] - n + 1
    total, at = None, 0
    for length, h in reversed(parts):
        piece = h[..., at : at + size]
        total = piece if total is None else total * (MULTIPLIER ** np.uint64(length)) + piece
        at += length
    return mixed(total)


def _sliding(x: np.ndarray, n: int, best: np.ufunc) -> np.ndarray:
    done = 1
    while 2 * done <= n:
        x = best(x[:-done], x[done:])
        done *= 2
    return best(x[: len(x) - (n - done)], x[n - done :]) if n > done else x


def owned(codes: np.ndarray, shape: Shape) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By stretches of the text: anchors' hashes, their places, and the first and the last
    start of the windows that they own."""
    mask = np.uint64((1 << STRETCH_BITS) - 1)
    for begin in range(0, len(codes) - shape.width + 1, (1 << STRETCH_BITS) - shape.width + 1):
        grams = rolling(codes[begin : begin + (1 << STRETCH_BITS)], shape.gram)
        least = _sliding((grams & ~mask) | np.arange(len(grams), dtype=np.uint64), shape.reach + 1, np.minimum)
        at = (least & mask).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
        last = np.append(first[1:], len(at)) - 1
        at = at[first]
        yield grams[at], at + begin, first + begin, last + begin


class Sums:
    """Hashes of any stretches of a text that don't depend on where they stand."""

    def __init__(self, codes: np.ndarray) -> None:
        self.upto = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(codes * _powers(MULTIPLIER, len(codes)), out=self.upto[1:])
        self.back = _powers(INVERSE, len(codes) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.upto[end] - self.upto[start]) * self.back[start] + mixed((end - start).astype(np.uint64)))


def anchors(docs: DataFrame, shape: Shape, units: Units) -> DataFrame:
    """The regions: a (the anchor's hash), c (the region's hash), key (of the text), lo (its
    first window's start), n (its windows), at (the anchor's place)."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        found = []
        for key, text in zip(batch.column("key").to_numpy(zero_copy_only=False), texts(batch), strict=True):
            codes, _ = units(text)
            if len(codes) < shape.width:
                continue
            sums = Sums(codes)
            for a, at, first, last in owned(codes, shape):
                found.append((a, sums.of(first, last + shape.width), np.full(len(at), key), first, last - first + 1, at))
        columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, dtype=np.int64)] * 6
        yield dict(zip(("a", "c", "key", "lo", "n", "at"), [x.astype(t) for x, t in zip(columns, (np.int64,) * 3 + (np.int32,) * 3, strict=True)], strict=True))

    return arrow_map(docs, run, "a bigint, c bigint, key bigint, lo int, n int, at int")


#: MULTIPLIER times this is 1 modulo 2**64.
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

_made: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """The first n powers; a worker keeps the longest list yet."""
    have = _made.get(int(base))
    if have is None or len(have) < n:
        have = np.full(n, base, dtype=np.uint64)
        have[0] = 1
        _made[int(base)] = have = np.multiply.accumulate(have)
    return have[:n]


#: (regions as bytes, their groups, first unit's place in its text) -> for each region the spans
#: of units that windows found twice in its group cover, as (region, from, to).
Kernel = Callable[[list[bytes], np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def parts_of(sums: Sums, a: int, lo: int, n: int, at: int, shape: Shape) -> Iterator[tuple[int, int, int]]:
    """(group, first start, windows) of the parts of a hot anchor's region."""
    start = lo
    while start < lo + n:
        part = (at - start) // shape.part  # of all starts with at - start in [part * shape.part, (part + 1) * shape.part)
        end = min(lo + n, at - part * shape.part + 1)
        core = np.array([at - part * shape.part]), np.array([at - (part + 1) * shape.part + 1 + shape.width])
        name = mixed(sums.of(*core) ^ mixed(np.array([a], dtype=np.int64).view(np.uint64)) + np.uint64(part))
        yield int(name.view(np.int64)[0]), start, end - start
        start = end


def repeated_spans(docs: DataFrame, shape: Shape, units: Units, kernel: Kernel, wide: DataFrame) -> DataFrame:
    """key and spans (array of (from, to) units, from the start of the text) of the texts that
    hold a repeated window. ``wide``: (key, text, doc_id), as the caller joins it again."""
    spark = docs.sparkSession
    every = stash(anchors(docs, shape, units), "every")
    place = F.xxhash64("key", "lo")
    # a table of its own, so that Spark can split a join task of an anchor with very many rows
    often = stash(every.groupBy("a").agg(F.min(place).alias("p"), F.max(place).alias("q")).where("p != q").select("a"), "often")
    near = stash(every.join(often, "a", "left_semi"), "anchors")
    row = F.struct(place.alias("p"), "key", "lo", "n", "at")
    kinds = stash(near.groupBy("a", "c").agg(F.min(row).alias("r"), (F.min(place) != F.max(place)).alias("twice")).select("a", "c", "r.*", "twice"), "kinds")
    unequal = kinds.groupBy("a").agg(F.count("*").alias("m")).where("m > 1")
    chosen = kinds.join(unequal, "a").withColumn("hot", F.col("m") > HOT_REGIONS)
    wanted = stash(chosen.groupBy("key").agg(F.collect_list(F.struct("a", "c", "lo", "n", "at", "hot")).alias("wanted")), "wanted")

    def cut(batch: pa.RecordBatch) -> Iterator[dict]:
        out: dict[str, list] = {n: [] for n in ("a", "c", "g", "shift", "first", "region")}
        for text, rows in zip(texts(batch), batch.column("wanted").to_pylist(), strict=True):
            codes, extent = units(text)
            sums = Sums(codes) if any(r["hot"] for r in rows) else None
            for r in rows:
                a, lo = r["a"], r["lo"]
                for g, first, n in parts_of(sums, a, lo, r["n"], r["at"], shape) if r["hot"] else [(a, lo, r["n"])]:
                    start, end = extent(first, first + n - 1 + shape.width)
                    for name, v in zip(out, (a, r["c"], g, first - lo, first, text[start:end]), strict=True):
                        out[name].append(v)
        yield out

    once = wide.join(wanted, "key").dropDuplicates(["key"]).select("doc_id", "text", "wanted")
    regions = arrow_map(once, cut, "a bigint, c bigint, g bigint, shift int, first int, region binary")
    volume = wanted.agg(F.sum(F.size("wanted"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(volume) * shape.width * shape.unit_bytes * 2 // BUCKET_BYTES)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole groups, as many as make a chunk; rows come sorted by group."""
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= CHUNK_BYTES:
                rows = pa.Table.from_batches(held)
                group = rows.column("g").to_numpy()
                done = int(np.searchsorted(group, group[-1]))  # the last group may go on
                if done:
                    yield compared(rows.slice(0, done))
                    held = rows.slice(done).combine_chunks().to_batches()
                    size = sum(b.nbytes for b in held)
        if held:
            yield compared(pa.Table.from_batches(held))

    def compared(rows: pa.Table) -> pa.RecordBatch:
        number = lambda n: rows.column(n).to_numpy()
        which, start, end = kernel(rows.column("region").to_pylist(), number("g").view(np.uint64), number("first").astype(np.int64))
        order = np.lexsort((start, which))
        which, start, end = which[order], start[order], end[order]
        heads = np.flatnonzero(np.diff(which, prepend=-1))
        mine = which[heads]
        offsets = pa.array(np.append(heads, len(which)).astype(np.int32))
        shift = number("shift")[which]
        spans = pa.StructArray.from_arrays([pa.array((start + shift).astype(np.int32)), pa.array((end + shift).astype(np.int32))], names=["s", "e"])
        return pa.RecordBatch.from_arrays([pa.array(number("a")[mine]), pa.array(number("c")[mine]), pa.ListArray.from_arrays(offsets, spans)], names=["a", "c", "spans"])

    kind = "spans array<struct<s:int,e:int>>"
    grouped = regions.repartition(buckets, "g").sortWithinPartitions("g")
    found = grouped.mapInArrow(compare, f"a bigint, c bigint, {kind}")
    # a region found at two places repeats as a whole
    whole = F.array(F.struct(F.lit(0).alias("s"), (F.col("n") + (shape.width - 1)).alias("e")))
    verdicts = kinds.where("twice").select("a", "c", whole.alias("spans")).unionByName(found.join(kinds.where("twice"), ["a", "c"], "left_anti"))
    shifted = F.transform("spans", lambda s: F.struct((F.col("lo") + s["s"]).alias("s"), (F.col("lo") + s["e"]).alias("e")))
    return near.join(verdicts, ["a", "c"]).select("key", shifted.alias("spans")).groupBy("key").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def without_repeats(docs: DataFrame, shape: Shape, units: Units, kernel: Kernel, finish: Callable[[bytes, list[tuple[int, int]]], dict], schema: str) -> DataFrame:
    """doc_id and the columns of ``finish``, which gets each text and its merged spans."""
    wide = docs.select("doc_id", "text", text_key().alias("key"))
    copies = wide.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.lit(True).alias("copied"))
    spans = repeated_spans(docs.select("text", text_key().alias("key")), shape, units, kernel, wide)
    marks = spans.join(copies, "key", "full_outer")

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        rows = []
        for text, found, copied in zip(texts(batch), batch.column("spans").to_pylist(), batch.column("copied").to_pylist(), strict=True):
            if copied:
                n = len(units(text)[0])
                merged = [(0, n)] if n >= shape.width else []
            else:
                merged = []
                for s in sorted(found or [], key=lambda x: x["s"]):
                    if merged and s["s"] <= merged[-1][1]:
                        merged[-1] = (merged[-1][0], max(merged[-1][1], s["e"]))
                    else:
                        merged.append((s["s"], s["e"]))
            rows.append(finish(text, merged))
        yield {"doc_id": batch.column("doc_id")} | {n: [r[n] for r in rows] for n in rows[0]}

    joined = wide.join(marks, "key", "left").select("doc_id", "text", "spans", "copied")
    return arrow_map(joined, run, f"doc_id {dict(docs.dtypes)['doc_id']}, {schema}")
