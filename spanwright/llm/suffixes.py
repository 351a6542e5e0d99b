"""Suffix-array dedup of bytes by a run-length index.

Every byte covered by a string of ``width`` bytes that also starts anywhere else is removed.
Regions that may repeat (see ``regions``) are indexed group by group: the window starts whose
strings may be found twice, by a hash, are put in suffix order, by their first ``ORDER`` bytes
and then by the hash, so that equal strings adjoin. The byte before each makes the
Burrows-Wheeler transform of that order, and only its runs are kept, with the suffixes at the
ends of runs as samples. The matching statistic of a sampled suffix is its common prefix with
its neighbour, counted byte by byte; between samples it falls by one from place to place, as
the byte before is the same on both sides. So the stream of statistics is known from the samples
alone, and each sample of ``width`` or more marks the whole match. In repetitive corpora there
are far fewer runs than bytes.

Null text is empty; texts of fewer than ``width`` bytes keep all. Very long texts are searched
whole. Copies and repeated rows lose every byte if they have ``width`` or more. An empty table
gives an empty result. Only doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .regions import Shape, mixed, rolling, without_repeats

#: Bytes of regions that are hashed at once.
BATCH_BYTES = 512 << 10
#: Bytes that suffixes are sorted by before their hashes.
ORDER = 8
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64))


def byte_units(text: bytes):
    return _BYTES[np.frombuffer(text, dtype=np.uint8)], lambda lo, hi: (lo, hi)


def common_prefix(data: np.ndarray, a: np.ndarray, b: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Bytes that the data has in common from a and from b on, ``room`` at most."""
    length = np.zeros(len(a), dtype=np.int64)
    alive = np.arange(len(a))
    padded = np.concatenate((data, np.zeros(64, dtype=np.uint8)))
    view = np.lib.stride_tricks.sliding_window_view(padded, 64)
    top = len(data)
    while len(alive):
        x, y = a[alive] + length[alive], b[alive] + length[alive]
        equal = view[np.minimum(x, top)] == view[np.minimum(y, top)]
        run = np.where(equal.all(axis=1), 64, equal.argmin(axis=1))
        length[alive] = np.minimum(length[alive] + run, room[alive])
        alive = alive[(run == 64) & (length[alive] < room[alive])]
    return length


def run_length_kernel(width: int):
    """Compares the regions of groups; see ``regions.Kernel``."""

    def hashed(regions: list[bytes], groups: np.ndarray) -> np.ndarray:
        """Hashes of all windows, region by region, in batches of about BATCH_BYTES."""
        out, begin, size = [np.zeros(0, dtype=np.uint64)], 0, 0
        for i, region in enumerate(regions):
            size += len(region)
            if size >= BATCH_BYTES or i + 1 == len(regions):
                part = regions[begin : i + 1]
                sizes = np.array([len(r) for r in part])
                ends = np.cumsum(sizes)
                names = rolling(_BYTES[np.frombuffer(b"".join(part), dtype=np.uint8)], width)
                row = np.repeat(np.arange(len(part)), sizes)[: len(names)]
                inside = np.arange(len(names)) + width <= ends[row]
                out.append(names[inside] ^ mixed(groups[begin : i + 1])[row[inside]])
                begin, size = i + 1, 0
        return np.concatenate(out)

    def twice(names: np.ndarray) -> np.ndarray:
        order = np.argsort(names)
        same = names[order[1:]] == names[order[:-1]]
        out = np.zeros(len(names), dtype=bool)
        out[order[1:][same]] = True
        out[order[:-1][same]] = True
        return out

    def kernel(regions, groups, first):
        names = hashed(regions, groups)
        windows = np.array([len(r) - width + 1 for r in regions], dtype=np.int64)
        hopeful = twice(names)
        row = np.repeat(np.arange(len(regions)), windows)
        good = np.unique(row[hopeful])
        if not len(good):
            return (np.zeros(0, dtype=np.int64),) * 3
        # the regions with such windows, end to end
        kept = np.zeros(len(regions), dtype=bool)
        kept[good] = True
        names, hopeful = names[kept[row]], hopeful[kept[row]]
        part = [regions[i] for i in good.tolist()]
        sizes = windows[good] + width - 1
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(part), dtype=np.uint8)
        row = np.repeat(np.arange(len(part)), windows[good])
        base = ends - sizes
        place = np.arange(len(row)) - (np.cumsum(windows[good]) - windows[good])[row] + base[row]
        which, start, end = indexed(data, place[hopeful], row[hopeful], names[hopeful], ends)
        return good[which], start - base[which], end - base[which]

    def indexed(data, starts, row, names, ends):
        """Spans (region, from, to) of ``data`` that equal windows among ``starts`` cover."""
        padded = np.concatenate((data, np.zeros(ORDER, dtype=np.uint8)))
        lead = np.zeros(len(starts), dtype=np.uint64)
        for k in range(ORDER):
            lead = (lead << np.uint64(8)) | padded[starts + k]
        by = np.lexsort((names, lead))
        order, rows = starts[by], row[by]
        # the transform, and where its runs end: two neighbours go on a run if the bytes before
        # them are equal and the starts before them are neighbours too
        place_of = np.full(len(data) + 1, -2, dtype=np.int64)
        place_of[order] = np.arange(len(order))
        region = np.full(len(data) + 1, -1, dtype=np.int64)
        region[starts] = row
        known = (region[order - 1] == rows) & (order > 0)
        back = np.where(known, order - 1, len(data))
        bwt = np.where(known, data[np.minimum(back, len(data) - 1)], 0)
        goes_on = known[1:] & known[:-1] & (bwt[1:] == bwt[:-1]) & (place_of[back[1:]] == place_of[back[:-1]] + 1)
        heads = np.flatnonzero(~goes_on) + 1
        above, below = order[heads - 1], order[heads]
        room = np.minimum(ends[rows[heads - 1]] - above, ends[rows[heads]] - below)
        # the statistic of a sample, then all that it marks on both sides
        statistic = common_prefix(data, above, below, room)
        long = statistic >= width
        marks = np.zeros(len(data) + 1, dtype=np.int64)
        for side in (above[long], below[long]):
            np.add.at(marks, side, 1)
            np.add.at(marks, side + statistic[long], -1)
        covered = np.cumsum(marks[:-1]) > 0
        # as spans, none over the end of a region
        edges = np.zeros(len(data) + 1, dtype=bool)
        edges[ends], edges[0] = True, True
        begin = np.flatnonzero(covered & (edges[:-1] | ~np.concatenate(([False], covered[:-1]))))
        stop = np.flatnonzero(covered & (edges[1:] | ~np.concatenate((covered[1:], [False])))) + 1
        return np.searchsorted(ends, begin, side="right"), begin, stop

    return kernel


def remove_repeated_bytes(docs: DataFrame, width: int = 400, gram: int = 96, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept (bytes) if ``with_text``."""

    def finish(text: bytes, spans: list[tuple[int, int]]) -> dict:
        kept, last = [], 0
        for s, e in spans:
            kept.append(text[last:s])
            last = e
        left = b"".join([*kept, text[last:]])
        out = {"n_bytes": len(text), "n_removed": len(text) - len(left), "n_spans": len(spans), "kept_sha256": hashlib.sha256(left).hexdigest()}
        return out | {"kept": left} if with_text else out

    schema = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_text
    return without_repeats(docs, Shape(width, gram), byte_units, run_length_kernel(width), finish, schema)


def op10_run_length_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(table(spark, sf_dir, "documents"))
