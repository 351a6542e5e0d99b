"""Substring dedup of words by fixed-block anchors.

Every word covered by a run of ``width`` words that also starts anywhere else is removed.
Among the regions that may repeat (see ``regions``), non-overlapping reference blocks, at the
multiples of the block size in their text, are indexed by hash; every rolling window of a
block's size is probed; each hit is extended over the windows that hold it, and windows that
meet in one hash are compared word by word; those that follow one another make the maximal
exact repeats. A block is half a window, so a repeated window always holds a whole reference
block.

Null text has no words; texts of fewer than ``width`` words keep all. Very long texts are
searched whole. Copies and repeated rows lose every word if they have ``width`` or more. An
empty table gives an empty result. Only doc_id and text are read, so other columns may have
any names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .regions import Shape, mixed, rolling, without_repeats


class _Codes(dict):
    LIMIT = 1_000_000

    def __missing__(self, word: bytes) -> int:
        code = xxhash.xxh64_intdigest(word)
        if len(self) < self.LIMIT:
            self[word] = code
        return code


_codes = _Codes()


def word_units(text: bytes):
    words = text.split()
    codes = np.fromiter(map(_codes.__getitem__, words), np.uint64, len(words))

    def extent(lo: int, hi: int) -> tuple[int, int]:
        if "ends" not in cache:
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            plain = np.frombuffer(text, dtype=np.uint8)
            ink = ~((plain == 32) | ((plain >= 9) & (plain <= 13)))
            cache["starts"] = np.flatnonzero(ink & ~np.concatenate(([False], ink[:-1])))
            cache["ends"] = cache["starts"] + sizes
        return int(cache["starts"][lo]), int(cache["ends"][hi - 1])

    cache: dict[str, np.ndarray] = {}
    return codes, extent


def block_kernel(width: int, block: int):
    """Compares the regions of groups; see ``regions.Kernel``."""

    def kernel(regions, groups, first):
        split = [r.split() for r in regions]
        sizes = np.array([len(w) for w in split], dtype=np.int64)
        number: dict[bytes, int] = {}
        for words in split:
            for w in words:
                number.setdefault(w, len(number))
        ids = np.array([number[w] for words in split for w in words], dtype=np.int64)
        row, ends = np.repeat(np.arange(len(split)), sizes), np.cumsum(sizes)
        inside = np.arange(len(ids)) - (ends - sizes)[row]
        codes, group = mixed(ids.astype(np.uint64)), mixed(groups)
        # index the reference blocks, probe with every rolling window
        probes = rolling(codes, block)
        n = len(probes)
        probes = probes ^ group[row[:n]]
        fits = inside[:n] + block <= sizes[row[:n]]
        index = np.unique(probes[fits & ((first[row[:n]] + inside[:n]) % block == 0)])
        if not len(index):
            return (np.zeros(0, dtype=np.int64),) * 3
        slot = np.minimum(np.searchsorted(index, probes), len(index) - 1)
        hit = fits & (index[slot] == probes)
        hit &= np.bincount(slot[hit], minlength=len(index))[slot] >= 2
        # extend each hit over the windows that hold it
        held = np.concatenate(([0], np.cumsum(hit)))
        starts = np.flatnonzero(inside + width <= sizes[row])
        starts = starts[held[starts + width - block + 1] > held[starts]]
        if len(starts) < 2:
            return (np.zeros(0, dtype=np.int64),) * 3
        names = rolling(codes, width)[starts] ^ group[row[starts]]
        starts = starts[np.argsort(names, kind="stable")]
        names = np.sort(names, kind="stable")
        met = np.flatnonzero(names[1:] == names[:-1])
        words = np.lib.stride_tricks.sliding_window_view(ids, width)
        met = met[(words[starts[met]] == words[starts[met + 1]]).all(axis=1)]
        starts = np.unique(np.concatenate((starts[met], starts[met + 1])))
        return _joined(row[starts], inside[starts], inside[starts] + width)

    return kernel


def _joined(row: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Spans of a row that follow one another by one unit, as one."""
    if not len(row):
        return row, start, end
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
    heads = np.flatnonzero(new)
    return row[heads], start[heads], end[np.append(heads[1:], len(row)) - 1]


def remove_repeated_words(docs: DataFrame, width: int = 35, gram: int = 10, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and kept (the words left) if ``with_text``."""

    def finish(text: bytes, spans: list[tuple[int, int]]) -> dict:
        words = text.split()
        kept, last = [], 0
        for s, e in spans:
            kept += words[last:s]
            last = e
        left = b" ".join(kept + words[last:])
        out = {"n_words": len(words), "n_removed": sum(e - s for s, e in spans), "kept_sha256": hashlib.sha256(left).hexdigest()}
        return out | {"kept": left.decode("utf-8", "replace")} if with_text else out

    schema = "n_words bigint, n_removed bigint, kept_sha256 string" + ", kept string" * with_text
    return without_repeats(docs, Shape(width, gram, 8), word_units, block_kernel(width, (width + 1) // 2), finish, schema)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_words(table(spark, sf_dir, "documents"))
