"""Kernels over stretches of the plane: what lies whole inside one is settled there.

Rows are dealt by ranges of a key that runs along strips of cells, so a task holds stretches whose
bounds it knows: every cell between its least and its greatest key is its own. Rows whose neighbours
all lie inside are settled at once, in one shuffle; the few along the bounds come out marked ``open``
and take the way by joins, as all rows of groups that reach such a row do."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spanwright.sources.scratch import stash

#: Cells that a strip is wide. Rows beside its edges are always open.
STRIP = 256
#: Rows that a kernel gets at once; a level of a strip stays whole up to four times as many.
TILE_ROWS = 200_000
#: Candidate pairs that a kernel looks at; a stretch with more is left open.
TILE_PAIRS = 5_000_000

Kernel = Callable[[pa.Table, int, int], pa.Table]


def width(reach: float) -> float:
    """Of cells, so that rows at most ``reach`` apart lie in the same or adjacent ones."""
    return max(reach, 1e-6) * 1.01


def cell(c: Column, size: float) -> Column:
    """Null where the coordinate isn't finite."""
    return F.when(F.abs(c) < F.lit(float("inf")), F.greatest(F.lit(-(2.0**40)), F.least(F.lit(2.0**40), F.floor(c / size).cast("double"))).cast("long"))


def key(cx: Column, cy: Column) -> Column:
    """Strip first, then the level along it."""
    strip = F.floor((cx + STRIP // 2) / STRIP).cast("long")
    level = F.greatest(F.lit(-(2**31)), F.least(F.lit(2**31 - 1), cy))
    return F.greatest(F.lit(-(2**30)), F.least(F.lit(2**30), strip)) * F.lit(2**32) + level + F.lit(2**31)


def dealt(rows: DataFrame, at: Column) -> DataFrame:
    """``rows`` with ``_key``, in ranges of it and sorted; rows without a place are spread."""
    return rows.withColumn("_key", F.coalesce(at, F.shiftright(F.xxhash64(*[F.col(c) for c in rows.columns if c in ("seq", "_seq")]), 1))).repartitionByRange("_key").sortWithinPartitions("_key")


def over_tiles(ready: DataFrame, kernel: Kernel, schema: str) -> DataFrame:
    """``kernel`` gets a stretch, sorted by ``_key``, and the keys between which all cells are in it."""
    tile = TILE_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n, whole = 0, None  # cells up to ``whole`` were given out in parts

        def solved(table: pa.Table) -> Iterator[pa.RecordBatch]:
            keys = table["_key"].to_numpy()
            low = int(keys[0]) if whole is None else max(int(keys[0]), whole + 1)
            yield from kernel(table, low, int(keys[-1])).to_batches()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= tile:
                table = pa.Table.from_batches(held)
                keys = table["_key"].to_numpy()
                cut = int(np.searchsorted(keys, keys[-1], "left"))
                if cut:
                    yield from solved(table.slice(0, cut))
                    table = table.slice(cut)
                elif n >= 4 * tile:  # one level that is too crowded to be held
                    yield from kernel(table, 1, 0).to_batches()
                    whole = int(keys[-1])
                    table = table.slice(n)
                held, n = table.to_batches(), table.num_rows
        if n:
            yield from solved(pa.Table.from_batches(held))

    return ready.mapInArrow(run, schema)


def in_one(rows: DataFrame, kernel: Kernel, schema: str | StructType) -> DataFrame | None:
    """What stretches left ``open`` (read from a table), settled by one task that gets all of it, so no cell
    lies beyond a bound; none where that is more than a task holds, or too crowded."""
    if rows.count() > TILE_ROWS:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from kernel(pa.Table.from_batches(held), -(2**63), 2**63 - 1).to_batches()

    made = stash(rows.withColumn("_key", F.lit(0).cast("long")).repartition(1).mapInArrow(run, schema), "one")
    return made if made.where("open").isEmpty() else None


def codes(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Equal values as equal numbers from 0, nulls as -1."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def numbers(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Nulls as NaN."""
    return column.cast(pa.float64()).to_numpy() if isinstance(column, pa.ChunkedArray) else column.cast(pa.float64()).to_numpy(zero_copy_only=False)


def cells(x: np.ndarray, size: float) -> np.ndarray:
    return np.clip(np.floor(x / size), -(2.0**40), 2.0**40).astype(np.int64)


def around(low: tuple[np.ndarray, np.ndarray], high: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest ``key`` of the cells from ``low`` to ``high`` and of those next to them."""

    def at(cx: np.ndarray, cy: np.ndarray) -> np.ndarray:
        strip = np.clip((cx + STRIP // 2) // STRIP, -(2**30), 2**30)
        return strip * 2**32 + np.clip(cy, -(2**31), 2**31 - 1) + 2**31

    return at(low[0] - 1, low[1] - 1), at(high[0] + 1, high[1] + 1)


def neighbours(ga: np.ndarray, ax: np.ndarray, ay: np.ndarray, gb: np.ndarray, bx: np.ndarray, by: np.ndarray, most: int = TILE_PAIRS) -> tuple[np.ndarray, np.ndarray] | None:
    """Places (i, j) of rows of one group whose cells are the same or adjacent, each pair of a cell
    once; none where they would be more than ``most``."""
    if not len(ga) or not len(gb):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    xs, ys = np.unique(bx), np.unique(by)
    code = (gb * len(xs) + np.searchsorted(xs, bx)) * len(ys) + np.searchsorted(ys, by)
    order = np.argsort(code, kind="stable")
    code = code[order]
    found, total = [], 0
    for dx in (-1, 0, 1):
        px = np.minimum(np.searchsorted(xs, ax + dx), len(xs) - 1)
        for dy in (-1, 0, 1):
            py = np.minimum(np.searchsorted(ys, ay + dy), len(ys) - 1)
            want = np.where((xs[px] == ax + dx) & (ys[py] == ay + dy), (ga * len(xs) + px) * len(ys) + py, -1)
            low, high = np.searchsorted(code, want, "left"), np.searchsorted(code, want, "right")
            many = high - low
            total += int(many.sum())
            if total > most:
                return None
            found.append((np.repeat(np.arange(len(ga)), many), order[np.repeat(low - np.cumsum(many) + many, many) + np.arange(int(many.sum()))]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def open_ones(n: int, inside: np.ndarray, pairs: np.ndarray, contracted: Callable) -> np.ndarray:
    """Of ``n`` rows those that are not ``inside`` or are linked, by any way, to one that isn't."""
    out = ~inside
    if len(pairs):
        names, roots = contracted(pairs)
        bad = np.zeros(n, dtype=bool)
        np.logical_or.at(bad, roots, out[names])
        out[names] = bad[roots]
    return out
