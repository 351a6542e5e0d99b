"""Vector code compression: product codes whose nearest entries are found by equal averages.

Components become integers, vectors are cut into equal parts, and every part position has a
codebook, fitted by rounds of assignment and means. A part's nearest entry is looked for among
entries sorted by the sum of their components: from the place of the part's own sum outward,
nearer sum first, until the squared gap of sums over the dimension strictly exceeds the best
squared distance; by Cauchy's inequality no entry farther out can be nearer or tie.

Each round is one pass over the table: tasks add up components by (part, entry) and Spark adds
up the tasks; the driver holds only the codebooks, whose size the parameters fix. Sums are
decimals, so they are exact at any number of rows.

Vectors that are null or hold null or non-finite components are dropped, as are those of
another dimension than the kept vector of least id. Parts of a dimension that isn't a multiple
of ``parts`` differ by one component. With fewer kept vectors than entries, codebooks have as
many entries as there are vectors. Distance ties go to the lower index; equal vec_ids go by
their bytes. Repeated rows are coded each; null vec_ids are coded, and come first. Null
labels are one group. An empty table gives an empty result. An error past 64 bits is null;
a scaled component of 2 ** 62 and more is a ValueError. Only vec_id, embedding and label are
read, so others may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, stash, table

#: Keys whose sums are broadcast at most.
BROADCAST_KEYS = 100_000


@dataclass(frozen=True)
class Coding:
    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: int = 4096


def bounds(dimension: int, parts: int) -> list[tuple[int, int]]:
    return [(p * dimension // parts, (p + 1) * dimension // parts) for p in range(parts)]


def integers(vectors: pa.ListArray, scale: int) -> list[bytes | None]:
    """floor(scale * x) of each vector as 64-bit integers; None where the row is dropped."""
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null: nan
    whole = np.floor(flat * scale)
    fine = np.isfinite(flat)
    if (np.abs(whole[fine]) >= 2.0**62).any():
        raise ValueError("a scaled component needs more than 62 bits")
    lengths = np.array([v or 0 for v in vectors.value_lengths().to_pylist()], dtype=np.int64)
    ends = np.cumsum(lengths)
    bad = np.append(0, np.cumsum(~fine))
    packed = np.where(fine, whole, 0).astype("<i8")
    valid = vectors.is_valid().to_pylist()
    return [packed[e - n : e].tobytes() if ok and bad[e] == bad[e - n] else None for ok, e, n in zip(valid, ends.tolist(), lengths.tolist(), strict=True)]


def small(values: np.ndarray, entries: np.ndarray) -> bool:
    """Whether squared sums of differences stay within 64 bits."""
    most = max((int(np.abs(a).max()) for a in (values, entries) if a.size), default=0)
    return (2 * most * max(values.shape[1], 1)) ** 2 < 2**62


def nearest(values: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry and its squared distance."""
    if not small(values, entries):
        values, entries = values.astype(object), entries.astype(object)
    n, width = values.shape
    if not width:
        return np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    sums = entries.sum(axis=1)
    order = np.argsort(sums, kind="stable")
    sums, own = sums[order], values.sum(axis=1)
    high = np.searchsorted(sums, own)
    low = high - 1
    who = np.full(n, -1, dtype=np.int64)
    best = np.zeros(n, dtype=values.dtype)
    live = np.arange(n)
    while live.size:
        lo, hi, mine = low[live], high[live], own[live]
        down, up = mine - sums[np.maximum(lo, 0)], sums[np.minimum(hi, len(sums) - 1)] - mine
        left = (lo >= 0) & ((hi >= len(sums)) | (down <= up).astype(bool))
        gap = np.where(left, down, up)
        more = (lo >= 0) | (hi < len(sums))
        more &= (who[live] < 0) | (gap * gap <= best[live] * width).astype(bool)
        live, left, lo, hi = live[more], left[more], lo[more], hi[more]
        entry = order[np.where(left, lo, hi)]
        low[live] -= left
        high[live] += ~left
        step = values[live] - entries[entry]
        far = (step * step).sum(axis=1)
        better = (who[live] < 0) | (far < best[live]).astype(bool) | ((far == best[live]).astype(bool) & (entry < who[live]))
        who[live[better]] = entry[better]
        best[live[better]] = far[better]
    return who, best


def matrix(batch: pa.RecordBatch, dimension: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("packed").to_pylist()), dtype="<i8").reshape(batch.num_rows, dimension)


def part_sums(rows: DataFrame, books: list[np.ndarray], dimension: int) -> DataFrame:
    """part, entry, place (-1 counts), total, over all rows."""
    cuts = bounds(dimension, len(books))

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        values, out = matrix(batch, dimension), {n: [] for n in ("part", "entry", "place", "total")}
        for p, ((a, b), book) in enumerate(zip(cuts, books, strict=True)):
            part = values[:, a:b]
            who, _ = nearest(part, book)
            for entry in np.unique(who).tolist():
                members = part[who == entry]
                held = members if small(members, book) and len(members) < 2**20 else members.astype(object)
                for place, total in enumerate([len(members), *held.sum(axis=0).tolist()], -1):
                    for name, v in zip(out, (p, entry, place, Decimal(int(total))), strict=True):
                        out[name].append(v)
        yield out

    sums = arrow_map(rows.select("packed"), run, "part int, entry int, place int, total decimal(38,0)")
    return sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"))


def fitted(rows: DataFrame, how: Coding) -> tuple[list[np.ndarray], int]:
    """The codebooks after all rounds and the dimension."""
    first = rows.where(F.col("packed").isNotNull()).orderBy("vec_id", "packed").limit(1).select(F.length("packed").alias("n")).collect()
    if not first:
        return [], 0
    width = first[0]["n"]
    kept = rows.where(F.length("packed") == width)
    seeds = kept.orderBy("vec_id", "packed").limit(how.entries).select("packed").collect()  # one row for each entry
    start = np.array([np.frombuffer(bytes(r["packed"]), dtype="<i8") for r in seeds]).reshape(len(seeds), width // 8)
    books = [start[:, a:b].copy() for a, b in bounds(width // 8, how.parts)]
    for _ in range(how.rounds):
        found: dict[tuple[int, int], dict[int, int]] = {}
        for r in part_sums(kept, books, width // 8).collect():  # parts * entries * (places + 1) numbers
            found.setdefault((r["part"], r["entry"]), {})[r["place"]] = int(r["total"])
        for (p, entry), totals in found.items():
            books[p][entry] = [totals[i] // totals[-1] for i in range(books[p].shape[1])]
    return books, width // 8


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for book in books for v in book.ravel().tolist()).encode()).hexdigest()


def with_group_total(rows: DataFrame, key: str, value: str, name: str, most: int = BROADCAST_KEYS) -> DataFrame:
    """Adds the sum of ``value`` over rows with an equal ``key``, nulls together.

    Sums are added up before the shuffle. Of up to ``most`` keys they are broadcast; else only
    those of the most crowded keys are, fewer than ``most``, and the other rows, no key of which
    has more than 1 / ``most`` of all, meet theirs by a shuffle."""
    totals = stash(rows.groupBy(F.col(key).alias("_key")).agg(F.sum(value).alias(name), F.count("*").alias("_many")), "totals")
    seen = totals.agg(F.count("*").alias("keys"), F.sum("_many").alias("rows")).collect()[0]
    here = F.col(key).eqNullSafe(F.col("_key"))
    if seen["keys"] <= most:
        return rows.join(F.broadcast(totals.drop("_many")), here).drop("_key")
    crowded = F.col("_many") > seen["rows"] // most
    hot = F.broadcast(totals.where(crowded).drop("_many"))
    few = totals.where(~crowded).drop("_many")
    return rows.join(hot, here).drop("_key").unionByName(rows.join(hot, here, "left_anti").join(few, here).drop("_key"))


def compressed(vectors: DataFrame, how: Coding = Coding()) -> tuple[DataFrame, list[np.ndarray]]:
    """vec_id, label, code, error of each kept row, and the codebooks."""
    kinds = dict(vectors.dtypes)

    def pack(batch: pa.RecordBatch) -> Iterator[dict]:
        yield {"vec_id": batch.column("vec_id"), "label": batch.column("label"), "packed": integers(batch.column("embedding"), how.scale)}

    ids = f"vec_id {kinds['vec_id']}, label {kinds['label']}"
    lists = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = stash(arrow_map(lists, pack, f"{ids}, packed binary").where(F.col("packed").isNotNull()), "vectors")
    books, dimension = fitted(rows, how)

    def code(batch: pa.RecordBatch) -> Iterator[dict]:
        values = matrix(batch, dimension)
        found = [nearest(values[:, a:b], book) for (a, b), book in zip(bounds(dimension, how.parts), books, strict=True)]
        digits = np.stack([who for who, _ in found], axis=1)
        errors = np.sum([e.astype(object) for _, e in found], axis=0) if batch.num_rows else []
        codes = ["".join(f"{d:02x}" for d in row) for row in digits.tolist()]
        yield {"vec_id": batch.column("vec_id"), "label": batch.column("label"), "code": codes, "error": [e if e < 2**63 else None for e in errors]}

    if not books:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).limit(0), books
    return arrow_map(rows.where(F.length("packed") == 8 * dimension), code, f"{ids}, code string, error bigint"), books


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compressed(table(spark, sf_dir, "embeddings"))
    rows = with_group_total(stash(coded, "codes"), "label", "error", "label_error")
    return rows.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle(how: Coding = Coding()) -> str:
    """Lloyd rounds over all (part, entry) distances."""
    width = f"(len(v) // {how.parts})"
    ctes = [
        "kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(" + str(how.scale) + " * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings "
        "WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "numbered AS (SELECT row_number() OVER (ORDER BY vec_id NULLS FIRST, v) AS rid, * FROM kept)",
        "places AS (SELECT rid, v, unnest(range(len(v))) AS spot FROM numbered)",
        f"comp AS MATERIALIZED (SELECT rid, spot // {width} AS part, spot % {width} AS place, v[spot + 1] AS val FROM places)",
        f"b0 AS (SELECT part, rid - 1 AS entry, place, val FROM comp WHERE rid <= {how.entries})",
    ]
    for k in range(how.rounds + 1):
        ctes.append(
            f"d{k} AS (SELECT c.rid, c.part, b.entry, sum((c.val - b.val) * (c.val - b.val)) AS far "
            f"FROM comp c JOIN b{k} b ON c.part = b.part AND c.place = b.place GROUP BY ALL)"
        )
        ctes.append(f"r{k} AS (SELECT rid, part, entry, far, row_number() OVER (PARTITION BY rid, part ORDER BY far, entry) AS nth FROM d{k})")
        ctes.append(f"a{k} AS MATERIALIZED (SELECT rid, part, entry, far FROM r{k} WHERE nth = 1)")
        if k < how.rounds:
            ctes.append(
                f"m{k} AS (SELECT a.part, a.entry, c.place, CAST(sum(c.val) AS BIGINT) AS s, count(*) AS n "
                f"FROM a{k} a JOIN comp c ON a.rid = c.rid AND a.part = c.part GROUP BY ALL)"
            )
            ctes.append(
                f"b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.place, "
                "CASE WHEN m.n IS NULL THEN b.val ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END AS val "
                f"FROM b{k} b LEFT JOIN m{k} m ON b.part = m.part AND b.entry = m.entry AND b.place = m.place)"
            )
    last = how.rounds
    ctes.append(
        f"coded AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM a{last} GROUP BY rid)"
    )
    ctes.append(f"book AS (SELECT sha256(string_agg(CAST(val AS VARCHAR), ',' ORDER BY part, entry, place)) AS h FROM b{last})")
    return (
        "WITH " + ",\n".join(ctes) + "\nSELECT n.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY n.label) AS BIGINT) AS label_error, "
        "(SELECT h FROM book) AS codebooks_sha256 FROM numbered n JOIN coded c ON n.rid = c.rid"
    )


ORACLE_SQL = _oracle()
