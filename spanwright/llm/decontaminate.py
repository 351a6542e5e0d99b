"""Benchmark decontamination by templates.

Words are put in canonical form: numbers, names and units become typed placeholders, others
lose their case and outer punctuation. Windows of canonical words of the documents are
hash-joined with those of the benchmark items. Where they meet, the words behind the
placeholders must be consistent: over an alignment, one value of the item stands for one value
of the document and the other way round. So a question is caught with other numbers and names
in it, but not a mere likeness of form. An item leaks into a document if at least ``share`` of
the item's windows are found there in one alignment.

A capitalised word at a sentence's start may be a name or not, so a window has a hash for each
way of reading such words, on both sides, and windows meet by any. An alignment is judged once
by the plain readings alone, in which these words are literal, and once by all readings: words
changed in other ways never hide what the plain readings find.

The documents' windows are first looked up in a bitmap of fixed size of the benchmark's window
hashes, the only thing that is broadcast; what passes goes through an ordinary join.

An item of fewer words than a window is one window of its own length, which is looked for in
all documents; items of fewer than ``least`` words say nothing and are left out. A window of
which too many words are placeholders would meet anything, so it is known by its words as they
stand; items that have only such windows are found by these.

Null text counts as empty and has no windows. Repeated rows with one doc_id are one document;
repeated items are one item. Very long texts are read whole. Ties between alignments go to the
one with the least shift. Empty tables give an empty result. Only the named columns are read, so
other columns may have any names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_map, stash, table, texts

#: Words that count as units.
UNITS = frozenset(
    "% $ € £ mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg lb lbs oz ton tons ml l liter liters litre litres "
    "gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years dollar dollars "
    "euro euros cent cents degree degrees mph kmh".split()
)
NUMBER = re.compile(r"[$€£#]?[-+]?\d[\d.,:/]*%?")
EDGES = "\"'`()[]{}<>.,;:!?*_«»“”‘’"
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
BITMAP_BITS = 24


@dataclass(frozen=True)
class Templates:
    """window: canonical words of a window. least: words of an item, at least. literal: least
    share of a window's words that are no placeholders. share: least share of an item's windows
    in one alignment."""

    window: int = 8
    least: int = 4
    literal: float = 0.5
    share: float = 0.3


class Lexicon(dict):
    """Index of each word into the arrays of what it stands for; made when first met."""

    #: Words that a worker keeps from batch to batch.
    LIMIT = 400_000

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[tuple] = []
        self.made: np.ndarray = np.zeros(0, dtype=self.KIND)

    KIND = np.dtype([("first", "u8"), ("inner", "u8"), ("exact", "u8"), ("last", "?"), ("slot_first", "?"), ("slot_inner", "?")])

    def __missing__(self, word: bytes) -> int:
        text = word.decode("utf-8", "replace")
        core = text.strip(EDGES)
        number = bool(NUMBER.fullmatch(text.strip("\"'()[].,;:!?")))
        unit = core.lower() in UNITS
        kind = "<num>" if number else "<unit>" if unit else None
        name = kind is None and len(core) > 1 and core[0].isupper() and core[1:].islower() and core.isalpha()
        digest = lambda s: xxhash.xxh64_intdigest(s.encode("utf-8"), 7)
        plain = digest(kind or core.lower())
        self.rows.append((plain, digest("<name>") if name else plain, digest(f"={core}"), text.rstrip("\"')]")[-1:] in ".!?:", kind is not None, kind is not None or name))
        self[word] = len(self.made) + len(self.rows) - 1
        return self[word]

    def of(self, words: list[bytes]) -> np.ndarray:
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.rows:
            self.made, self.rows = np.concatenate((self.made, np.array(self.rows, dtype=self.KIND))), []
        return self.made[at]


_lexicons: list[Lexicon] = []


def lexicon() -> Lexicon:
    """The worker's own; a full one is replaced."""
    if not _lexicons or len(_lexicons[0]) > Lexicon.LIMIT:
        _lexicons[:] = [Lexicon()]
    return _lexicons[0]


def canonical(words: list[bytes], begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the canonical words, which are placeholders, the hashes if a capital at a
    sentence's start is a name too, where these differ, and the hashes of the words as they
    stand. Texts start at places ``begins``."""
    row = lexicon().of(words)
    starts = np.ones(len(row), dtype=bool)
    starts[1:] = row["last"][:-1]
    starts[begins] = True
    code = np.where(starts, row["first"], row["inner"])
    return code, np.where(starts, row["slot_first"], row["slot_inner"]), row["inner"], code != row["inner"], row["exact"]


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the windows; ``mixed`` makes them final."""
    out = np.zeros(max(0, len(hashes) - n + 1), dtype=np.uint64)
    for k in range(n):
        out = out * MULTIPLIER + hashes[k : k + len(out)]
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    return h ^ (h >> np.uint64(29))


def readings(h: np.ndarray, at: np.ndarray, room: np.ndarray, change: np.ndarray, open_: np.ndarray, n: int, first: int = 0, taken: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(places, hashes, bits of the words taken as names) of windows ``at`` with hashes ``h``
    for every choice of one or more of their words that are ``open_``; ``room``: how many
    placeholders each window may still take."""
    for k in range(first, n):
        pick = (room > 0) & open_[at + k]
        if pick.any():
            step = np.uint64(pow(int(MULTIPLIER), n - 1 - k, 1 << 64))
            here, new = at[pick], h[pick] + change[at[pick] + k] * step
            yield here, new, taken | 1 << k
            yield from readings(new, here, room[pick] - 1, change, open_, n, k + 1, taken | 1 << k)


def windows(rows: DataFrame, key: str, rules: Templates, bitmap: np.ndarray | None, lengths: tuple[int, ...] = ()) -> DataFrame:
    """key, text_key (of the whole text), total (windows of it), words (of the window), hash, at,
    plain (no word at a sentence's start is read as a name), and slots: the words behind the
    window's placeholders, each with its place. ``bitmap``: others are dropped; windows are of
    the usual length and of ``lengths``. Without one the rows are items."""
    n = rules.window
    known = None if bitmap is None else np.unpackbits(bitmap).astype(bool)
    names = (key, "text_key", "total", "words", "hash", "at", "plain", "slots")

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        out: dict[str, list] = {c: [] for c in names}
        split = [t.split() for t in texts(batch)]
        sizes = np.array([len(w) for w in split], dtype=np.int64)
        words = [w for doc in split for w in doc]
        if not words:
            yield out
            return
        ends = np.cumsum(sizes)
        code, slot, named, either, exact = canonical(words, (ends - sizes)[sizes > 0])
        count = np.concatenate(([0], np.cumsum(slot)))
        every = np.repeat(np.arange(len(sizes)), sizes)
        ids, keys = batch.column(key).to_pylist(), {}
        wanted = sorted({n, *lengths} if known is not None else {n, *(int(x) for x in np.unique(sizes) if rules.least <= x < n)})
        for m in wanted:
            h, literal = rolling(code, m), rolling(exact, m)
            doc = every[: len(h)]
            inside = np.arange(len(h)) + m <= ends[doc]
            if known is None and m < n:
                inside &= sizes[doc] == m
            room = np.floor((1 - rules.literal) * m).astype(np.int64) - (count[m:] - count[: len(h)])
            good, crowded = np.flatnonzero(inside & (room >= 0)), np.flatnonzero(inside & (room < 0))
            total = np.bincount(doc[good], minlength=len(sizes))
            if known is None:  # an item is known by its crowded windows only if it has no others
                crowded = crowded[total[doc[crowded]] == 0]
            total = total + np.bincount(doc[crowded], minlength=len(sizes))
            found = [(good, h[good], 0), *readings(h[good], good, room[good], named - code, either, m)]
            salt = np.uint64(m if m < n else 0) * MULTIPLIER
            for places, hashes, taken in [*[(p, x + salt, t) for p, x, t in found], (crowded, ~(literal[crowded] + salt), 0)]:
                hashes = mixed(hashes)
                if known is not None:
                    met = known[(hashes & np.uint64((1 << BITMAP_BITS) - 1)).astype(np.int64)]
                    places, hashes = places[met], hashes[met]
                for i, value in zip(places.tolist(), hashes.view(np.int64).tolist(), strict=True):
                    d = int(doc[i])
                    if d not in keys:
                        keys[d] = hashlib.md5(batch.column("text")[d].as_py().encode()).hexdigest()
                    start = int(ends[d] - sizes[d])
                    values = [f"{i + k - start}\t{words[i + k].decode('utf-8', 'replace').strip(EDGES)}" for k in range(m) if slot[i + k] or taken >> k & 1]
                    for c, v in zip(out, (ids[d], keys[d], int(total[d]), m, value, i - start, not taken, values), strict=True):
                        out[c].append(v)
        yield out

    kind = dict(rows.dtypes)[key]
    return arrow_map(rows.select(key, "text"), run, f"`{key}` {kind}, text_key string, total bigint, words int, hash bigint, at int, plain boolean, slots array<string>")


def bitmap_of(items: DataFrame) -> np.ndarray:
    """Bits of the items' window hashes: 2 MB, whatever the benchmark's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << BITMAP_BITS, dtype=bool)
        for batch in batches:
            bits[batch.column("hash").to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64((1 << BITMAP_BITS) - 1)] = True
        yield pa.RecordBatch.from_pydict({"bits": [np.packbits(bits).tobytes()]})

    out = np.zeros(1 << (BITMAP_BITS - 3), dtype=np.uint8)
    for row in items.select("hash").coalesce(8).mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(row.bits, dtype=np.uint8)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, rules: Templates = Templates()) -> DataFrame:
    """doc_id, text_key, item_id, n_windows (found in the best alignment), item_windows, and
    n_changed: placeholders whose words differ there."""
    items = stash(windows(benchmark, "item_id", rules, None), "items")
    lengths = tuple(r["words"] for r in items.select("words").distinct().collect())  # at most rules.window
    found = windows(docs, "doc_id", rules, bitmap_of(items), lengths).drop("words")
    right = items.select("hash", "item_id", F.col("at").alias("item_at"), F.col("total").alias("item_windows"), F.col("slots").alias("item_slots"), F.col("plain").alias("item_plain")).distinct()
    met = stash(found.drop("total").join(right, "hash").withColumn("shift", F.col("at") - F.col("item_at")), "met")
    # every meeting counts among all readings; those of two plain windows by themselves too
    turns = F.when(F.col("plain") & F.col("item_plain"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))
    met = met.withColumn("turn", F.explode(turns))
    key = ["doc_id", "text_key", "item_id", "shift", "turn"]
    pair = F.explode(F.arrays_zip(F.col("slots").alias("d"), F.col("item_slots").alias("b")))
    word = lambda c: F.element_at(F.split(c, "\t", 2), 2)
    slots = met.select(*key, pair.alias("p")).select(*key, F.col("p.d").alias("d"), F.col("p.b").alias("b")).distinct().select(*key, word(F.col("d")).alias("d"), word(F.col("b")).alias("b"))
    each = slots.groupBy(*key).agg(F.count_distinct("b").alias("nb"), F.count_distinct("d").alias("nd"), F.count_distinct("b", "d").alias("np"), F.count_if(F.col("b") != F.col("d")).alias("n_changed"))
    runs = met.groupBy(*key, "item_windows").agg(F.count_distinct("at").alias("n_windows"))
    same = [runs[k].eqNullSafe(each[k]) for k in key]
    judged = runs.join(each, same[0] & same[1] & same[2] & same[3] & same[4], "left").select(*[runs[k] for k in key], "item_windows", "n_windows", "nb", "nd", "np", F.coalesce("n_changed", F.lit(0)).cast("long").alias("n_changed"))
    consistent = F.col("np").isNull() | ((F.col("np") == F.col("nb")) & (F.col("np") == F.col("nd")))
    best = F.row_number().over(Window.partitionBy("doc_id", "text_key", "item_id").orderBy(F.desc("n_windows"), "shift", "turn"))
    kept = judged.where(consistent & (F.col("n_windows") >= rules.share * F.col("item_windows"))).withColumn("best", best)
    return kept.where("best = 1").select("doc_id", "text_key", "item_id", "n_windows", "item_windows", "n_changed")


def without_leaks(docs: DataFrame, benchmark: DataFrame, rules: Templates = Templates()) -> DataFrame:
    """The rows of ``docs`` whose text has no leak, with all their columns."""
    bad = leaks(docs, benchmark, rules).select(F.col("text_key").alias("_leaking")).distinct()
    return docs.join(bad, F.md5(docs["text"]) == bad["_leaking"], "left_anti")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")
