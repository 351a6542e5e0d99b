"""Phrase collocations: frequent n-grams by mergeable Misra-Gries summaries, then exact counts.

First pass: tasks count the n-grams of one to ``longest`` words by hash; the hash also parts
them. Every partition merges what the tasks counted into one summary, whose capacity exceeds
the partition's mass (n-grams in it, repeats included) over the least count; so an n-gram that
stands that often is never lost, whatever is merged in which order (Misra and Gries; Agarwal et
al.). The counters, tenths of the mass, are all that a partition holds. Second pass: the texts
are counted again, but only n-grams whose hash survived, exactly, as strings, so n-grams of
equal hash are no matter. Counters that with all that was taken off the summary can't reach the
least count are dropped before. The survivors go to the tasks as a bitmap of fixed size; a bitmap that
fills up lets more through, which the exact counts then drop.

Scores join a phrase's counts with those of its parts, which are at least as frequent. Products
are decimals of 38 digits, enough for counts below 10 ** 16.

Null text counts as empty, null lang is ``und``. Texts without words have no phrases. Texts of
any length are read whole. Repeated rows count each. Ties of rank go by count, then by bytes.
An empty table gives an empty result. Only text and lang are read, so others may have any names.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_map, arrow_stream, blank, stash, table, texts

#: Bytes of text for each hash partition: about five million n-grams' mass to a few MB.
PART_BYTES = 32 << 20
#: Distinct n-grams and words that a task holds before it passes them on.
HELD_GRAMS, HELD_WORDS = 1_200_000, 200_000
#: Bytes of text that are split into words at a time, one text at least.
CHUNK_BYTES = 2 << 20
#: Rows that a task passes on at a time.
ROWS = 50_000
#: Bits of the survivors' bitmap: 8 MB.
BITMAP = 1 << 26
#: Candidates of one (lang, salt), which a window sorts, on average at most.
BLOCK_ROWS = 100_000
#: Marks that part pieces all become this one, which no word holds.
_BREAK = b"."
_MARKS = bytes.maketrans(b",;:!?\n\x0b\x0c\r", _BREAK * 9)
#: Bits of a word's number in a packed n-gram.
_BITS = 21


@dataclass(frozen=True)
class Phrases:
    longest: int = 3  # the packing holds three words
    least: int = 10
    covered: int = 50  # percent of a phrase's count that drops it for a longer one
    first: int = 2000


class Tally:
    """A task's counts: words get numbers, n-grams are numbers of up to three words packed."""

    def __init__(self, longest: int) -> None:
        self.longest = longest
        self.clear()

    def clear(self) -> None:
        self.words: list[bytes] = [b""]
        self.numbers: defaultdict[bytes, int] = defaultdict(self._new)
        self.numbers[_BREAK] = 0
        self.hashes = array("Q", [0])
        self.held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.rows = 0

    def _new(self) -> int:
        self.words.append(b"")
        return len(self.words) - 1

    def grams(self, found: list[bytes]) -> np.ndarray:
        data = (b"\n" + _BREAK).join(found).lower().translate(_MARKS).replace(_BREAK, b" . ").split()
        ids = np.fromiter(map(self.numbers.__getitem__, data), dtype=np.int64, count=len(data))
        out, packed, ok = [ids[ids > 0]], ids, ids > 0
        for n in range(2, self.longest + 1):
            ok = ok[:-1] & (ids[n - 1 :] > 0)
            packed = (packed[:-1] << _BITS) | ids[n - 1 :]
            out.append(packed[ok])
        return np.concatenate(out)

    def name(self) -> None:
        """Looks up the words of new numbers."""
        if len(self.hashes) < len(self.words):
            for word, n in self.numbers.items():
                self.words[n] = word
            self.hashes.extend(map(xxhash.xxh64_intdigest, self.words[len(self.hashes) :]))
            self.words[0] = b""

    def add(self, lang: str, packed: np.ndarray) -> None:
        keys, counts = np.unique(packed, return_counts=True)
        self.held.setdefault(lang, []).append((keys, counts))
        self.rows += len(keys)
        if self.rows > HELD_GRAMS:
            self.held = {k: [summed(v)] for k, v in self.held.items()}
            self.rows = sum(len(v[0][0]) for v in self.held.values())

    @property
    def full(self) -> bool:
        return self.rows > HELD_GRAMS // 2 or len(self.words) > HELD_WORDS

    def parts(self, packed: np.ndarray) -> list[np.ndarray]:
        """Numbers of the first to last word, zero before shorter n-grams."""
        return [packed >> (_BITS * k) & ((1 << _BITS) - 1) for k in range(self.longest - 1, -1, -1)]

    def hashed(self, lang: str, packed: np.ndarray) -> np.ndarray:
        """64 bits of (lang, n-gram), the same in every task."""
        words = np.frombuffer(self.hashes, dtype=np.uint64)
        out = np.full(len(packed), xxhash.xxh64_intdigest(lang), dtype=np.uint64)
        for part in self.parts(packed):
            out = (out ^ words[part]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out

    def strings(self, packed: np.ndarray) -> list[str]:
        rows = np.stack(self.parts(packed), axis=1).tolist()
        return [b" ".join([self.words[i] for i in row if i]).decode("utf-8", "replace") for row in rows]


def summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(c) for c in zip(*held, strict=True))
    keys, back = np.unique(keys, return_inverse=True)
    return keys, np.bincount(back, weights=counts, minlength=len(keys)).astype(np.int64)


def tallies(batches: Iterator[pa.RecordBatch], longest: int, tally: Tally) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(lang, packed n-grams, counts) of a task, in as many turns as it needs; each sees all of
    ``tally``'s words."""

    def turns() -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        tally.name()
        for lang, held in tally.held.items():
            yield lang, *summed(held)
        tally.clear()

    for batch in batches:
        by_lang: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), texts(batch), strict=True):
            by_lang.setdefault(lang, []).append(text)
        for lang, found in by_lang.items():
            for chunk in chunks(found):
                packed = tally.grams(chunk)
                if len(packed):
                    tally.add(lang, packed)
                if tally.full:
                    yield from turns()
    yield from turns()


def chunks(found: list[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for text in found:
        held.append(text)
        size += len(text)
        if size >= CHUNK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


class Summary:
    """Misra-Gries counters of one partition, merged from weighted counts."""

    def __init__(self, mass: int, least: int) -> None:
        self.capacity, self.least, self.error = mass // least + 1, least, 0
        self.keys, self.counts = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys, self.counts = summed([(self.keys, self.counts), (keys, counts)])
        over = len(self.keys) - self.capacity
        if over > 0:
            largest = np.partition(self.counts, over - 1)[over - 1]  # of those beyond capacity
            self.counts, self.error = self.counts - largest, self.error + int(largest)
            kept = self.counts > 0
            self.keys, self.counts = self.keys[kept], self.counts[kept]

    def frequent(self) -> np.ndarray:
        """Keys that may be frequent: a count is at most the counter and all that was taken off."""
        return self.keys[self.counts + self.error >= self.least]


def survivors(docs: DataFrame, how: Phrases) -> DataFrame:
    """``hashes``: packed 64-bit hashes that hold those of every frequent n-gram."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).collect()[0]["n"] or 0
    parts = max(1, -(-size // PART_BYTES))
    longest, least = how.longest, how.least

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        mass: dict[int, int] = defaultdict(int)
        tally = Tally(longest)
        for lang, packed, counts in tallies(batches, longest, tally):
            keys = tally.hashed(lang, packed)
            part = (keys >> np.uint64(32)) % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            keys, counts, part = keys[order], counts[order], part[order]
            found, first = np.unique(part, return_index=True)
            ends = [*first[1:].tolist(), len(part)]
            for p, a, b in zip(found.tolist(), first.tolist(), ends, strict=True):
                mass[p] += int(counts[a:b].sum())
                yield {"part": [p], "mass": [None], "keys": [keys[a:b].tobytes()], "counts": [counts[a:b].astype("<i8").tobytes()]}
        if mass:
            yield {"part": list(mass), "mass": list(mass.values()), "keys": [None] * len(mass), "counts": [None] * len(mass)}

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        """Rows come by part, masses first."""
        at, mass, summary = None, 0, None
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> Iterator[dict]:
            if summary is not None:
                if held:
                    summary.merge(*summed(held))
                yield {"hashes": [summary.frequent().tobytes()]}

        for batch in batches:
            for part, m, keys, counts in zip(*(batch.column(n).to_pylist() for n in ("part", "mass", "keys", "counts")), strict=True):
                if part != at:
                    yield from out()
                    at, mass, summary, held = part, 0, None, []
                if m is not None:
                    mass += m
                    continue
                if summary is None:
                    summary = Summary(mass, least)
                held.append((np.frombuffer(keys, dtype="<u8"), np.frombuffer(counts, dtype="<i8")))
                if sum(len(k) for k, _ in held) > max(200_000, len(summary.keys)):
                    summary.merge(*summed(held))
                    held = []
        yield from out()

    counted = arrow_stream(docs, local, "part bigint, mass bigint, keys binary, counts binary")
    dealt = counted.repartition(parts, "part").sortWithinPartitions("part", F.col("mass").isNull())
    return stash(arrow_stream(dealt, merged, "hashes binary"), "survivors")


def bitmap(found: DataFrame) -> np.ndarray:
    """Bits of the survivors' hashes, as bytes. Tasks send what bits they have by bytes of the
    bitmap; the driver holds the bitmap alone."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for hashes in batch.column("hashes").to_pylist():
            bits = np.frombuffer(hashes, dtype="<u8") & np.uint64(BITMAP - 1)
            words, back = np.unique(bits >> np.uint64(6), return_inverse=True)
            values = np.zeros(len(words), dtype=np.uint64)
            np.bitwise_or.at(values, back, np.uint64(1) << (bits & np.uint64(63)))
            yield {"word": words.astype(np.int64), "bits": values.view(np.int64)}

    words = arrow_map(found, run, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    out = np.zeros(BITMAP // 64, dtype=np.uint64)
    got = words.toArrow()  # a row for each of the bitmap's words at most
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def counted(docs: DataFrame, how: Phrases) -> DataFrame:
    """lang, size, phrase, n: every n-gram of at least ``least`` occurrences, and with size 0 and
    an empty phrase all words of a language."""
    docs = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    longest = how.longest
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(survivors(docs, how)))  # BITMAP bits

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        bits, tally = shared.value, Tally(longest)
        for lang, packed, counts in tallies(batches, longest, tally):
            single = packed < (1 << _BITS)
            keys = tally.hashed(lang, packed) & np.uint64(BITMAP - 1)
            kept = (bits[keys >> np.uint64(6)] >> (keys & np.uint64(63)) & np.uint64(1)).astype(bool)
            total = int(counts[single].sum())
            packed, counts = packed[kept], counts[kept]
            for a in range(0, len(packed), ROWS):
                part = packed[a : a + ROWS]
                size = sum((p > 0).astype(np.int32) for p in tally.parts(part))
                yield {"lang": [lang] * len(part), "size": size, "phrase": tally.strings(part), "n": counts[a : a + ROWS]}
            yield {"lang": [lang], "size": [0], "phrase": [""], "n": [total]}

    rows = arrow_stream(docs, exact, "lang string, size int, phrase string, n bigint")
    return rows.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n")).where((F.col("size") == 0) | (F.col("n") >= how.least))


def floored_score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000000 * a * a / (l * r)) by whole-number division of decimals, which rounds nothing."""
    a, l, r = (c.cast("decimal(16,0)") for c in (a, l, r))  # noqa: E741
    return F.call_function("div", (F.lit(1_000_000).cast("decimal(7,0)") * a * a).cast("decimal(38,0)"), (l * r).cast("decimal(38,0)"))


def collocations(docs: DataFrame, how: Phrases = Phrases()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score."""
    counts = stash(counted(docs, how), "phrases")
    grams = counts.where("size > 0").select("lang", "phrase", "n")
    found = counts.where("size > 1").select("lang", "size", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("words"))
    # what longer phrases hold of a shorter one
    inside = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: F.concat_ws(" ", F.slice("words", i, n)))))
    longer = found.where("size > 2").select("lang", F.explode(inside).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    held = found.join(longer, ["lang", "phrase"], "left")
    held = held.where(F.col("most").isNull() | (100 * F.col("most") < how.covered * F.col("a")))
    cuts = held.select("lang", "phrase", "a", "words", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.concat_ws(" ", F.slice("words", F.lit(1), F.col("k"))).alias("first"), F.concat_ws(" ", F.slice("words", F.col("k") + 1, F.col("size") - F.col("k"))).alias("rest"))
    heads, tails = grams.toDF("lang", "first", "l"), grams.toDF("lang", "rest", "r")
    both = cuts.join(heads, ["lang", "first"]).join(tails, ["lang", "rest"])
    both = both.withColumn("score", floored_score(F.col("a"), F.col("l"), F.col("r")))
    least = both.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("cut")).select("lang", "phrase", "cut.*")
    return ranked(stash(least, "scores"), how.first).join(counts.where("size = 0").select("lang", "n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def ranked(scores: DataFrame, first: int) -> DataFrame:
    """The first rows of each lang: first those of every block of a lang, then of these."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    blocks = max(1, scores.count() // BLOCK_ROWS)
    salted = scores.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(blocks)))
    near = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= first)
    final = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return final.where(F.col("rank") <= first).drop("salt")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang),
grams AS (
  SELECT lang, unnest(w) AS phrase, 1 AS size FROM worded
  UNION ALL
  SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), 2 FROM worded WHERE len(w) > 1
  UNION ALL
  SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])), 3 FROM worded WHERE len(w) > 2),
f AS MATERIALIZED (SELECT lang, phrase, size, count(*) AS n FROM grams GROUP BY ALL),
cand AS (SELECT lang, phrase, size, n AS a, string_split(phrase, ' ') AS p FROM f WHERE size > 1 AND n >= 10),
covered AS (
  SELECT DISTINCT s.lang, s.phrase FROM cand s
  JOIN (SELECT lang, a, p[1] || ' ' || p[2] AS inner_phrase FROM cand WHERE size = 3
        UNION ALL SELECT lang, a, p[2] || ' ' || p[3] FROM cand WHERE size = 3) t
    ON s.lang = t.lang AND s.phrase = t.inner_phrase
  WHERE s.size = 2 AND 100 * t.a >= 50 * s.a),
cuts AS (
  SELECT lang, phrase, a, 1 AS k, p[1] AS head, substr(phrase, length(p[1]) + 2) AS tail FROM cand
  UNION ALL
  SELECT lang, phrase, a, 2, p[1] || ' ' || p[2], p[3] FROM cand WHERE size = 3),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, h.n AS l, t.n AS r,
         CAST((CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(h.n AS HUGEINT) * t.n) AS BIGINT) AS score
  FROM cuts c JOIN f h ON h.lang = c.lang AND h.phrase = c.head JOIN f t ON t.lang = c.lang AND t.phrase = c.tail
  WHERE NOT EXISTS (SELECT 1 FROM covered v WHERE v.lang = c.lang AND v.phrase = c.phrase)),
picked AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM scored),
ranks AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM picked WHERE nth = 1)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, n.n, r.score FROM ranks r JOIN totals n ON n.lang = r.lang WHERE r.rank <= 2000
"""
