"""Secret scans with corpus-wide ownership frequency.

Three fixed kinds of candidates (assignments, access keys, hex strings) and a fourth, long
mixed tokens of any length, are found in each whole text; where a token overlaps a span of the fixed
kinds, its parts beside that are candidates. Each candidate's secret value is hashed; over the
corpus, the distinct repositories and owners of each hash are counted. A value that several
owners have is a widely copied example; one that stays with its owner looks live. Tokens of
the fourth kind count as spans only if they look live.

Where no column tells the repository, each distinct text is one, so copies of a document don't
make its secret look shared.

Null text counts as empty. A null owner or repository counts as one more owner or repository.
Repeated rows count once as to owners and repositories and are each reported. Very long texts
are searched whole. Spans that start at one place are listed by kind. An empty table gives an
empty result. Only the named columns are read, and other columns may have any names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, blank, null_key, stash, table, texts, unused

#: Kinds in the order in which equal places are listed.
KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{24,}")


@dataclass(frozen=True)
class Ownership:
    """A value is an example if at least this many distinct owners, or this many distinct
    repositories under at least two owners, have it."""

    example_owners: int = 3
    example_repositories: int = 20


def mixed(token: str) -> bool:
    """Upper, lower and digits, and at least 3.5 bits a character, in the whole token or a
    stretch of 200 characters of it."""
    if not (any(c.isdigit() for c in token) and any(c.isupper() for c in token) and any(c.islower() for c in token)):
        return False
    n = len(token)
    if -sum(c / n * math.log2(c / n) for c in Counter(token).values()) >= 3.5:
        return True
    return n > 200 and any(mixed(token[k : k + 200]) for k in range(0, n, 200))


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) by start, then kind; places are code points."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    base = list(out)
    for m in TOKEN.finditer(text):
        out += [(s, 3, e, text[s:e]) for s, e in _beside(m.start(), m.end(), base) if e - s >= 24 and mixed(text[s:e])]
    return sorted(out)


def _beside(start: int, end: int, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int]]:
    """The parts of a place that no span of ``base`` covers."""
    out = []
    for s, e in sorted((s, e) for s, _, e, _ in base if s < end and start < e):
        out.append((start, s))
        start = max(start, e)
    return [(s, e) for s, e in [*out, (start, end)] if s < e]


def text_hash() -> Column:
    return F.xxhash64(blank(F.col("text")))


def find(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` and, for each document, the arrays starts, kinds, ends and values (hashes)."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        found = [candidates(t.decode("utf-8", "replace")) for t in texts(batch)]
        digest = lambda v: int.from_bytes(hashlib.sha256(v.encode()).digest()[:8], "little", signed=True)
        yield {n: batch.column(n) for n in keep} | {
            "starts": [[c[0] for c in d] for d in found],
            "kinds": [[c[1] for c in d] for d in found],
            "ends": [[c[2] for c in d] for d in found],
            "hashes": [[digest(c[3]) for c in d] for d in found],
        }

    kinds = dict(docs.dtypes)
    columns = ", ".join(f"`{n}` {kinds[n]}" for n in keep)
    return arrow_map(docs.select(*dict.fromkeys((*keep, "text"))), run, f"{columns}, starts array<int>, kinds array<int>, ends array<int>, hashes array<bigint>")


def ownership(found: DataFrame, owner: str, repository: str | None, rules: Ownership) -> DataFrame:
    """(hash, repositories, owners, live): one row for each candidate value of the corpus.
    Distinct triples first, so that a value with very many copies is summed on the map side."""
    seen = found.select(F.explode("hashes").alias("hash"), null_key(owner).alias("owner"), (null_key(repository) if repository else F.col("_text")).alias("repository"))
    counts = seen.distinct().groupBy("hash").agg(F.count_distinct("repository").alias("repositories"), F.count_distinct("owner").alias("owners"))
    example = (F.col("owners") >= rules.example_owners) | ((F.col("repositories") >= rules.example_repositories) & (F.col("owners") >= 2))
    return counts.withColumn("live", ~example)


def judged_spans(docs: DataFrame, keep: tuple[str, ...], owner: str = "source", repository: str | None = None, rules: Ownership = Ownership()) -> DataFrame:
    """``keep`` and spans: array of (start, kind, end, live) in order; kind is a place in
    KINDS. Only documents with candidates go through the join with the ownership table.

    Rows are told apart by a number given to each when the candidates are stored."""
    need = tuple(dict.fromkeys((*keep, owner, *([repository] if repository else []), "_text")))
    found = stash(find(docs.select(*need[:-1], *({"text"} - {*need}), text_hash().alias("_text")), need).withColumn("row", F.monotonically_increasing_id()), "candidates")
    owners = ownership(found.where(F.size("hashes") > 0), owner, repository, rules)
    each = found.where(F.size("hashes") > 0).select("row", F.posexplode(F.arrays_zip("starts", "kinds", "ends", "hashes")).alias("i", "c")).select("row", "c.*").withColumnRenamed("hashes", "hash")
    span = F.struct(F.col("starts").alias("start"), F.col("kinds").alias("kind"), F.col("ends").alias("end"), "live")
    lists = each.join(owners, "hash").where((F.col("kinds") < 3) | F.col("live")).groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,live:boolean>>")
    return found.select("row", *keep).join(lists, "row", "left").select(*keep, F.coalesce("spans", empty).alias("spans"))


def redacted(docs: DataFrame, owner: str = "source", repository: str | None = None, rules: Ownership = Ownership()) -> DataFrame:
    """``docs``, all of its columns, with every span replaced by its kind, "<hex>", or "<hex:example>" if its value
    is a widely copied example; overlapping spans are one. n_chars, if there is one, follows."""
    need = tuple(dict.fromkeys((owner, *([repository] if repository else []))))
    slim = docs.select(*need, *({"text"} - {*need}), text_hash().alias("_text"))
    found = stash(find(slim, ("_text", *need)).where(F.size("hashes") > 0), "candidates")
    owners = ownership(found, owner, repository, rules)
    each = found.dropDuplicates(["_text"]).select("_text", F.explode(F.arrays_zip("starts", "kinds", "ends", "hashes")).alias("c")).select("_text", "c.*").withColumnRenamed("hashes", "hash")
    span = F.struct(F.col("starts").alias("start"), F.col("kinds").alias("kind"), F.col("ends").alias("end"), "live")
    key, listed = unused(docs, "text_hash"), unused(docs, "found_spans")
    spans = each.join(owners, "hash").where((F.col("kinds") < 3) | F.col("live")).groupBy(F.col("_text").alias(key)).agg(F.sort_array(F.collect_list(span)).alias(listed))
    names = docs.columns

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        new = []
        for text, found_here in zip(batch.column("text").to_pylist(), batch.column(listed).to_pylist(), strict=True):
            out, last = [], 0
            for s in found_here or []:
                if s["start"] >= last:
                    out += [text[last : s["start"]], f"<{KINDS[s['kind']]}{'' if s['live'] else ':example'}>"]
                last = max(last, s["end"])
            new.append("".join([*out, text[last:]]) if out else text)
        kept = {n: batch.column(n) for n in names} | {"text": new}
        if "n_chars" in names:
            kept["n_chars"] = [c if t == n else len(n) for c, t, n in zip(batch.column("n_chars").to_pylist(), batch.column("text").to_pylist(), new, strict=True)]
        yield kept

    kinds = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    return arrow_map(docs.withColumn(key, text_hash()).join(spans, key, "left").select(*names, listed), run, kinds)


def _listed(spans: str) -> str:
    name = "element_at(array('assign','access','hex','token'), s.kind + 1)"
    return f"concat_ws(',', transform({spans}, s -> concat_ws(':', {name}, s.start, s.end)))"


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged_spans(table(spark, sf_dir, "documents"), ("doc_id",))
    count = lambda k: F.expr(f"cast(size(filter(spans, s -> s.kind = {k})) as bigint)")
    return out.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(F.expr(_listed("filter(spans, s -> s.kind < 3)")), 256).alias("base_sha256"),
        F.expr(_listed("spans")).alias("spans"),
        F.expr("cast(size(filter(spans, s -> s.live)) as bigint)").alias("n_live"),
    )
