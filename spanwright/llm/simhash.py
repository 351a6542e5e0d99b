"""SimHash fingerprints, and groups of documents whose fingerprints are near by Hamming
distance, found by a self-join of the binary trie of all fingerprints.

A trie node is a prefix of the fingerprint; the join keeps node pairs with the bits in which
they differ so far and drops a pair once the error budget is exceeded. One of the two halves
of a fingerprint has at most a half of the errors, so two tries are traversed, the second on
fingerprints rotated by 32 bits, and the budget down to depth 32 is a half of the whole one.
Fingerprints one bit apart are linked first, by looking up their flips; a node pair whose
leaves are all of one linked component is then pruned, since it can add nothing. So a large
group of near copies costs in proportion to its size and isn't expanded into pairs.

Null text counts as empty; texts without words have fingerprint zero and are linked like
others. Copies and repeated rows share one fingerprint and are joined back at the end. A
null doc_id never names a component unless all of the component's are null. Very long texts
are read whole. An empty table gives an empty result. Other columns are not read.

``near_copies`` groups by a stated similarity of word shingles instead, for which 64 bits are
too few: it traverses tries of wider fingerprints and holds what meets to the shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.operators.cluster import numbered
from spanwright.operators.graph import _contracted, connected_components
from spanwright.sources.scratch import large

from .common import arrow_map, blank, stash, table, texts, unused
from .tokens import forget

SEED = 42


def fingerprint(text: bytes, shingle: int) -> int:
    """64 bits of a text's word shingles (ASCII lower case), repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(g, SEED) for g in grams], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and f, the fingerprint as a signed long."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        f = np.array([fingerprint(t, shingle) for t in texts(batch)], dtype=np.uint64).view(np.int64)
        yield {n: batch.column(n) for n in keep} | {"f": f}

    kinds = dict(docs.dtypes)
    return arrow_map(docs.select(*keep, "text"), run, ", ".join(f"`{n}` {kinds[n]}" for n in keep) + ", f bigint")


def _flips(key: Column, bits: range, upward: Column) -> Column:
    """The key and its one-bit changes in ``bits``; where ``upward``, only those that set a bit."""
    masks = F.array(*[F.lit(1 << b if b < 63 else -(1 << 63)) for b in bits])
    return F.concat(F.array(key), F.transform(F.filter(masks, lambda m: ~upward | (key.bitwiseAND(m) == 0)), lambda m: key.bitwiseXOR(m)))


def _different(x: str, y: str) -> Column:
    """False for a node pair whose leaves all are of one component."""
    lo, hi = F.least(f"{x}lo", f"{y}lo"), F.greatest(f"{x}hi", f"{y}hi")
    return lo != hi


def _nodes(leaves: DataFrame, depth: int, name: str) -> DataFrame:
    key = F.shiftrightunsigned("k", 64 - depth) if depth < 64 else F.col("k")
    return leaves.groupBy(key.alias(name)).agg(F.min("c").alias(f"{name}lo"), F.max("c").alias(f"{name}hi"))


def trie_links(leaves: DataFrame, budget: int) -> DataFrame:
    """(a, b): links of components c of ``leaves`` (f, c) whose fingerprints differ in at most
    ``budget`` (0 to 3) bits; every such pair of components has a path of links."""
    found = []
    for turn in (0, 32):
        key = F.col("f") if turn == 0 else F.shiftleft("f", 32).bitwiseOR(F.shiftrightunsigned("f", 32))
        turned = stash(leaves.select(key.alias("k"), "c"), "trie")
        top = _nodes(turned, 16, "x")
        pairs = (
            top.select("x", "xlo", "xhi", F.explode(_flips(F.col("x"), range(16), F.lit(True))).alias("y"))
            .join(_nodes(turned, 16, "y"), "y")
            .where(_different("x", "y"))
            .select(F.col("x").alias("px"), F.col("y").alias("py"))
        )
        mid = _nodes(turned, 32, "x").withColumn("px", F.shiftrightunsigned("x", 16))
        low = F.col("x").bitwiseAND(F.lit(0xFFFF))
        same = F.col("px") == F.col("py")
        step = pairs.join(mid, "px").select(
            "x", "xlo", "xhi", F.explode(F.when(same, _flips(low, range(16), F.lit(True))).otherwise(F.array(low))).alias("y16"), F.shiftleft("py", 16).alias("base")
        )
        pairs = (
            step.select("x", "xlo", "xhi", F.col("base").bitwiseOR(F.col("y16")).alias("y"))
            .join(_nodes(turned, 32, "y"), "y")
            .where(_different("x", "y"))
            .select(F.col("x").alias("px"), F.col("y").alias("py"))
        )
        pairs = stash(pairs, "pairs")
        for depth in (48, 64):
            up = 16
            parent = lambda n: F.shiftrightunsigned(n, up)  # noqa: B023, E731
            left, right = _nodes(turned, depth, "x").withColumn("px", parent("x")), _nodes(turned, depth, "y").withColumn("py", parent("y"))
            pairs = (
                pairs.join(left, "px")
                .join(right, "py")
                .where((F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= budget) & _different("x", "y") & ((F.col("px") != F.col("py")) | (F.col("x") <= F.col("y"))))
                .select(F.col("x").alias("px"), F.col("y").alias("py"), "xlo", "ylo")
            )
            pairs = pairs if depth == 64 else pairs.select("px", "py")
        found.append(pairs.select(F.col("xlo").alias("a"), F.col("ylo").alias("b")))
    return found[0].unionByName(found[1])


def near_groups(prints: DataFrame, budget: int = 3) -> DataFrame:
    """(f, root): each fingerprint of ``prints`` with the least one it reaches by steps of at
    most ``budget`` bits."""
    if not 1 <= budget <= 3:
        raise ValueError("the budget is 1 to 3 bits")
    every = stash(prints.select("f").distinct(), "prints")
    flips = every.select(F.col("f").alias("a"), F.explode(F.slice(_flips(F.col("f"), range(64), F.lit(True)), 2, 64)).alias("f"))
    first = connected_components(flips.join(every, "f").select("a", F.col("f").alias("b")))
    leaves = every.join(first, every.f == first.v, "left").select("f", F.coalesce("root", "f").alias("c"))
    if budget == 1:
        return leaves.select("f", F.col("c").alias("root"))
    leaves = stash(leaves, "leaves")
    joined = connected_components(trie_links(leaves, budget))
    return leaves.join(joined, leaves.c == joined.v, "left").select("f", F.coalesce("root", "c").alias("root"))


def simhash_components(docs: DataFrame, shingle: int = 3, budget: int = 3) -> DataFrame:
    """doc_id, f (signed long), root (a fingerprint of the group) and component_id."""
    prints = stash(fingerprints(docs, shingle), "fingerprints")
    groups = near_groups(prints, budget)
    least = prints.groupBy("f").agg(F.min("doc_id").alias("least")).join(groups, "f")
    names = stash(least.join(least.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("f", "root", "component_id"), "names")
    return prints.join(names, "f").select("doc_id", "f", "root", "component_id")


# Near copies by similarity: wide fingerprints


@dataclass(frozen=True)
class Likeness:
    """shingle: words of a shingle. similarity: least Jaccard similarity of the sets of shingles
    of two linked texts. recall: share of the pairs just at that similarity that the search
    should meet. spare: bits of a trie's depth beyond the logarithm of the number of texts."""

    shingle: int = 5
    similarity: float = 0.8
    recall: float = 0.95
    spare: int = 2

    @property
    def apart(self) -> float:
        """Share of fingerprint bits that differ at the least similarity: the angle between the
        counts of shingles of two texts of one length, over a half turn."""
        return math.acos(2 * self.similarity / (1 + self.similarity)) / math.pi

    def tries(self, texts: int) -> tuple[int, int]:
        """(depth, how many): deep enough that few unrelated texts meet; so many that all miss a
        pair, each with more than one differing bit, with odds of 1 - recall at most."""
        depth = min(48, max(8, math.ceil(math.log2(max(texts, 2))) + self.spare))
        q = (1 - self.apart) ** depth + depth * self.apart * (1 - self.apart) ** (depth - 1)
        return depth, math.ceil(math.log(1 - self.recall) / math.log(1 - q))

    def budget(self, bits: int) -> int:
        """Differing bits beyond which a pair is dropped: three deviations above the mean."""
        return math.floor(bits * self.apart + 3 * math.sqrt(bits * self.apart * (1 - self.apart)))


def _shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    grams = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False))
    return np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams], dtype="<u8")


def wide_prints(docs: DataFrame, key: str, shingle: int, depth: int, count: int) -> DataFrame:
    """``key`` and f: ``count`` words of ``depth`` bits, each a fingerprint of its own hashes, as
    many in a long as fit 60 bits."""
    per = max(1, 60 // depth)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        forget()  # what an earlier packing left in this worker
        out = []
        for text in texts(batch):
            h, words = _shingle_hashes(text, shingle), []
            for k in range(count):
                x = h + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
                x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                x ^= x >> np.uint64(31)
                size, ones = -(-depth // 8), np.zeros(8 * -(-depth // 8), dtype=np.int64)
                for at in range(0, len(x), 1 << 16):
                    ones += np.unpackbits(x[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)[:, :size], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                words.append(int.from_bytes(np.packbits(2 * ones[:depth] > len(x), bitorder="little").tobytes(), "little"))
            out.append([sum(v << depth * i for i, v in enumerate(words[k : k + per])) for k in range(0, count, per)])
        yield {key: batch.column(key), "f": out}

    kind = dict(docs.dtypes)[key]
    return arrow_map(docs.select(key, "text"), run, f"`{key}` {kind}, f array<bigint>")


def _apart(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets of shingles are as similar as that."""
    left, right = sets.select(F.col("t").alias("a"), F.col("s").alias("sa")), sets.select(F.col("t").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(left, "a").join(right, "b").where(both >= similarity * (F.size("sa") + F.size("sb") - both)).select("a", "b")


#: Text hashes that are sent to every task, at most; more go through a join.
SENT_HASHES = 1_000_000


def _sets(docs: DataFrame, need: DataFrame, how: Likeness) -> DataFrame:
    """(t, s): the shingles of the texts ``need`` (t). Texts don't move where few are needed."""
    need = stash(need.distinct(), "need")
    need = F.broadcast(need) if need.count() <= SENT_HASHES else need

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        yield {"t": batch.column("t"), "s": [np.unique(_shingle_hashes(x, how.shingle)).view(np.int64) for x in texts(batch)]}

    return stash(arrow_map(docs.join(need, "t", "left_semi"), run, "t bigint, s array<bigint>").dropDuplicates(["t"]), "sets")


def _verified(pairs: DataFrame, docs: DataFrame, how: Likeness) -> DataFrame:
    """``docs``: t (the text's hash) and text."""
    pairs = stash(pairs.select("a", "b"), "candidates")
    sets = _sets(docs, pairs.select(F.col("a").alias("t")).union(pairs.select("b")), how)
    return _alike(pairs, sets, how.similarity)


#: Candidates of a text beyond which it is judged in blocks, with all texts that it meets.
CROWDED = 64
#: Texts and shingles of a block at most; one text with more is a block of its own.
BLOCK_TEXTS, BLOCK_SHINGLES = 512, 1 << 18
#: Texts of one component in a crowd from which they get blocks of their own.
BLOCK_OWN = 256


def _crowds(leaves: DataFrame, close: DataFrame, slim: int) -> DataFrame | None:
    """(t, crowd): texts of ``leaves`` (k, t, g) near to the middle m, gm of a node, where a text of
    one of them meets more than ``CROWDED`` in the node pairs ``close`` (x, mx, gx, nx; y, my, gy, ny),
    each with the least text of what those pairs connect; None where there is no such text."""
    load = close.select(F.col("x").alias("k"), F.col("ny").alias("n")).union(close.where("x != y").select("y", "nx")).groupBy("k").agg(F.sum("n").alias("n"))
    laden = stash(large(leaves.select("k", "t")).join(large(load), "k"), "laden")
    hot = stash(laden.groupBy("t").agg(F.sum("n").alias("n")).where(F.col("n") > CROWDED).select("t"), "hot")
    if hot.isEmpty():
        return None
    flagged = stash(laden.join(hot, "t", "left_semi").select("k").distinct(), "flagged")
    ends = [close.join(flagged.select(F.col("k").alias(n)), n, "left_semi").select(*close.columns) for n in ("x", "y")]
    touched = stash(ends[0].union(ends[1]).distinct(), "touched")
    inner = touched.select(F.col("x").alias("k"), F.col("mx").alias("m"), F.col("gx").alias("gm")).union(touched.select("y", "my", "gy")).distinct()
    members = leaves.join(inner, "k").where(F.bit_count(F.col("g").bitwiseXOR(F.col("gm"))) <= slim)
    members = stash(members.select(F.col("t").alias("a"), F.col("m").alias("b")).distinct(), "members")
    found = connected_components(members.unionByName(touched.select(F.col("mx").alias("a"), F.col("my").alias("b"))).distinct())
    return stash(found.select(F.col("v").alias("t"), F.col("root").alias("crowd")), "crowds")


def _crowd_links(crowded: DataFrame, docs: DataFrame, how: Likeness) -> DataFrame:
    """(a, b): components c of ``crowded`` (t, c, crowd) to be joined, as stars: all with texts of
    one crowd that are alike.

    A crowd's texts are laid out in blocks by size; block pairs whose sizes, or components, leave
    nothing to find are skipped, each other one is judged by one task on its sets of shingles. So
    no row is made for a pair, and a task holds two blocks."""
    sets = _sets(docs, crowded.select("t"), how)
    rows = stash(crowded.join(sets.select("t", F.size("s").alias("n")), "t"), "crowd")
    own = rows.groupBy("crowd", "c").count().where(F.col("count") >= BLOCK_OWN).select("crowd", "c", F.col("c").alias("own"))
    rows = rows.join(own, ["crowd", "c"], "left").withColumn("_order", F.struct("crowd", "own", "n", "t"))
    level = F.floor(F.log2("n"))
    many = F.greatest(F.lit(1), F.least(F.lit(BLOCK_TEXTS), F.floor(F.lit(BLOCK_SHINGLES) / F.pow(F.lit(2), level + 1))))
    block = level * F.lit(1 << 40) + F.floor((F.col("no") - 1) / many)
    placed = stash(numbered(rows, "_order", "no").select("t", "c", "crowd", "n", block.cast("long").alias("block")), "placed")
    spans = placed.groupBy("crowd", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    side = lambda n: spans.select("crowd", *[F.col(c).alias(f"{n}{c}") for c in ("block", "lo", "hi", "c0", "c1")])
    pairs = side("a").join(side("b"), "crowd").where(
        (F.col("ablock") <= F.col("bblock")) & (F.col("ahi") >= how.similarity * F.col("blo")) & (F.col("bhi") >= how.similarity * F.col("alo"))
        & ((F.least("ac0", "bc0") != F.greatest("ac1", "bc1")))
    )
    pairs = stash(pairs.select("ablock", "bblock").distinct(), "blocks")
    held = placed.select("t", "c", "block").join(sets, "t").select("block", "c", "s")
    part = lambda n, right: pairs.where("ablock != bblock" if right else "true").join(held, F.col(n) == F.col("block")).select("ablock", "bblock", F.lit(right).alias("right"), "c", "s")
    similarity = how.similarity

    def judge(table: pa.Table) -> pa.Table:
        links = _alike_in(table["s"], table["c"].to_numpy(), table["right"].to_numpy(), similarity)
        return pa.table({"a": links[0], "b": links[1]})

    return stash(part("ablock", False).unionByName(part("bblock", True)).groupBy("ablock", "bblock").applyInArrow(judge, "a long, b long").distinct(), "crowd_links")


def _alike_in(sets: pa.ChunkedArray, c: np.ndarray, right: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Components of texts as stars, linked where a left and a right set (two left ones, if there
    are no right ones) are as similar as that. Overlaps are products of 0/1 matrices."""
    sets = sets.combine_chunks()
    n, flat = sets.value_lengths().to_numpy().astype(np.int64), sets.flatten().to_numpy()
    _, col, df = np.unique(flat, return_inverse=True, return_counts=True)
    owner, shared = np.repeat(np.arange(len(n)), n), df[col] > 1
    owner, col = owner[shared], (np.cumsum(df > 1) - 1)[col[shared]]
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    left, right = np.flatnonzero(~right), np.flatnonzero(right if right.any() else ~right)
    both = np.zeros((len(left), len(right)))
    width = 4096
    for at in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        lo, hi = np.searchsorted(col, [at, at + width])
        held = np.zeros((len(n), width), dtype=np.float32)
        held[owner[lo:hi], col[lo:hi] - at] = 1
        both += held[left] @ held[right].T
    near = (both >= similarity * (n[left][:, None] + n[right][None] - both)) & (c[left][:, None] != c[right][None])
    i, j = np.nonzero(near)
    if not len(i):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    names, roots = _contracted(np.stack([c[left[i]], c[right[j]]], axis=1))
    return names[names != roots], roots[names != roots]


def near_copies(docs: DataFrame, how: Likeness = Likeness()) -> DataFrame:
    """(t, root): every text hash of ``docs`` (t, text) with the least of its group of near copies.

    Tries of wide fingerprints, one for each word of them, are joined with themselves: node
    pairs are followed to ``depth`` with at most one differing bit, and what meets there is
    pruned by the differing bits of the first long, then of all. Candidates are then held to the
    exact similarity of their shingles. Texts that share a leaf are first linked to the nearest
    of the leaves' least texts, so a dense group is one component before pairs are looked for;
    those only matter between components. A text is first held to its nearest in each, then to all
    that it met in components that are still apart, so no candidate is left unjudged.

    Where texts meet more than ``CROWDED`` others that seem near by the least texts of their nodes, they and
    those are a crowd. Pairs inside a crowd are judged in blocks, whatever their bits, and make no
    rows; all others, also those of two crowds, are paired row by row."""
    depth, count = how.tries(docs.select("t").distinct().count())
    per = max(1, 60 // depth)
    slim, limit = how.budget(depth * min(per, count)), how.budget(depth * count)
    prints = stash(wide_prints(docs, "t", how.shingle, depth, count).dropDuplicates(["t"]), "prints")
    word = lambda w: F.shiftrightunsigned(F.col("f")[w // per], depth * (w % per)).bitwiseAND(F.lit((1 << depth) - 1))
    # a leaf: which word, and its bits
    leaf = lambda df: df.select(*[c for c in df.columns if c != "f"], F.col("f")[0].alias("g"), F.explode(F.array(*[word(w).bitwiseOR(F.lit(w << 48)) for w in range(count)])).alias("k"))
    bits = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y)))

    def whole(pairs: DataFrame) -> DataFrame:
        """(a, b, d, ...) of the pairs within the limit by all words."""
        left, right = prints.select(F.col("t").alias("a"), F.col("f").alias("fa")), prints.select(F.col("t").alias("b"), F.col("f").alias("fb"))
        return pairs.join(left, "a").join(right, "b").withColumn("d", _apart(F.col("fa"), F.col("fb"))).where(F.col("d") <= limit).drop("fa", "fb")

    leaves = leaf(prints)
    star = leaves.groupBy("k").agg(F.min(F.struct("t", "g")).alias("m")).select("k", F.col("m.t").alias("m"), F.col("m.g").alias("gm"))
    tied = leaves.join(star, "k").where((F.col("t") != F.col("m")) & (bits("g", "gm") <= slim)).select(F.col("t").alias("a"), F.col("m").alias("b")).distinct()
    nearest = whole(tied).groupBy("a").agg(F.min(F.struct("d", "b")).alias("b")).select("a", F.col("b.b").alias("b"))
    first = connected_components(_verified(nearest, docs, how))
    known = stash(prints.join(first, prints.t == first.v, "left").select("t", "f", F.coalesce("root", "t").alias("c")), "known")
    # nodes at the full depth; c: the component of all their leaves, if it is one
    one = F.when(F.min("c") == F.max("c"), F.min("c"))
    apart = lambda df: df.where("cx IS NULL OR cy IS NULL OR cx != cy")
    middle = F.min(F.struct("t", "g"))
    nodes = leaf(known).groupBy("k").agg(one.alias("c"), F.count("*").alias("n"), middle.alias("m"))
    nodes = stash(nodes.select("k", "c", "n", F.col("m.t").alias("m"), F.col("m.g").alias("g")), "nodes")
    end = lambda n: nodes.select(F.col("k").alias(n), *[F.col(c).alias(f"{c}{n}") for c in ("c", "n", "m", "g")])
    probes = end("x").withColumn("y", F.explode(_flips(F.col("x"), range(depth), F.lit(True))))
    met = stash(apart(probes.join(end("y"), "y")).select("x", "y", (bits("gx", "gy") <= slim).alias("near")), "nodes_met")
    close = stash(met.where("near").select("x", "y").join(end("x"), "x").join(end("y"), "y"), "close")
    crowds = _crowds(leaf(known).select("k", "t", "g"), close, slim)
    if crowds is None:
        none = F.lit(None).cast("long")
        known, met = known.withColumn("p", none), met.select("x", "y", none.alias("px"), none.alias("py"))
    else:
        links = _crowd_links(known.select("t", "c").join(crowds, "t"), docs, how)
        known = known.select("t", "f").join(_merged(known.select("t", "c"), links), "t").join(crowds, "t", "left")
        known = stash(known.withColumnRenamed("crowd", "p"), "known")
        # texts of a node by their crowd: only those of different ones, or of none, are left to be paired
        parts = stash(leaf(known).groupBy("k", "p").agg(one.alias("c")), "parts")
        end = lambda n: parts.select(F.col("k").alias(n), F.col("p").alias(f"p{n}"), F.col("c").alias(f"c{n}"))
        met = apart(large(met.select("x", "y")).join(large(end("x")), "x").join(large(end("y")), "y").where("px IS NULL OR py IS NULL OR px != py")).select("x", "y", "px", "py")
    side = lambda n: leaf(known).select(F.col("k").alias(f"k{n}"), F.col("p").alias(f"q{n}"), F.col("t").alias(f"t{n}"), F.col("g").alias(f"g{n}"), F.col("c").alias(f"c{n}"))
    at = lambda n: (F.col(n) == F.col(f"k{n}")) & F.col(f"p{n}").eqNullSafe(F.col(f"q{n}"))
    pairs = met.join(side("x"), at("x")).join(side("y"), at("y")).where((F.col("cx") != F.col("cy")) & (bits("gx", "gy") <= slim))
    pairs = stash(whole(pairs.select(F.col("tx").alias("a"), F.col("ty").alias("b"), F.col("cx").alias("ca"), F.col("cy").alias("cb")).distinct()), "met")
    turned = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("cb").alias("ca"), F.col("ca").alias("cb"), "d")
    best = pairs.unionByName(turned).groupBy("a", "ca", "cb").agg(F.min(F.struct("d", "b")).alias("b")).select("a", F.col("b.b").alias("b"))
    tried = stash(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "tried")
    nearer = _merged(known.select("t", "c"), _verified(tried, docs, how))
    # all other candidates whose components are still apart
    ends = lambda n: nearer.select(F.col("t").alias(n), F.col("c").alias(f"c{n}"))
    rest = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    rest = stash(rest.join(ends("a"), "a").join(ends("b"), "b").where("ca != cb").select("a", "b"), "rest")
    if rest.isEmpty():
        return nearer.select("t", F.col("c").alias("root"))
    return _merged(nearer, _verified(rest, docs, how)).select("t", F.col("c").alias("root"))


def _merged(names: DataFrame, links: DataFrame) -> DataFrame:
    """(t, c): texts with their components after the links (a, b) of texts."""
    ends = lambda n: names.select(F.col("t").alias(n), F.col("c").alias(f"c{n}"))
    joined = connected_components(links.join(ends("a"), "a").join(ends("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    return stash(names.join(joined, names.c == joined.v, "left").select("t", F.coalesce("root", "c").alias("c")), "merged")


def one_of_each_group(docs: DataFrame, how: Likeness = Likeness()) -> DataFrame:
    """``docs`` with one row of each group of near copies: the one with the least doc_id (nulls
    last), then the least text hash. Null text counts as empty; texts without words are one
    group; an empty table stays empty; columns of any names are kept as they are."""
    key = unused(docs, "text_hash")
    mine = docs.withColumn(key, F.xxhash64(blank(F.col("text"))))
    slim = mine.select(F.col(key).alias("t"), "text")
    wordy = F.lower(blank(F.col("text"))).rlike(r"[^\x20\x09-\x0D]")
    groups = near_copies(slim.where(wordy), how)
    ids = mine.select("doc_id", F.col(key).alias("t"), wordy.alias("wordy"))
    named = ids.join(groups, "t", "left").select("doc_id", "t", F.when(F.col("wordy"), F.col("root")).alias("root"), "wordy")
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "t")
    chosen = named.groupBy("root", "wordy").agg(F.min(order).alias("first")).select(F.col("first.doc_id").alias("_id"), F.col("first.t").alias("_t"))
    chosen = stash(chosen.distinct(), "chosen")
    kept = mine.join(chosen, (mine[key] == chosen["_t"]) & mine["doc_id"].eqNullSafe(chosen["_id"]), "left_semi")
    return kept.dropDuplicates(["doc_id", key]).drop(key)


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")
