"""Connected components of an edge table: stars of each task, then alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.sources.scratch import discard, large, stash


#: Edges (16 bytes each) that one task takes at the end; more are contracted in rounds.
LAST_EDGES = 500_000
#: Edges that a task holds before it contracts them with what it has.
CHUNK_EDGES = 2_000_000
#: Links between tasks whose roots are sent to every task, at most; more go through a join.
SENT_LINKS = 100_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", last: int = LAST_EDGES) -> DataFrame:
    """(v, root): every vertex that has an edge to another, with the least vertex it reaches.

    Edges are dealt by ranges of their lesser vertex, and each task contracts its own to stars.
    Numbers that are near mostly belong together here (the rows of a place follow each other), so
    few vertices are left in stars of several tasks; only those stars' roots are linked and
    contracted in rounds. Null vertices and loops are dropped.
    """
    both = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a != b")
    e = both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    e = stash(e, "edges")
    if e.limit(last + 1).count() <= last:
        return _at_once(e)
    stars = stash(e.repartitionByRange("b").mapInPandas(_stars, "v long, root long"), "stars")
    discard(e)
    owners = stash(stars.groupBy("v").agg(F.min("root").alias("root"), F.max("root").alias("_last")), "owners")
    shared = stash(owners.where("root <> _last").select(F.col("v").alias("_v"), F.col("root").alias("b")), "shared")
    n = shared.count()
    if n == 0:
        return owners.select("v", "root")
    shared = F.broadcast(shared) if n <= SENT_LINKS else shared
    links = stash(stars.join(shared, stars.v == F.col("_v")).where("root <> b").select(F.col("root").alias("a"), "b").distinct(), "links")
    discard(stars)
    n = links.count()
    joined = (_at_once(links) if n <= last else _in_rounds(links, last)).select(F.col("v").alias("_v"), F.col("root").alias("_root"))
    joined = F.broadcast(joined) if n <= SENT_LINKS else joined
    return owners.join(joined, owners.root == joined["_v"], "left").select("v", F.coalesce("_root", "root").alias("root"))


def _in_rounds(e: DataFrame, last: int) -> DataFrame:
    """Each round hangs neighbours onto the least neighbour (large star), then joins the smaller
    side of each vertex (small star); both only aggregate minima, so a vertex with very many
    edges is summed on the map side. Rounds grow with the logarithm of a component's size."""
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        hung = large(both).join(large(least), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = hung.groupBy("a").agg(F.min("b").alias("m"))
        small = large(hung).join(large(low), "a")
        small = small.select("a", F.col("m").alias("b")).unionByName(small.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        before, e = e, stash(small.distinct(), "edges")
        discard(before)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        if now[0] <= last:
            return _at_once(e)
        mark = now
    roots = e.select("b").distinct().select(F.col("b").alias("v"), F.col("b").alias("root"))
    return e.select(F.col("a").alias("v"), F.col("b").alias("root")).unionByName(roots)


def _contracted(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of edges and their roots: roots take the least of their neighbours' roots and
    then their own root's root, until nothing changes."""
    names, ends = np.unique(pairs, return_inverse=True)
    left, right = ends.reshape(-1, 2).T
    root = np.arange(len(names))
    while True:
        before = root.copy()
        low = np.minimum(root[left], root[right])
        np.minimum.at(root, root[left], low)  # the roots themselves move, so whole trees do
        np.minimum.at(root, root[right], low)
        root = root[root]
        if (root == before).all():
            break
    return names, names[root]


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A task's edges as stars: each vertex with the least that it reaches by them, itself included."""
    held, fresh = np.empty((0, 2), dtype=np.int64), []

    def taken() -> np.ndarray:
        return np.stack(_contracted(np.concatenate([held, *fresh])), axis=1)

    for batch in batches:
        fresh.append(batch[["a", "b"]].to_numpy(dtype=np.int64))
        if sum(map(len, fresh)) > max(CHUNK_EDGES, len(held)):
            held, fresh = taken(), []
    if fresh:
        held = taken()
    for at in range(0, len(held), 1 << 18):
        yield pd.DataFrame(held[at : at + (1 << 18)], columns=["v", "root"])


def _at_once(edges: DataFrame) -> DataFrame:
    """The same for few edges, in one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = [b[["a", "b"]].to_numpy(dtype=np.int64) for b in batches]
        names, roots = _contracted(np.concatenate(found) if found else np.empty((0, 2), dtype=np.int64))
        yield pd.DataFrame({"v": names, "root": roots})

    return edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).coalesce(1).mapInPandas(run, "v long, root long")
