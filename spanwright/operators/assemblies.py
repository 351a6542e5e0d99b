"""Assemblies of the model: hardware records grouped by place, one for each body.

Hardware has seq, id, family, x, y and may have z, level, box. Products are named by families;
the schedule's specifications give the marks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructType
from pyspark.sql.window import Window

from spanwright.functions.marks import variant_key
from spanwright.operators import tiles
from spanwright.operators.cluster import founders, leader_clusters, numbered
from spanwright.operators.spatial import attach_nearest
from spanwright.sources.scratch import large, stash

# Families that are bolts, the word of companion variants, and the categories
# that may hold the hardware.
BOLT_FAMILY = r"(?i)ANCHOR[_\s-]*BOLT|J[\s-]*BOLT|ANCHOR[_\s-]*ROD"
COMPANION = "offset"
HARDWARE_CATEGORIES = ("Structural Connections", "Structural Foundation", "Generic Models", "Structural Framing")


def hardware_records(elements: DataFrame, categories: tuple[str, ...] = HARDWARE_CATEGORIES) -> DataFrame:
    """Elements of the categories whose family names a product, with its ``key``. Patterns are tried
    once a row: the key comes out of a generator, so no later filter repeats them."""
    return elements.where(F.col("category").isin(*categories)).withColumn("key", F.explode(F.array(variant_key(F.col("family"))))).where("key IS NOT NULL")


def is_body(family: Column) -> Column:
    return ~F.coalesce(family, F.lit("")).rlike(BOLT_FAMILY) & ~F.lower(F.coalesce(family, F.lit(""))).contains(COMPANION)


def seated(records: DataFrame, tolerance: float) -> DataFrame:
    """Adds ``founder`` (of the first-fit cluster by place), ``body`` and ``seat``, the record that
    stands for the assembly: in a cluster of several bodies each body is a seat and the others
    sit with the nearest (the first of equally near); else the only body, or the founder.

    Clusters inside a stretch of the plane are settled there, in one shuffle; the few that reach a
    bound go to one task; where they are many, or levels too crowded to hold, they go by joins."""
    records = records.withColumn("seq", F.col("seq").cast("long")).withColumn("body", is_body(F.col("family")))
    size = tiles.width(tolerance)
    at = {c: F.col(c).cast("double") for c in ("x", "y")}
    ready = tiles.dealt(records, tiles.key(tiles.cell(at["x"], size), tiles.cell(at["y"], size)))
    made = stash(tiles.over_tiles(ready, _seats(tolerance), _seat_schema(records)), "seats")
    columns, left = [*records.columns, "founder", "seat", "split"], made.where("open").select(*records.columns)
    rest = stash(_seated_by_joins(left, tolerance).select(*columns), "rest")
    return made.where("NOT open").select(*columns).unionByName(rest)


def _seat_schema(records: DataFrame) -> StructType:
    return StructType(list(records.schema.fields)).add("founder", LongType()).add("seat", LongType()).add("split", BooleanType()).add("open", BooleanType())


def _seats(tolerance: float) -> tiles.Kernel:
    """A stretch's records with founder, seat and split; those of open clusters come out without."""

    def kernel(t: pa.Table, low: int, high: int) -> pa.Table:
        n, seq, body = t.num_rows, t["seq"].to_numpy(), t["body"].to_numpy()
        x, y = tiles.numbers(t["x"]), tiles.numbers(t["y"])
        placed, zero = np.isfinite(x) & np.isfinite(y), np.zeros(n, dtype=np.int64)
        founder, undone = founders(zero, placed, seq, zero.tolist(), x, y, low, high, tolerance, False)
        bodies = np.bincount(founder[body], minlength=n)
        # bodies by cluster, then seq: a cluster's first stands for it if it is the only one
        heads = np.flatnonzero(body)
        heads = heads[np.lexsort((seq[heads], founder[heads]))]
        start = np.searchsorted(founder[heads], np.arange(n))
        seat = founder.copy()
        one = bodies[founder] == 1
        seat[one] = heads[start[founder[one]]]
        split = bodies[founder] > 1
        seat[split & body] = np.flatnonzero(split & body)
        loose = np.flatnonzero(split & ~body)
        # each loose member and each body of its cluster, some millions at a time
        many = np.cumsum(bodies[founder[loose]])
        lo = 0
        while lo < len(loose):
            hi = max(lo + 1, int(np.searchsorted(many, (many[lo - 1] if lo else 0) + tiles.TILE_PAIRS, "right")))
            part = loose[lo:hi]
            count = bodies[founder[part]]
            first = np.cumsum(count) - count
            mine = np.repeat(np.arange(len(part)), count)
            head = heads[start[founder[part]][mine] + np.arange(len(mine)) - first[mine]]
            far = np.square(x[head] - x[part][mine]) + np.square(y[head] - y[part][mine])
            # the first of the nearest, as heads are in order of seq
            least = np.minimum.reduceat(far, first)
            hit = np.flatnonzero(far == least[mine])
            seat[part] = head[hit[np.searchsorted(mine[hit], np.arange(len(part)))]]
            lo = hi
        out = {c: t[c] for c in t.column_names if c != "_key"}
        return pa.table(out | {"founder": pa.array(seq[founder]), "seat": pa.array(seq[seat]), "split": pa.array(split), "open": pa.array(undone)})

    return kernel


def _seated_by_joins(records: DataFrame, tolerance: float) -> DataFrame:
    """The same from records with ``body``. Members and bodies of a cluster meet by distinct places, so
    copies at one place cost one row on either side. Few records go to one task instead."""
    one = tiles.in_one(records, _seats(tolerance), _seat_schema(records))
    if one is not None:
        return one.drop("open")
    found = leader_clusters(records.withColumn("mark", F.lit("")).withColumn("sheet", F.lit("")), tolerance, one_per_sheet=False).drop("mark", "sheet")
    found = stash(found, "clusters")
    bodies = found.where("body")
    count = bodies.groupBy("founder").agg(F.count("*").alias("bodies"), F.min("seq").alias("first_body"))
    counted = large(found).join(large(count), "founder", "left")
    loose = counted.where("NOT body AND bodies > 1").select("founder", "x", "y").distinct()
    places = bodies.groupBy("founder", F.col("x").alias("bx"), F.col("y").alias("by")).agg(F.min("seq").alias("b"))
    far = F.pow(F.col("bx") - F.col("x"), 2) + F.pow(F.col("by") - F.col("y"), 2)
    nearest = large(loose).join(large(places), "founder").groupBy("founder", "x", "y").agg(F.min(F.struct(far.alias("far"), "b")).alias("n")).select("founder", "x", "y", F.col("n.b").alias("nearest"))
    seat = F.when(F.coalesce("bodies", F.lit(0)) <= 1, F.coalesce("first_body", "founder")).when(F.col("body"), F.col("seq")).otherwise(F.col("nearest"))
    return large(counted).join(large(nearest), ["founder", "x", "y"], "left").withColumn("seat", seat).withColumn("split", F.coalesce(F.col("bodies") > 1, F.lit(False))).drop("nearest", "first_body", "bodies")


def marked_seats(records: DataFrame, specs: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """(seq, mark, level): the assemblies of ``built`` by the record that each is named for, without
    numbers and members."""
    rows = seated(_filled(records).select("seq", "family", "x", "y", "level"), tolerance).where("seq = seat")
    specs = specs.groupBy("key").agg(F.min("mark").alias("mark"))
    return rows.select("seq", "level", variant_key(F.col("family")).alias("key")).join(F.broadcast(specs), "key", "left").select("seq", "mark", "level")


def built(records: DataFrame, specs: DataFrame, tolerance: float = 2.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(assemblies, members, evidence).

    assemblies: seq, id, mark, core_token, family, primary_id, x, y, z, level, n_members,
    confidence, reason, in order of their clusters, then of their bodies. members: assembly,
    place (from 1; a split-off body comes first), element, role. evidence: assembly, family, n.
    ``specs``: key, mark, of the schedules."""
    rows = seated(_filled(records), tolerance)
    seats = rows.where("seq = seat").withColumn("_order", F.struct("founder", "seat"))
    named = numbered(seats, "_order", "no").drop("_order").withColumn("assembly", F.format_string("rev_asm_%03d", "no"))
    specs = specs.groupBy("key").agg(F.min("mark").alias("mark"))
    named = stash(named.withColumn("key", variant_key(F.col("family"))).join(specs, "key", "left"), "named")
    inside = large(rows).join(large(named.select("seat", "assembly")), "seat")
    order = F.struct((F.col("split") & (F.col("seq") != F.col("seat"))).alias("later"), "seq")
    members = inside.withColumn("place", F.row_number().over(Window.partitionBy("assembly").orderBy(order)))
    members = members.select("assembly", "place", F.col("id").alias("element"), F.when(F.col("body"), "body").otherwise("evidence_member").alias("role"), "family")
    members = stash(members, "members")
    evidence = members.groupBy("assembly", "family").agg(F.count("*").alias("n"))
    size = members.groupBy("assembly").agg(F.count("*").alias("n_members"))
    known = F.col("mark").isNotNull()
    product = F.coalesce("key", F.lit("unknown"))
    reason = F.when(known, F.concat(F.lit("Family "), "family", F.lit(" is product "), product, F.lit(", which the schedule lists as "), "mark", F.lit("."))).otherwise(
        F.concat(F.lit("Family "), "family", F.lit(" is product "), product, F.lit(", which no schedule row specifies; no mark is given."))
    )
    assemblies = large(named).join(large(size), "assembly").select(
        F.col("no").alias("seq"), F.col("assembly").alias("id"), "mark", F.coalesce("key", F.lit("")).alias("core_token"), "family", F.col("id").alias("primary_id"), "x", "y", "z", "level", "n_members",
        F.when(known, 0.9).otherwise(0.5).alias("confidence"), reason.alias("reason"),
    )
    return assemblies, members.drop("family"), evidence


def converted(records: DataFrame, attach_ft: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(assemblies, members, unresolved) of records (seq, id, kind, token, mark, x, y, family) that
    are classified already: each body is an assembly, a member belongs to the nearest body of
    its token (blank tokens fit all). Unresolved are members without a body and bodies without
    a token, each with its reason."""
    bodies = records.where("kind = 'body'")
    members = records.where("kind = 'evidence_member'")
    named = stash(numbered(bodies, "seq", "no").withColumn("assembly", F.format_string("rev_asm_%03d", "no")), "named")
    sited = members.join(attach_nearest(members.select("id", "seq", "x", "y", "token"), bodies.select("id", "seq", "x", "y", "token"), attach_ft).select("id", "body", "dist"), "id")
    sited = stash(sited, "sited")
    mine = named.select(F.col("id").alias("body"), "assembly")
    inside = sited.join(mine, "body").select("assembly", F.col("id").alias("element"), "family", F.lit("evidence_member").alias("role"), F.bround("dist", 4).alias("attach_ft"))
    heads = named.select("assembly", F.col("id").alias("element"), "family", F.lit("body").alias("role"), F.lit(None).cast("double").alias("attach_ft"))
    known = F.coalesce("token", F.lit("")) != ""
    assemblies = named.select("no", "assembly", "mark", "token", "family", F.col("id").alias("primary_id"), "x", "y", F.when(known, 0.9).otherwise(0.4).alias("confidence"))
    orphans = sited.where("body IS NULL").select("id", "family", "token", F.lit("no body near enough, or of another token").alias("reason"))
    nameless = bodies.where(~known).select("id", "family", "token", F.lit("family without a known token").alias("reason"))
    return assemblies, heads.unionByName(inside), orphans.unionByName(nameless)


def families(records: DataFrame) -> DataFrame:
    """(family, kind, token, n, levels) of each family: what it is taken for and where it stands."""
    return records.groupBy("family").agg(F.min("kind").alias("kind"), F.min(F.nullif("token", F.lit(""))).alias("token"), F.count("*").alias("n"), F.count_distinct("level").alias("levels"))


def _filled(records: DataFrame) -> DataFrame:
    for name, kind in (("z", "double"), ("level", "string")):
        records = records if name in records.columns else records.withColumn(name, F.lit(None).cast(kind))
    return records
