"""Summaries of a run, and rows put in place of others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwright.functions.verdicts import product_block
from spanwright.operators.spatial import within


def device_summary(devices: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for each category: rows on sheets, devices, targets, devices by status, targets
    that no device has."""
    count = devices.groupBy("category", "status").agg(F.count("*").alias("n"), F.sum(F.size("appearances")).alias("rows"))
    mine = count.groupBy("category").agg(F.sum("rows").alias("callout_rows"), F.sum("n").alias("devices"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "n")))).alias("by_status"))
    taken = devices.where("target_id IS NOT NULL").select(F.col("target_id").alias("id"), F.lit(1).alias("taken")).distinct()
    theirs = targets.join(taken, "id", "left").groupBy("category").agg(F.count("*").alias("targets"), F.count_if(F.col("taken").isNull()).alias("revit_only"))
    return mine.join(theirs, "category", "full_outer")


def replaced(rows: DataFrame, gone: tuple[str, ...], fresh: DataFrame) -> DataFrame:
    """``rows`` without unmatched placeholders (ids that begin with one of ``gone``) of the
    categories of ``fresh``, and with the rows of ``fresh``."""
    categories = fresh.select(F.col("category").alias("_c")).distinct()
    prefixed = F.lit(False)
    for p in gone:
        prefixed |= F.col("id").startswith(p)
    stale = (F.col("status") == "REVIT_ONLY") & prefixed
    kept = rows.join(categories, (rows["category"] == F.col("_c")) & stale, "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def counts_of(rows: DataFrame, column: str, domain: tuple[str, ...]) -> DataFrame:
    """(value, n) of each value of a domain, zeros included."""
    n = [F.struct(F.lit(v).alias("value"), F.count_if(F.col(column) == v).alias("n")) for v in domain]
    return rows.agg(F.array(*n).alias("r")).select(F.inline("r"))


def marks_of(*tables: DataFrame) -> DataFrame:
    """The marks of all tables, once each, in order."""
    out = tables[0].select("mark")
    for t in tables[1:]:
        out = out.union(t.select("mark"))
    return out.where("mark IS NOT NULL").distinct().orderBy("mark")


def key_points(records: DataFrame) -> DataFrame:
    """(token, bodies): bodies of each core token; the row of a null token counts all records:
    records, bodies, members and distinct families."""
    body = F.col("kind") == "body"
    total = records.agg(F.count("*").alias("records"), F.count_if(body).alias("bodies"), F.count_if(F.col("kind") == "evidence_member").alias("members"), F.count_distinct("family").alias("families")).withColumn("token", F.lit(None).cast("string"))
    each = records.where(body & (F.coalesce("token", F.lit("")) != "")).groupBy("token").agg(F.count("*").alias("bodies"))
    return total.unionByName(each, allowMissingColumns=True)


def count_deltas(found: DataFrame, baseline: DataFrame) -> DataFrame:
    """(mark, found, expected, delta, warning) of every mark of either side."""
    have = found.groupBy("mark").agg(F.count("*").alias("found"))
    both = have.join(baseline.select("mark", "expected"), "mark", "full_outer").na.fill({"found": 0})
    delta = F.col("found") - F.coalesce("expected", F.lit(0))
    warning = F.when(F.col("expected").isNull(), "not expected").when(delta != 0, "count differs")
    return both.select("mark", "found", "expected", delta.alias("delta"), warning.alias("warning"))


def systematic_sample(analysed: DataFrame, cap: int = 30) -> DataFrame:
    """(systematic, sampled) over the first rows by seq, as a phase summary tells it."""
    first = analysed.orderBy("seq").limit(cap)
    return first.agg(F.count_if("systematic").alias("systematic"), F.count("*").alias("sampled"))


def with_connection_status(connections: DataFrame, assemblies: DataFrame, devices: DataFrame, radius: float) -> DataFrame:
    """Live connections (id, box of six numbers) with the status of the nearest assembly (id, seq,
    x, y) that a device has, within the radius of the box's centre."""
    status = devices.where("target_id IS NOT NULL").groupBy("target_id").agg(F.min_by(F.coalesce("status", F.lit("NOT_EVALUATED")), "seq").alias("status"))
    known = assemblies.join(status, assemblies.id == F.col("target_id")).select("seq", "id", "x", "y", "status")
    middle = lambda i: (F.col("box")[i] + F.col("box")[i + 3]) / 2
    near = within(connections.withColumn("x", middle(0)).withColumn("y", middle(1)).select("id", "x", "y"), known, radius)
    best = near.groupBy("id").agg(F.min_by(F.struct("r_id", "r_status"), F.struct("dist", "r_seq")).alias("b"))
    return connections.join(best, "id", "left").select(*connections.columns, F.col("b.r_id").alias("assembly_id"), F.col("b.r_status").alias("status"))


def explained(elements: DataFrame, assemblies: DataFrame, devices: DataFrame, radius: float, match_ft: float) -> DataFrame:
    """(element, assembly_id, mark, status, text): each element (element, x, y) with the nearest
    assembly within the radius, else the one that lists it as a member, its device, and a plain
    sentence. Assemblies: seq, id, mark, x, y, members; devices: target_id, status, distance_ft."""
    sited = elements.where("x IS NOT NULL AND y IS NOT NULL")
    near = within(sited, assemblies.select("seq", "id", "x", "y"), radius).groupBy("element").agg(F.min_by("r_id", F.struct("dist", "r_seq")).alias("near"))
    listed = assemblies.select("seq", "id", F.explode("members").alias("element")).groupBy("element").agg(F.min_by("id", "seq").alias("listed"))
    found = elements.select("element").join(near, "element", "left").join(listed, "element", "left").withColumn("assembly_id", F.coalesce("near", "listed"))
    found = found.join(assemblies.select(F.col("id").alias("assembly_id"), "mark"), "assembly_id", "left")
    device = devices.groupBy("target_id").agg(F.min_by(F.struct("status", "distance_ft"), "seq").alias("v")).select(F.col("target_id").alias("assembly_id"), "v.*")
    out = found.join(device, "assembly_id", "left")
    head = F.concat(F.lit("Part of assembly "), "assembly_id", F.coalesce(F.concat(F.lit(" ("), "mark", F.lit(")")), F.lit("")), F.lit(". "))
    text = (
        F.when(F.col("assembly_id").isNull(), F.concat(F.lit("Element "), F.col("element").cast("string"), F.lit(" is in no assembly of the model.")))
        .when(F.col("status").isNull(), F.concat(head, F.lit("No drawn device is paired with it.")))
        .when((F.col("status") == "MATCH") & F.col("distance_ft").isNotNull(), F.concat(head, F.format_string(f"Drawn %.2f ft away, within {match_ft:g} ft: a match.", "distance_ft")))
        .otherwise(F.concat(head, F.lit("Its status is "), "status", F.lit(".")))
    )
    return out.select("element", "assembly_id", "mark", "status", text.alias("text"))


def reappearances(members: DataFrame) -> DataFrame:
    """Physical devices of callouts (founder, status): matched if any is, else a location
    mismatch if any is, else only drawn; and how many unmatched rows only show a matched one
    again. One row for each verdict."""
    each = members.groupBy("founder").agg(F.bool_or(F.col("status") == "MATCH").alias("hit"), F.bool_or(F.col("status") == "LOCATION_MISMATCH").alias("off"), F.count_if(F.col("status").isin("PDF_ONLY", "LOCATION_MISMATCH")).alias("again"))
    verdict = F.when(F.col("hit"), "MATCH").when(F.col("off"), "LOCATION_MISMATCH").otherwise("PDF_ONLY")
    return each.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("devices"), F.sum(F.when(F.col("hit"), F.col("again")).otherwise(0)).alias("reappearances"))


def with_products(rows: DataFrame) -> DataFrame:
    """Rows whose product block is missing get one; others, and a second call, change nothing."""
    made = product_block([c for c in rows.columns if c != "product"])
    return rows.withColumn("product", F.coalesce("product", made) if "product" in rows.columns else made)


def panel_rows(consistency: DataFrame, hidden: tuple[str, ...] = ("wall_type",)) -> DataFrame:
    """The count rows that a panel shows: other categories, and only where the sides differ."""
    differs = ~F.col("schedule_listed") | (F.col("plan_count") == 0)
    return consistency.where(~F.col("category").isin(*hidden)).withColumn("flagged", differs)


def checked_fields(edits: DataFrame, lengths: dict[str, int], choices: dict[str, tuple[str, ...]]) -> DataFrame:
    """Edits (field, value) with ``clean`` (trimmed, blank as null) and ``problem``: a field that
    may not be edited, a value that isn't one of its choices, or one that is too long."""
    name, value = F.col("field"), F.trim("value")
    allowed = [*lengths, *choices]
    longest = F.create_map(*[F.lit(x) for kv in lengths.items() for x in kv])[name]
    wrong: Column = F.lit(False)
    for field, known in choices.items():
        wrong |= (name == field) & ~value.isin(*known)
    problem = F.when(~name.isin(*allowed), "unknown field").when(wrong, "not a choice").when(F.length(value) > longest, "too long")
    return edits.withColumn("problem", problem).withColumn("clean", F.when(F.col("problem").isNull() & (value != ""), value))


def live_scene(payload: DataFrame) -> DataFrame:
    """Elements of a live payload (category, items of id and bbox_ft) that have a whole box, as
    scene rows with the box's middle."""
    each = payload.select("category", F.explode("items").alias("i")).select("category", "i.id", F.col("i.bbox_ft").alias("box"))
    middle = F.array(*[(F.col("box")[k] + F.col("box")[k + 3]) / 2 for k in range(3)])
    return each.where(F.size("box") == 6).withColumn("middle", middle)


def folder_sizes(files: DataFrame, root: str) -> DataFrame:
    """(folder, files, bytes) of the folders right under ``root``, from a table of files (path,
    length) as Spark's binaryFile source lists them."""
    top = f"{root.rstrip('/')}/"
    inside = F.split(F.substring_index("path", top, -1), "/")
    return files.where(F.col("path").contains(top)).groupBy(inside[0].alias("folder")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def artifact_states(known: DataFrame, files: DataFrame) -> DataFrame:
    """(name, present, bytes) of every artifact that a run should leave, by file name."""
    there = files.select(F.substring_index("path", "/", -1).alias("name"), "length").groupBy("name").agg(F.max("length").alias("bytes"))
    return known.select("name").join(there, "name", "left").withColumn("present", F.col("bytes").isNotNull()).select("name", "present", "bytes")
