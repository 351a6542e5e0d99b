"""Schedules on drawing pages, set-wise: lines, headers, column bands, rows and their cells.

Words (page, seq, x0, y0, x1, y1, text) are dealt by page once; lines, runs, bands and stops are
windows over a page's words or a table's lines, so no page is a frame of its own and nothing
leaves the JVM. What must be walked in order, lines whose heights drift, is walked inside an
island of heights that no gap parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanwright.functions.marks import MARK_PATTERNS, first_of
from spanwright.sources.scratch import large, stash

# Fixed values, in points: how far a word may stand from its line's mean height, gaps between
# runs and between columns, how far around and below a header its columns are looked for, the
# pad of the outer columns, the factor and least gap that end a table, and how many words of a
# row may hold its mark.
LINE_PT, RUN_PT, COLUMN_PT, AROUND_PT, BELOW_PT, PAD_PT = 3.0, 30.0, 14.0, 320.0, 60.0, 10.0
STOP_FACTOR, LEAST_GAP, MARK_WORDS = 2.5, 16.0, 8
# Headers of schedules by category, what a mark looks like anywhere, titles of
# columns, titles of the column of marks in the order they are looked for, and notes.
HEADERS = {
    "holdown": r"HOLD[- ]?(?:DOWN|OWN)\s+SCHEDULE",
    "shear_wall": r"SHEAR\s+WALL\s+SCHEDULE",
    "post": r"POST\s+SCHEDULE",
    "steel_column": r"(?:STEEL\s+)?COLUMN\s+SCHEDULE",
    "wall_type": r"WALL\s+SPEC(?:IFICATION)?",
}
ANY_HEADER = r"\bSCHEDULE\b"
GENERIC_MARK = r"^[A-Z]{1,4}-?\d{1,3}[A-Z]?$"
SUBHEADER = r"^(MARK|SYMBOL|TYPE|S\.?NO\.?|SR\.?NO\.?|SW\.?|#)$"
MARK_TITLES = (r"\bMARK\b", r"\bSYMBOL\b", r"^#$", r"\bID\b")
NOTES = r"^NOTES?\b"

#: Words of a line in order, and what comes before a row in it.
_ORDER = ("x0", "yc", "seq")


def _joined(text: str, *order: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text))), lambda s: s[text]), " ")


def lined(words: DataFrame) -> DataFrame:
    """Adds ``yc``, ``line`` (the height at which the word's line starts) and the line's ``ly0`` and
    ``ly1``. In order of height, a word joins the line before it if it is within LINE_PT of the
    mean of that line's words so far."""
    page = Window.partitionBy("page").orderBy("yc")
    rows = words.where("x0 IS NOT NULL AND y0 IS NOT NULL AND x1 IS NOT NULL AND y1 IS NOT NULL").withColumn("yc", (F.col("y0") + F.col("y1")) / 2)
    step = F.when(F.col("yc") - F.lag("yc").over(page) > LINE_PT, 1).otherwise(0)  # beyond any mean before it
    rows = rows.withColumn("_step", step).withColumn("_island", F.sum("_step").over(page.rowsBetween(Window.unboundedPreceding, 0)))
    island = Window.partitionBy("page", "_island")
    rows = rows.withColumn("_low", F.min("yc").over(island)).withColumn("_wide", F.max("yc").over(island) - F.col("_low") > LINE_PT)
    heights = F.array_sort(F.collect_list(F.when(F.col("_wide"), F.col("yc"))).over(island))
    start = F.expr("cast(array() AS array<struct<start:double,mean:double,n:int>>)")
    last = lambda done: F.try_element_at(done, F.lit(-1))

    def walk(done: Column, y: Column) -> Column:
        now = last(done)
        grown = F.struct(now["start"].alias("start"), (now["mean"] + (y - now["mean"]) / (now["n"] + 1)).alias("mean"), (now["n"] + 1).alias("n"))
        fresh = F.struct(y.alias("start"), y.alias("mean"), F.lit(1).alias("n"))
        return F.when(now.isNotNull() & (F.abs(y - now["mean"]) <= LINE_PT), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown))).otherwise(F.concat(done, F.array(fresh)))

    starts = F.transform(F.aggregate(heights, start, walk), lambda s: s["start"])
    mine = F.array_max(F.filter(starts, lambda s: s <= F.col("yc")))
    rows = rows.withColumn("line", F.when(F.col("_wide"), mine).otherwise(F.col("_low")))
    line = Window.partitionBy("page", "line")
    return rows.withColumn("ly0", F.min("y0").over(line)).withColumn("ly1", F.max("y1").over(line)).drop("_step", "_island", "_low", "_wide")


def _built_in(title: Column) -> Column:
    return F.coalesce(first_of(title, HEADERS), F.when(title.rlike(ANY_HEADER), "unknown"))


def headers(words: DataFrame, category: Callable[[Column], Column] = _built_in) -> DataFrame:
    """(page, table_no, category, header_text, hx0, hy0, hx1, hy1, stop) of lined words: runs of
    words in a line whose text names a schedule, numbered down the page. ``stop`` is the top of
    the next header below. ``category``: from the upper-case text of a run."""
    line = Window.partitionBy("page", "line").orderBy(*_ORDER)
    fresh = F.when(F.col("x0") - F.lag("x1").over(line) > RUN_PT, 1).otherwise(0)
    runs = words.withColumn("_fresh", fresh).withColumn("_run", F.sum("_fresh").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    each = runs.groupBy("page", "line", "_run").agg(_joined("text", *_ORDER).alias("header_text"), F.min("x0").alias("hx0"), F.min("y0").alias("hy0"), F.max("x1").alias("hx1"), F.max("y1").alias("hy1"))
    found = each.withColumn("category", category(F.upper("header_text"))).where("category IS NOT NULL")
    down = Window.partitionBy("page").orderBy("hy0", "line", "_run")
    later = Window.partitionBy("page")
    tops = F.array_sort(F.collect_list("hy0").over(later))
    stop = F.get(F.filter(tops, lambda y: y > F.col("hy1")), 0)
    return found.withColumn("table_no", F.row_number().over(down) - 1).withColumn("stop", stop).select("page", "table_no", "category", "header_text", "hx0", "hy0", "hx1", "hy1", "stop")


def _marks(category: str, token: Column, default: Column) -> Column:
    out = default
    for name, pattern in MARK_PATTERNS.items():
        out = F.when(F.col(category) == name, token.rlike(pattern)).otherwise(out)
    return out


def bands(words: DataFrame, found: DataFrame) -> DataFrame:
    """The words of each table's column titles, with ``sub_y1``, the lower end of the band: lines
    below the header, around it, up to the first that holds a mark, or the first beyond BELOW_PT.
    Tables without a known title have none."""
    near = large(words).join(large(found), "page").where((F.col("ly0") > F.col("hy1")) & ((F.col("x0") + F.col("x1")) / 2).between(F.col("hx0") - AROUND_PT, F.col("hx1") + AROUND_PT))
    hit = _marks("category", F.upper(F.trim("text")), F.lit(False))
    lines = near.groupBy("page", "table_no", "line").agg(F.bool_or(hit).alias("marked"), F.min("ly0").alias("ly0"), F.min("hy1").alias("hy1"))
    order = Window.partitionBy("page", "table_no").orderBy("line")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("far", F.col("ly0") - F.col("hy1") > BELOW_PT).withColumn("n", F.count("*").over(before))
    # any line of the page beyond reach, with words near or not, ends a band that is still empty
    ends = (F.col("far") & (F.col("n") == 0)) | F.col("marked") | F.col("far")
    lines = lines.withColumn("ends", ends).withColumn("over", F.coalesce(F.max("ends").over(before), F.lit(False)))
    alive = lines.where("NOT over")
    first_far = large(words).join(large(found.select("page", "table_no", "hy1")), "page").where(F.col("ly0") - F.col("hy1") > BELOW_PT).groupBy("page", "table_no").agg(F.min("line").alias("far_line"))
    alive = large(alive).join(large(first_far), ["page", "table_no"], "left")
    first = Window.partitionBy("page", "table_no")
    alive = alive.withColumn("head", F.min("line").over(first)).where(F.col("far_line").isNull() | (F.col("head") < F.col("far_line")))
    data = F.min(F.when(F.col("marked"), F.col("ly0"))).over(first)
    kept = alive.withColumn("data_y0", data).where("NOT marked AND NOT (far AND n = 0)").select("page", "table_no", "line", "data_y0")
    band = large(near).join(large(kept), ["page", "table_no", "line"]).where(F.col("data_y0").isNull() | (F.col("y1") <= F.col("data_y0")))
    title = F.upper(F.regexp_replace("text", r"\.+$", "")).rlike(SUBHEADER)
    whole = Window.partitionBy("page", "table_no")
    band = band.withColumn("_titled", F.max(title).over(whole)).withColumn("sub_y1", F.max("y1").over(whole))
    return band.where("_titled").select("page", "table_no", "category", "stop", "seq", "x0", "y0", "x1", "y1", "yc", "text", "sub_y1")


def columns(band: DataFrame) -> DataFrame:
    """(page, table_no, column, name, x0, x1, sub_y1, category, stop): words of a band that lie
    within COLUMN_PT of each other, widened to the middle between neighbours and padded at the
    ends."""
    across = Window.partitionBy("page", "table_no").orderBy(*_ORDER)
    reach = F.max("x1").over(across.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("x0") > reach + COLUMN_PT, 1).otherwise(0)
    grouped = band.withColumn("_fresh", fresh).withColumn("column", F.sum("_fresh").over(across.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).withColumn("_row", F.bround("y0"))
    each = grouped.groupBy("page", "table_no", "column").agg(
        _joined("text", "_row", "x0", "yc", "seq").alias("name"), F.min("x0").alias("a"), F.max("x1").alias("b"), F.min("sub_y1").alias("sub_y1"), F.min("category").alias("category"), F.min("stop").alias("stop")
    )
    order = Window.partitionBy("page", "table_no").orderBy("column")
    left, right = F.lag("b").over(order), F.lead("a").over(order)
    x0, x1 = F.coalesce((left + F.col("a")) / 2, F.col("a") - PAD_PT), F.coalesce((F.col("b") + right) / 2, F.col("b") + PAD_PT)
    return each.select("page", "table_no", "column", "name", x0.alias("x0"), x1.alias("x1"), "sub_y1", "category", "stop")


def body(words: DataFrame, cols: DataFrame) -> DataFrame:
    """The words inside each table's rows, with their ``column`` (null between none): lines below
    the titles, up to the next header, a note, or a gap much wider than those before it."""
    tables = cols.groupBy("page", "table_no", "category", "stop", "sub_y1").agg(
        F.min("x0").alias("tx0"), F.max("x1").alias("tx1"), F.array_sort(F.collect_list(F.struct("column", "x0", "x1"))).alias("spans")
    )
    below = large(words).join(large(tables), "page").where(F.col("ly0") > F.col("sub_y1")).withColumn("xc", (F.col("x0") + F.col("x1")) / 2)
    inside = F.col("xc").between(F.col("tx0"), F.col("tx1"))
    lines = below.groupBy("page", "table_no", "line").agg(F.min("ly0").alias("ly0"), F.min("ly1").alias("ly1"), F.min("stop").alias("stop"), F.bool_or(inside).alias("any"), F.min_by("text", F.when(inside, F.struct(*_ORDER))).alias("first"))
    order = Window.partitionBy("page", "table_no").orderBy("line")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("gap", F.when(F.col("any"), F.col("ly0") - F.last(F.when(F.col("any"), F.col("ly1")), ignorenulls=True).over(past)))
    gaps = F.sort_array(F.collect_list("gap").over(past))
    usual = F.get(gaps, F.floor(F.size(gaps) / 2).cast("int"))
    ends = F.coalesce(F.col("ly0") >= F.col("stop"), F.lit(False)) | F.coalesce(F.col("any") & F.upper("first").rlike(NOTES), F.lit(False))
    ends |= F.coalesce(F.col("any") & usual.isNotNull() & (F.col("gap") > STOP_FACTOR * F.greatest(usual, F.lit(LEAST_GAP))), F.lit(False))
    lines = lines.withColumn("ends", ends).withColumn("over", F.max("ends").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    kept = lines.where("any AND NOT over").select("page", "table_no", "line")
    column = F.get(F.filter("spans", lambda s: F.col("xc").between(s["x0"], s["x1"])), 0)["column"]
    return large(below.where(inside)).join(large(kept), ["page", "table_no", "line"]).withColumn("column", column).drop("spans", "stop")


def _mark_columns(cols: DataFrame, cells: DataFrame) -> DataFrame:
    """(page, table_no, mark_column): the column whose title says so, else the one whose cells look
    most like marks of the category, else the first."""
    titles = F.upper("name")
    rank = F.lit(None).cast("int")
    for k, pattern in reversed(list(enumerate(MARK_TITLES))):
        rank = F.when(titles.rlike(pattern), k).otherwise(rank)
    named = cols.withColumn("rank", rank).groupBy("page", "table_no").agg(F.min_by("column", F.when(F.col("rank").isNotNull(), F.struct("rank", "column"))).alias("named"))
    hit = _marks("category", F.trim("cell"), F.lit(False))
    like = cells.groupBy("page", "table_no", "column").agg(F.count_if(hit).alias("hits")).where("hits > 0").groupBy("page", "table_no").agg(F.min_by("column", F.struct((-F.col("hits")).alias("h"), "column")).alias("like"))
    return large(named).join(large(like), ["page", "table_no"], "left").select("page", "table_no", F.coalesce("named", "like", F.lit(0)).alias("mark_column"))


def read_schedules(words: DataFrame, category: Callable[[Column], Column] = _built_in) -> dict[str, DataFrame]:
    """tables (page, table_no, category, header_text, x0, y0, x1, y1, n_columns, n_rows), columns
    (page, table_no, column, name, x0, x1), rows (page, table_no, category, row_no, mark,
    row_text, x0, y0, x1, y1) and cells (page, table_no, row_no, column, name, text).

    A line with a mark starts a row; a line without one goes on with the row above."""
    rows = stash(lined(words), "lines")
    found = stash(headers(rows, category), "headers")
    cols = stash(columns(bands(rows, found)), "columns")
    inner = stash(body(rows, cols), "body")
    keys = ["page", "table_no", "line"]
    cells = stash(inner.where("column IS NOT NULL").groupBy(*keys, "column", "category").agg(_joined("text", *_ORDER).alias("cell")), "cells")
    mark_column = _mark_columns(cols, cells)
    place = Window.partitionBy(*keys).orderBy(*_ORDER)
    spots = inner.withColumn("place", F.row_number().over(place)).withColumn("many", F.count("*").over(Window.partitionBy(*keys)))
    token = F.upper(F.trim("text"))
    window = F.when(F.col("category") == "wall_type", (F.col("many") >= 4) & (F.col("place") <= 2)).otherwise(F.col("place") <= MARK_WORDS)
    lines = spots.groupBy(*keys, "category").agg(
        F.min_by(token, F.when(window & _marks("category", token, F.lit(False)), F.col("place"))).alias("mark"), _joined("text", "place").alias("line_text"),
        F.min("ly0").alias("ly0"), F.min("ly1").alias("ly1"), F.min("tx0").alias("tx0"), F.min("tx1").alias("tx1"),
    )
    at_mark = large(cells).join(large(mark_column), ["page", "table_no"]).where("column = mark_column").select(*keys, F.trim("cell").alias("own"))
    lines = large(lines).join(large(at_mark), keys, "left")
    known = F.col("category").isin(*MARK_PATTERNS)
    spare = F.when(F.col("category") == "wall_type", None).when(known, F.when(F.upper("own").rlike(GENERIC_MARK), F.upper("own"))).otherwise(F.nullif("own", F.lit("")))
    lines = lines.withColumn("mark", F.coalesce("mark", spare))
    order = Window.partitionBy("page", "table_no").orderBy("line")
    starts = F.when(F.col("mark").isNotNull() | (F.row_number().over(order) == 1), 1).otherwise(0)
    lines = lines.withColumn("_starts", starts).withColumn("row_no", F.sum("_starts").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    lines = stash(lines, "rows")
    out = lines.groupBy("page", "table_no", "category", "row_no").agg(
        F.min_by("mark", "line").alias("mark"), _joined("line_text", "line").alias("row_text"), F.min("tx0").alias("x0"), F.min_by("ly0", "line").alias("y0"), F.min("tx1").alias("x1"), F.max_by("ly1", "line").alias("y1")
    )
    named = cols.select("page", "table_no", "column", "name")
    merged = large(cells).join(large(lines.select(*keys, "row_no")), keys).groupBy("page", "table_no", "row_no", "column").agg(_joined("cell", "line").alias("text"))
    ends = out.groupBy("page", "table_no").agg(F.max("y1").alias("ry1"), F.count("*").alias("n_rows"))
    spans = cols.groupBy("page", "table_no").agg(F.min("x0").alias("cx0"), F.max("x1").alias("cx1"), F.count("*").alias("n_columns"), F.min("sub_y1").alias("sub_y1"))
    tables = large(found).join(large(spans), ["page", "table_no"], "left").join(large(ends), ["page", "table_no"], "left").select(
        "page", "table_no", "category", "header_text", F.least("hx0", "cx0").alias("x0"), F.col("hy0").alias("y0"), F.greatest("hx1", "cx1").alias("x1"), F.coalesce("ry1", "sub_y1", "hy1").alias("y1"),
        F.coalesce("n_columns", F.lit(0)).alias("n_columns"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
    )
    return {"tables": tables, "columns": cols.select("page", "table_no", "column", "name", "x0", "x1"), "rows": out, "cells": large(merged).join(large(named), ["page", "table_no", "column"])}


def schedule_rows(words: DataFrame) -> DataFrame:
    return read_schedules(words)["rows"]


def banded_rows(words: DataFrame, bands: list[tuple[str, float, float]], columns: dict[str, tuple[float, float]], needed: str, left: float, right: float) -> DataFrame:
    """(page, row_no, mark, and the columns) of a schedule whose rows and columns stand at known
    places: ``bands`` (mark, y0, y1) and ``columns`` (x0, x1) hold the middles of words. A row
    without ``needed`` is left out; cells are read down, then across. Bands and columns are a
    drawing's layout, so each word is held to all of them where it is."""
    from spanwright.functions.marks import cell_text

    xc, yc = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    rows = F.array(*[F.struct(F.lit(k).alias("row_no"), F.lit(m).alias("mark"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (m, a, b) in enumerate(bands, 1)])
    inside = words.where(xc.between(left, right)).withColumn("_band", F.explode(F.filter(rows, lambda r: yc.between(r["a"], r["b"]))))
    cell = lambda a, b: cell_text(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(xc.between(a, b), F.struct("y0", "x0", "seq", "text")))), lambda s: s["text"]), " "))
    out = inside.groupBy("page", "_band.row_no", "_band.mark").agg(*[cell(a, b).alias(c) for c, (a, b) in columns.items()])
    return out.where(F.col(needed) != "")


def located_page(words: DataFrame, sheet: str, mark: str) -> DataFrame:
    """(doc, page, marks): of each document's pages with a word that names the sheet, the one with
    the most marks, the first on a tie; documents whose such pages have no mark have none."""
    each = words.groupBy("doc", "page").agg(F.bool_or(F.coalesce(F.col("text").rlike(sheet), F.lit(False))).alias("named"), F.count_if(F.col("text").rlike(mark)).alias("marks"))
    found = each.where("named AND marks > 0")
    best = found.groupBy("doc").agg(F.min_by(F.struct("page", "marks"), F.struct((-F.col("marks")).alias("m"), "page")).alias("b"))
    return best.select("doc", "b.page", "b.marks")
