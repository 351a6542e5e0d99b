"""Marks, schedules and leaders from the words and strokes of drawing pages.

Words are (page, seq, x0, y0, x1, y1, text) or (page, seq, x, y, text); strokes are segments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanwright.functions.geometry import orientation
from spanwright.functions.marks import MARK_PATTERNS, first_of
from spanwright.operators.spatial import within

# Tokens on plans.
COUNT = r"^\((\d{1,2})\)$"
EMBEDDED = r"^\((\d{1,2})\)(\S+)$"
DETAIL = r"^\d{1,2}/[A-Z]{1,2}-?\d{3}$|^[A-Z]{1,2}-?\d{3}$"
SHEET = r"^[A-Z]{1,3}-?\d{1,3}(?:\.\d{1,2})?(?:-?[A-Z])?$"


def plan_marks(words: DataFrame, vocabulary: DataFrame | None = None, reach: int = 6) -> DataFrame:
    """Mark tokens of the plan, with their count from an embedded or a separate "(n)" to the
    left, without those beside a detail reference. Neighbours are at most ``reach`` words and
    36 points away, so a window over each page's words is enough. ``vocabulary``: (token,
    category, mark) taught aliases, which go before the built-in patterns."""
    w = words.withColumn("token", F.upper(F.trim("text")))
    embedded = F.nullif(F.regexp_extract("token", EMBEDDED, 1), F.lit(""))
    w = w.withColumn("own", embedded.cast("int")).withColumn("token", F.when(embedded.isNotNull(), F.regexp_extract("token", EMBEDDED, 2)).otherwise(F.col("token")))
    by_seq = Window.partitionBy("page").orderBy("seq").rangeBetween(-reach, reach)
    near = F.collect_list(F.struct("seq", "x", "y", "token")).over(by_seq)
    w = w.withColumn("near", F.filter(near, lambda o: (o["seq"] != F.col("seq")) & (F.abs(o["y"] - F.col("y")) <= 6) & (F.abs(o["x"] - F.col("x")) <= 36)))
    counts = F.array_max(F.transform(F.filter("near", lambda o: o["token"].rlike(COUNT) & (o["x"] < F.col("x"))), lambda o: F.regexp_extract(o["token"], COUNT, 1).cast("int")))
    detail = F.exists("near", lambda o: o["token"].rlike(DETAIL))
    category, mark = first_of(F.col("token"), MARK_PATTERNS, ("wall_type",)), F.col("token")
    if vocabulary is not None:
        w = w.join(vocabulary.select("token", F.col("category").alias("_c"), F.col("mark").alias("_m")), "token", "left")
        category, mark = F.coalesce(F.col("_c"), category), F.coalesce(F.col("_m"), mark)
    w = w.withColumn("category", category).withColumn("mark", mark).where(F.col("category").isNotNull() & ~detail)
    return w.withColumn("total", F.coalesce("own", counts, F.lit(1)).cast("int")).drop("near", "own")


def expanded(marks: DataFrame, sheet: str) -> DataFrame:
    """One row for each instance, with ids numbered in order for each sheet, category, mark."""
    rows = marks.withColumn("instance", F.explode(F.sequence(F.lit(1), "total")))
    n = F.row_number().over(Window.partitionBy(sheet, "category", "mark").orderBy("seq", "instance"))
    return rows.withColumn("id", F.format_string("%s_%s_%s_%03d", F.lower(F.col(sheet).cast("string")), "category", F.lower("mark"), n))


def sheet_number(words: DataFrame) -> DataFrame:
    """The tallest sheet-number token of each page, then the lowest, then the first."""
    named = words.where(F.upper("text").rlike(SHEET))
    return named.groupBy("page").agg(F.max_by("text", F.struct("height", "y1", -F.col("seq"))).alias("sheet"))


def overrides(rules: DataFrame) -> DataFrame:
    """The rules that hold for each kind and token: the last one told."""
    return rules.groupBy("kind", "token").agg(F.max_by("maps_to", "seq").alias("maps_to"))


def leader_tips(callouts: DataFrame, segments: DataFrame, attach: float = 18.0, most: int = 6) -> DataFrame:
    """The far ends of the segments that start within ``attach`` of a callout (id, x, y), the
    ``most`` nearest starts: a leader has one callout and few strokes."""
    end = lambda a, b: segments.select("seq", F.col(f"{a}x").alias("x"), F.col(f"{a}y").alias("y"), F.col(f"{b}x").alias("tx"), F.col(f"{b}y").alias("ty"))
    near = within(callouts, end("a", "b").unionByName(end("b", "a")), attach)
    one = near.groupBy("id", "r_seq").agg(F.min(F.struct("dist", F.col("r_tx").alias("x"), F.col("r_ty").alias("y"))).alias("e"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("e.dist", "r_seq"))
    return one.withColumn("rank", rank).where(F.col("rank") <= most).select("id", "rank", "e.x", "e.y", F.col("e.dist").alias("attach"))


def snapped(labels: DataFrame, dots: DataFrame, segments: DataFrame, search: float = 45.0, start: float = 25.0, end: float = 8.0, least: float = 3.0) -> DataFrame:
    """(id, x, y): the dot that a leader joins to each label, the nearest to the label; labels
    that are on their dot already have none."""
    tips = leader_tips(labels, segments, start, 1 << 20).select("id", "x", "y")
    hits = within(tips, dots.select("x", "y"), end).select("id", F.col("r_x").alias("dx"), F.col("r_y").alias("dy"))
    far = F.hypot(F.col("dx") - F.col("x"), F.col("dy") - F.col("y"))
    best = hits.join(labels.select("id", "x", "y"), "id").withColumn("far", far).where(F.col("far") <= search).groupBy("id").agg(F.min(F.struct("far", "dx", "dy")).alias("b"))
    return best.where(F.col("b.far") >= least).select("id", F.col("b.dx").alias("x"), F.col("b.dy").alias("y"))


def hatch_runs(strokes: DataFrame, longest: float = 8.0, gap: float = 14.0, ticks: int = 6, least: float = 12.0) -> DataFrame:
    """Wall runs (page, run, ax, ay, bx, by, angle): short strokes at the two most common
    angles of their page, linked within ``gap``, with at least ``ticks`` of them, as the main
    axis of each cluster, at least ``least`` long."""
    from spanwright.operators.cluster import single_link
    from spanwright.operators.fit import principal_segments

    size = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    short = strokes.where((size > 0) & (size <= longest)).select("page", "seq", ((F.col("ax") + F.col("bx")) / 2).alias("x"), ((F.col("ay") + F.col("by")) / 2).alias("y"), F.floor(orientation(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")) / 10).cast("int").alias("bucket"))
    common = short.groupBy("page", "bucket").agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(Window.partitionBy("page").orderBy(F.desc("n"), "bucket"))).where("r <= 2")
    linked = single_link(short.join(common.select("page", "bucket"), ["page", "bucket"]), gap, "page")
    big = linked.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= ticks).select("component")
    return principal_segments(linked.join(big, "component").withColumn("run", F.struct("page", "component")), "run").where(F.col("length") >= least).select("run.page", F.col("run.component").alias("run"), "ax", "ay", "bx", "by", "angle", "length")


def learned_vocabulary(rows: DataFrame) -> DataFrame:
    """The first row of each category and mark."""
    order = F.struct("page", "table_no", "row_no")
    return rows.where("mark IS NOT NULL").groupBy("category", "mark").agg(F.min_by("row_text", order).alias("row_text"))


def unrecognized(marks: DataFrame) -> DataFrame:
    """Marks on plans that no schedule lists: how many, and the first sheet."""
    return marks.groupBy("category", "mark").agg(F.count("*").alias("n"), F.bool_or("schedule_listed").alias("listed"), F.min_by("sheet", "seq").alias("first_sheet")).where("NOT listed")


# Names of the columns that hold marks, what a mark looks like in a schedule of
# hold-downs, and how far apart the words of one row may stand in height.
MARK_COLUMNS = ("MARK", "SYMBOL", "#")
SCHEDULE_MARK = r"(?i)^(?:H|HD|HDU|HTT|TD)-?\d{1,2}$"
ROW_HEIGHT = 4.0


def schedule_products(words: DataFrame, tables: DataFrame, columns: DataFrame) -> DataFrame:
    """(schedule, line, mark, key) of each row of a schedule that pairs a mark with a product.

    ``words``: page, x0, y0, x1, y1, text. ``tables``: table, page, x0, y0, x1, y1. ``columns``:
    table, name, x0, x1. A table takes the words whose middle is inside it. Where it has a
    column of marks and one of types, a row's mark is the first mark in the one, its product
    the first word in the other; else the first mark anywhere in the row and the first other
    word that names a product."""
    from spanwright.functions.marks import variant_key
    from spanwright.operators.cluster import anchored_lines
    from spanwright.operators.spatial import inside_intervals

    mid = words.withColumn("xc", (F.col("x0") + F.col("x1")) / 2).withColumn("yc", (F.col("y0") + F.col("y1")) / 2).drop("y0", "y1", "x1")
    held = inside_intervals(mid, tables, F.col("yc"), "y0", "y1", ["page"], 64.0).where(F.col("xc").between(F.col("i_x0"), F.col("i_x1")))
    held = held.select(F.col("i_table").alias("table"), "x0", "xc", "yc", "text")
    lined = anchored_lines(held, ["table"], "yc", ROW_HEIGHT)
    name = F.upper(F.trim(F.coalesce("name", F.lit(""))))
    first = lambda cond: F.min_by(F.struct("x0", "x1"), F.when(cond, F.col("x0")))
    kinds = columns.groupBy("table").agg(first(name.isin(*MARK_COLUMNS)).alias("m"), first(name.contains("TYPE")).alias("t"))
    both = kinds.where("m IS NOT NULL AND t IS NOT NULL")
    spans = both.select("table", F.inline(F.array(F.struct(F.lit("mark").alias("role"), "m.x0", "m.x1"), F.struct(F.lit("type").alias("role"), "t.x0", "t.x1"))))
    order = F.struct("yc", "x0", "text")
    marked, token = F.col("text").rlike(SCHEDULE_MARK), F.upper("text")
    cells = inside_intervals(lined, spans, F.col("xc"), "x0", "x1", ["table"], 64.0)
    strict = cells.groupBy("table", "line").agg(F.min_by(token, F.when((F.col("i_role") == "mark") & marked, order)).alias("mark"), F.min_by("text", F.when(F.col("i_role") == "type", order)).alias("product"))
    strict = strict.select("table", "line", "mark", variant_key(F.col("product")).alias("key"))
    free = lined.join(both.select("table"), "table", "left_anti")
    heads = free.groupBy("table", "line").agg(F.min_by(token, F.when(marked, order)).alias("mark")).where("mark IS NOT NULL")
    key = variant_key(F.col("text"))
    loose = free.join(heads, ["table", "line"]).where(token != F.col("mark")).withColumn("key", key).groupBy("table", "line", "mark").agg(F.min_by("key", F.when(F.col("key").isNotNull(), order)).alias("key"))
    return strict.unionByName(loose).where("mark IS NOT NULL AND key IS NOT NULL")


def product_marks(rows: DataFrame, order: list[str]) -> DataFrame:
    """key, mark: the mark of the first row that specifies a product."""
    return rows.groupBy("key").agg(F.min_by("mark", F.struct(*order)).alias("mark"))
