"""Scans of a page's strokes, words and annotations for what a drawing says by its marks.

Strokes have page, seq, ax, ay, bx, by and may have kind ("l" line, "c" curve), fill and color
(arrays of parts from 0, dark, to 1) and the box x0, y0, x1, y1 of their path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanwright.operators.evidence import distinct_within
from spanwright.operators.spatial import segments_within, within

# Fixed values, in points: lengths of leader lines, sides of dots and of dark markers, reach of
# a label, and what counts as dark.
LEADER = (8.0, 220.0)
DOT = 7.0
MARKER = (4.0, 22.0)
DARK = 0.25
LABEL_REACH, LABEL_SIDE, FAR_END, SNAP, APART = 55.0, 14.0, 25.0, 26.0, 22.0
BENCHMARK = r"(?i)\bBM[-_ ]?(\d)\b"
STAMPS = ("Stamp", "Square", "Circle")


def leader_segments(strokes: DataFrame) -> DataFrame:
    """Straight strokes as long as leader lines."""
    length = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    return strokes.where((F.col("kind") == "l") & length.between(*LEADER)).withColumn("length", length)


def dots(strokes: DataFrame) -> DataFrame:
    """(page, seq, x, y): centres of small filled paths."""
    small = (F.col("x1") - F.col("x0") <= DOT) & (F.col("y1") - F.col("y0") <= DOT)
    return strokes.where(F.col("fill").isNotNull() & small).select("page", "seq", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))


def dark_markers(strokes: DataFrame) -> DataFrame:
    """(page, seq, x, y, width, height): centres of dark filled paths as large as symbols; a
    flat or a narrow one may be half as thick."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    low, high = MARKER
    sized = (w.between(low, high) & h.between(low, high)) | (w.between(low + 1, high) & h.between(low / 2, high)) | (w.between(low / 2, high) & h.between(low + 1, high))
    dark = F.coalesce(F.array_max("fill") < DARK, F.lit(False))
    return strokes.where(dark & sized).select("page", "seq", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"), w.alias("width"), h.alias("height"))


def diagonals(strokes: DataFrame) -> DataFrame:
    """Dark slanted strokes, neither level nor upright, from 10 to 220 points long."""
    dx, dy = F.abs(F.col("ax") - F.col("bx")), F.abs(F.col("ay") - F.col("by"))
    dark = F.coalesce(F.array_max("color") <= DARK, F.lit(True))
    slanted = (dx >= 8) & (dy >= 8) & F.try_divide(dy, dx).between(0.25, 4.0)
    return strokes.where((F.col("kind") == "l") & dark & F.hypot(dx, dy).between(10, 220) & slanted)


def annotated_benchmarks(annotations: DataFrame) -> DataFrame:
    """(page, mark, x, y, n, confidence) of benchmark stamps among annotations (page, kind,
    subject, title, content and a box). ``n`` above one is a mark stamped twice on a page, whose
    place is not to be used."""
    digit = F.regexp_extract(F.concat_ws(" ", "subject", "title", "content"), BENCHMARK, 1)
    found = annotations.where(F.col("kind").isin(*STAMPS) & (digit != "")).withColumn("mark", F.concat(F.lit("BM-"), digit))
    at = lambda a, b: F.avg((F.col(a) + F.col(b)) / 2)
    return found.groupBy("page", "mark").agg(at("x0", "x1").alias("x"), at("y0", "y1").alias("y"), F.count("*").alias("n"), F.lit(0.98).alias("confidence"))


def benchmark_pages(found: DataFrame) -> DataFrame:
    """(mark, page, pages, problem): each mark's first page, and what forbids its use: two
    stamps on a page, or several pages."""
    each = found.groupBy("mark").agg(F.min("page").alias("page"), F.count_distinct("page").alias("pages"), F.max("n").alias("most"))
    problem = F.when(F.col("most") > 1, "duplicate").when(F.col("pages") > 1, "several pages")
    return each.select("mark", "page", "pages", problem.alias("problem"))


def plan_words(words: DataFrame, width: float, height: float, strip: float = 0.12) -> DataFrame:
    """Words on the page and left of its title strip."""
    return words.where((F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < width * (1 - strip)) & (F.col("y") <= height))


def leader_targets(labels: DataFrame, segments: DataFrame, markers: DataFrame) -> DataFrame:
    """(page, label, seq, x, y): the far ends of the strokes that begin at a label (page, label,
    x, y), each moved to the nearest marker (page, seq, x, y) around it; of ends close to each
    other the first stays."""
    ends = segments_within(labels.select("page", "label", "x", "y"), segments.select("page", "seq", "ax", "ay", "bx", "by"), LABEL_REACH, "page")
    a, b = F.hypot(F.col("r_ax") - F.col("x"), F.col("r_ay") - F.col("y")), F.hypot(F.col("r_bx") - F.col("x"), F.col("r_by") - F.col("y"))
    begins = (F.least(a, b) < LABEL_REACH) | (F.col("dist") < LABEL_SIDE)
    far = F.when(a < b, F.struct(F.col("r_bx").alias("x"), F.col("r_by").alias("y"))).otherwise(F.struct(F.col("r_ax").alias("x"), F.col("r_ay").alias("y")))
    tips = ends.where(begins & (F.greatest(a, b) >= FAR_END)).select("page", "label", F.col("r_seq").alias("seq"), far.alias("p")).select("page", "label", "seq", "p.*")
    near = within(tips, markers.select("page", "seq", "x", "y"), SNAP, "page")
    best = near.groupBy("page", "label", "seq").agg(F.min(F.struct("dist", "r_seq", F.col("r_x").alias("mx"), F.col("r_y").alias("my"))).alias("m"))
    snapped = tips.join(best, ["page", "label", "seq"], "left").select("page", "label", "seq", F.coalesce("m.mx", "x").alias("x"), F.coalesce("m.my", "y").alias("y"))
    whole = snapped.withColumn("at", F.struct("page", "label"))
    return distinct_within(whole, "at", APART).select("at.page", "at.label", "seq", "x", "y")


def label_hits(words: DataFrame, marks: list[str]) -> DataFrame:
    """Words "(n)MARK" or "n MARK" of the known ``marks``, in either case: mark and count."""
    known = "|".join(sorted((m.replace(".", r"\.") for m in marks), key=lambda m: (-len(m), m)))
    grammar = rf"(?i)^(?:(?:\((\d+)\)|(\d+))\s*)?({known})$"
    text = F.trim("text")
    count = F.coalesce(*[F.nullif(F.regexp_extract(text, grammar, i), F.lit("")) for i in (1, 2)], F.lit("1"))
    return words.where(text.rlike(grammar)).withColumn("mark", F.regexp_extract(text, grammar, 3)).withColumn("count", count.cast("int"))


def widened_columns(columns: DataFrame, by: str, pad: float = 10.0) -> DataFrame:
    """Column bounds (``by``, x0, x1) drawn out to the middle between neighbours, and by a pad at
    the table's sides."""
    w = Window.partitionBy(by).orderBy("x0")
    left, right = F.lag("x1").over(w), F.lead("x0").over(w)
    return columns.select(by, F.coalesce((left + F.col("x0")) / 2, F.col("x0") - pad).alias("x0"), F.coalesce((F.col("x1") + right) / 2, F.col("x1") + pad).alias("x1"))


def detections_to_rows(detections: DataFrame, base_z: Column) -> DataFrame:
    """One row for each detected instance: the detection's own elevation, or the storey's, which
    is then marked as inferred."""
    return detections.withColumn("z_inferred", F.col("z").isNull()).withColumn("z", F.coalesce("z", base_z))


def nearest_segment(points: DataFrame, segments: DataFrame, gate: float) -> DataFrame:
    """Each point (id, x, y) with the nearest segment (seq, ax, ay, bx, by) within the gate."""
    far = segments_within(points, segments, gate)
    return far.groupBy("id").agg(F.min_by(F.struct("r_seq", "dist"), F.struct("dist", "r_seq")).alias("b")).select("id", F.col("b.r_seq").alias("segment"), "b.dist")
