"""Model exports and artifacts: reading JSON documents into flat tables, and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.functions.marks import BENCHMARK, EVIDENCE_WORDS, stem, variant_key

POINT = "array<double>"
#: Schema of exports whose version starts with "3"; fields that others lack are null.
EXPORT = f"""
schema_version string, source_model string, source_file string, exported_at string,
levels array<struct<name:string,elevation_ft:double>>,
grids array<struct<id:string,label:string,line:array<{POINT}>>>,
walls array<struct<id:string,type_name:string,mark:string,level:string,base_line:array<{POINT}>,centerline:array<{POINT}>,thickness_ft:double,thickness:double,height_ft:double,is_structural:boolean>>,
elements array<struct<id:string,category:string,family:string,type_name:string,mark:string,level:string,elevation_ft:double,location:struct<point:{POINT},curve:array<{POINT}>>,bbox:array<{POINT}>,params:map<string,string>>>,
holdowns array<struct<element_id:string,category:string,family:string,scheduled_type:string,location:{POINT},elevation:double,bbox:{POINT},level:string,view:string,mark:string>>,
benchmarks array<struct<id:string,mark:string,family:string,level:string,point_ft:struct<x:double,y:double,z:double>>>,
_corrupt_record string
"""


def read_exports(spark: SparkSession, path: str) -> DataFrame:
    """One row a file; torn files have only ``_corrupt_record``. Adds ``project``, the name of
    the folder, and ``title``, the name of the model without its extension."""
    raw = spark.read.schema(EXPORT).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)
    name = F.col("_metadata.file_path")
    return raw.withColumn("project", F.element_at(F.split(name, "/"), -2)).withColumn("title", stem(F.coalesce("source_model", "source_file")))


def is_v3() -> Column:
    return F.coalesce(F.col("schema_version"), F.lit("")).startswith("3")


def torn(exports: DataFrame) -> DataFrame:
    return exports.where("_corrupt_record IS NOT NULL").select("project", "title", "_corrupt_record")


def element_rows(exports: DataFrame) -> DataFrame:
    """Elements of either version in one shape."""
    new = exports.where(is_v3()).select("project", F.posexplode("elements").alias("seq", "e"))
    new = new.select(
        "project", "seq", "e.id", "e.category", "e.family", "e.type_name", F.lit(None).cast("string").alias("scheduled_type"), "e.mark", "e.level",
        F.coalesce("e.elevation_ft", F.get(F.col("e.location.point"), 2)).alias("z"), F.get(F.col("e.location.point"), 0).alias("x"), F.get(F.col("e.location.point"), 1).alias("y"),
    )
    old = exports.where(~is_v3()).select("project", F.posexplode("holdowns").alias("seq", "e"))
    old = old.select("project", "seq", F.col("e.element_id").alias("id"), "e.category", "e.family", F.lit(None).cast("string").alias("type_name"), "e.scheduled_type", "e.mark", "e.level", F.col("e.elevation").alias("z"), F.get(F.col("e.location"), 0).alias("x"), F.get(F.col("e.location"), 1).alias("y"))
    return new.unionByName(old)


def holdown_rows(elements: DataFrame) -> DataFrame:
    """Elements whose family names a hold-down product, with its key and part."""
    return elements.withColumn("variant", variant_key(F.col("family"))).where("variant IS NOT NULL").withColumn("part", F.when(F.lower("family").rlike(EVIDENCE_WORDS), "evidence_member").otherwise("body"))


def wall_rows(exports: DataFrame) -> DataFrame:
    w = exports.select("project", F.posexplode("walls").alias("seq", "w")).withColumn("line", F.coalesce("w.base_line", "w.centerline"))
    end = lambda i, k: F.get(F.get("line", F.lit(i)), F.lit(k))
    return w.where(F.size("line") >= 2).select("project", "seq", "w.id", "w.type_name", "w.mark", "w.level", end(0, 0).alias("ax"), end(0, 1).alias("ay"), end(1, 0).alias("bx"), end(1, 1).alias("by"), F.coalesce("w.thickness_ft", "w.thickness").alias("thickness"), "w.height_ft", "w.is_structural")


def grid_rows(exports: DataFrame) -> DataFrame:
    g = exports.select("project", F.posexplode("grids").alias("seq", "g"))
    end = lambda i, k: F.get(F.get(F.col("g.line"), F.lit(i)), F.lit(k))
    return g.select("project", "seq", F.coalesce("g.id", "g.label").alias("id"), "g.label", end(0, 0).alias("ax"), end(0, 1).alias("ay"), end(1, 0).alias("bx"), end(1, 1).alias("by"))


def level_rows(exports: DataFrame) -> DataFrame:
    """Levels in order of elevation, with the height to the next."""
    from pyspark.sql.window import Window

    rows = exports.select("project", F.explode("levels").alias("l")).select("project", "l.*")
    above = F.lead("elevation_ft").over(Window.partitionBy("project").orderBy("elevation_ft"))
    return rows.withColumn("height_ft", above - F.col("elevation_ft"))


def benchmark_rows(exports: DataFrame) -> DataFrame:
    b = exports.select("project", F.explode("benchmarks").alias("b")).select("project", "b.*")
    named = F.lower(F.coalesce("family", F.lit(""))).contains("benchmark") | F.upper(F.coalesce("mark", F.lit(""))).rlike(BENCHMARK)
    return b.where(named).select("project", "id", "mark", "level", "point_ft.x", "point_ft.y", "point_ft.z")


def enriched(base: DataFrame, other: DataFrame, fields: tuple[str, ...], key: str = "id") -> DataFrame:
    """Fields that are missing in ``base`` from the other export's row, and its own rows."""
    o = other.select(F.col(key).alias("_k"), *[F.col(f).alias(f"_{f}") for f in fields])
    filled = base.join(o, base[key] == o["_k"], "left").select(*[F.coalesce(base[c], o[f"_{c}"]).alias(c) if c in fields else base[c] for c in base.columns])
    return filled.unionByName(other.join(base.select(key), key, "left_anti"), allowMissingColumns=True)


def changed_files(spark: SparkSession, folder: str, ingested: DataFrame, pattern: str = "*.json") -> DataFrame:
    """Files whose content was never taken in, the newest first: (path, mtime, sha)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    rows = files.select("path", F.col("modificationTime").alias("mtime"), "length", F.sha2("content", 256).alias("sha"))
    return rows.join(ingested.select("sha"), "sha", "left_anti").orderBy(F.desc("mtime"), "path")


def live_rows(lines: DataFrame) -> DataFrame:
    """(id, x, y) from a connector's text lines such as "id 123: (1.5, 2.0, 0)"."""
    number = r"(-?\d+(?:\.\d+)?)"
    pattern = rf"(\d+)\D*?\(\s*{number}\s*,\s*{number}"
    part = lambda i: F.nullif(F.regexp_extract("value", pattern, i), F.lit(""))
    return lines.select(part(1).cast("long").alias("id"), part(2).cast("double").alias("x"), part(3).cast("double").alias("y")).where("id IS NOT NULL")


def capped(rows: DataFrame, by: str, most: int = 3000) -> tuple[DataFrame, DataFrame]:
    """The first ``most`` rows of each category, as a viewer takes them, and what was left out."""
    from pyspark.sql.window import Window

    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy("seq")))
    over = rows.groupBy(by).agg(F.count("*").alias("n")).where(F.col("n") > most).withColumn("left_out", F.col("n") - most)
    return ranked.where(F.col("_r") <= most).drop("_r"), over


def write_artifact(df: DataFrame, path: str) -> None:
    """Replaces a table; Spark's committer shows it whole or not at all."""
    df.write.mode("overwrite").parquet(path)


def write_punch_list(rows: DataFrame, path: str) -> None:
    rows.orderBy("sheet", "category", "mark").write.mode("overwrite").option("header", "true").csv(path)


def overlay_svg(items: DataFrame, by: str = "sheet") -> DataFrame:
    """(sheet, svg): a circle for each drawable item of a sheet, in order; a sheet's items are
    as many as fit on paper."""
    circle = F.format_string('<circle cx="%s" cy="%s" r="6" class="%s"><title>%s</title></circle>', F.round("x", 2), F.round("y", 2), F.lower("verdict"), F.replace(F.replace("id", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", circle.alias("c")))), lambda s: s["c"]), "")
    return items.where("x IS NOT NULL").groupBy(by).agg(F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg">'), body, F.lit("</svg>")).alias("svg"))
