"""Readers of the formats that incident data come in; each gives a DataFrame and touches no data until it is used."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_documents(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One document in each file; broken ones give null columns."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = False) -> DataFrame:
    """One record in each line; broken lines are left out, or stop the read if ``strict``."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def csv_rows(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    r = spark.read.option("header", True)
    return (r.schema(schema) if schema else r).csv(path)


def first_valid(sources: list[DataFrame], key: str, valid: str) -> DataFrame:
    """Rows of several sources by priority: for each key, the first source whose row is ``valid``."""
    ranked = [s.withColumn("_priority", F.lit(i)) for i, s in enumerate(sources)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked).where(valid)
    w = Window.partitionBy(key).orderBy("_priority")
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_priority")


def front_matter(spark: SparkSession, path: str) -> DataFrame:
    """path, fields (map), body of Markdown files with ``key: value`` lines between two lines of dashes."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r\n", "\n").alias("raw"))
    head = F.regexp_extract("raw", r"(?s)\A---\n(.*?)\n---\n?", 1)
    lines = F.filter(F.split(head, "\n"), lambda x: x.rlike(r"^[A-Za-z_][A-Za-z0-9_]*:"))
    entries = F.transform(lines, lambda x: F.struct(F.trim(F.split_part(x, F.lit(":"), F.lit(1))).alias("key"), F.trim(F.regexp_replace(F.regexp_replace(x, r"^[^:]*:", ""), r"""^\s*["']|["']\s*$""", "")).alias("value")))
    # A key that comes again is passed over.
    first = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, F.lit(1), i), lambda x: x["key"] == e["key"]))
    return files.select("path", F.map_from_entries(first).alias("fields"), F.regexp_replace("raw", r"(?s)\A---\n.*?\n---\n?", "").alias("body"))


def listed(value) -> "F.Column":
    """Items of a front-matter list, with or without brackets."""
    bare = F.regexp_replace(F.coalesce(value, F.lit("")), r"[\[\]\"']", "")
    return F.filter(F.transform(F.split(bare, ","), lambda x: F.trim(x)), lambda x: x != "")


def truthy(value) -> "F.Column":
    return F.lower(F.trim(F.coalesce(value, F.lit("")))).isin("true", "yes", "1", "on")


def yolo_labels(spark: SparkSession, path: str, width: float, height: float, default_confidence: float = 1.0) -> DataFrame:
    """path, class_id, confidence, x1..y2 in pixels; lines of fewer than five fields are left out."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), parts.alias("p")).where(F.size("p") >= 5)
    n = lambda i: F.get("p", F.lit(i)).try_cast("double")
    cx, cy, w, h = n(1) * width, n(2) * height, n(3) * width, n(4) * height
    return rows.select("path", n(0).cast("int").alias("class_id"), F.coalesce(n(5), F.lit(default_confidence)).alias("confidence"), (cx - w / 2).alias("x1"), (cy - h / 2).alias("y1"), (cx + w / 2).alias("x2"), (cy + h / 2).alias("y2"))


COCO = "images array<struct<id:long,file_name:string,width:double,height:double>>, annotations array<struct<id:long,image_id:long,category_id:long,bbox:array<double>>>, categories array<struct<id:long,name:string>>"


def coco(spark: SparkSession, path: str) -> DataFrame:
    """file_name, category, x1..y2 of all annotations."""
    doc = json_documents(spark, path, COCO)
    images = doc.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), "i.file_name")
    names = doc.select(F.explode("categories").alias("c")).select(F.col("c.id").alias("category_id"), F.col("c.name").alias("category"))
    a = doc.select(F.explode("annotations").alias("a")).select("a.image_id", "a.category_id", "a.bbox")
    x, y, w, h = (F.get("bbox", F.lit(i)) for i in range(4))
    return a.join(images, "image_id").join(F.broadcast(names), "category_id").select("file_name", "category", x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2"))


def png_sizes(spark: SparkSession, path: str) -> DataFrame:
    """path, width, height from the headers of PNG files; null for others."""
    b = spark.read.format("binaryFile").load(path)
    number = lambda at: F.conv(F.hex(F.substring("content", at, 4)), 16, 10).cast("int")
    is_png = F.hex(F.substring("content", 1, 4)) == "89504E47"
    return b.select("path", F.when(is_png, number(17)).alias("width"), F.when(is_png, number(21)).alias("height"))


def with_path_keys(df: DataFrame, pattern: str, names: list[str]) -> DataFrame:
    """``df`` (with ``path``) and columns from the groups of ``pattern`` in the path, back slashes taken as slashes."""
    path = F.regexp_replace("path", r"\\", "/")
    return df.select("*", *[F.regexp_extract(path, pattern, i + 1).alias(n) for i, n in enumerate(names)])


def manifest_cases(manifest: DataFrame, events: DataFrame, labels: DataFrame) -> DataFrame:
    """Manifest rows with their events and, for evaluation, labels; cases without files stay with nulls."""
    return manifest.join(events, "case_id", "left").join(labels, "case_id", "left")
