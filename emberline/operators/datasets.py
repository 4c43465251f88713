"""Training records and splits: conversations to records, checks, preference pairs, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.operators.rules import violations


def records(turns: DataFrame) -> DataFrame:
    """conv_id and its messages in order."""
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages")).select("conv_id", F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def record_violations(recs: DataFrame) -> DataFrame:
    """conv_id and what is wrong with its messages."""
    m, roles = F.col("messages"), F.transform("messages", lambda x: x["role"])
    rules = violations(
        (F.size(m) != 3, "not three messages"),
        (F.get(roles, F.lit(0)) != "system", "first is not system"),
        (~F.exists(roles, lambda r: r == "assistant"), "no assistant"),
        (F.exists(m, lambda x: F.length(F.trim(F.coalesce(x["content"], F.lit("")))) == 0), "empty content"),
    )
    return recs.select("conv_id", rules.alias("violations"))


def split_by_hash(df: DataFrame, key: str, shares: dict[str, float]) -> DataFrame:
    """``split`` by the MD5 of the key: stable for each row, whatever the others are."""
    u = F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    out, low = F.lit(list(shares)[-1]), 0.0
    cuts = []
    for name, share in shares.items():
        low += share
        cuts.append((low, name))
    for high, name in reversed(cuts[:-1]):
        out = F.when(u < high, F.lit(name)).otherwise(out)
    return df.withColumn("split", out)


def ordered_split(df: DataFrame, order: str, share: float) -> DataFrame:
    """The first max(1, round(n * share)) rows for training, at least one left for validation.

    Places come from counts by range of the order, so no task holds all rows.
    """
    ids = df.select(order).repartitionByRange(F.col(order)).withColumn("_p", F.spark_partition_id())
    from emberline.operators.graph import cut

    ids = cut(ids)
    starts = ids.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).withColumn("_start", F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    total = ids.count()
    train = min(max(1, round(total * share)), max(1, total - 1))
    placed = ids.join(F.broadcast(starts), "_p").withColumn("_n", F.col("_start") + F.row_number().over(Window.partitionBy("_p").orderBy(order)))
    return df.join(placed.select(order, F.when(F.col("_n") <= train, "train").otherwise("val").alias("split")), order)


def chat_text(messages: Column) -> Column:
    """Messages as marked lines."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), F.coalesce(m["content"], F.lit("")))), "\n")


def trainer_rows(recs: DataFrame) -> DataFrame:
    """Nested rows for a trainer: prompt messages, ground truth, extra information."""
    n = F.size("messages")
    return recs.select(
        F.lit("conversations").alias("data_source"),
        F.slice("messages", F.lit(1), F.greatest(n - 1, F.lit(0))).alias("prompt"),
        F.struct(F.lit("rule").alias("style"), F.struct(F.element_at(F.col("messages"), -1)["content"].alias("answer")).alias("ground_truth")).alias("reward_model"),
        F.struct(F.col("conv_id").alias("index")).alias("extra_info"),
    )


def yolo_lines(boxes: DataFrame, width: Column, height: Column) -> DataFrame:
    """``line``: class, centre and size as shares of the image, held to 0..1, six digits."""
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    x, y = (F.col("x1") + F.col("x2")) / 2 / width, (F.col("y1") + F.col("y2")) / 2 / height
    w, h = (F.col("x2") - F.col("x1")) / width, (F.col("y2") - F.col("y1")) / height
    return boxes.withColumn("line", F.format_string("%d %.6f %.6f %.6f %.6f", "class_id", unit(x), unit(y), unit(w), unit(h)))


def coco(images: DataFrame, boxes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Image and annotation tables with ids; boxes are cut to their image and empty ones left out."""
    im = images.withColumn("image_id", F.dense_rank().over(Window.orderBy("file_name")))
    j = boxes.join(im, "file_name").select("image_id", "class_id", F.greatest(F.lit(0.0), F.col("x1")).alias("x1"), F.greatest(F.lit(0.0), F.col("y1")).alias("y1"), F.least("x2", "width").alias("x2"), F.least("y2", "height").alias("y2"))
    j = j.where("x2 > x1 and y2 > y1")
    place = Window.partitionBy("image_id").orderBy("y1", "x1", "class_id")
    return im, j.select(F.concat_ws("-", "image_id", F.row_number().over(place)).alias("id"), "image_id", (F.col("class_id") + 1).alias("category_id"), F.array("x1", "y1", F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("bbox"), ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("area"))
