"""The corpus pipeline: from raw documents to packed training bins.

Every stage takes (spark, docs, sf_dir) and works on all that the one before
kept; it is written as Parquet and read again as the next one's ``docs``. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm import decontam, minhash, packing, paragraphs, toxicity
from emberline.llm.links import bounded
from emberline.llm.scratch import Scratch, tidy

CAPACITY = 2048


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject (score under 0.7)."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    tidy(spark)  # the fitting's tables of terms and features
    return toxicity.accepted(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, similarity 0.8; the one with the smallest doc_id.

    Of rows that repeat a document one stays.
    """
    found = minhash.near_duplicates(docs.select("doc_id", "text"), 80, 5)
    dropped = Scratch(spark, "near-duplicates").write(found.where("not kept").select("doc_id").distinct(), "dropped")
    kept = docs.join(bounded(dropped), "doc_id", "left_anti").select(*docs.columns)
    twice = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return kept if twice.isEmpty() else kept.dropDuplicates()


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the paragraphs that an earlier document has as well; documents of which nothing is left go."""
    cut = paragraphs.remove(docs)
    had = F.coalesce(F.col("n_chars"), F.lit(0)) > 0
    left = cut.where(~had | (F.length(F.trim(F.col("text"))) > 0))
    return left.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of CAPACITY words: doc_id, piece, start, length, bin_id, bin_offset."""
    return packing.pack(packing.word_lengths(docs), CAPACITY)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("repeated passages", drop_repeated_passages),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: No SQL expresses the fitted model of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
