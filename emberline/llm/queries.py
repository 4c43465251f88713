"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm import decontam, langid, licenses, lm, minhash, packing, paragraphs, store, toxicity, vafile
from emberline.llm.scratch import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(divisor: int):
    """The fold of a document; a null doc_id counts as an empty one."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def _tokenizer_path(name: str) -> str:
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into bins of 2048 words."""
    return packing.pack(packing.word_lengths(_table(spark, sf_dir, "documents")), 2048)


def op2_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in all documents, with up to 5 % edits."""
    found = decontam.find(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.withColumn("contaminated", F.col("n_hits") > 0)


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors by inner product for each vec_id divisible by 50."""
    return vafile.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5, 256)


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of all documents, learned from those outside the held-out fold."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", (_fold(7) == 2).alias("held_out"))
    model = lm.fit(docs.where("not held_out"), Scratch(spark, "lm"))
    scores = lm.score(docs, model, ["doc_id", "held_out"], spend=True)
    return scores.withColumn("train_tokens", F.lit(model.tokens).cast("long"))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes all documents into a content-addressed store and reads its files back."""
    root = Scratch(spark, "token-store").path("store")
    store.write(_table(spark, sf_dir, "documents").select("doc_id", "text"), root, _tokenizer_path("byte_bpe_50k.json"), 2)
    return store.digests(spark, root)


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: five words, similarity 0.85."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), 85, 5)


def op9_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated paragraphs of all documents: five words, similarity 0.8; repeated passages of 50 words or more."""
    return paragraphs.duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), 80).drop("spans", "passages")


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those outside the held-out fold."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (_fold(4) == 2).alias("held_out"))
    langs, model = langid.fit(docs.where("not held_out"))
    return langid.predict(docs.select("doc_id", "held_out", "text"), langs, model, ["doc_id", "held_out"])


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License detections of all documents."""
    return licenses.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"]).drop("detections")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from the labels outside the held-out fold."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels").where(_fold(3) != 1))
    return toxicity.score(docs.withColumn("held_out", _fold(3) == 1), model, ["doc_id", "held_out"])


QUERIES = {
    "op1_packing": op1_packing,
    "op2_decontam": op2_decontam,
    "op3_topk": op3_topk,
    "op4_lm": op4_lm,
    "op5_token_store": op5_token_store,
    "op6_licenses": op6_licenses,
    "op7_toxicity": op7_toxicity,
    "op8_minhash": op8_minhash,
    "op9_paragraphs": op9_paragraphs,
    "op10_langid": op10_langid,
}
ORACLE_SQL: dict[str, str] = {
    "op3_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id
            WHERE q.vec_id % 50 = 0
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op8_minhash": """
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
            FROM documents
        ), g AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
            FROM w
        ), n AS (
            SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
        ), p AS (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2
        ), e AS (
            SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)
        ), l AS (
            SELECT a, b FROM e UNION SELECT b, a FROM e
        ), r AS (
            SELECT doc_id, doc_id AS other FROM w
            UNION
            SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a
        ), c AS (
            SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id
        )
        SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
        FROM w JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
    """,
}
