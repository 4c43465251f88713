import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from emberline.llm import store
from emberline.llm import textkernel as K
from emberline.llm.queries import _tokenizer_path
from emberline.llm.scratch import Scratch

from .helpers import docs, prose

PATH = _tokenizer_path("byte_bpe_50k.json")
HARD = ["", "a", "  two  spaces ", "tab\t and \n\n lines\r\n", "it's we'll 'd", "3.5, 4,000.00...", "x<|endoftext|>y <|endoftext|> ", "a\0b", "é ñ. ß,ü", " lead", "end\n", ".,", "a .b ,c", " x  y", "日本語。テスト 12", "_a_ b_c.", "é. x", "p.\nq,\n r", "a×. b", "a—.b", "ok. Fine, then.\nNext é ñ", "... \n"]


def test_pieces_give_the_library_s_ids():
    t = Tokenizer.from_file(PATH)
    e = store.Encoder(PATH)
    r = random.Random(3)
    texts = HARD + ["".join(r.choice(["a", "The", "an", "of", " ", " ", ".", ",", "\n", "'s", "9", "é", "|", "\t", "-"]) for _ in range(r.randint(0, 60))) for _ in range(3000)]
    column = pa.array(texts)
    plain = np.concatenate([store.plain_texts(data, offsets) for _, data, offsets in K.blocks(column, 500)])
    assert plain.any() and not plain.all()
    whole = [ids for _, data, offsets in K.blocks(column, 500) for ids in e.block(data, offsets)]
    for text, raw, raw2, raw3 in zip(texts, e.encode(texts), e.encode(texts, plain), whole, strict=True):
        assert raw == raw2 == raw3, repr(text)
        assert np.frombuffer(raw, e.kind).tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_round_trip(spark):
    t = Tokenizer.from_file(PATH)
    shared = prose(1, 2000)
    texts = [*HARD, None, shared, shared + " tail", "head " + shared, *[prose(k, 300) for k in range(20)], shared]
    root = Scratch(spark, "store").path("s")
    table = docs(spark, texts, 10)
    store.write(table, root, PATH, 2)
    got, back = {r.doc_id: r for r in store.digests(spark, root).collect()}, {r.doc_id: r for r in store.read(spark, root).collect()}
    at = 0
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        g = got[10 + i]
        assert (g.start, g.n_tokens, g.ids_crc32, g.verified) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)
        assert (back[10 + i].start, back[10 + i].ids) == (at, ids)
        at += len(ids)
    chunks = spark.read.parquet(f"{root}/chunks")
    held = chunks.where("ids is not null")
    assert held.select("hash").distinct().count() == held.count() < chunks.count()


def test_repeated_and_null_ids_and_empty_tables(spark):
    rows = [(3, "b c"), (3, "b c"), (None, "n"), (1, None)]
    root = Scratch(spark, "store").path("s")
    store.write(spark.createDataFrame(rows, "doc_id long, text string"), root, PATH, 2)
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in store.digests(spark, root).collect())
    assert [x[1] for x in got] == [None, 1, 3, 3] and [x[0] for x in got] == [0, 2, 3, 6]
    empty = Scratch(spark, "store").path("s")
    store.write(docs(spark, []), empty, PATH, 2)
    assert store.digests(spark, empty).count() == 0


def copied(spark, root, name, change):
    """A copy of a store with one table changed."""
    other = Scratch(spark, "store").path("s")
    for x in ("chunks", "recipes", "manifest"):
        df = spark.read.parquet(f"{root}/{x}")
        (change(df) if x == name else df).write.parquet(f"{other}/{x}")
    return other


def test_a_changed_chunk_is_found(spark):
    root = Scratch(spark, "store").path("s")
    store.write(docs(spark, ["some text"]), root, PATH, 2)
    other = copied(spark, root, "chunks", lambda df: df.withColumn("ids", F.unhex(F.reverse(F.hex("ids")))))
    with pytest.raises(Exception, match="does not hold"):
        store.digests(spark, other).collect()


def test_changed_recipes_and_manifests_are_found(spark, monkeypatch):
    monkeypatch.setattr(store, "LEAVES", 4)
    root = Scratch(spark, "store").path("s")
    store.write(docs(spark, [prose(k, 90) for k in range(40)]), root, PATH, 2)
    assert all(r.verified for r in store.digests(spark, root).collect())
    assert spark.read.parquet(f"{root}/recipes").where("place < -2").count() > 0
    swapped = copied(spark, root, "recipes", lambda df: df.withColumn("root", F.when((F.col("doc_id") == 7), F.lit(b"0" * 16)).otherwise(F.col("root"))))
    bad = {r.doc_id for r in store.digests(spark, swapped).where("not verified").collect()}
    segment = spark.read.parquet(f"{root}/recipes").where("doc_id = 7").first()["segment"]
    assert bad == {r.doc_id for r in spark.read.parquet(f"{root}/recipes").where(f"place >= 0 and segment = {segment}").collect()}
    node = copied(spark, root, "recipes", lambda df: df.withColumn("root", F.when(F.col("place") == -2, F.lit(b"0" * 16)).otherwise(F.col("root"))))
    assert not any(r.verified for r in store.digests(spark, node).collect())
    for name, change in (("recipes", lambda df: df.withColumn("root", F.when(F.col("place") == -1, F.lit(b"0" * 16)).otherwise(F.col("root")))), ("manifest", lambda df: df.withColumn("root", F.lit(b"0" * 16)))):
        with pytest.raises(ValueError, match="manifest"):
            store.digests(spark, copied(spark, root, name, change)).collect()


def test_crc_of_joined_parts_and_merkle_roots():
    r = random.Random(1)
    for _ in range(50):
        a, b = r.randbytes(r.randint(0, 9000)), r.randbytes(r.randint(0, 9000))
        assert store.crc_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    leaves = [bytes([i]) * 16 for i in range(9)]
    assert len({store.merkle(leaves[:k]) for k in range(10)}) == 10
    assert store.merkle(leaves) != store.merkle(leaves[::-1])
