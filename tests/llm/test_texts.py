import re

import corpus_pipeline
from pyspark.sql import functions as F

from emberline.llm import langid, licenses, toxicity
from emberline.llm.boosting import Isotonic, Trees

from .helpers import docs, prose

WORDS = {"en": "the of and to in is that by this with".split(), "de": "der die und das ist von für nicht mit auf".split(), "fr": "le la les des est dans une pour sur avec".split()}


def text_of(lang, seed, n=60):
    import random

    r = random.Random(f"{lang}{seed}")
    return " ".join(r.choice(WORDS[lang]) for _ in range(n))


def test_languages_and_mixtures(spark):
    rows = [(i, text_of(lang, i), lang) for i, lang in enumerate(["en", "de", "fr"] * 40)] + [(900, None, "en"), (901, "x", None)]
    langs, model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert langs == ["de", "en", "fr"]
    asked = [text_of("en", 1000), text_of("de", 1001), text_of("fr", 1002), text_of("en", 5, 300) + " " + text_of("de", 6, 150), None, "", "123 .. 45", "日本", "a"]
    got = {r.doc_id: r for r in langid.predict(docs(spark, asked), langs, model, ["doc_id"]).collect()}
    assert [got[i].lang_pred for i in range(7)] == ["en", "de", "fr", "en", "und", "und", "und"]
    assert got[7].lang_pred != "und" and got[8].lang_pred != "und"
    assert got[3].langs == ["en", "de"] and abs(got[3].shares[0] - 2 / 3) < 0.1
    assert all(0 <= r.score <= 1 for r in got.values())


def test_no_language_is_learned_from_nothing(spark):
    langs, model = langid.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert [r.lang_pred for r in langid.predict(docs(spark, ["a", None]), langs, model, ["doc_id"]).collect()] == ["und", "und"]
    assert langid.predict(docs(spark, []), langs, model, ["doc_id"]).count() == 0


def plain_licenses(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    places, labels = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_places_and_labels(spark):
    texts = [None, "", "MIT License", "mit\n- LICENSE mit license", "xmit license", "the MIT licenses", "Apache-License, GNU General  Public\tLicense v3", "mit license " * 200, "é mit license é", "Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: BSD-3-Clause", "Permission is hereby granted, free of charge, to any person obtaining a copy", "license", prose(1, 3000) + " mit license"]
    got = {r.doc_id: r for r in licenses.scan(docs(spark, texts), ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_licenses(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert (got[9].labels, got[10].labels, got[11].labels, got[12].labels) == ("cc-by-nc", "bsd-3-clause", "mit", "")
    assert got[6].labels == "apache,gpl,gpl-3.0" and got[0].score == 0 and got[2].score == 1
    assert licenses.scan(docs(spark, []), ["doc_id"]).count() == 0


def test_contained_detections_are_dropped(spark):
    r = licenses.scan(docs(spark, ["licensed under the GNU Lesser General Public License version 2.1"]), ["doc_id"]).first()
    kept = [(d.first, d.last) for d in r.detections]
    assert not any(a != b and b[0] <= a[0] and a[1] <= b[1] for a in kept for b in kept)
    assert "lgpl-2.1" in r.labels.split(",") and "gpl" in r.labels.split(",")


def toxic_corpus(n=160):
    bad = ["vileword", "nastyterm", "grimroot"]
    texts = [prose(i, 50) + (f" you {bad[i % 3]}{'x' * (i % 4)} {bad[(i + 1) % 3]}!" if i % 4 == 0 else "") for i in range(n)]
    return texts, [(i, 1, int(i % 4 == 0)) for i in range(n)]


def test_toxicity_on_texts_that_it_has_not_seen(spark):
    texts, labels = toxic_corpus()
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs(spark, texts[:120]), table)
    got = {r.doc_id: r for r in toxicity.score(docs(spark, [*texts, None, ""]), model, ["doc_id"]).collect()}
    assert len(got) == 162 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    assert all(got[i].predicted == int(i % 4 == 0) for i in range(120, 160))
    assert got[160].score == got[161].score and got[160].predicted == 0


def test_toxicity_without_labels_or_with_one_class(spark):
    for labels, score in (([], 0.0), ([(0, 1, 0)], 0.0), ([(0, 1, 1), (0, 1, 0)], 1.0), ([(5, 1, 1), (6, 1, 0)], 0.0)):
        model = toxicity.fit(docs(spark, ["a", "b"]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        assert [r.score for r in toxicity.score(docs(spark, ["a", None]), model, ["doc_id"]).collect()] == [score, score]


def test_trees_and_calibration():
    import numpy as np

    r = np.random.default_rng(0)
    x = r.normal(size=(600, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    m = Trees().fit(x[:400], y[:400]).margin(x[400:])
    assert ((m > 0) == (y[400:] > 0)).mean() > 0.9
    p = Isotonic().fit(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1])).apply(np.array([0.0, 1, 2.5, 4, 9]))
    assert p.tolist() == [0, 0, 0.5, 1, 1]


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    item = "The quick brown fox jumps over the lazy dog, and then it runs back home before the rain begins to fall."
    shared = prose(5005, 60)
    texts, labels = toxic_corpus(160)
    texts += [texts[1], texts[1] + " one", "start " + item + " end", prose(901, 30) + "\n" + shared, prose(902, 30) + "\n" + shared, shared, None, ""]
    names = ["hits", "_text", "score", "row", "_spans", "_d", "node", "bucket", "th", "block", "kept", "predicted"]
    table = docs(spark, texts).select("*", *[F.lit(n).alias(n) for n in names])
    d = str(tmp_path)
    table.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    out, ids = spark.read.parquet(f"{d}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, d)
        if name != "packing":
            assert out.columns == table.columns
        ids.append({r.doc_id for r in out.select("doc_id").collect()})
    clean = {i for i in range(160) if i % 4}
    assert ids[0] == clean | set(range(160, 168))
    assert ids[1] == ids[0] - {160, 161}
    assert ids[2] == ids[1] - {165}
    assert ids[3] == ids[2] - {162} == ids[4]
    assert {r.doc_id for r in corpus_pipeline.run(spark, d).collect()} == ids[4]


def test_repeated_rows_and_empty_tables_of_the_pipeline(spark, tmp_path):
    d = str(tmp_path)
    twice = prose(1, 30)
    docs(spark, [twice, prose(2, 30)]).union(docs(spark, [twice])).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, d).collect()) == [0, 1]
    docs(spark, []).write.mode("overwrite").parquet(f"{d}/documents.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0


def test_fresh_names(spark):
    from emberline.llm.scratch import fresh

    assert fresh(spark.createDataFrame([(1, 2)], "_D int, _d_ int"), "_d") == "_d__"
