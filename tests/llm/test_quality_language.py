"""Quality classifier and language ID: held-out accuracy, brute force, odd inputs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from peoplelens.llm import language, quality, queries

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, score double, stats string, held_out string"
ODD = [(1, None, None, None, 1.0, "x", "y"), (2, "", "en", "s", None, None, None), (2, "", "en", "s", None, None, None),
       (None, "12 345 !!", "fr", "s", None, None, None), (3, "word " * 60_000, "en", None, None, None, None)]


def slow_score(forest, row):
    total = forest.start
    for feature, threshold, leaf in zip(forest.statistic, forest.threshold, forest.leaf):
        at = 0
        while at < len(feature):
            at = 2 * at + (2 if row[feature[at]] > threshold[at] else 1)
        total += leaf[at - len(feature)]
    return 1 / (1 + np.exp(-total))


def test_repeated_rows_do_not_fill_the_quality_sample(spark, monkeypatch):
    """Nine rows in ten are one document, or share its id: the sample stays bounded and holds the other documents all the same."""
    width = len(quality.STATISTICS)
    stats = spark.range(20_000).selectExpr("if(id < 18000, 7, id) AS doc_id", f"array_repeat(float(if(id < 12000, 0, id)), {width}) AS stats")
    labels = stats.select("doc_id").distinct().selectExpr("doc_id", "int(doc_id % 2) AS quality")
    seen = {}
    monkeypatch.setattr(quality, "fit_forest", lambda x, y, **_: seen.update(x=x, y=y))
    quality.fit(stats, labels, sample=400)
    assert 300 < len(seen["x"]) < 500 and len(np.unique(seen["x"], axis=0)) == len(seen["x"])
    assert (seen["x"][:, 0] >= 18_000).sum() > 50
    quality.fit(stats, labels, sample=50_000)  # fewer different rows than the sample: all of them, each once
    assert len(seen["x"]) == 1 + 8_000
    quality.fit(stats.limit(0), labels, sample=10)
    assert seen["x"].shape == (0, width)


def test_forest_learns_and_arrays_agree_with_walking():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < 0)).astype(float)
    forest = quality.fit_forest(x[:1500], y[:1500])
    got = forest.score(x[1500:])
    assert ((got > 0.5) == y[1500:]).mean() > 0.95
    assert np.allclose(got[:50], [slow_score(forest, r) for r in x[1500:1550]])


def test_forest_without_labels_or_with_one_class():
    assert quality.fit_forest(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    one = quality.fit_forest(np.ones((20, 3)), np.ones(20))
    assert (one.score(np.ones((2, 3))) > 0.9).all()


def test_op1_held_out_accuracy(spark):
    got = queries.op1_quality(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = got.join(labels, "doc_id").filter("held_out").select((F.col("predicted") == F.col("quality")).cast("int").alias("ok")).toPandas()
    assert len(rows) > 500 and rows["ok"].mean() > 0.98
    assert got.count() == 10_000 and got.filter("score < 0 OR score > 1 OR score IS NULL").isEmpty()


def test_quality_odd_rows_and_empty_tables(spark):
    docs = spark.createDataFrame(ODD, DOCS)
    stats = quality.statistics_table(docs)
    labels = spark.createDataFrame([(1, None), (2, 1), (2, 0), (None, 1)], "doc_id long, quality int")
    forest = quality.fit(stats, labels)
    rows = quality.score(stats, forest).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    empty = quality.score(quality.statistics_table(docs.limit(0)), quality.fit(stats.limit(0), labels.limit(0)))
    assert empty.columns == ["doc_id", "score"] and empty.isEmpty()


def test_statistics_read_the_whole_text():
    text = "plain words here " * 50_000
    assert quality.statistics(text + "|" * 1000)[quality.STATISTICS.index("bars")] > 0
    assert quality.statistics(None).tolist() == quality.statistics("").tolist() == [0] * len(quality.STATISTICS)


def test_grams_of_long_texts_equal_those_of_one_piece():
    text = "abcdéfg hij" * 60_000
    codes = f" {text} ".encode()
    total = np.zeros(language.DIMS, np.int64)
    for n, salt in ((1, 1), (2, 2), (3, 3)):
        for i in range(len(codes)):
            # a gram that the end cuts short does not count
            if i + n <= len(codes):
                g = 0
                for c in codes[i:i + n]:
                    g = (g * 257 + c) & 0xFFFFFFFF
                g = ((g + (salt * 0x9E3779B1 & 0xFFFFFFFF)) * 0x85EBCA6B) & 0xFFFFFFFF
                total[(g ^ (g >> 15)) % language.DIMS] += 1
    assert (language.gram_counts(text) == total).all()


def test_op7_held_out_accuracy_and_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op7_language(spark, SF).join(docs.select("doc_id", "lang", "text"), "doc_id").toPandas()
    held = got[got["held_out"]]
    assert len(got) == docs.count() and (held["lang_pred"] == held["lang"]).mean() > 0.98
    model = language.fit(docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    for row in got.head(40).itertuples():
        counts = language.gram_counts(row.text)
        dense = np.log1p(counts) * model.idf
        cosine = model.centroids @ dense / np.linalg.norm(dense)
        assert row.lang_pred == model.languages[int(np.argmax(cosine))] and row.score == pytest.approx(cosine.max(), abs=1e-5)


def test_language_odd_rows(spark):
    train = spark.createDataFrame(
        [(i, t * 5, lang) for i in range(30) for t, lang in (("the cat and the dog ", "en"), ("der Hund und die Katze ", "de"))],
        "doc_id long, text string, lang string")
    model = language.fit(train)
    docs = spark.createDataFrame(ODD, DOCS)
    rows = language.predict(docs, model, keep=("doc_id",)).collect()
    assert [r.lang_pred for r in rows if r.doc_id in (1, 2, None)] == ["und"] * 4
    kept = language.accepted(docs.unionByName(docs.limit(1).select(
        F.lit(9).cast("long").alias("doc_id"), F.lit("the dog and the cat").alias("text"), "lang", "source", "score", "stats", "held_out")), model)
    assert kept.columns == docs.columns and 9 in [r.doc_id for r in kept.collect()]
    nothing = language.fit(train.limit(0))
    assert {r.lang_pred for r in language.predict(docs, nothing).collect()} == {"und"}
    assert language.predict(docs.limit(0), model).isEmpty()


def test_unlike_texts_are_rejected(spark):
    train = spark.createDataFrame([(i, "the cat and the dog sat on the mat with this and that " * 3, "en") for i in range(40)],
                                  "doc_id long, text string, lang string")
    docs = spark.createDataFrame([(1, "qqqq zzzz xxxx jjjj qzqz " * 6), (2, "the cat sat with the dog on that mat " * 4)], "doc_id long, text string")
    got = {r.doc_id: r.rejected for r in language.predict(docs, language.fit(train)).collect()}
    assert got == {1: True, 2: False}


def test_signs_are_no_letters_and_no_model_rejects_no_text(spark):
    docs = spark.createDataFrame([(1, "½ ² Ⅷ"), (2, "½ a"), (3, None), (4, "12 34 __"), (5, "словo")], "doc_id long, text string").withColumn(
        "lang", F.lit(None).cast("string"))
    empty = language.fit(docs.filter("lang IS NOT NULL"))
    got = {r.doc_id: (r.lang_pred, r.rejected) for r in language.predict(docs, empty).collect()}
    assert got == {1: ("und", True), 2: ("und", False), 3: ("und", True), 4: ("und", True), 5: ("und", False)}
    assert sorted(r.doc_id for r in language.accepted(docs, empty).collect()) == [2, 5]
    assert all(language.gram_counts(t) is None for t in ("½ ² Ⅷ", "", None, "1_2")) and language.gram_counts("ª") is not None
