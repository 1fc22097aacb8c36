"""Language and quality: held-out accuracy, and odd rows."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracegrain.llm import langid, quality, queries

SF = "/root/testdata/sf0.001"


def test_language_of_held_out_documents(spark):
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = queries.op4_language_id(spark, SF).join(truth, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 20
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def plain_grams(text):
    """Bigrams and trigrams inside words, with a boundary on either side."""
    words = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    return [words[i : i + n] for n in (2, 3) for i in range(len(words) - n + 1) if words[i : i + n].strip() and (n == 2 or words[i + 1] != " ")]


def test_filters_decide_as_sets_do(spark):
    """The same rule with plain sets of n-grams in place of bit-sliced filters."""
    rows = [(r.doc_id, r.text or "", r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]
    learn = [(t, lang) for i, t, lang in rows if lang is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    counts = {}
    for t, lang in learn:
        counts.setdefault(lang, Counter()).update(plain_grams(t))
    total = {lang: sum(c.values()) for lang, c in counts.items()}
    rate = {lang: {g: n / total[lang] for g, n in c.items()} for lang, c in counts.items()}
    every = Counter()
    for r in rate.values():
        every.update(r)
    profile = {lang: {g for g, x in r.items() if x >= langid.LEAST_RATE and x * len(rate) >= every[g] - 1e-15} for lang, r in rate.items()}
    model = langid.fit(spark.createDataFrame(learn, "text string, lang string"))
    assert set(model.languages) == set(profile)
    shares, has = model.shares([t for _, t, _ in rows])
    predicted = model.predict([t for _, t, _ in rows])[0]
    for (_, t, _), share, letters, lang in zip(rows, shares, has, predicted, strict=True):
        grams = plain_grams(t)
        want = {x: sum(g in p for g in grams) / max(len(grams), 1) for x, p in profile.items()}
        assert letters == any(map(str.isalpha, t))
        assert dict(zip(model.languages, share, strict=True)) == pytest.approx(want, abs=2e-3)
        best = sorted(want.values())[-2:]
        if letters and best[1] - best[0] > 5e-3:
            assert lang == max(want, key=want.get)


def test_language_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op4_language_id(spark, str(tmp_path)).count() == 0


def test_language_of_odd_rows(spark):
    rows = [("the house and the dog", "en"), ("le chien et la maison", "fr"), (None, "fr"), ("", "en"), ("1 2 3", None), ("der Hund", None)]
    df = spark.createDataFrame(rows, "text string, lang string")
    model = langid.fit(df)
    assert set(model.languages) == {"en", "fr"}
    asked = spark.createDataFrame([(None, "a"), ("", "b"), ("12 ?!", "c"), ("le chien " * 50_000, "d"), ("THE DOG", "e"), ("жук", "f")], "text string, score string")
    got = asked.withColumn("p", langid.predictor(spark, model)("text")).collect()
    assert [r.p.lang_pred for r in got][:5] == ["und", "und", "und", "fr", "en"]
    assert got[5].p.lang_pred in model.languages and got[5].p.score == 0
    nobody = langid.fit(df.limit(0))
    assert nobody.predict(["x"]) == (["und"], [0.0], [0.0])


def test_more_languages_than_bits_of_a_word(spark):
    names = [f"l{i:02}" for i in range(70)]
    letters = [chr(0x4E00 + 40 * i) for i in range(70)]
    df = spark.createDataFrame([(c * 3 + " " + c * 2, n) for c, n in zip(letters, names, strict=True)], "text string, lang string")
    model = langid.fit(df)
    assert model.predict([c * 3 for c in letters])[0] == names


def test_false_positives_are_taken_out():
    table = np.full((1, 1 << langid.SLOT_BITS), 3, np.uint64)  # every slot is set for both: hits say nothing
    model = langid.Model(["a", "b"], table, np.ones(2))
    assert model.shares(["some text"])[0].tolist() == [[0, 0]]


def test_quality_of_held_out_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    rows = queries.op10_quality(spark, SF).join(labels, "doc_id").collect()
    good, bad = ([r.score for r in rows if r.held_out and r.quality == q] for q in (1, 0))
    assert len(good) > 10 and len(bad) > 0
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    assert all(r.predicted == (r.score >= 0.3) for r in rows)


def test_summed_equations_are_the_dense_ones(spark):
    """Weights and calibration against one dense solve over the same rows."""
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(["good", "words", "spam!!", "BUY", "tree", "|"], int(rng.integers(3, 60)))), int(rng.integers(0, 2))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int").repartition(5)
    labels = docs.select("doc_id", F.col("y").alias("quality"))
    model = quality.fit(docs, labels)
    key = {r.doc_id: r.k for r in docs.select("doc_id", F.xxhash64("doc_id").alias("k")).collect()}
    x, y = np.array([quality.statistics(t) for _, t, _ in rows]), np.array([q for *_, q in rows], float)
    assert model.mean == pytest.approx(x.mean(0)) and model.scale == pytest.approx(np.where(x.std(0) > 1e-9, x.std(0), 1), rel=1e-6)
    seen = np.array([key[i] % 4 != 0 for i, *_ in rows])
    f, size = model.features(x), quality.FEATURES + 1
    weights = np.linalg.solve(f[seen].T @ f[seen] + quality.RIDGE * np.eye(size) * max(seen.sum(), 1) / size, f[seen].T @ y[seen])
    assert f @ model.weights == pytest.approx(f @ weights, abs=1e-6)
    knots, values = quality.isotonic(model.raw(x)[~seen], y[~seen])
    assert model.knots[0] == pytest.approx(knots) and model.knots[1] == pytest.approx(values)
    kernel = f[:, :-1] @ f[:, :-1].T
    z = np.clip((x - model.mean) / model.scale, -6, 6)
    gauss = np.exp(-((z[:, None] - z[None]) ** 2).sum(2) / (2 * (quality.WIDTH * np.sqrt(z.shape[1])) ** 2))
    assert np.abs(kernel - gauss).mean() < 0.06


def test_quality_of_very_long_texts_and_empty_tables(spark, tmp_path):
    assert np.isfinite(quality.statistics("word " * 1_000_000)).all()
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert queries.op10_quality(spark, str(tmp_path)).count() == 0


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "fine words here", 1), (2, "BAD!! BAD!!", 2), (None, None, 3), (2, "BAD!! BAD!!", 4), (4, "", 5)], "doc_id long, text string, y int")
    labels = spark.createDataFrame([(1, 1, "a"), (2, 0, "b"), (None, 1, "c"), (4, None, "d"), (9, 1, "e")], "doc_id long, quality int, text string")
    model = quality.fit(docs, labels)
    got = docs.select(quality.scorer(spark, model)("text").alias("s")).collect()
    assert len(got) == 5 and all(0 <= r.s <= 1 for r in got)
    none = quality.fit(docs, labels.limit(0))
    assert {r.s for r in docs.select(quality.scorer(spark, none)(F.col("text")).alias("s")).collect()} == {0.5}
    assert docs.limit(0).select(quality.scorer(spark, none)(F.col("text")).alias("s")).count() == 0


def test_isotonic():
    knots, values = quality.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert values.tolist() == [0, 0.5, 1] and knots.tolist() == [1, 2.5, 4]
