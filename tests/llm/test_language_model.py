"""The language model: n-grams stay apart, every language is calibrated."""

from __future__ import annotations

import numpy as np

from marketloom.llm import language_id


def test_model_grows_with_distinct_ngrams(spark):
    """More distinct trigrams than 18 bits tell apart, each counted once and found alone."""
    r = np.random.default_rng(5)
    letters = np.array([chr(c) for c in range(0x4E00, 0x9F00)])
    texts = ["".join(letters[r.integers(0, len(letters), 20_000)]) for _ in range(20)]
    plain = np.unique(np.concatenate([language_id.trigrams(t) for t in texts]), return_counts=True)
    model = language_id.train(spark.createDataFrame([(t, "zh") for t in texts], "text string, lang string"))
    k, n, _ = model.tables["zh"]["tri"]
    assert len(plain[0]) > 1 << 18 and len(k) == len(plain[0])
    assert (model._find((k, n, n), language_id.key(plain[0]))[0] == plain[1]).all()
    unseen = language_id.trigrams("".join(letters[r.integers(0, len(letters), 5_000)]))
    unseen = unseen[~np.isin(unseen, plain[0])]
    assert (model._find((k, n, n), language_id.key(unseen))[0] == 0).all()


def test_many_and_rare_languages(spark):
    """More than 128 languages, and rare ones that a sample of all rows would miss."""
    rows = [(f"common words number {k} stand {k * 7} here", "en") for k in range(4000)]
    rows += [(f"mot {chr(97 + k % 26)}{chr(97 + k // 26)} {x} rare", f"l{k}") for k in range(140) for x in ("un", "deux", "trois")]
    model = language_id.train(spark.createDataFrame(rows, "text string, lang string"))
    assert len(model.languages) == 141 and np.isfinite(model.limits).all()


def test_calibration_rows_are_left_out_of_the_counts(spark, monkeypatch):
    """A common language is calibrated on rows that it does not count, a rare one on its own."""
    monkeypatch.setattr(language_id, "CALIBRATION_ROWS", 20)
    monkeypatch.setattr(language_id, "LEAST_ROWS", 10)
    rows = [(chr(0x4E00 + 3 * k) + chr(0x4E01 + 3 * k) + chr(0x4E02 + 3 * k), "zh") for k in range(60)]
    rows += [(f"mot {x}", "fr") for x in ("un", "deux", "trois")]
    model = language_id.train(spark.createDataFrame(rows, "text string, lang string"))
    found = [model._find(model.tables["zh"]["tri"], language_id.key(language_id.trigrams(t)))[0].max() for t, lang in rows if lang == "zh"]
    assert sorted(found) == [0.0] * 10 + [1.0] * 50
    assert (model._find(model.tables["fr"]["tri"], language_id.key(language_id.trigrams("mot deux")))[0] > 0).all()
    assert np.isfinite(model.limits).all()


def test_the_query_learns_from_every_row(spark, tmp_path, monkeypatch):
    """Nothing is set apart for calibration and no number of rows bounds it."""
    monkeypatch.setattr(language_id, "CALIBRATION_ROWS", 20)
    monkeypatch.setattr(language_id, "LEAST_ROWS", 10)
    models, fitted, train, fit = [], [], language_id.train, language_id.Verdicts.fit
    monkeypatch.setattr(language_id, "train", lambda *a, **k: models.append(train(*a, **k)) or models[0])
    monkeypatch.setattr(language_id.Verdicts, "fit", lambda self, sums: fitted.append(sums.where("k = 0").groupBy().sum("value").first()[0]) or fit(self, sums))
    text = lambda k: f"{chr(0x4E00 + 3 * k)}{chr(0x4E01 + 3 * k)}{chr(0x4E02 + 3 * k)}"
    docs = spark.createDataFrame([(k, text(k), "zh") for k in range(200)], "doc_id long, text string, lang string").withColumn("held_out", language_id.held_out())
    docs.drop("held_out").write.parquet(f"{tmp_path}/documents.parquet")
    assert language_id.query(spark, str(tmp_path)).count() == 200
    learned = [r.text for r in docs.where("not held_out").collect()]
    tri = models[0].tables["zh"]["tri"]
    assert len(learned) > 100 and all((models[0]._find(tri, language_id.key(language_id.trigrams(t)))[0] > 0).all() for t in learned)
    assert fitted == [len(learned) * language_id.UNIT] and np.isfinite(models[0].limits).all()
