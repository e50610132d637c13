"""The corpus pipeline: its rows against SQL, and each stage on odd input."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_run_equals_sql(spark, data, same):
    same(cp.run(spark, data), cp.ORACLE_SQL)


@pytest.mark.parametrize("name,stage", cp.STAGES)
def test_stage_on_odd_rows(name, stage, spark, data):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "x " * 30_000, "en", None, 60_000), (3, "x " * 30_000, "en", None, 60_000), (None, "a b", None, "s", 3)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("n_words", F.lit(1))
    out = stage(spark, docs, data)
    assert out.count() <= len(rows)
    if name != "mix_sources":
        assert out.columns == cp.COLUMNS
    assert stage(spark, docs.limit(0), data).count() == 0


def test_join_stage_keeps_one_of_each_group(spark, data):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(5, text, None, None, 1), (4, text + " end", None, None, 1), (9, "different words stand in this text", None, None, 1), (9, "different words stand in this text", None, None, 1)]
    assert sorted(r.doc_id for r in cp.apply_ngram_join(spark, spark.createDataFrame(rows, DOCS), data).collect()) == [4, 9]


def test_join_stage_tells_rows_of_one_id_apart(spark, data):
    a, b = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    rows = [(4, a, None, None, 1), (9, a + " end", None, None, 1), (9, b, None, None, 1), (None, b, None, None, 1), (None, "c " + b[:90], None, None, 1), (None, "c " + b[:90], None, None, 1)]
    out = cp.apply_ngram_join(spark, spark.createDataFrame(rows, DOCS), data).collect()
    assert sorted((r.doc_id or 0, r.text) for r in out) == [(0, "c " + b[:90]), (4, a), (9, b)]


def test_clean_documents_come_through_every_stage(spark, data):
    """Different texts without repeats, shared lines or benchmark passages stay as they are; beside
    them stands what each stage acts on."""
    from tests.llm.test_operators import words

    bench = spark.read.parquet(f"{data}/benchmark.parquet").where("length(text) > 100").first().text
    clean = {k: "\n".join(" ".join(words(9000 + 10 * k + j, 40)) for j in range(4)) for k in range(24)}
    loop, near = "the same three words " * 60, clean[3].rsplit(" ", 1)[0] + " changed"
    rows = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in clean.items()]
    dirty = {"quality_rules": (100, loop), "ngram_join": (101, near), "decontaminate": (102, clean[5][:300] + " " + bench)}
    for name, stage in cp.STAGES[:-1]:
        more = [(*dirty[name], "en", "s0", 1)] if name in dirty else [(200 + k, f"shared line\n{clean[k]} x{k}", "en", "s0", 1) for k in range(12)]
        out = {r.doc_id: r.text for r in stage(spark, spark.createDataFrame(rows + more, DOCS).repartition(3), data).collect()}
        assert {k: out.get(k) for k in clean} == clean, name
        if name == "line_dedup":
            assert all(out[200 + k] == f"{clean[k]} x{k}" for k in range(12))
        elif name == "decontaminate":
            assert bench[20:80] not in out[102]
        else:
            assert dirty[name][0] not in out
    mix = {r.doc_id: r.taken for r in cp.apply_mixing(spark, spark.createDataFrame(rows, DOCS), data).collect()}
    sizes = {k: len(t.split()) for k, t in clean.items()}
    assert all(0 < n <= 3 * sizes[k] for k, n in mix.items()) and abs(sum(mix.values()) - sum(sizes.values())) <= 3
