"""Intervals, status, dossiers and discovery by hand."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from marketloom.operators import rollups as roll


def test_bootstrap_agrees_with_theory(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0.01, 0.05, 20_000)
    rows = [("a", k, float(v)) for k, v in enumerate(x)] + [("b", 1, 0.5), ("c", 1, None)]
    out = {r.g: r for r in roll.bootstrap_mean(spark.createDataFrame(rows, "g string, id int, v double"), "g", "v", "id").collect()}
    half = 1.2816 * x.std() / len(x) ** 0.5
    assert out["a"].n == len(x) and out["a"].mean == pytest.approx(x.mean())
    assert out["a"].ci_low == pytest.approx(x.mean() - half, abs=half / 4) and out["a"].ci_high == pytest.approx(x.mean() + half, abs=half / 4)
    assert (out["b"].mean, out["b"].ci_low, out["b"].ci_high) == (0.5, 0.5, 0.5) and "c" not in out


def test_poisson_steps_are_a_distribution():
    steps = roll.poisson_steps()
    chances = np.diff([0.0, *steps])
    assert steps[-1] == pytest.approx(1) and (np.arange(len(steps)) * chances).sum() == pytest.approx(1, abs=1e-6)


def test_rollup_takes_the_worst(spark):
    rows = [("r", "a", "ok", "x"), ("r", "b", "degraded", "m"), ("r", "b", "stale", "l"), ("r", "c", None, "n"), ("q", "a", "ok", None)]
    out = {r.run: r for r in roll.status_rollup(spark.createDataFrame(rows, "run string, component string, severity string, message string")).collect()}
    assert (out["r"].status, out["r"].n_components, out["r"].alerts) == ("error", 3, ["b: l", "c: n"])
    assert (out["q"].status, out["q"].alerts) == ("ok", [])


def test_dossiers(spark):
    facts = spark.createDataFrame([("A", 4), ("B", 20)], "symbol string, available_fields long")
    memos = [(1, "A", "fundamental", [], "avoid", ["x", "y"]), (2, "A", "fundamental", [], "attractive", ["x"]), (3, "A", "fundamental", ["bad"], None, None), (4, "A", "other", [], "neutral", [])]
    df = spark.createDataFrame(memos, "memo_id int, symbol string, kind string, errors array<string>, stance string, citations array<string>")
    out = {r.symbol: r for r in roll.dossiers(facts, df).collect()}
    assert (out["A"].quality, out["A"].status) == (0.5, "ready") and (out["B"].quality, out["B"].status) == (1.0, "unsupported")
    again = {r.symbol: r for r in roll.dossiers(facts, df.where("memo_id <> 2")).collect()}
    assert again["A"].source_hash != out["A"].source_hash and again["B"].source_hash == out["B"].source_hash


def test_discovery_prefers_a_direct_stance(spark):
    d = dt.date(2024, 1, 1)
    s = spark.createDataFrame([(d, "A", "m", 0.5), (d, "B", "m", 0.5), (d, "C", "z", 9.0)], "as_of date, symbol string, node string, alpha double")
    m = spark.createDataFrame([("A", "Solar One", 1e5), ("B", "Solar Two", 1e5), ("C", None, None)], "symbol string, name string, dollar_volume double")
    g = spark.createDataFrame([(d, 1.0, ["solar"], ["c"], {"A": -0.1})], "as_of date, confidence double, favored array<string>, avoided array<string>, direct map<string,double>")
    out = {r.symbol: r for r in roll.discovery_ranking(s, {"m": 1.0, "n": 1.0}, m, g).collect()}
    assert out["A"].score == pytest.approx(0.9 * 0.25 + 0.05 - 0.1) and out["B"].score == pytest.approx(0.9 * 0.25 + 0.05 + 0.15) and out["C"].score == pytest.approx(-0.15)
    assert [out[k].rank for k in "BAC"] == [1, 2, 3]
