"""Exits, exposure, weights, holdings, displacement, switches and graph samples by hand."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketloom.operators import indicators as ind
from marketloom.operators import joins, panel, sizing, stats

DAY = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(60)]


def test_exit_reasons_take_the_first_word(spark):
    t = spark.createDataFrame([("stop hit",), ("stop",), ("time limit",), ("",), (None,)], "exit_reason string")
    assert {r.reason: r.n for r in stats.exit_reasons(t).collect()} == {"stop": 2, "time": 1, "": 2}


def test_exposure_match(spark):
    curve = spark.createDataFrame([("p", DAY[0], 100.0, 50.0), ("p", DAY[1], 110.0, 0.0), ("p", DAY[2], 120.0, 240.0), ("q", DAY[0], 0.0, 5.0)], "source string, d date, equity double, cash double")
    bench = spark.createDataFrame([(DAY[0], 10.0), (DAY[1], 11.0), (DAY[2], 12.1)], "d date, close double")
    filled = spark.createDataFrame([("p", 55.0), ("p", 165.0)], "source string, notional double")
    out = {r.source: r for r in stats.exposure_match(curve, bench, filled).collect()}
    assert out["p"].matched_return == pytest.approx(1.05 * 1.1 - 1) and out["p"].average_exposure == pytest.approx(0.5)
    assert (out["p"].turnover, out["p"].average_order) == pytest.approx((2.0, 110.0))
    assert (out["q"].matched_return, out["q"].cash_drag, out["q"].turnover) == (0.0, 1.0, 0.0)


def test_regime_multipliers_hold_floor_and_cells(spark):
    rows = [("old", "active", "up", -0.01 - 0.001 * (k % 3), 1.0) for k in range(60)] + [("new", "experimental", "up", -0.01 - 0.001 * (k % 3), 1.0) for k in range(60)]
    rows += [("few", "active", "up", 0.01 + 0.001 * (k % 3), 1.0) for k in range(31)] + [("few", "active", "down", 0.01, 1.0)]
    out = {(r.node, r.regime): r for r in stats.regime_multipliers(spark.createDataFrame(rows, "node string, status string, regime string, ret double, alpha double")).collect()}
    assert (out["old", None].multiplier, out["new", None].multiplier) == (0.5, 0.25) and out["old", None].action == "deemphasized"
    assert (out["few", None].multiplier, out["few", None].action) == (1.0, "hold")
    assert out["few", "up"].multiplier == 1.5 and ("few", "down") not in out


def test_pair_statistics_on_shared_dates(spark):
    rows = [(s, DAY[k], v * (k - 20)) for s, v in (("A", 1.0), ("B", -2.0)) for k in range(40) if (s, k) != ("B", 39)] + [("C", DAY[0], 1.0)]
    h = spark.createDataFrame([("A", 0.6), ("B", 0.3), ("C", 0.1), ("D", 0.0)], "symbol string, weight double")
    out = {(r.a, r.b): r for r in stats.pair_statistics(spark.createDataFrame(rows, "symbol string, d date, r double"), h, last=35).collect()}
    assert set(out) == {("A", "A"), ("A", "B"), ("B", "B")}
    assert out["A", "B"].n == 34 and out["A", "B"].correlation == pytest.approx(-1) and out["A", "A"].weight == 0.6


def test_outside_counts(spark):
    rows = [(1, "A", False, True, "v1"), (2, "A", False, True, "v1"), (3, "A", False, False, "v1"), (4, "A", False, True, "v1"), (5, "A", True, True, "v1"), (6, "A", False, True, "v1"), (7, "A", False, True, "v2"), (9, "A", False, True, "v2"), (10, "A", False, False, None)]
    out = joins.outside_counts(spark.createDataFrame(rows, "cycle int, symbol string, in_target boolean, ranked boolean, version string")).orderBy("cycle").collect()
    assert [r.outside for r in out] == [1, 2, 2, 3, 0, 1, 1, 1, 0]


def test_quotes_by_provider_and_age(spark):
    t = dt.datetime(2024, 1, 2, 12)
    rows = [("A", "x", t - dt.timedelta(minutes=90), 1, 10.0), ("A", "y", t - dt.timedelta(minutes=20), 2, 8.0), ("A", "y", t, 3, 10.0), ("B", "x", t, 4, 5.0), ("C", "z", t, 5, 5.0)]
    q = spark.createDataFrame(rows, "symbol string, provider string, ts timestamp, id int, price double")
    out = {r.symbol: (r.provider, r.price, r.change_pct) for r in joins.resolve_quotes(q, ("x", "y"), 3600).collect()}
    assert out == {"A": ("y", 10.0, 0.25), "B": ("x", 5.0, 0.0)}


def test_switches_and_reset_peak(spark):
    levels = [100, 97, 97, 97, 80, 90, 90, 90, 90, 90, 90, 90, 90, 90, 90, 90]
    curve = spark.createDataFrame([("p", DAY[k], float(v)) for k, v in enumerate(levels)], "source string, d date, equity double")
    out = sizing.switches(curve, F.col("d") == DAY[5]).orderBy("d").collect()
    assert [r.daily_loss for r in out][:6] == [False, True, False, False, True, False]
    assert [k for k, r in enumerate(out) if r.drawdown_halt] == list(range(4, 14))
    assert [r.peak for r in ind.peak_since_reset(curve, F.col("d") == DAY[5]).orderBy("d").collect()][3:6] == [100.0, 100.0, 90.0]


def test_sizing_leaves_out_held_and_scaled_away(spark):
    rows = [("A", 0.01, 0.5, 1.0, None, 1.0, False), ("B", 0.01, 0.5, 1.0, 0.5, 0.5, False), ("C", 0.01, 0.5, 1.0, 0.0, 1.0, False), ("D", 0.01, 0.5, 1.0, None, 1.0, True)]
    c = spark.createDataFrame([(1, *r) for r in rows], "cycle int, symbol string, atr double, score double, coverage double, scale double, size_multiplier double, held boolean")
    assert {r.symbol: r.notional for r in sizing.vol_target(c, 1000.0, 5).collect()} == {"A": 80.0, "B": 20.0}


def test_spend_gate(spark):
    rows = [("m1", "a", 5.0, True), ("m1", "b", 2.0, False), ("m2", "a", 9.0, False), ("m2", "b", 3.0, False)]
    out = {(r.month, r.purpose): r for r in stats.spend(spark.createDataFrame(rows, "month string, purpose string, cost double, cache_hit boolean"), 10.0, 4.0).collect()}
    assert (out["m1", "a"].allowed, out["m1", "b"].allowed, out["m2", "b"].allowed, out["m1", None].allowed, out["m2", None].allowed) == (False, True, False, True, False)
    assert out["m1", None].remaining == 3.0 and out["m1", None].cache_hits == 1 and out[None, None].remaining is None


def test_graph_samples_and_report(spark):
    bars = spark.createDataFrame([(s, DAY[k], 100.0 + k * v) for s, v in (("A", 2.0), ("ALL", 1.0)) for k in range(60)], "symbol string, d date, close double")
    sig = spark.createDataFrame([(DAY[k], "A", "momentum", "long" if k % 2 else "avoid", 0.5, 0.8) for k in range(60)], "as_of date, symbol string, node_id string, direction string, score double, confidence double")
    regime = spark.createDataFrame([(DAY[k], "risk_on") for k in range(60)], "d date, regime string")
    x = panel.graph_samples(sig, regime, bars, "ALL", ("momentum", "gap"))
    out = x.orderBy("as_of").collect()
    assert len(out) == 39 and (out[0].momentum, out[0].gap, out[0].macro_regime) == (-0.4, None, 1.0)
    assert out[0].y5 == pytest.approx(0.10 - 0.05) and out[0].y21 == pytest.approx(0.42 - 0.21)
    rep = {r.horizon: r for r in panel.sealed_report(x, F.col("momentum"), {5: 0.02, 21: 0.04}).collect()}
    assert rep[5].n == 39 - int(39 * 0.85) and 0 <= rep[5].coverage <= 1 and -1 <= rep[21].ic <= 1
