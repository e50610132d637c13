"""Memos, stances, views and option marks by hand."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from marketloom.operators import memos
from marketloom.operators import options as opt


def test_memos_need_a_source_of_their_own_symbol(spark):
    cite = [{"source_id": "N1", "claim": "c"}, {"source_id": "N2"}, "N1", 7]
    raw = [
        (1, "A", json.dumps({"stance": "ATTRACTIVE", "confidence": 3, "horizon_days": 500, "citations": cite})),
        (2, "B", json.dumps({"stance": "avoid", "confidence": 0.4, "citations": cite})),
        (3, "A", json.dumps({"stance": "buy", "citations": cite})),
        (4, "A", json.dumps({"stance": "neutral", "confidence": "high"})),
        (5, "A", "{"), (6, "A", None), (7, "A", "[1]"), (8, "A", "{}"),
    ]
    catalog = spark.createDataFrame([("A", "N1"), ("A", "N1"), ("C", "N2")], "symbol string, source_id string")
    out = {r.memo_id: r for r in memos.validate_memos(spark.createDataFrame(raw, "memo_id int, symbol string, raw string"), catalog).collect()}
    assert (out[1].stance, out[1].confidence, out[1].horizon_days, out[1].citations) == ("attractive", 1.0, 180, ["N1", "N1"])
    assert out[2].errors == ["directional memo has no verified citation"] and out[2].stance is None
    assert out[3].errors == ["invalid stance"] and out[4].errors == ["invalid confidence or horizon"]
    assert all(out[k].errors == ["memo missing"] for k in (5, 6, 7))
    assert (out[8].stance, out[8].confidence, out[8].horizon_days, out[8].citations) == ("neutral", 0.0, 21, [])


def test_stances_are_cut_before_they_are_checked(spark):
    good = {"symbol": " aa ", "direction": "long", "conviction": 2, "horizon_days": 99}
    body = {"thesis": "t", "stances": [{"symbol": "1"}] * 11 + [good, good], "watchlist": ["b", "B", "known", None] + [f"W{c}" for c in "abcdefghij"]}
    raw = spark.createDataFrame([(1, "short_term", json.dumps(body)), (2, "north_star", json.dumps(body)), (3, "short_term", "{}")], "id int, tier string, raw string")
    out = {r.id: r for r in memos.validate_stances(raw, spark.createDataFrame([("KNOWN",)], "symbol string")).collect()}
    assert [tuple(s) for s in out[1].stances] == [("AA", "long", 1.0, 40)]
    assert out[1].watchlist == ["B", "WA", "WB", "WC", "WD", "WE", "WF", "WG"]
    assert (out[2].stances, out[2].watchlist) == ([], []) and 3 not in out


def test_veto_reason(spark):
    rows = [(["  stale data (5d): x", "b"],), (["cap: 1"],), ([],), (None,), (["x" * 90],)]
    out = [r.v for r in spark.createDataFrame(rows, "a array<string>").select(memos.veto_reason(F.col("a")).alias("v")).collect()]
    assert out == ["stale data", "cap", None, None, "x" * 60]


def test_marks_of_options(spark):
    d = dt.date(2024, 3, 1)
    bars = spark.createDataFrame([("A", d, 12.5)], "symbol string, d date, close double")
    chain = spark.createDataFrame([("A", d, dt.date(2024, 6, 21), "C", 10.0, 3.0), ("A", d, dt.date(2024, 6, 21), "P", 10.0, 0.0)], "symbol string, d date, expiry date, kind string, strike double, bid double")
    names = ["A240621C00010000", "A240621P00010000", "A240621C00011000", "A", None]
    p = spark.createDataFrame([("A", n, d) for n in names], "symbol string, option_symbol string, d date")
    out = {r.option_symbol: r.mark for r in opt.mark_options(p, chain, bars).collect()}
    assert out == {names[0]: 3.0, names[1]: 0.01, names[2]: 1.5, "A": None, None: None}


def test_marks_take_one_shuffle_by_contract(spark):
    """The highest bid of the last day before, also if lower than older ones; a null bid counts as
    none; of positions without a contract or a day nothing is lost."""
    day = lambda k: dt.date(2024, 3, k)
    x = dt.date(2024, 6, 21)
    bars = spark.createDataFrame([("A", day(1), 12.5), ("A", day(3), 13.5)], "symbol string, d date, close double")
    quotes = [(1, 9.0), (2, 3.0), (2, 4.0), (2, None), (4, None), (None, 7.0)]
    chain = spark.createDataFrame([("A", k and day(k), x, "C", 10.0, b) for k, b in quotes], "symbol string, d date, expiry date, kind string, strike double, bid double")
    name = "A240621C00010000"
    rows = [(0, "A", name, None)] + [(k, "A", name, day(k)) for k in range(1, 6)] + [(6, "A", "A240231C00010000", day(2)), (7, "A", "A", None), (8, None, name, day(3)), (9, "A", None, day(2))]
    marked = opt.mark_options(spark.createDataFrame(rows, "id int, symbol string, option_symbol string, d date"), chain, bars)
    assert {r.id: r.mark for r in marked.collect()} == {0: None, 1: 9.0, 2: 4.0, 3: 4.0, 4: 3.5, 5: 3.5, 6: None, 7: None, 8: None, 9: None}
    plan = marked._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Window") == 3 and "max(bid" not in plan  # contracts, and two levels for the prices


def test_delta_at_the_money(spark):
    x = spark.range(1).select(opt.call_delta(F.lit(100.0), F.lit(100.0), F.lit(0.2), F.lit(1.0)).alias("a"), opt.call_delta(F.lit(100.0), F.lit(100.0), F.lit(0.0), F.lit(1.0)).alias("b")).first()
    assert x.a == pytest.approx(0.617911, abs=1e-6) and x.b == 0.0


def test_a_hypothesis_acts_from_the_next_whole_hour(spark):
    at = dt.datetime(2024, 1, 1, 9, 0, 0)
    stance = [("A", "long", 0.5, 4), ("B", "long", 0.5, 4), ("A", "avoid", 0.0, 4)]
    h = spark.createDataFrame([(at, 1, stance), (at + dt.timedelta(microseconds=1), 2, [("A", "avoid", 1.0, 9)])], "activated_at timestamp, id int, stances array<struct<symbol:string,direction:string,conviction:double,horizon_days:int>>")
    decisions = spark.createDataFrame([(at - dt.timedelta(hours=1),), (at,), (at + dt.timedelta(hours=1),)], "as_of timestamp")
    prices = spark.createDataFrame([("A", dt.date(2023, 12, 1), 10.0, None)], "symbol string, d date, close double, atr_pct double")
    out = sorted((r.as_of.hour, r.symbol, r.id, r.direction, round(r.expected_return, 6)) for r in memos.hypothesis_stances(h, decisions, prices).collect())
    assert [x[1:] for x in out] == [("A", 1, "long", 0.01), ("A", 2, "avoid", -0.03)]


def test_texts_end_before_the_watchlists_are_joined(spark):
    raw = spark.createDataFrame([(1, "short_term", "{}")], "id int, tier string, raw string")
    plan = memos.validate_stances(raw, spark.createDataFrame([("A",)], "symbol string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "variant" not in plan.split("Join LeftOuter")[0]
