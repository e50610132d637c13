"""Redaction, contracts, exits and set operations by hand."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from marketloom.operators import contracts, records
from marketloom.operators.joins import latest_at, next_after, within_days


@pytest.mark.parametrize(
    "text,gone,left",
    [
        ("Authorization: Bearer abc.def", "abc.def", ""),
        ("token=hunter2hunter2 ok", "hunter2hunter2", "ok"),
        ("account 12345678 at 10:15", "12345678", "10:15"),
        ("blob " + "A1b2" * 8, "A1b2A1b2", "blob"),
        ("see docs/readme.md 2024", "nothing", "see docs/readme.md 2024"),
    ],
)
def test_redaction(spark, text, gone, left):
    out = spark.createDataFrame([(text,)], "t string").select(records.redact_text(F.col("t")).alias("t")).first().t
    assert gone not in out and left in out


def test_null_values_fail_a_contract(spark):
    df = spark.createDataFrame([(None, 0.5, 5, "long"), (0.2, 0.5, 5, "long")], "score double, confidence double, horizon_days int, direction string")
    assert [r.reasons for r in contracts.check_signals(df).collect()] == [["score"], []]


def test_crossed_quantiles_are_rejected_not_clamped(spark):
    df = spark.createDataFrame([(5, 0.3, 0.2, 0.4, 0.5, "m")], "horizon int, q10 double, q50 double, q90 double, p_positive double, model_id string")
    assert contracts.check_forecasts(df).first().reasons == ["order"]


def test_excess_without_absolute_gain_is_no_vote(spark):
    df = spark.createDataFrame([(-0.01, 0.6, 0.05), (-0.01, 0.4, -0.02), (0.02, 0.6, 0.03)], "q50 double, p_positive double, excess double")
    assert [r.direction for r in contracts.forecast_vote(df).collect()] == ["avoid", "long"]


def days(*values):
    return [("A", dt.date(2020, 1, 1) + dt.timedelta(days=k), float(v)) for k, v in values]


def test_exits_by_stop_and_by_time(spark):
    schema = "symbol string, d date, close double"
    bars = spark.createDataFrame(days((0, 100), (5, 97), (8, 96), (31, 99), (40, 101)), schema)
    out = {r.entry_d.day: r for r in records.first_exit(bars.where("day(d) in (1, 9) and month(d) = 1"), bars).collect()}
    assert out[1].reason == "stop_loss" and out[1].exit == 96.0
    assert out[9].reason == "time_stop" and out[9].exit == 101.0


def test_time_exit_after_a_long_gap(spark):
    """Entries at all places of a bucket leave at the first bar after a gap of any length."""
    bars = spark.createDataFrame(days(*((k, 100) for k in range(60)), (400, 99)), "symbol string, d date, close double")
    out = {r.entry_d: r for r in records.first_exit(bars, bars).collect()}
    assert len(out) == 60 and {(r.exit_d - e).days for e, r in out.items() if (e - dt.date(2020, 1, 1)).days < 30} == {30}
    assert all(r.exit == 99.0 and r.reason == "time_stop" for e, r in out.items() if (e - dt.date(2020, 1, 1)).days >= 30)


def test_as_of_joins_take_the_edge(spark):
    schema = "symbol string, d date, v double"
    history = spark.createDataFrame(days((0, 1), (2, 2), (4, 3)), schema)
    events = spark.createDataFrame(days((2, 0), (3, 0), (9, 0)), "symbol string, d date, x double")
    assert sorted(r.v for r in latest_at(events, history, ["v"], ["symbol"], "d").collect()) == [2.0, 2.0, 3.0]
    assert [r.v for r in next_after(events, history, ["v"], ["symbol"], "d").orderBy("d").collect()] == [3.0, 3.0, None]


def test_interval_join_over_bucket_edges(spark):
    decisions = spark.createDataFrame([("A", dt.datetime(2024, 1, 15))], "symbol string, at timestamp")
    items = spark.createDataFrame([("A", dt.datetime(2024, 1, d), d) for d in range(1, 20)], "symbol string, p timestamp, k int")
    assert sorted(r.k for r in within_days(decisions, items, 7, "symbol", "at", "p").collect()) == list(range(8, 16))


def test_intraday_supersedes_the_day(spark):
    daily = spark.createDataFrame([(dt.date(2024, 1, 1), 1.0), (dt.date(2024, 1, 2), 2.0)], "d date, equity double")
    intraday = spark.createDataFrame([(dt.datetime(2024, 1, 2, 9), 5.0)], "ts timestamp, equity double")
    assert sorted((r.kind, r.equity) for r in records.merge_curves(daily, intraday).collect()) == [("daily", 1.0), ("intraday", 5.0)]


def test_day_digest_of_odd_payloads(spark):
    t = dt.datetime(2024, 1, 2, 9)
    rows = [(t, "paper", "cycle_end", '{"candidates": 3}'), (t, "paper", "cycle_end", "{broken"), (t, "paper", "cycle_end", None), (t, "live", "risk_decision", '{"verdict": "REJECTED", "reasons": []}')]
    rows += [(t, "paper", "risk_decision", f'{{"verdict": "REJECTED", "reasons": ["{r}", "other"]}}') for r in ("stale (5)", "stale: x", "a", "b", "c", "d", "e")]
    audit = spark.createDataFrame(rows, "ts timestamp, mode string, event_type string, payload string")
    orders = spark.createDataFrame([(t + dt.timedelta(days=1), "paper", "filled")], "ts timestamp, mode string, status string")
    out = {(r.day.day, r.mode): r for r in records.day_digest(audit, orders).collect()}
    assert (out[2, "paper"].scans, out[2, "paper"].candidates, out[2, "paper"].top_vetoes) == (3, 3, "stale=2, a=1, b=1, c=1")
    assert set(out) == {(2, "paper"), (3, "paper")} and (out[3, "paper"].filled, out[3, "paper"].top_vetoes) == (1, "")


def test_both_ends_and_differences(spark):
    df = spark.createDataFrame([("g", k, float(v)) for k, v in enumerate([3, 1, 2, 2])] + [("h", 9, 5.0)], "g string, id int, v double")
    got = sorted((r.g, r.end, r["rank"], r.id) for r in records.both_ends(df, ["g"], "v", "id", 2).collect())
    assert got == [("g", "bottom", 1, 1), ("g", "bottom", 2, 3), ("g", "top", 1, 0), ("g", "top", 2, 2), ("h", "bottom", 1, 9), ("h", "top", 1, 9)]
    a, b = (spark.createDataFrame([(x,) for x in xs], "id int") for xs in ([1, 2, 2, None], [2, 3]))
    assert sorted(map(tuple, records.differences(a, b, "id").collect()), key=str) == [(1, "left"), (3, "right"), (None, "left")]


def test_a_fingerprint_changes_with_what_it_covers(spark):
    facts = spark.createDataFrame([("1", dt.date(2020, 1, 1)), ("2", dt.date(2020, 2, 1)), ("2", dt.date(2021, 1, 1))], "cik string, filed date")
    mark = lambda df, day="2020-06-30", h="f1": records.fingerprint(df, "cik", day, h).first()
    one = mark(facts)
    assert (one.owners, one.facts, one.newest) == (2, 2, "2020-02-01") and mark(facts.repartition(7)).sha256 == one.sha256
    assert len({one.sha256, mark(facts, "2021-06-30").sha256, mark(facts, h="f2").sha256, mark(facts.where("cik = '1'")).sha256}) == 4
    assert mark(facts.limit(0)).facts == 0


def test_dual_forecasts_fail_loudly(spark):
    good = dict(horizon=5, abs_q10=-0.1, abs_q50=0.02, abs_q90=0.1, ex_q10=-0.1, ex_q50=0.01, ex_q90=0.1, p_abs=0.6, p_ex=0.95, model_id="m", manifest_id="d", feature_hash="h", as_of=dt.date(2024, 1, 2))
    bad = [dict(horizon=7), dict(ex_q90=float("nan")), dict(abs_q10=float("-inf")), dict(ex_q50=-0.2), dict(p_ex=1.1), dict(manifest_id=" "), dict(model_id=None), dict(abs_q50=None)]
    schema = "horizon int, abs_q10 double, abs_q50 double, abs_q90 double, ex_q10 double, ex_q50 double, ex_q90 double, p_abs double, p_ex double, model_id string, manifest_id string, feature_hash string, as_of date"
    df = spark.createDataFrame([tuple({**good, **x}.values()) for x in [{}, *bad]], schema)
    out = [r.reasons for r in contracts.check_dual_forecasts(df).collect()]
    assert out[0] == [] and all(out[1:]) and out[2] == ["finite_ex_q90"] and out[4] == ["order_ex"]
    assert contracts.check_dual_forecasts(df.limit(1), strict=True).count() == 1
    with pytest.raises(Exception, match="forecast refused"):
        contracts.check_dual_forecasts(df, strict=True).select("reasons").collect()
    day = F.lit("2024-01-02").cast("date")
    assert contracts.admitted(df, day, "m", "h").count() == 1
    assert [contracts.admitted(df, *x).count() for x in ((F.lit("2024-01-03").cast("date"), "m", "h"), (day, "other", "h"), (day, "m", "old"), (day, "", "h"))] == [0] * 4
    vote = contracts.dual_vote(contracts.admitted(df, day, "m", "h")).first()
    assert (vote.direction, round(vote.score, 6), vote.confidence) == ("long", round(0.01 / 0.06, 6), 0.9)


def test_issuer_facts_from_aliases(spark):
    from marketloom.operators import stats

    day = dt.date
    rows = [("1", t, v, f, p, form) for t, v, f, p, form in [
        ("Revenues", 100.0, day(2020, 2, 1), day(2019, 12, 31), "10-K"), ("Revenues", 150.0, day(2021, 2, 1), day(2020, 12, 31), "10-K"), ("Revenues", 999.0, day(2021, 5, 1), day(2021, 3, 31), "10-Q"),
        ("NetIncomeLoss", -10.0, day(2021, 2, 1), day(2020, 12, 31), "10-K"), ("NetCashProvidedByUsedInOperatingActivities", 20.0, day(2021, 2, 1), day(2020, 12, 31), "10-K"),
        ("PaymentsToAcquirePropertyPlantAndEquipment", -5.0, day(2021, 2, 1), day(2020, 12, 31), "10-K"), ("ShortTermBorrowings", 7.0, day(2021, 2, 1), day(2020, 12, 31), "10-K"), ("Assets", 0.0, day(2021, 2, 1), day(2020, 12, 31), "10-K"),
    ]] + [("2", "Other", 1.0, day(2020, 1, 1), day(2019, 1, 1), "10-K")]
    out = {r.cik: r for r in stats.issuer_facts(spark.createDataFrame(rows, "cik string, tag string, value double, filed date, period_end date, form string")).collect()}
    a = out["1"]
    assert (a.revenue, a.revenue_growth, a.free_cash_flow, a.total_debt, a.earnings_quality) == (999.0, 0.5, 15.0, 7.0, 2.0)
    assert a.net_margin == -10 / 999 and a.equity_to_assets is None and a.accrual_ratio is None and a.dilution_rate is None
    assert a.available_fields == 11 and out["2"].available_fields == 0


def test_exits_do_not_compare_prices_made_twice(spark):
    """Closes that differ in the last bit each time they are made, as sums over a shuffle do."""
    noisy = F.udf(lambda x: x * (1 + random.choice((-4e-16, 0.0, 4e-16))), "double").asNondeterministic()
    days = [(f"S{s}", dt.date(2024, 1, 1) + dt.timedelta(days=k), 100.0 + s - (10 if k % 7 == 3 else 0)) for s in range(6) for k in range(60)]
    bars = spark.createDataFrame(days, "symbol string, d date, close double").withColumn("close", noisy("close"))
    out = records.first_exit(bars, bars).collect()
    want = {d: d + dt.timedelta(days=(3 - k) % 7 or 7) for k, d in enumerate(dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(59)) if k % 7 != 3}
    assert sum(r.reason == "stop_loss" for r in out) == 6 * len(want)
    assert all(r.exit_d == want[r.entry_d] for r in out if r.reason == "stop_loss")
