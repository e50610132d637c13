"""Every query against its SQL, imports without a session, and the no-lookahead rule."""

from __future__ import annotations

import datetime as dt
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from marketloom import catalog
from marketloom.operators import evaluation, fusion, joins, signals, sizing, stats
from marketloom.operators import indicators as ind


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(name, spark, data, same):
    same(catalog.QUERIES[name](spark, data), catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_has_rows(name, spark, data):
    assert catalog.QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "score" in df.columns


def test_imports_without_a_session():
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=__spark_entry__.__file__.rpartition("/")[0])
    assert out.returncode == 0, out.stderr


def wave(n: int = 320, symbols=("AAA", "BBB", "ALL")):
    """Weekday bars: a drift and a sine, volumes that differ."""
    import math

    rows = []
    for j, s in enumerate(symbols):
        px, d, i = 100.0, dt.date(2020, 1, 1), 0
        while i < n:
            d += dt.timedelta(days=1)
            if d.weekday() > 4:
                continue
            px *= 1 + 0.002 * (j + 1) / 3 + 0.005 * math.sin(0.7 * i + j)
            rows.append((s, d, px * 0.999, px * 1.01, px * 0.99, px, 1e6 + 1000.0 * (i % 7)))
            i += 1
    return rows


BARS = "symbol string, d date, open double, high double, low double, close double, volume double"
PANELS = {
    "returns": ind.returns, "sma": ind.sma, "atr": ind.atr_pct, "rsi": ind.rsi, "vol": ind.realized_vol, "volume_z": ind.volume_z,
    "breakout": ind.breakout, "range_gap": ind.range_gap, "vol_ratio": ind.vol_ratio, "band": ind.band_pos,
    "signals": lambda b: signals.price_signals(b).withColumnRenamed("as_of", "d"),
}


@pytest.mark.parametrize("name", sorted(PANELS))
def test_no_lookahead(name, spark):
    """Deleting later bars changes nothing before them."""
    rows = wave()
    cut = dt.date(2021, 2, 1)
    whole = PANELS[name](spark.createDataFrame(rows, BARS)).where(F.col("d") <= F.lit(cut))
    part = PANELS[name](spark.createDataFrame([r for r in rows if r[1] <= cut], BARS))
    key = lambda r: str(r)
    assert sorted(whole.collect(), key=key) == sorted(part.collect(), key=key)


@pytest.mark.parametrize("name", ["rsi", "signals"])
def test_partitions_do_not_matter(name, spark):
    bars = spark.createDataFrame(wave(), BARS)
    one, many = PANELS[name](bars.repartition(1)), PANELS[name](bars.repartition(7))
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


def test_reversal_fires_on_a_fall_in_an_uptrend(spark):
    rows, px = [], 100.0
    for i in range(230):
        px *= 1.004 + (0.001 if i % 2 else -0.001) if i < 225 else 0.985
        rows.append(("AAA", dt.date(2020, 1, 1) + dt.timedelta(days=i), px, px * 1.01, px * 0.99, px, 1.0))
    out = signals.price_signals(spark.createDataFrame(rows, BARS)).where("node_id = 'reversal'").collect()
    assert out and all(r.direction == "long" and 0 < r.score <= 1 and r.downside < 0 for r in out)


def test_missing_evidence_gives_no_weight_away(spark):
    d = dt.date(2020, 1, 1)
    grid = spark.createDataFrame([(d, "AAA", 300), (d, "BBB", 300)], "as_of date, symbol string, n_bars int")
    rows = [(d, "AAA", "momentum", "long", 0.5, 1.0, 20, 0.02), (d, "BBB", "momentum", "long", 0.5, 1.0, 20, 0.02), (d, "BBB", "reversal", "avoid", 0.5, 1.0, 5, 0.02)]
    s = spark.createDataFrame(rows, "as_of date, symbol string, node_id string, direction string, score double, confidence double, horizon_days int, expected_return double")
    out = {r.symbol: r for r in fusion.fuse(s, grid).collect()}
    assert out["AAA"].raw == pytest.approx(0.2 * 0.4 * 0.5) and out["AAA"].conflict == 1
    assert out["BBB"].raw == pytest.approx(0.2 * (0.4 - 0.2) * 0.5) and out["BBB"].conflict < 1


def test_conflict_never_rescues_a_negative_case(spark):
    d = dt.date(2020, 1, 1)
    grid = spark.createDataFrame([(d, "AAA", 300)], "as_of date, symbol string, n_bars int")
    rows = [(d, "AAA", "momentum", "avoid", 0.5, 1.0, 20, 0.02), (d, "AAA", "gap", "long", 0.5, 1.0, 5, 0.02)]
    s = spark.createDataFrame(rows, "as_of date, symbol string, node_id string, direction string, score double, confidence double, horizon_days int, expected_return double")
    r = fusion.fuse(s, grid).first()
    assert r.raw < 0 and r.production == r.raw and r.final is None


def test_labels_by_hand(spark):
    """95 against 90: minus 5 per cent absolute, plus 5 in excess."""
    def series(s, last):
        return [(s, dt.date(2020, 1, 1) + dt.timedelta(days=i), 1.0, 1.0, 1.0, 100.0 if i < 5 else last, 1.0) for i in range(6)]

    r = evaluation.dual_labels(spark.createDataFrame(series("AAA", 95.0), BARS), spark.createDataFrame(series("ALL", 90.0), BARS), (5,)).orderBy("d").first()
    assert r.abs5 == pytest.approx(-0.05) and r.excess5 == pytest.approx(0.05)
    assert not r.beats5 and r.leads5


def test_folds_are_purged(spark):
    days = spark.range(400).select(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    folds = sorted(evaluation.walk_forward(days).collect())
    assert folds[0].test_start == 180 and folds[-1].test_end == 340
    assert all(f.train_end == f.test_start - 22 for f in folds)
    assert all(a.test_end == b.test_start for a, b in zip(folds, folds[1:], strict=False))


def test_average_ranks_share_ties(spark):
    x = spark.createDataFrame([(1, 5.0), (1, 5.0), (1, 7.0), (1, 1.0)], "d int, v double").withColumn("r", ind.average_rank("v", "d"))
    assert sorted(r.r for r in x.collect()) == [1.0, 2.5, 2.5, 4.0]


def test_capacity_drops_the_weakest(spark):
    batch = spark.createDataFrame([(1, k, n, 12.0) for k, n in ((1, 10.0), (2, 8.0), (3, 6.0))], "cycle int, rank int, notional double, cap double")
    out = sorted(sizing.fit_capacity(batch, "cap").collect())
    assert [r["rank"] for r in out] == [1, 2] and sum(r.order_notional for r in out) == pytest.approx(12.0)


def test_streaks_reset(spark):
    x = spark.createDataFrame([("a", k, f) for k, f in enumerate([True, True, False, True, None, True])], "s string, k int, f boolean")
    assert [r.streak for r in joins.streaks(x, ["s"], "k", F.col("f")).orderBy("k").collect()] == [1, 2, 0, 1, 0, 1]


def test_insert_ignore_keeps_the_first(spark):
    base = spark.createDataFrame([("a", 1)], "k string, v int")
    delta = spark.createDataFrame([("a", 9), ("b", 3), ("b", 2)], "k string, v int")
    assert sorted(map(tuple, joins.insert_ignore(base, delta, ["k"], [F.col("v")]).collect())) == [("a", 1), ("b", 2)]


def test_multipliers_hold_below_the_minimum(spark):
    card = spark.createDataFrame([("few", 49, 3.0), ("many", 500, 0.2), ("bad", 500, -9.0)], "node string, n int, information_ratio double")
    out = {r.node: r.multiplier for r in stats.multipliers(card).collect()}
    assert out["few"] == 1.0 and 1.0 < out["many"] <= 1.5 and out["bad"] == 0.25


def test_bootstrap_is_deterministic(spark):
    r = spark.range(60).select(F.col("id").alias("i"), (F.col("id") % 7 - 3).cast("double").alias("x")).select("i", (F.col("x") / 100).alias("r"))
    a, b = (sorted(map(tuple, sizing.block_bootstrap(x, 20, 3).collect())) for x in (r.repartition(1), r.repartition(5)))
    assert len(a) == 20 and [tuple(map(lambda v: round(v, 12), t)) for t in a] == [tuple(map(lambda v: round(v, 12), t)) for t in b]
