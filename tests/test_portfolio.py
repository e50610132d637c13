"""Order review, average cost and weights by hand."""

from __future__ import annotations

import datetime as dt

import pytest
from marketloom.operators import portfolio as pf

ORDERS = "cycle string, id long, ts timestamp, symbol string, side string, notional double, switched boolean, age int, repeat boolean, equity double, budget double, open_positions int, held double, deployed double, cash double"


def order(k, side="buy", notional=30.0, switched=False, age=1, repeat=False, held=0.0, cycle="a", budget=70.0, open_positions=0, cash=1000.0):
    return (cycle, k, dt.datetime(2024, 1, 1, 0, k), f"S{k}", side, notional, switched, age, repeat, 1000.0, budget, open_positions, held, 0.0, cash)


def test_review_uses_up_the_budget(spark):
    rows = [order(1), order(2), order(3), order(4, "sell"), order(5, age=9), order(6, repeat=True), order(7, switched=True, cycle="b"), order(8, notional=60.0, cycle="c"), order(9, held=78.0, cycle="d"), order(10, open_positions=12, cycle="e")]
    out = {r.id: (r.verdict, r.reason, r.approved) for r in pf.review_orders(spark.createDataFrame(rows, ORDERS)).collect()}
    assert out[1] == ("APPROVED", "", 30.0) and out[2] == ("APPROVED", "", 30.0)
    assert out[3] == ("APPROVED_WITH_SIZE_REDUCTION", "", 10.0)
    assert out[4] == ("APPROVED", "exit", 30.0)
    assert [out[k][1] for k in (5, 6, 7, 9, 10)] == ["stale", "duplicate", "stopped", "single name", "open positions"]
    assert out[8][0] == "REQUIRES_HUMAN_APPROVAL"


def test_average_cost_of_partial_sales(spark):
    d = dt.date(2024, 1, 1)
    rows = [("a", "S", side, q, p, d, k) for k, (side, q, p) in enumerate([("buy", 10.0, 10.0), ("buy", 10.0, 20.0), ("sell", 5.0, 30.0), ("sell", 99.0, 10.0), ("buy", 1.0, 7.0)])]
    out = pf.average_cost(spark.createDataFrame(rows, "account string, symbol string, side string, qty double, price double, d date, seq int")).orderBy("seq").collect()
    assert [r.held for r in out] == pytest.approx([10, 20, 15, 0, 1])
    assert [r.avg_cost for r in out if r.avg_cost] == pytest.approx([10, 15, 15, 7])
    assert [r.realized for r in out] == pytest.approx([0, 0, 75, -75, 0])


def test_weights_stay_under_the_cap(spark):
    rows = [("c", f"S{k}", 1.0 - k / 20, 0.01 + k / 500, 0.02, 1.0) for k in range(15)]
    w = [r.weight for r in pf.target_weights(spark.createDataFrame(rows, "cycle string, symbol string, score double, expected double, atr double, size double")).collect()]
    assert len(w) == 12 and max(w) <= 0.08 + 1e-12 and sum(w) == pytest.approx(0.70, abs=1e-5)


def recurrence(rows):
    """Position, cost and gain after each fill, one after another."""
    held, cost, out = 0.0, 0.0, {}
    for side, q, p, seq in rows:
        gain = 0.0
        if side == "sell":
            sold = min(held, q)
            gain, held = (p - cost) * sold, held - sold
        elif held + q > 0:
            cost, held = (held * cost + q * p) / (held + q), held + q
        held = held if held > 1e-9 else 0.0
        out[seq] = (held, cost if held else None, gain)
    return out


FILL = "account string, symbol string, side string, qty double, price double, d date, seq int"


def test_ten_thousand_half_sales(spark):
    """The scales of a holding's cost fade to 0 here; they are never divided by."""
    held, rows = 0.0, []
    for k in range(20_000):
        side = "sell" if k % 2 else "buy"
        q = held / 2 if k % 2 else 1.0
        held += -q if k % 2 else q
        rows.append((side, q, 10.0 + k % 7, k))
    days = [dt.date(2015, 1, 1) + dt.timedelta(days=k // 8) for k in range(20_000)]
    df = spark.createDataFrame([("a", "S", s, q, p, d, k) for (s, q, p, k), d in zip(rows, days, strict=True)] + [("b", "S", "buy", 2.0, 3.0, days[5], 1), (None, "S", "sell", 2.0, 3.0, days[5], 1)], FILL)
    out = pf.average_cost(df.repartition(5)).collect()
    want = recurrence(rows)
    assert len(out) == 20_002
    for r in out:
        if r.account == "a":
            assert (r.held, r.realized) == pytest.approx((want[r.seq][0], want[r.seq][2]), abs=1e-8)
            assert r.avg_cost == pytest.approx(want[r.seq][1], abs=1e-8)


def test_a_hot_key_is_cut_into_blocks(spark):
    """Random fills of one key over 800 days: the same result by blocks of any length."""
    import random

    r = random.Random(3)
    rows = [("sell" if r.random() < 0.5 else "buy", float(r.randrange(1, 9)), float(r.randrange(5, 50)), k) for k in range(800)]
    df = spark.createDataFrame([("a", "S", s, q, p, dt.date(2020, 1, 1) + dt.timedelta(days=k), k) for s, q, p, k in rows], FILL)
    want = recurrence(rows)
    for days in (7, 90, 10_000):
        for x in pf.average_cost(df, days).collect():
            assert (x.held, x.realized, x.avg_cost) == pytest.approx(tuple(want[x.seq][i] for i in (0, 2, 1)), abs=1e-8)


def test_small_keys_are_stepped_and_hot_ones_scanned_alike(spark):
    """Positions of many keys, stepped, are those by blocks; few fills a key make one shuffle of them."""
    import random

    r = random.Random(5)
    rows = [(r.choice(("a", "b", None)), r.choice("ST"), "sell" if r.random() < 0.5 else "buy", float(r.randrange(0, 9)), float(r.randrange(5, 50)), dt.date(2020, 1, 1) + dt.timedelta(days=r.randrange(400)), k) for k in range(900)]
    df = spark.createDataFrame(rows, FILL)
    one, two, mixed = ({x.seq: x for x in pf.average_cost(df, 30, most).collect()} for most in (10**6, 0, 150))
    assert len(one) == len(two) == len(mixed) == 900
    for k, x in one.items():
        for c in ("held", "avg_cost", "sold", "realized", "entry_price"):
            assert two[k][c] == pytest.approx(x[c], abs=1e-8) and mixed[k][c] == pytest.approx(x[c], abs=1e-8)
    plan = pf.average_cost(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 1 and "Join" not in plan
