"""The registry: nodes that fail alone, versions, roles; what states do to coverage and fusion."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketloom.operators import families, nodes

D = dt.date(2024, 1, 2)
SIGNAL = "as_of date, symbol string, direction string, score double, confidence double, horizon_days int, expected_return double"


@pytest.fixture
def panel(spark):
    return spark.createDataFrame([(D, "A", "neutral", False), (D, "B", "neutral", False), (D, "F", "neutral", True), (D, "N", None, False)], "as_of date, symbol string, regime string, is_fund boolean")


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], "node_id string, regime string, multiplier double")


def say(spark, *rows):
    return spark.createDataFrame([(D, *r) for r in rows], SIGNAL)


def registry(spark, broken: bool):
    reg = nodes.Registry()
    reg.node("momentum")(lambda p: say(spark, ("A", "long", 0.5, 0.8, 20, 0.1), ("F", "long", 0.5, 0.8, 20, 0.1)))
    reg.node("quality_value")(lambda p: (say(spark, ("A", "avoid", 0.4, 0.5, 40, 0.02)), p.where("symbol <> 'N'").select("as_of", "symbol")))
    reg.node("veto", role="filter")(lambda p: p.select("as_of", "symbol", F.lit(True).alias("passes")))
    if broken:
        reg.node("reversal")(lambda p: p.select("no_such_column"))
        reg.node("gap")(lambda p: 1 / 0)
        reg.node("company_catalyst")(lambda p: p.select("as_of", "symbol"))  # columns are missing
    return reg


def test_broken_nodes_leave_the_others_as_they_are(spark, panel, none):
    whole, part = registry(spark, False).run(panel), registry(spark, True).run(panel)
    assert {k for k, v in part.node_states.items() if v == "blocked"} == set(part.errors) == {"reversal", "gap", "company_catalyst"}
    assert "ZeroDivisionError" in part.errors["gap"] and set(part.others) == {"veto"}
    rows = [sorted(families.fuse(x, panel, none).collect()) for x in (whole, part)]
    assert rows[0] == rows[1]
    states = {(r.node_id, r.symbol): r.state for r in nodes.node_grid(part, panel).collect()}
    assert states["gap", "A"] == "blocked" and states["momentum", "A"] == "running" and states["momentum", "B"] == "verified_neutral"
    assert (states["quality_value", "B"], states["quality_value", "N"]) == ("verified_neutral", "unavailable") and len(states) == 5 * 4


def test_values_by_hand(spark, panel, none):
    out = {r.symbol: r for r in families.fuse(registry(spark, False).run(panel), panel, none).collect()}
    a = out["A"]
    up, down = 0.20 * 0.4 * 0.4 + 0.15 * 0.45 * 0.10, 0.15 * 0.2
    assert (a.price_value, a.quality_value, a.context_value) == pytest.approx((0.16, -0.2, 0.045))
    assert a.raw == pytest.approx(up - down) and a.conflict == pytest.approx(1 - 0.5 * 2 * min(up, down) / (up + down))
    assert a.coverage == pytest.approx(0.20 * 0.4 + 0.15 * 1 + 0.15 * 0.45)
    mass = 0.2 * 0.4 * 0.8, 0.15 * 1.0 * 0.5, 0.15 * 0.45
    assert a.gross == pytest.approx((0.1 * mass[0] - 0.02 * mass[1]) / sum(mass)) and a.net == pytest.approx(a.gross - 0.0016)
    assert a.horizon_days == 20 and a.final == pytest.approx(a.production - 0.0016 / max(abs(a.gross), 0.005) * 0.01)
    # a fund has no company families: price and context at half each
    f = out["F"]
    assert f.quality_value is None and f.raw == pytest.approx(0.5 * 0.16 + 0.5 * 0.045)
    # no evidence at all, no regime: nothing is made up
    assert (out["N"].raw, out["N"].final) == (0.0, None) and out["B"].raw > 0 and out["B"].final is None


def test_reliability_by_regime_and_its_bounds(spark, panel):
    m = spark.createDataFrame([("momentum", None, 0.1), ("momentum", "neutral", 9.0), ("reversal", None, 0.1)], "node_id string, regime string, multiplier double")
    by = {r.node_id: r.by for r in families.reliability(m).collect()}
    assert by == {"momentum": {"*": 0.5, "neutral": 1.5}, "reversal": {"*": 0.25}}
    out = {r.symbol: r.price_value for r in families.fuse(registry(spark, False).run(panel), panel, m).collect()}
    assert out["A"] == pytest.approx(0.16 * 1.5)


def test_switched_off_nodes_give_their_share_away(spark, panel, none):
    off = ("reversal", "gap", "vol_contraction", "momentum")
    assert families.priors(off)["price"] == {} and sum(families.priors(("insider",))["catalyst"].values()) == pytest.approx(1)
    done = registry(spark, False).run(panel, disabled=("momentum",))
    assert done.node_states["momentum"] == "human_disabled"
    assert {r.symbol: r.price_value for r in families.fuse(done, panel, none, ("momentum",)).collect()}["A"] is None


def test_versions_stand_once_and_can_be_pinned(spark, panel):
    reg = nodes.Registry()
    reg.node("gap", "1")(lambda p: say(spark, ("A", "long", 0.1, 1.0, 5, 0.0)))
    reg.node("gap", "2")(lambda p: say(spark, ("A", "long", 0.2, 1.0, 5, 0.0)))
    with pytest.raises(ValueError, match="there already"):
        reg.node("gap", "2")(lambda p: p)
    assert reg.run(panel).signals.first().score == 0.2 and reg.run(panel, pinned={"gap": "1"}).signals.first().score == 0.1
    assert reg.run(panel, pinned={"gap": "7"}).node_states == {"gap": "blocked"}
    with pytest.raises(ValueError, match="no role"):
        reg.node("x", role="boss")(lambda p: p)
