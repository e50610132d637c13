"""Cross-sectional signals from daily bars.

All price signals come out of one pass: the panel carries every indicator over the one
window of a symbol's bars, each rule makes a struct or null, and the structs are exploded.
Union branches that would each compute the panel again are thereby avoided.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.columns import full, squash
from marketloom.operators import indicators as ind
from marketloom.sources.fixtures import BENCHMARK

#: Horizons in days and the factors that turn score into expected return.
HORIZON = {"momentum": 20, "reversal": 5, "sector_rotation": 20, "gap": 5, "vol_contraction": 20}
RETURN_FACTOR = {"momentum": 0.5, "sector_rotation": 0.4, "gap": 0.5, "vol_contraction": 0.5}
GAP_MIN, GAP_MAX = 0.015, 0.06


def panel(bars: DataFrame) -> DataFrame:
    """Every indicator that a price signal reads, by (symbol, d)."""
    x = ind.returns(ind.spread(bars))
    x = ind.sma(x)
    x = ind.atr_pct(x)
    x = ind.rsi(x)
    x = ind.realized_vol(x)
    x = ind.vol_ratio(x)
    x = ind.band_pos(x)
    return x.withColumns(
        {
            "n_bars": F.row_number().over(ind.by_date()),
            "hi60": full(F.max, F.col("close"), 60),
            "gap": F.col("open") / F.lag("close", 1).over(ind.by_date()) - 1,
            "settled50": full(F.avg, F.col("close"), 50, end=-1),
            "atr_used": F.when(F.col("atr_pct") > 0, F.col("atr_pct")).otherwise(0.02),
        }
    )


def with_benchmark(x: DataFrame) -> DataFrame:
    """The panel with the benchmark's returns of the same date, by the exchange on the date that
    the ranking of a date needs anyway: the panel is made once."""
    w = Window.partitionBy("d")
    own = F.col("symbol") == BENCHMARK
    return x.withColumns({"b63": F.max(F.when(own, F.col("r63"))).over(w), "b21": F.max(F.when(own, F.col("r21"))).over(w)})


def _signal(node: str, when: Column, direction: Column, score: Column, confidence: Column, expected: Column, down: float = -2.0) -> Column:
    vol = F.col("atr_used") * HORIZON[node] ** 0.5
    return F.when(
        when,
        F.struct(
            F.lit(node).alias("node_id"),
            direction.alias("direction"),
            F.abs(score).alias("score"),
            confidence.alias("confidence"),
            F.lit(HORIZON[node]).alias("horizon_days"),
            expected.alias("expected_return"),
            vol.alias("expected_volatility"),
            (down * vol).alias("downside"),
        ),
    )


def _vol(node: str) -> Column:
    return F.col("atr_used") * HORIZON[node] ** 0.5


def momentum() -> Column:
    """Mean of six components; no opinion below .10; confidence: share that agrees in sign."""
    parts = [
        squash(F.col("r12_1"), 0.30),
        squash(F.col("r63"), 0.15),
        squash(F.col("r21"), 0.08),
        F.when(F.col("above50"), 0.5).otherwise(-0.5),
        F.when(F.col("above200"), 0.5).otherwise(-0.5),
        squash(F.col("r63") - F.coalesce("b63", F.lit(0.0)), 0.10),
    ]
    score = sum(parts[1:], parts[0]) / 6
    agree = sum((F.when(p * score > 0, 1.0).otherwise(0.0) for p in parts), F.lit(0.0)) / 6
    return _signal("momentum", (F.col("n_bars") >= 260) & (F.abs(score) >= 0.10), F.when(score > 0, "long").otherwise("avoid"), score, agree, score * _vol("momentum") * 0.5)


def reversal() -> Column:
    """A fall of 1.5 five-day deviations in an uptrend with RSI at most 40."""
    sigma = F.col("vol60") * 5**0.5
    z = F.col("r5") / sigma
    when = (F.col("n_bars") >= 210) & (F.col("close") >= F.col("sma200")) & (sigma > 0) & (z <= -1.5) & (F.col("rsi") <= 40)
    score = F.least(F.lit(1.0), (-z - 1.5) / 2 + (40 - F.col("rsi")) / 80 + F.greatest(F.lit(0.0), -F.col("band_pos")))
    return _signal("reversal", when, F.lit("long"), score, F.lit(0.5), F.least(-0.5 * F.col("r5"), 2 * _vol("reversal")), -2.5)


def gap() -> Column:
    """An opening gap of 1.5 to 6 per cent above the mean of 50 settled closes."""
    score = F.tanh(F.col("gap") / F.col("atr_used") / 3) * 0.8
    when = (F.col("n_bars") >= 60) & F.col("gap").between(GAP_MIN, GAP_MAX) & (F.col("open") >= F.col("settled50"))
    return _signal("gap", when, F.lit("long"), score, F.lit(0.4), score * _vol("gap") * 0.5)


def vol_contraction() -> Column:
    """Recent deviation under .7 of that before, close to the 60-bar high, above both means."""
    when = (F.col("n_bars") >= 260) & (F.col("vol_ratio") < 0.70) & (F.col("close") >= F.col("hi60") * 0.97) & (F.col("close") >= F.col("sma50")) & (F.col("close") >= F.col("sma200"))
    near = 1 - (F.col("hi60") - F.col("close")) / (F.col("hi60") * 0.03)
    score = F.round(F.least(F.lit(0.9), 0.5 * (1 - F.col("vol_ratio")) + 0.4 * near), 4)
    return _signal("vol_contraction", when, F.lit("long"), score, F.lit(0.5), score * _vol("vol_contraction") * 0.5)


def sector_rotation() -> Column:
    """The three strongest sectors of a date, if above the benchmark, and the three weakest."""
    strength = F.tanh(F.col("rel") / 0.06)
    up = (F.col("rel_rank") <= 3) & (strength > 0)
    down = (F.col("rel_rank_low") <= 3) & (strength < 0)
    return _signal("sector_rotation", up | down, F.when(up, "long").otherwise("avoid"), strength, F.lit(0.6), strength * _vol("sector_rotation") * 0.4)


def price_signals(bars: DataFrame) -> DataFrame:
    """All price signals: ``as_of, symbol`` and the signal's columns. The benchmark's own bars
    take part as a reference only."""
    x = with_benchmark(panel(bars)).where(F.col("symbol") != BENCHMARK)
    # Symbols stand for sectors here; those without a 63-session return have no rank.
    rel = F.when(F.col("b63").isNotNull(), 0.6 * (F.col("r63") - F.col("b63")) + 0.4 * (F.col("r21") - F.col("b21")))
    x = x.withColumn("rel", rel)
    by = Window.partitionBy("d", F.col("rel").isNotNull())
    x = x.withColumn("rel_rank", F.when(F.col("rel").isNotNull(), F.row_number().over(by.orderBy(F.desc("rel"), "symbol"))))
    x = x.withColumn("rel_rank_low", F.when(F.col("rel").isNotNull(), F.row_number().over(by.orderBy("rel", F.desc("symbol")))))
    rules = F.array(momentum(), reversal(), sector_rotation(), gap(), vol_contraction())
    return x.select(F.col("d").alias("as_of"), "symbol", F.inline(F.filter(rules, lambda s: s.isNotNull())))


#: The digits that signals are shown with; fusion works on unrounded ones.
DIGITS = {"score": 4, "confidence": 3, "expected_return": 5, "expected_volatility": 5, "downside": 5}


def shown(signals: DataFrame) -> DataFrame:
    """Signals rounded for output."""
    return signals.withColumns({c: F.round(c, n) for c, n in DIGITS.items()})


def top_k(signals: DataFrame, k: int) -> DataFrame:
    """The k strongest of each date and node, ties by symbol: ``rank`` added."""
    w = Window.partitionBy("as_of", "node_id").orderBy(F.desc("score"), "symbol")
    return signals.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
