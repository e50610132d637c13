"""Regime labels and the fusion of signals into one score by family budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.columns import ROUND_TRIP, full, signed_alpha
from marketloom.operators import indicators as ind
from marketloom.sources.fixtures import BENCHMARK

#: Regime thresholds and what each regime lets be deployed.
VIX_STRESS, VIX_RISK_ON = 28, 20
BREADTH_ON, BREADTH_OFF = 0.55, 0.35
#: Deviations of the damped series, scaled to the range of a volatility index.
SCALE = 20
DEPLOYMENT = {"risk_on": 1.0, "neutral": 0.6, "risk_off": 0.25, "stress": 0.0}
MACRO = {"risk_on": 0.65, "neutral": 0.10, "risk_off": -0.50, "stress": -1.0}
#: A node's family and its prior among the enabled nodes of the family.
NODES = {
    "momentum": ("price", 0.40),
    "reversal": ("price", 0.20),
    "gap": ("price", 0.15),
    "vol_contraction": ("price", 0.25),
    "sector_rotation": ("context", 0.5),
    "macro_regime": ("context", 0.5),
}
FAMILY_WEIGHT = {"business": 0.30, "catalyst": 0.20, "quality": 0.15, "context": 0.15, "price": 0.20}
CONFLICT_PENALTY = 0.5
MIN_FINAL = 0.15


def vol_context(bench: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """By symbol and date, with ``carry``: implied-volatility stand-ins ``v9, v21, v63, v126``
    (per cent a year, 60 at most), their slopes, the five-session change, ``vvix``, the volatility
    ``realized21`` of the last 21 returns, and the ``spread`` of the implied one over it."""
    x = bench.withColumn("__r", ind.ret(1))
    sd = {n: full(F.stddev_samp, F.col("__r"), n) for n in (9, 21, 63, 126)}
    x = x.withColumns({f"v{n}": F.when(c.isNotNull(), F.least(F.lit(60.0), c * 252**0.5 * SCALE)) for n, c in sd.items()})
    x = x.withColumn("realized21", sd[21] * 252**0.5 * 100)
    x = x.withColumn("vvix", full(F.stddev_samp, F.col("v21"), 21) * 100)
    return x.select(
        "d", "symbol", "close", "v9", "v21", "v63", "v126", "vvix",
        (F.col("v9") / F.col("v63") - 1).alias("slope_9d_3m"),
        (F.col("v21") / F.col("v63") - 1).alias("slope_1m_3m"),
        (F.col("v63") / F.col("v126") - 1).alias("slope_3m_6m"),
        (F.col("v21") / F.lag("v21", 5).over(ind.by_date()) - 1).alias("vix_change_5d"),
        "realized21", (F.col("v21") - F.col("realized21")).alias("spread"), *carry,
    )


def classify(days: DataFrame) -> DataFrame:
    """``regime`` and ``deployment`` by date from ``close, sma50, sma200, v21``, slopes,
    ``vvix``, ``vix_change_5d``, ``credit`` and ``breadth``; a null counts as unknown.

    Stress goes before risk-on, risk-on before risk-off. Without 200 bars the trend is 0.
    """
    sign = F.when(F.col("close") > F.col("sma50"), 1).otherwise(-1) + F.when(F.col("close") > F.col("sma200"), 1).otherwise(-1)
    trend = F.when(F.col("sma200").isNull(), 0).otherwise(sign)

    def least(c: str, x: float) -> Column:
        return F.coalesce(F.col(c) >= x, F.lit(False))

    inverted = least("slope_9d_3m", 0.08) | least("slope_1m_3m", 0.05)
    shock = least("vvix", 125) | least("vix_change_5d", 0.35)
    regime = (
        F.when(least("v21", VIX_STRESS) | (inverted & shock), "stress")
        .when((trend == 2) & F.coalesce(F.col("v21") < VIX_RISK_ON, F.lit(True)) & F.coalesce(F.col("breadth") >= BREADTH_ON, F.lit(True)), "risk_on")
        .when((trend <= -1) | F.coalesce(F.col("credit") <= -0.04, F.lit(False)) | F.coalesce(F.col("breadth") <= BREADTH_OFF, F.lit(False)), "risk_off")
        .otherwise("neutral")
    )
    deployment = F.create_map(*[x for k, v in DEPLOYMENT.items() for x in (F.lit(k), F.lit(v))])
    return days.withColumn("trend", trend).withColumn("regime", regime).withColumn("deployment", deployment[F.col("regime")])


def regimes(bars: DataFrame, stocks: DataFrame, risky: str, safe: str) -> DataFrame:
    """``classify`` over every benchmark session. ``bars`` has the benchmark and two reference
    symbols whose 21-session returns stand for credit; ``stocks`` gives breadth."""
    # One pass: every symbol's windows, then the wanted ones of each date side by side.
    x = ind.sma(bars.where(F.col("symbol").isin(BENCHMARK, risky, safe)), (50, 200)).withColumn("__r21", ind.ret(21))
    x = vol_context(x, ("sma50", "sma200", "__r21"))
    own = [c for c in x.columns if c not in ("d", "symbol", "__r21")]

    def of(symbol: str, c: str) -> Column:
        return F.max(F.when(F.col("symbol") == symbol, F.col(c)))

    days = x.groupBy("d").agg(F.max(F.col("symbol") == BENCHMARK).alias("__open"), *(of(BENCHMARK, c).alias(c) for c in own), (of(risky, "__r21") - of(safe, "__r21")).alias("credit"))
    return classify(days.where("__open").drop("__open").join(ind.breadth(stocks).select("d", "breadth"), "d", "left"))


def macro_signals(regime: DataFrame, grid: DataFrame) -> DataFrame:
    """The regime as explicit evidence for every (as_of, symbol) of ``grid``."""
    level = F.create_map(*[x for k, v in MACRO.items() for x in (F.lit(k), F.lit(v))])[F.col("regime")]
    return grid.join(regime.select(F.col("d").alias("as_of"), "regime"), "as_of").select(
        "as_of", "symbol", F.lit("macro_regime").alias("node_id"), F.when(level >= 0, "long").otherwise("avoid").alias("direction"),
        F.abs(level).alias("score"), F.lit(1.0).alias("confidence"), F.lit(21).alias("horizon_days"), F.lit(0.0).alias("expected_return"),
    )


def fuse(signals: DataFrame, grid: DataFrame) -> DataFrame:
    """One row for each (as_of, symbol) of ``grid`` (with ``n_bars``): family values, conflict,
    score, coverage, expectation.

    Priors stand over the whole enabled family, so missing evidence gives its weight to no
    one. A node without a signal counts as looked at (and neutral) if the symbol has the 260
    bars it needs. Conflict shrinks positive scores only.
    """
    family = F.create_map(*[x for k, (f, _) in NODES.items() for x in (F.lit(k), F.lit(f))])[F.col("node_id")]
    prior = F.create_map(*[x for k, (_, p) in NODES.items() for x in (F.lit(k), F.lit(p))])[F.col("node_id")]
    weight = F.create_map(*[x for k, v in FAMILY_WEIGHT.items() for x in (F.lit(k), F.lit(v))])
    s = signals.withColumn("family", family).withColumn("w", prior).where("family is not null")
    s = s.withColumn("alpha", signed_alpha(F.col("direction"), F.col("score"), F.col("confidence"))).withColumn("fw", weight[F.col("family")])
    s = s.withColumn("part", F.col("fw") * F.col("alpha") * F.col("w"))
    sign = F.when(F.col("direction").isin("long", "long_call"), 1.0).otherwise(-1.0)
    is_long = F.col("direction").isin("long", "long_call") & (F.col("node_id") != "macro_regime")
    fused = s.groupBy("as_of", "symbol").agg(
        F.sum(F.when(F.col("family") == "price", F.col("alpha") * F.col("w"))).alias("price_value"),
        F.sum(F.when(F.col("family") == "context", F.col("alpha") * F.col("w"))).alias("context_value"),
        F.sum("part").alias("raw"),
        F.sum(F.greatest("part", F.lit(0.0))).alias("positive"),
        F.sum(F.greatest(-F.col("part"), F.lit(0.0))).alias("negative"),
        F.sum(sign * F.abs("expected_return") * F.col("fw") * F.col("w") * F.col("confidence")).alias("exp_num"),
        F.sum(F.col("fw") * F.col("w") * F.col("confidence")).alias("exp_den"),
        F.avg(F.when(is_long, F.col("horizon_days").cast("double"))).alias("horizon"),
        F.sum(F.when(F.col("family") == "price", F.col("w")).otherwise(0.0)).alias("price_prior"),
        F.sum(F.when(F.col("family") == "context", F.col("w")).otherwise(0.0)).alias("context_prior"),
    )
    out = grid.join(fused, ["as_of", "symbol"], "left").fillna(0.0, ["raw", "positive", "negative", "price_prior", "context_prior"])
    looked = F.col("n_bars") >= 260
    cover = FAMILY_WEIGHT["price"] * F.when(looked, 1.0).otherwise(F.least(F.lit(1.0), "price_prior")) + FAMILY_WEIGHT["context"] * F.when(looked, 1.0).otherwise(F.least(F.lit(1.0), "context_prior"))
    total = F.col("positive") + F.col("negative")
    conflict = 1 - CONFLICT_PENALTY * F.when(total > 0, 2 * F.least("positive", "negative") / total).otherwise(0.0)
    gross = F.when(F.col("exp_den") > 0, F.col("exp_num") / F.col("exp_den")).otherwise(0.0)
    out = out.withColumn("coverage", cover).withColumn("conflict", conflict).withColumn("gross", gross)
    out = out.withColumn("production", F.when(F.col("raw") > 0, F.col("raw") * F.col("conflict")).otherwise(F.col("raw")))
    penalty = ROUND_TRIP / F.greatest(F.abs("gross"), F.lit(0.005)) * 0.01
    traded = (F.col("raw") > 0) & F.col("horizon").isNotNull()
    return out.withColumn("final", F.when(traded, F.col("production") - penalty)).select(
        "as_of", "symbol", "price_value", "context_value", "raw", "conflict", "production", "coverage", "gross", F.round("horizon").cast("int").alias("horizon_days"), "final",
    )
