"""The feature panel, baselines, cohorts and gates of forecast models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.columns import ROUND_TRIP, clamp, full, signed_alpha
from marketloom.operators import indicators as ind
from marketloom.operators.evidence import fundamentals
from marketloom.operators.joins import latest_at

#: Scales of the context columns, and how evidence has to be before it counts.
FUNDAMENTALS = ("revenue_growth", "operating_margin", "fcf_margin", "debt_assets", "dilution", "accruals", "liquidity")
MIN_NAMES, MIN_COHORTS, MIN_OFFSETS = 8, 3, 8
RIDGE = 1e-2
REGIME_VALUE = {"risk_on": 1.0, "neutral": 0.3, "risk_off": -0.5, "stress": -1.0}
RAMP = {0: 0.0, 1: 0.10, 2: 0.25, 3: 0.50}


def valuation(bars: DataFrame, facts: DataFrame) -> DataFrame:
    """Bars with ``valuation`` (price by the earnings per share known then, clipped, over 25)
    and whether it is missing. A filing date counts with its latest period."""
    eps = facts.where(F.col("form").isin("10-K", "10-K/A") & (F.col("tag") == "EarningsPerShareDiluted"))
    known = eps.groupBy("cik", F.col("filed").alias("d")).agg(F.max_by("value", "period_end").alias("eps"))
    x = latest_at(bars, known, ["eps"], ["cik"], "d")
    pe = F.when(F.col("eps") != 0, clamp(F.col("close") / F.col("eps"), -100.0, 100.0) / 25)
    return x.withColumn("valuation", F.coalesce(pe, F.lit(0.0))).withColumn("valuation_missing", F.when(pe.isNull(), 1.0).otherwise(0.0)).drop("eps")


def event_proximity(bars: DataFrame, facts: DataFrame) -> DataFrame:
    """``event_proximity``: exp(-days / 10) since the last annual or quarterly filing, 0 after
    30 days; missing before the first."""
    filed = facts.where(F.col("form").isin("10-K", "10-K/A", "10-Q", "10-Q/A")).select("cik", F.col("filed").alias("d")).distinct().withColumn("filed", F.col("d"))
    days = F.datediff("d", "filed")
    x = latest_at(bars, filed, ["filed"], ["cik"], "d")
    near = F.when(days <= 30, F.exp(-days / 10)).otherwise(0.0)
    return x.withColumn("event_proximity", near).withColumn("event_missing", F.when(F.col("filed").isNull(), 1.0).otherwise(0.0)).drop("filed")


def then_known(bars: DataFrame, facts: DataFrame, tags: tuple[str, ...]) -> DataFrame:
    """The fundamentals as the last filing at each date had them, and whether each is missing.
    A value that a later filing lacks is carried on."""
    f = fundamentals(facts, tags)
    w = Window.partitionBy("cik").orderBy("filed").rowsBetween(Window.unboundedPreceding, 0)
    carried = f.select("cik", F.col("filed").alias("d"), *(F.last(c, ignorenulls=True).over(w).alias(c) for c in FUNDAMENTALS))
    x = latest_at(bars, carried, list(FUNDAMENTALS), ["cik"], "d")
    return x.withColumns({c + "_missing": F.when(F.col(c).isNull(), 1.0).otherwise(0.0) for c in FUNDAMENTALS} | {c: F.coalesce(c, F.lit(0.0)) for c in FUNDAMENTALS})


def news_features(bars: DataFrame, news: DataFrame) -> DataFrame:
    """``news_sentiment``: the mean of the last three days that have news, each the mean of
    stance x confidence x reliability; and whether it is missing."""
    day = news.where("stance is not null").groupBy("symbol", F.to_date("published_at").alias("d")).agg(F.avg(F.col("stance") * F.col("confidence") * F.coalesce("reliability", F.lit(0.5))).alias("v"))
    roll = day.withColumn("news_sentiment", F.avg("v").over(Window.partitionBy("symbol").orderBy("d").rowsBetween(-2, 0))).select("symbol", "d", "news_sentiment")
    x = latest_at(bars, roll, ["news_sentiment"], ["symbol"], "d")
    return x.withColumn("news_missing", F.when(F.col("news_sentiment").isNull(), 1.0).otherwise(0.0)).fillna(0.0, ["news_sentiment"])


def price_features(bars: DataFrame, market: DataFrame) -> DataFrame:
    """The temporal columns of the panel, all over one window of a symbol, and those of the
    market on the same date (``market``: a row a date), nulls of the context as 0."""
    x = ind.range_gap(ind.returns(bars, (1, 21))).withColumnRenamed("day_range", "range")
    x = ind.sma(ind.breakout(ind.volume_z(ind.realized_vol(x, (21,)))), (50, 200))
    x = x.withColumns({"__tr": ind.true_range(), "__g": F.greatest("r1", F.lit(0.0)), "__l": F.greatest(-F.col("r1"), F.lit(0.0))})
    x = x.withColumns({"__g": F.when(F.col("r1").isNotNull(), F.col("__g")), "__l": F.when(F.col("r1").isNotNull(), F.col("__l"))})
    x = x.withColumns({"atr14": full(F.avg, F.col("__tr"), 14) / F.col("close"), "__g": full(F.avg, F.col("__g"), 14), "__l": full(F.avg, F.col("__l"), 14)})
    x = x.withColumn("rsi14", F.col("__g") / (F.col("__g") + F.col("__l") + 1e-8) - 0.5)
    x = x.select("symbol", "d", "close", *(c for c in bars.columns if c == "cik"), "r1", "r21", "range", "gap", "volume_z", "vol21", "atr14", F.col("breakout").alias("breakout60"), "rsi14", F.col("dist50").alias("sma50_d"), F.col("dist200").alias("sma200_d"))
    m = market.select(
        "d", F.col("m_r1").alias("spy_r1"), F.col("m_r21").alias("spy_r21"), (F.col("v21") / 20 - 1).alias("vix"), *(F.coalesce(F.col(a) / 20 - 1, F.lit(0.0)).alias(b) for a, b in (("v9", "vix9d"), ("v63", "vix3m"), ("v126", "vix6m"))),
        F.coalesce(F.col("vvix") / 100 - 1, F.lit(0.0)).alias("vvix"), F.coalesce("slope_9d_3m", F.lit(0.0)).alias("vix_curve_9d_3m"), F.coalesce("slope_1m_3m", F.lit(0.0)).alias("vix_curve_1m_3m"),
        F.coalesce((F.col("v21") - F.col("m_vol") * 252**0.5 * 100) / 20, F.lit(0.0)).alias("implied_realized_spread"),
        F.when(F.col("v9").isNull() | F.col("v63").isNull() | F.col("v126").isNull() | F.col("vvix").isNull(), 1.0).otherwise(0.0).alias("vol_context_missing"),
    )
    return x.join(m, "d", "left").withColumn("relative_r21", F.col("r21") - F.col("spy_r21")).drop("r21")


def ridge(train: DataFrame, features: list[str], target: str) -> list[float]:
    """Intercept and weights of a ridge regression on standardised features, the intercept free.

    One aggregation of the rows gives the moments, k x k numbers; only those are solved on the
    driver.
    """
    cols = [F.col(c) for c in features]
    first = train.agg(F.count(F.lit(1)), F.avg(target), *(F.avg(c) for c in cols), *(F.stddev_pop(c) for c in cols)).first()
    k, n = len(features), first[0]
    mean, sd = np.array(first[2 : 2 + k], float), np.array(first[2 + k :], float) + 1e-8
    z = [(c - float(m)) / float(s) for c, m, s in zip(cols, mean, sd, strict=True)]
    second = train.agg(*(F.sum(a * b) for i, a in enumerate(z) for b in z[i:]), *(F.sum(a * (F.col(target) - first[1])) for a in z)).first()
    gram = np.zeros((k, k))
    gram[np.triu_indices(k)] = second[: k * (k + 1) // 2]
    gram = gram + gram.T - np.diag(np.diag(gram))
    w = np.linalg.solve(gram + RIDGE * n * np.eye(k), np.array(second[k * (k + 1) // 2 :], float)) / sd
    return [float(first[1] - w @ mean), *map(float, w)]


def linear(weights: list[float], features: list[str]) -> Column:
    return sum((F.col(c) * w for c, w in zip(features, weights[1:], strict=True)), F.lit(weights[0]))


def apply_calibration(x: DataFrame, offsets: DataFrame, *by: str) -> DataFrame:
    """Quantiles moved by their offsets and put in order; the logit of the probability moved by
    ``shift``. The offsets have a row a key; Spark broadcasts them if they are few."""
    y = x.join(offsets, list(by), "left").fillna(0.0, ["off10", "off50", "off90", "shift"])
    q = F.array_sort(F.array(F.col("q50") + F.col("off10"), F.col("q50") + F.col("off50"), F.col("q50") + F.col("off90")))
    p = clamp(F.col("p"), 1e-6, 1 - 1e-6)
    return y.withColumns({"q10": q[0], "q50": q[1], "q90": q[2], "p": 1 / (1 + F.exp(-(F.log(p / (1 - p)) + F.col("shift"))))}).drop("off10", "off50", "off90", "shift")


def selection_score(ic: Column, alpha: Column, coverage: Column, pinball: Column) -> Column:
    return ic + 4 * alpha - 0.25 * F.abs(coverage - 0.8) - pinball


def cohorts(x: DataFrame, pred: str, truth: str, h: int, *by: str) -> DataFrame:
    """By (key, offset): the dates of one staggered alignment, every h-th, so that no two
    forward windows overlap; top-decile mean after costs, ``cohorts``, ``annualized``,
    ``sharpe`` and ``max_drawdown``. Dates are numbered inside the key."""
    rows = x.where(F.col(pred).isNotNull() & F.col(truth).isNotNull())
    days = rows.select(*by, "d").distinct().withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy("d")) - 1)
    cut = rows.groupBy(*by, "d").agg(F.percentile(pred, 0.9).alias("cut"), F.count(F.lit(1)).alias("names")).where(F.col("names") >= MIN_NAMES)
    picked = rows.join(cut, [*by, "d"]).where(F.col(pred) >= F.col("cut")).groupBy(*by, "d").agg((F.avg(truth) - ROUND_TRIP).alias("r"))
    c = picked.join(days, [*by, "d"]).withColumn("offset", F.col("i") % h)
    w = Window.partitionBy(*by, "offset").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn("level", F.exp(F.sum(F.log1p("r")).over(w)))
    c = c.withColumn("dd", 1 - F.col("level") / F.max("level").over(w))
    year = 252 / h
    return c.groupBy(*by, "offset").agg(
        F.count(F.lit(1)).alias("cohorts"), (F.avg("r") * year).alias("annualized"), (F.avg("r") / (F.stddev_pop("r") + 1e-9) * year**0.5).alias("sharpe"), F.max("dd").alias("max_drawdown"),
    )


def graph_samples(signals: DataFrame, regime: DataFrame, bars: DataFrame, benchmark: str, nodes: tuple[str, ...]) -> DataFrame:
    """By (as_of, symbol) with a signal: the activation of each of ``nodes`` (null without one),
    the regime's value, and the excess returns over the next 5 and 21 bars, each side counted
    on its own calendar. Rows without 21 later bars on both sides are left out."""
    value = F.create_map(*[x for k, v in REGIME_VALUE.items() for x in (F.lit(k), F.lit(v))])
    alpha = signed_alpha(F.col("direction"), F.col("score"), F.col("confidence"))
    g = signals.groupBy("as_of", "symbol").agg(*(F.max(F.when(F.col("node_id") == k, alpha)).alias(k) for k in nodes))
    g = g.join(regime.select(F.col("d").alias("as_of"), F.coalesce(value[F.col("regime")], F.lit(0.0)).alias("macro_regime")), "as_of", "left")
    w = Window.partitionBy("symbol").orderBy("d")
    ahead = bars.select(F.col("d").alias("as_of"), "symbol", *((F.lead("close", h).over(w) / F.col("close") - 1).alias(f"r{h}") for h in (5, 21))).where("r21 is not null")
    own = g.join(ahead, ["as_of", "symbol"])
    market = ahead.where(F.col("symbol") == benchmark).select("as_of", F.col("r5").alias("b5"), F.col("r21").alias("b21"))
    return own.join(market, "as_of").select("as_of", "symbol", *nodes, "macro_regime", (F.col("r5") - F.col("b5")).alias("y5"), (F.col("r21") - F.col("b21")).alias("y21"))


def sealed_report(samples: DataFrame, score: Column, scales: dict[int, float]) -> DataFrame:
    """By horizon: how a fixed graph does on the sealed last 15 per cent of the dates.

    ``score`` times the horizon's scale is the forecast. The interval's ends are the 10 and 90
    per cent quantiles of the residuals between 70 and 85 per cent of the dates, rounded to
    four digits so that their counts stay few. ``coverage`` is the share of sealed rows inside,
    ``ic`` the correlation of forecast and outcome (0 without a deviation).
    """
    dates = samples.select("as_of").distinct().withColumn("k", F.row_number().over(Window.orderBy("as_of")) - 1)  # a row a session
    n = F.count(F.lit(1)).over(Window.partitionBy())
    part = dates.withColumn("n", n).select("as_of", F.when(F.col("k") >= F.floor(F.col("n") * 0.85), "test").when(F.col("k") >= F.floor(F.col("n") * 0.70), "validation").alias("part")).where("part is not null")
    rows = [F.struct(F.lit(h).alias("horizon"), (score * s).alias("pred"), F.col(f"y{h}").alias("y")) for h, s in scales.items()]
    x = samples.withColumn("x", F.explode(F.array(*rows))).select("as_of", "x.*").join(part, "as_of")
    ends = x.where("part = 'validation'").groupBy("horizon").agg(F.percentile(F.round(F.col("y") - F.col("pred"), 4), F.lit(0.10)).alias("low"), F.percentile(F.round(F.col("y") - F.col("pred"), 4), F.lit(0.90)).alias("high"))
    inside = (F.col("y") >= F.col("pred") + F.col("low")) & (F.col("y") <= F.col("pred") + F.col("high"))
    spread = (F.stddev_samp("pred") > 1e-12) & (F.stddev_samp("y") > 1e-12)
    return x.where("part = 'test'").join(F.broadcast(ends), "horizon").groupBy("horizon").agg(F.count(F.lit(1)).alias("n"), F.avg(inside.cast("double")).alias("coverage"), F.when(spread, F.corr("pred", "y")).otherwise(0.0).alias("ic"))


def staggered(offsets: DataFrame, *by: str) -> DataFrame:
    """Medians over the offsets of MIN_COHORTS cohorts or more. With fewer than MIN_OFFSETS of
    them the evidence is insufficient and every number is the worst."""
    ok = F.col("cohorts") >= MIN_COHORTS
    g = offsets.groupBy(*by).agg(F.count(F.when(ok, 1)).alias("offsets"), *(F.percentile(F.when(ok, F.col(c)), 0.5).alias(c) for c in ("annualized", "sharpe", "max_drawdown")), F.min(F.when(ok, F.col("sharpe"))).alias("worst_sharpe"))
    thin = F.col("offsets") < MIN_OFFSETS
    return g.select(
        *by, "offsets", F.when(thin, "insufficient").otherwise("ok").alias("evidence"), F.when(thin, -1.0).otherwise(F.col("annualized") - 0.5 * F.col("max_drawdown")).alias("utility"),
        F.when(thin, -99.0).otherwise(F.col("sharpe")).alias("sharpe"), F.when(thin, 1.0).otherwise(F.col("max_drawdown")).alias("max_drawdown"), F.when(~thin, F.col("worst_sharpe")).alias("worst_sharpe"),
    )


def promotion_gates(metrics: DataFrame) -> DataFrame:
    """By model: ``promoted`` if every horizon has a positive IC and alpha, a coverage of .75 to
    .85, 10,000 forward rows and 30 sessions; ``failed`` names what does not hold."""
    checks = {"ic": F.col("ic") > 0, "alpha": F.col("alpha") > 0, "coverage": F.col("coverage").between(0.75, 0.85), "rows": F.col("n") >= 10_000, "sessions": F.col("sessions") >= 30}
    g = metrics.groupBy("model").agg(*(F.bool_and(F.coalesce(c, F.lit(False))).alias(k) for k, c in checks.items()))
    failed = F.array_compact(F.array(*(F.when(~F.col(k), F.lit(k)) for k in checks)))
    return g.select("model", (F.size(failed) == 0).alias("promoted"), F.array_join(failed, ",").alias("failed"))


def holding_gates(metrics: DataFrame, baseline: DataFrame) -> DataFrame:
    """Whether a model of one holding replaces the global one: pinball at most 95 per cent of
    it, a positive IC, direction over 52 per cent, coverage .75 to .85, 200 forward rows."""
    x = metrics.join(F.broadcast(baseline.select("horizon", F.col("pinball").alias("global"))), "horizon", "left")
    ok = (F.col("pinball") <= 0.95 * F.col("global")) & (F.col("ic") > 0) & (F.col("direction") > 0.52) & F.col("coverage").between(0.75, 0.85) & (F.col("n") >= 200)
    return x.groupBy("model").agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("serves"))


def beats_baselines(metrics: DataFrame, baselines: DataFrame) -> DataFrame:
    """Whether a model has less pinball and a higher selection score than every baseline."""
    x = metrics.join(baselines.select(F.col("pinball").alias("bp"), F.col("selection").alias("bs"), "horizon"), "horizon")
    return x.groupBy("model", "horizon").agg(F.bool_and((F.col("pinball") < F.col("bp")) & (F.col("selection") > F.col("bs"))).alias("beats"))


def finalists(models: DataFrame) -> DataFrame:
    """Models of each kind by score, then age, then id."""
    return models.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("score"), "created_at", "id")))


def latest_states(transitions: DataFrame) -> DataFrame:
    """Each model's state after its last transition, and how many there were."""
    return transitions.groupBy("model").agg(F.max_by("state", F.struct("at", "id")).alias("state"), F.max("at").alias("since"), F.count(F.lit(1)).alias("transitions"))


def activation(pairs: DataFrame) -> DataFrame:
    """``stage`` and ``blend`` of a graph and its temporal model from their forward metrics.

    Rows have stage, graph and temporal (structs of sessions, n, ic, alpha, least_cov,
    most_cov; null if missing), trained_with, temporal_id and age. Missing, mismatched or
    older than 7 days: stage 0. Decay takes one stage back, not below the first.
    """
    def both(check) -> Column:
        return check("graph") & check("temporal")

    two = both(lambda m: (F.col(f"{m}.sessions") >= 21) & (F.col(f"{m}.n") >= 5_000) & (F.col(f"{m}.ic") >= 0.01) & (F.col(f"{m}.alpha") > 0))
    three = both(lambda m: (F.col(f"{m}.sessions") >= 30) & (F.col(f"{m}.n") >= 10_000) & (F.col(f"{m}.least_cov") >= 0.75) & (F.col(f"{m}.most_cov") <= 0.85) & (F.col(f"{m}.alpha") > 0))
    decay = ~both(lambda m: (F.col(f"{m}.n") < 1_000) | ((F.col(f"{m}.ic") > 0) & (F.col(f"{m}.least_cov") >= 0.70) & (F.col(f"{m}.most_cov") <= 0.90)))
    start = F.greatest(F.lit(1), F.coalesce("stage", F.lit(1)))
    up = F.when((start < 2) & two, 2).otherwise(start)
    top = F.when((up < 3) & three, 3).otherwise(up)
    after = F.when((top > 1) & decay, top - 1).otherwise(top)
    reason = F.when(F.col("graph").isNull(), "graph missing").when(F.col("temporal").isNull(), "temporal model missing").when(~F.col("trained_with").eqNullSafe(F.col("temporal_id")), "mismatch").when(F.col("age") > 7, "stale")
    x = pairs.withColumn("blocked", reason).withColumn("stage", F.when(reason.isNotNull(), 0).otherwise(after))
    return x.withColumn("blend", F.create_map(*[v for k, b in RAMP.items() for v in (F.lit(k), F.lit(b))])[F.col("stage")])
