"""Queries of labels, splits and forecast evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.functions.aggregates import register_aggregates
from marketloom.functions.columns import rounded
from marketloom.operators import evaluation as ev
from marketloom.plans.indicators import lag
from marketloom.registry import register
from marketloom.sources import fixtures as fx

BRAND = fx.bars_sql("p_brand")


def _brands(spark, d):
    bars = fx.bars(spark, d, "p_brand")
    return bars.where(F.col("symbol") != fx.BENCHMARK), bars.where(F.col("symbol") == fx.BENCHMARK)


def _lead(h: int) -> str:
    return f"lead(close, {h}) OVER (PARTITION BY symbol ORDER BY d) / close - 1"


LABELS = f"{BRAND}, f AS (SELECT *, {_lead(5)} AS f5, {_lead(21)} AS f21, close / {lag('close', 1)} - 1 AS r1 FROM bars), bb AS (SELECT d, f5 AS b5, f21 AS b21 FROM f WHERE symbol = 'ALL'), lab AS (SELECT f.*, b5, b21, f5 - b5 AS e5, f21 - b21 AS e21 FROM f LEFT JOIN bb USING (d) WHERE symbol <> 'ALL')"
L = ["abs5", "excess5", "abs21", "excess21"]
register(
    "m5_dual_labels",
    lambda spark, d: rounded(ev.dual_labels(*_brands(spark, d)).select("symbol", "d", *L, "beats5", "leads5", "beats21", "leads21"), *L),
    f"WITH {LABELS} SELECT symbol, d, round(f5, 6) AS abs5, round(e5, 6) AS excess5, round(f21, 6) AS abs21, round(e21, 6) AS excess21, f5 > 0.0016 AS beats5, e5 > 0 AS leads5, f21 > 0.0016 AS beats21, e21 > 0 AS leads21 FROM lab",
)
register(
    "m7_chronological_split",
    lambda spark, d: ev.chronological_split(_brands(spark, d)[1]),
    f"""WITH {BRAND}, x AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT d FROM bars WHERE symbol = 'ALL'))
SELECT d, i, CASE WHEN i < floor(n * 0.7) - 22 THEN 'train' WHEN i < floor(n * 0.7) THEN 'embargo' WHEN i < floor(n * 0.85) - 22 THEN 'validation' WHEN i < floor(n * 0.85) THEN 'embargo' ELSE 'test' END AS split FROM x""",
)
register(
    "m8_walk_forward",
    lambda spark, d: ev.walk_forward(_brands(spark, d)[1]),
    f"""WITH {BRAND}, x AS (SELECT count(DISTINCT d) AS n FROM bars WHERE symbol = 'ALL'), y AS (SELECT floor(n * 0.45) AS a, floor(n * 0.85) AS b, unnest(range(5)) AS fold FROM x)
SELECT fold, (a + floor((b - a) * fold / 5.0) - 22)::BIGINT AS train_end, (a + floor((b - a) * fold / 5.0))::BIGINT AS test_start, (a + floor((b - a) * (fold + 1) / 5.0))::BIGINT AS test_end FROM y""",
)


def _panel(spark, d):
    """The momentum baseline with its labels; predictions are rounded so that ties agree."""
    stocks, bench = _brands(spark, d)
    x = ev.dual_labels(ev.momentum_forecast(stocks), bench)
    return x.withColumns({c: F.round(c, 8) for c in ("q10", "q50", "q90", "excess5")})


PANEL = f"{LABELS}, pan AS (SELECT symbol, d, round(r1 * sqrt(5), 8) AS q50, round(r1 * sqrt(5) - 0.05, 8) AS q10, round(r1 * sqrt(5) + 0.05, 8) AS q90, round(e5, 8) AS excess5 FROM lab)"
RANK = "rank() OVER (PARTITION BY d ORDER BY {c}) + (count(*) OVER (PARTITION BY d, {c}) - 1) / 2.0"
register(
    "m11_rank_ic",
    lambda spark, d: rounded(ev.rank_ic(_panel(spark, d), "q50", "excess5"), "ic"),
    f"""WITH {PANEL}, ok AS (SELECT *, count(*) OVER (PARTITION BY d) AS n FROM pan WHERE q50 IS NOT NULL AND excess5 IS NOT NULL),
rk AS (SELECT d, {RANK.format(c='q50')} AS p, {RANK.format(c='excess5')} AS t FROM ok WHERE n >= 8) SELECT d, count(*) AS names, round(corr(p, t), 6) AS ic FROM rk GROUP BY d""",
)
register(
    "m12_top_decile",
    lambda spark, d: rounded(ev.top_decile(_panel(spark, d), "q50", "excess5"), "alpha"),
    f"""WITH {PANEL}, ok AS (SELECT * FROM pan WHERE q50 IS NOT NULL AND excess5 IS NOT NULL), c AS (SELECT d, quantile_cont(q50, 0.9) AS cut, count(*) AS names FROM ok GROUP BY d HAVING count(*) >= 8)
SELECT d, names, round(avg(excess5) - 0.0016, 6) AS alpha, count(*) AS picked FROM ok JOIN c USING (d) WHERE q50 >= cut - 1e-12 GROUP BY d, names""",
)
F_ = ("pinball", "coverage", "direction", "brier")
register(
    "m10_forecast_metrics",
    lambda spark, d: rounded(ev.forecast_metrics(_panel(spark, d), "excess5", "symbol"), *F_, digits=9),
    f"""WITH {PANEL}, ok AS (SELECT * FROM pan WHERE q50 IS NOT NULL AND excess5 IS NOT NULL)
SELECT symbol, count(*) AS n, round((avg(greatest(0.1 * (excess5 - q10), -0.9 * (excess5 - q10))) + avg(greatest(0.5 * (excess5 - q50), -0.5 * (excess5 - q50))) + avg(greatest(0.9 * (excess5 - q90), -0.1 * (excess5 - q90)))) / 3, 9) AS pinball,
  round(avg((excess5 BETWEEN q10 AND q90)::INT), 9) AS coverage, round(avg(((excess5 > 0) = (q50 > 0))::INT), 9) AS direction, round(avg(pow(CASE WHEN q50 > 0 THEN 0.6 ELSE 0.4 END - (excess5 > 0)::INT, 2)), 9) AS brier FROM ok GROUP BY symbol""",
)
register(
    "m6_eligible_windows",
    lambda spark, d: ev.eligible_windows(_panel(spark, d), F.col("q50").isNotNull() & F.col("excess5").isNotNull()).select("symbol", "d", "eligible"),
    f"WITH {PANEL} SELECT symbol, d, coalesce(sum((q50 IS NOT NULL AND excess5 IS NOT NULL)::INT) OVER (PARTITION BY symbol ORDER BY d ROWS 59 PRECEDING) = 60, false) AS eligible FROM pan",
)


def _resolved(spark, d):
    stocks, _ = _brands(spark, d)
    return rounded(ev.nth_next(stocks.where(F.dayofweek("d") == 2).select("symbol", "d"), stocks, 5).select("symbol", "d", "resolved_at", "realized"), "realized")


register(
    "m16_resolved_forecasts",
    _resolved,
    f"WITH {BRAND} SELECT symbol, d, ra AS resolved_at, round(x / close - 1, 6) AS realized FROM (SELECT *, lead(d, 5) OVER w AS ra, lead(close, 5) OVER w AS x FROM bars WHERE symbol <> 'ALL' WINDOW w AS (PARTITION BY symbol ORDER BY d)) WHERE dayofweek(d) = 1",
)
O = ("off10", "off50", "off90")
register(
    "m14_calibration",
    lambda spark, d: rounded(ev.calibration(_panel(spark, d), "excess5", "symbol"), *O),
    f"WITH {PANEL}, ok AS (SELECT symbol, excess5 - q50 AS r FROM pan WHERE q50 IS NOT NULL AND excess5 IS NOT NULL) SELECT symbol, count(*) AS n, round(quantile_cont(r, 0.1), 6) AS off10, round(quantile_cont(r, 0.5), 6) AS off50, round(quantile_cont(r, 0.9), 6) AS off90 FROM ok GROUP BY symbol",
)
register(
    "k3_evenly_spaced",
    lambda spark, d: rounded(ev.evenly_spaced(_brands(spark, d)[0], 40, "symbol", "d").select("symbol", "d", "close"), "close"),
    f"""WITH {BRAND}, x AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars WHERE symbol <> 'ALL')
SELECT symbol, d, round(close, 6) AS close FROM x WHERE n <= 40 OR list_contains([floor(k * (n - 1) / 39.0)::BIGINT for k in range(40)], i)""",
)

_X, _Y = ["q50", "q10", "volume"], ["excess5"]


def _scaling(spark, d):
    return rounded(ev.train_scaling(_panel(spark, d), _brands(spark, d)[1], _X, _Y), "mean", "scale")


SPLIT = "ds AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT d FROM bars WHERE symbol = 'ALL')), tr AS (SELECT d FROM ds WHERE i < floor(n * 0.7) - 22)"
register(
    "m7_train_scaling",
    _scaling,
    f"""WITH {PANEL}, {SPLIT}, w AS (SELECT pan.*, b.volume FROM pan JOIN bars b ON b.symbol = pan.symbol AND b.d = pan.d WHERE pan.d IN (SELECT d FROM tr))
{' UNION ALL '.join(f"SELECT '{c}' AS column, round(avg({c}), 6) AS mean, round(stddev_pop({c}) + 1e-6, 6) AS scale FROM w" for c in _X)} UNION ALL SELECT 'excess5', 0, round(greatest(stddev_pop(excess5), 0.005), 6) FROM w""",
)
_MEAN = "count(*) AS dates, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS sd, round(avg({c}) / stddev_samp({c}), 6) AS ratio"
register(
    "m11_mean_ic",
    lambda spark, d: rounded(ev.mean_of_days(ev.rank_ic(_panel(spark, d), "q50", "excess5"), "ic"), "mean", "sd", "ratio"),
    f"""WITH {PANEL}, ok AS (SELECT *, count(*) OVER (PARTITION BY d) AS n FROM pan WHERE q50 IS NOT NULL AND excess5 IS NOT NULL),
rk AS (SELECT d, {RANK.format(c='q50')} AS p, {RANK.format(c='excess5')} AS t FROM ok WHERE n >= 8), ic AS (SELECT d, corr(p, t) AS ic FROM rk GROUP BY d) SELECT {_MEAN.format(c='ic')} FROM ic WHERE ic IS NOT NULL AND NOT isnan(ic)""",
)
register(
    "m12_mean_alpha",
    lambda spark, d: rounded(ev.mean_of_days(ev.top_decile(_panel(spark, d), "q50", "excess5"), "alpha"), "mean", "sd", "ratio"),
    f"""WITH {PANEL}, ok AS (SELECT * FROM pan WHERE q50 IS NOT NULL AND excess5 IS NOT NULL), c AS (SELECT d, quantile_cont(q50, 0.9) AS cut FROM ok GROUP BY d HAVING count(*) >= 8),
al AS (SELECT d, avg(excess5) - 0.0016 AS alpha FROM ok JOIN c USING (d) WHERE q50 >= cut - 1e-12 GROUP BY d) SELECT {_MEAN.format(c='alpha')} FROM al""",
)


def _from_sql(spark, d):
    """The aggregates by name, in SQL."""
    register_aggregates(spark)
    return spark.sql(
        "SELECT d, round(rank_ic(q50, excess5), 6) AS ic, round(pinball(0.1D, q10, excess5), 6) AS loss10, round(profit_factor(excess5), 6) AS factor FROM {x} GROUP BY d",
        x=_panel(spark, d).select("d", "q10", "q50", "excess5"),
    )


register(
    "u4_sql_aggregates",
    _from_sql,
    f"""WITH {PANEL}, ok AS (SELECT *, count(*) OVER (PARTITION BY d) AS n FROM pan WHERE q50 IS NOT NULL AND excess5 IS NOT NULL),
rk AS (SELECT d, {RANK.format(c='q50')} AS p, {RANK.format(c='excess5')} AS t FROM ok WHERE n >= 8), ic AS (SELECT d, CASE WHEN stddev_pop(p) > 0 AND stddev_pop(t) > 0 THEN corr(p, t) END AS ic FROM rk GROUP BY d),
g AS (SELECT d, avg(greatest(0.1 * (excess5 - q10), -0.9 * (excess5 - q10))) AS loss10, CASE WHEN min(excess5) < 0 THEN sum(greatest(excess5, 0)) / -sum(least(excess5, 0)) END AS factor FROM pan GROUP BY d)
SELECT d, round(ic, 6) AS ic, round(loss10, 6) AS loss10, round(factor, 6) AS factor FROM g LEFT JOIN ic USING (d)""",
)
