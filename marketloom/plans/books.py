"""Queries of exits, exposure, learned weights, holdings, displacement, switches and graph samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketloom.functions.columns import rounded
from marketloom.operators import indicators as ind
from marketloom.operators import joins, panel, signals, sizing, stats
from marketloom.plans.indicators import lag
from marketloom.plans.signals import BR, REGIME, SIGNALS, _regimes
from marketloom.plans.stats import CARD, EV, _evidence
from marketloom.registry import register
from marketloom.sources import fixtures as fx

B, T, EQ, OE = fx.bars_sql(), fx.TRADES_SQL, fx.EQUITY_SQL, fx.ORDER_EVENTS_SQL
BRAND = fx.bars_sql("p_brand", benchmark=False)
TYPES = fx.bars_sql("p_type", benchmark=False)

REASON = "CASE WHEN ret <= -0.04 THEN 'stop hit at close' WHEN horizon_days >= 90 THEN 'time limit' WHEN ret > 0.05 THEN 'target' WHEN ret > 0 THEN '' END"
register(
    "a4_exit_reasons",
    lambda spark, d: stats.exit_reasons(fx.trades(spark, d).withColumn("exit_reason", F.expr(REASON)), "source"),
    f"WITH {T} SELECT source, split_part(coalesce({REASON}, ''), ' ', 1) AS reason, count(*) AS n FROM trades GROUP BY 1, 2",
)


def _exposure(spark, d):
    curve = fx.equity_curve(spark, d).withColumn("cash", F.col("equity") * (F.dayofmonth("d") % 12 - 1) / 10)
    bench = fx.bars(spark, d).where(F.col("symbol") == fx.BENCHMARK)
    filled = fx.order_events(spark, d).where("status = 'filled'").select(F.col("mode").alias("source"), "notional")
    return rounded(stats.exposure_match(curve, bench, filled), "matched_return", "average_exposure", "cash_drag", "turnover", "average_order")


register(
    "a5_exposure_matched",
    _exposure,
    f"""WITH {EQ}, {B}, {OE}, c AS (SELECT source, d, equity, equity * (day(d) % 12 - 1) / 10 AS cash FROM equity),
x AS (SELECT c.*, close, CASE WHEN equity <> 0 THEN greatest(0, least(1, 1 - cash / equity)) ELSE 0 END AS e FROM c LEFT JOIN (SELECT d, close FROM bars WHERE symbol = 'ALL') b ON b.d = c.d),
y AS (SELECT *, lag(e) OVER w * (close / lag(close) OVER w - 1) AS step FROM x WINDOW w AS (PARTITION BY source ORDER BY d)),
g AS (SELECT source, exp(coalesce(sum(ln(1 + step)), 0)) - 1 AS m, avg(e) AS e, avg(equity) AS q FROM y GROUP BY 1),
t AS (SELECT mode AS source, sum(notional) AS s, count(*) AS n FROM oe WHERE status = 'filled' GROUP BY 1)
SELECT source, round(m, 6) AS matched_return, round(e, 6) AS average_exposure, round(1 - e, 6) AS cash_drag, round(coalesce(s, 0) / greatest(q, 1), 6) AS turnover, round(coalesce(s, 0) / greatest(coalesce(n, 0), 1), 6) AS average_order FROM g LEFT JOIN t USING (source)""",
)
_MULT = "least(greatest(1 + 2 * information_ratio * n / (n + {s}), CASE WHEN status = 'experimental' THEN 0.25 ELSE 0.5 END), 1.5)".format(s=stats.SHRINK_N)
register(
    "a7_regime_multipliers",
    lambda spark, d: rounded(stats.regime_multipliers(_evidence(spark, d).withColumn("status", F.when(F.col("node").isin("A", "O"), "experimental").otherwise("active"))), "information_ratio", "multiplier"),
    f"""WITH {EV}, w AS ({CARD.format(by='node')}), c AS ({CARD.format(by='node, regime')}), u AS (SELECT node, NULL AS regime, n, information_ratio FROM w UNION ALL SELECT node, regime, n, information_ratio FROM c WHERE n >= 30 AND regime IS NOT NULL),
s AS (SELECT *, CASE WHEN node IN ('A', 'O') THEN 'experimental' ELSE 'active' END AS status FROM u), m AS (SELECT *, CASE WHEN regime IS NULL AND n < 50 THEN 1 ELSE {_MULT} END AS x FROM s)
SELECT node, regime, status, n, round(information_ratio, 6) AS information_ratio, round(x, 6)::DOUBLE AS multiplier, CASE WHEN regime IS NULL AND n < 50 THEN 'hold' WHEN x <= CASE WHEN status = 'experimental' THEN 0.25 ELSE 0.5 END + 1e-9 THEN 'deemphasized' ELSE 'updated' END AS action FROM m""",
)


def _pairs(spark, d):
    """Sectors as holdings: everything traded, at the last close."""
    b = fx.bars(spark, d, "p_type", False)
    value = b.groupBy("symbol").agg((F.sum("volume") * F.max_by("close", "d")).alias("v"))
    holdings = value.withColumn("weight", F.col("v") / F.sum("v").over(Window.partitionBy())).select("symbol", "weight")  # a row a holding
    r = ind.returns(b, (1,)).where("r1 is not null").select("symbol", "d", F.col("r1").alias("r"))
    return rounded(stats.pair_statistics(r, holdings), "mean", "sd", "correlation", "weight")


register(
    "a12_pair_correlations",
    _pairs,
    f"""WITH {TYPES}, v AS (SELECT symbol, sum(volume) * arg_max(close, d) AS v FROM bars GROUP BY 1), h AS (SELECT symbol, v / sum(v) OVER () AS weight FROM v),
r AS (SELECT * FROM (SELECT symbol, d, close / {lag('close', 1)} - 1 AS r FROM bars) WHERE r IS NOT NULL),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY d DESC) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM r) WHERE k <= 120 AND n > 30),
x AS (SELECT * FROM k WHERE d IN (SELECT d FROM k GROUP BY d HAVING count(*) = (SELECT count(DISTINCT symbol) FROM k)))
SELECT a.symbol AS a, b.symbol AS b, count(*) AS n, round(avg(a.r), 6) AS mean, round(stddev_samp(a.r), 6) AS sd, round(corr(a.r, b.r), 6) AS correlation, round(any_value(weight), 6) AS weight
FROM x a JOIN x b ON a.d = b.d AND a.symbol <= b.symbol JOIN h ON h.symbol = a.symbol GROUP BY 1, 2""",
)


def _outside(spark, d):
    """Brands by week; the target set: the twelve of most volume; every tenth week has none."""
    w = fx.bars(spark, d, "p_brand", False).groupBy(F.trunc("d", "week").alias("week"), "symbol").agg(F.sum("volume").alias("v"))
    cycle = F.floor(F.datediff("week", F.lit("1990-01-01").cast("date")) / 7).cast("int")
    rank = F.row_number().over(Window.partitionBy("week").orderBy(F.desc("v"), "symbol"))
    x = w.select(cycle.alias("cycle"), "symbol", (rank <= 12).alias("in_target"), (cycle % 10 != 3).alias("ranked"), F.concat(F.lit("v"), F.year("week").cast("string")).alias("version"))
    return joins.outside_counts(x).select("cycle", "symbol", "in_target", "ranked", "outside")


register(
    "w20_outside_counts",
    _outside,
    f"""WITH {BRAND}, w AS (SELECT date_trunc('week', d)::DATE AS week, symbol, sum(volume) AS v FROM bars GROUP BY 1, 2),
x AS (SELECT (datediff('day', DATE '1990-01-01', week) // 7)::INT AS cycle, symbol, row_number() OVER (PARTITION BY week ORDER BY v DESC, symbol) <= 12 AS in_target, datediff('day', DATE '1990-01-01', week) // 7 % 10 <> 3 AS ranked, year(week) AS version FROM w),
y AS (SELECT *, coalesce(lag(version) OVER s <> version OR lag(cycle) OVER s <> cycle - 1, false) OR (ranked AND in_target) AS anew FROM x WINDOW s AS (PARTITION BY symbol ORDER BY cycle)),
z AS (SELECT *, sum(anew::INT) OVER (PARTITION BY symbol ORDER BY cycle) AS i FROM y)
SELECT cycle, symbol, in_target, ranked, (sum((ranked AND NOT in_target)::INT) OVER (PARTITION BY symbol, i ORDER BY cycle))::BIGINT AS outside FROM z""",
)
_RESET = "day(d) = 15 AND month(d) % 6 = 1"
RESET = f"""{EQ}, rs AS (SELECT *, sum((day(d) = 15 AND month(d) % 6 = 1)::INT) OVER (PARTITION BY source ORDER BY d) AS part FROM equity), pk AS (SELECT *, max(equity) OVER (PARTITION BY source, part ORDER BY d) AS peak FROM rs)"""
register(
    "w16_peak_since_reset",
    lambda spark, d: rounded(ind.peak_since_reset(fx.equity_curve(spark, d), F.expr(_RESET)), "equity", "peak", "drawdown"),
    f"WITH {RESET} SELECT source, d, round(equity, 6) AS equity, round(peak, 6) AS peak, round(1 - equity / peak, 6) AS drawdown FROM pk",
)
register(
    "p7_switches",
    lambda spark, d: rounded(sizing.switches(fx.equity_curve(spark, d), F.expr(_RESET)), "day_loss", "week_loss", "drawdown"),
    f"""WITH {RESET}, x AS (SELECT source, d, 1 - equity / last(equity) OVER (w RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING) AS dl, 1 - equity / last(equity) OVER (w RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 7 DAY PRECEDING) AS wl, 1 - equity / peak AS pl FROM pk WINDOW w AS (PARTITION BY source ORDER BY d)),
f AS (SELECT *, coalesce(dl > 0.02, false)::INT AS a, coalesce(wl > 0.05, false)::INT AS b, (pl > 0.15)::INT AS c FROM x)
SELECT source, d, round(dl, 6) AS day_loss, round(wl, 6) AS week_loss, round(pl, 6) AS drawdown, a = 1 AS daily_loss, max(b) OVER (w RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) = 1 AS weekly_loss,
  max(c) OVER (w RANGE BETWEEN INTERVAL 9 DAY PRECEDING AND CURRENT ROW) = 1 AS drawdown_halt FROM f WINDOW w AS (PARTITION BY source ORDER BY d)""",
)
register(
    "p7_rejections",
    lambda spark, d: sizing.rejections(fx.order_events(spark, d).withColumn("clears", F.expr("status = 'filled' and notional >= 450"))),
    f"""WITH {fx.ORDER_EVENTS_SQL}, x AS (SELECT mode, ts::DATE AS d, status, sum((status = 'filled' AND notional >= 450)::INT) OVER (PARTITION BY mode, ts::DATE ORDER BY ts, id) AS part FROM oe),
g AS (SELECT mode, d, part, count(*) FILTER (WHERE status = 'rejected') AS n FROM x GROUP BY 1, 2, 3)
SELECT mode, d, max(n) AS rejected, max(n) > 5 AS rejected_orders FROM g GROUP BY 1, 2 HAVING max(n) > 0""",
)
NODES = ("momentum", "reversal", "gap", "vol_contraction", "sector_rotation")


def _samples(spark, d):
    # Read for the signals, the regimes and the labels: written once.
    bars = fx.stored(fx.bars(spark, d), "bars")
    s = signals.price_signals(bars).where(F.col("symbol") != fx.BENCHMARK)
    return panel.graph_samples(s, _regimes(spark, d), bars, fx.BENCHMARK, NODES)


SAMPLES = f"""{SIGNALS}, {BR}, {REGIME}, ah AS (SELECT * FROM (SELECT symbol, d, lead(close, 5) OVER w / close - 1 AS r5, lead(close, 21) OVER w / close - 1 AS r21 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY d)) WHERE r21 IS NOT NULL),
ac AS (SELECT d, symbol, {', '.join(f"max(CASE WHEN node_id = '{k}' THEN CASE WHEN direction = 'long' THEN 1 ELSE -1 END * abs(score) * confidence END) AS {k}" for k in NODES)} FROM raw WHERE symbol <> 'ALL' GROUP BY 1, 2),
sa AS (SELECT ac.d AS as_of, ac.symbol, {', '.join(NODES)}, CASE rg.regime WHEN 'risk_on' THEN 1.0 WHEN 'neutral' THEN 0.3 WHEN 'risk_off' THEN -0.5 WHEN 'stress' THEN -1.0 END::DOUBLE AS macro_regime, ah.r5 - m.r5 AS y5, ah.r21 - m.r21 AS y21
  FROM ac JOIN ah ON ah.d = ac.d AND ah.symbol = ac.symbol JOIN ah m ON m.symbol = 'ALL' AND m.d = ac.d LEFT JOIN rg ON rg.d = ac.d)"""
register(
    "m20_graph_samples",
    lambda spark, d: rounded(_samples(spark, d), *NODES, "y5", "y21"),
    fx.settled(f"WITH {SAMPLES} SELECT as_of, symbol, {', '.join(f'round({c}, 6) AS {c}' for c in (*NODES, 'y5', 'y21'))}, macro_regime FROM sa"),
)
#: A fixed graph: what each node's activation adds to the score.
GRAPH = {"momentum": 0.4, "reversal": 0.2, "gap": 0.15, "vol_contraction": 0.25, "sector_rotation": 0.5, "macro_regime": 0.5}


def _sealed(spark, d):
    score = sum((F.coalesce(k, F.lit(0.0)) * w for k, w in GRAPH.items()), F.lit(0.0))
    x = fx.stored(_samples(spark, d), "samples")  # read for the dates, the ends and the report
    return rounded(panel.sealed_report(x, F.tanh(score), {5: 0.02, 21: 0.04}), "coverage", "ic", digits=5)


register(
    "m21_sealed_report",
    _sealed,
    f"""WITH {SAMPLES}, dt AS (SELECT as_of, row_number() OVER (ORDER BY as_of) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT as_of FROM sa)),
x AS (SELECT horizon, k >= floor(n * 0.85) AS test, tanh({' + '.join(f'coalesce({k}, 0) * {w}' for k, w in GRAPH.items())}) * CASE horizon WHEN 5 THEN 0.02 ELSE 0.04 END AS p, CASE horizon WHEN 5 THEN y5 ELSE y21 END AS y
  FROM sa JOIN dt USING (as_of), (SELECT unnest([5, 21])::INT AS horizon) WHERE k >= floor(n * 0.7)),
e AS (SELECT horizon, quantile_cont(round(y - p, 4), 0.1) AS lo, quantile_cont(round(y - p, 4), 0.9) AS hi FROM x WHERE NOT test GROUP BY 1)
SELECT horizon, count(*) AS n, round(avg((y >= p + lo AND y <= p + hi)::INT), 5) AS coverage, round(CASE WHEN stddev_samp(p) > 1e-12 AND stddev_samp(y) > 1e-12 THEN corr(p, y) ELSE 0 END, 5) AS ic FROM x JOIN e USING (horizon) WHERE test GROUP BY 1""",
)
