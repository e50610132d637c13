"""Queries of the feature panel, baselines, cohorts and model gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketloom.functions.columns import rounded
from marketloom.operators import evaluation as ev
from marketloom.operators import fusion
from marketloom.operators import indicators as ind
from marketloom.operators import panel as pn
from marketloom.plans.evaluation import LABELS, PANEL, RANK, _brands, _panel
from marketloom.plans.indicators import full, lag
from marketloom.plans.signals import VOL, VOL_COLS  # noqa: F401
from marketloom.registry import register
from marketloom.sources import fixtures as fx

ST, NEWS = fx.STATEMENTS_SQL, fx.NEWS_SQL
BRAND = fx.bars_sql("p_brand", benchmark=False)
ALL = fx.bars_sql("p_brand")
TAGS = fx.STATEMENT_TAGS
CIK = "(replace(symbol, 'Brand#', '')::BIGINT)"


def _owned(spark, d):
    """Brand bars; the brand's number is the issuer."""
    return fx.bars(spark, d, "p_brand", False).withColumn("cik", F.regexp_replace("symbol", "Brand#", "").cast("long"))


OWN = f"{BRAND}, own AS (SELECT *, {CIK} AS cik FROM bars)"
VAL = f"""ep AS (SELECT cik, filed AS d, arg_max(value, period_end) AS eps FROM st WHERE form = '10-K' AND tag = 'EarningsPerShareDiluted' GROUP BY 1, 2),
va AS (SELECT symbol, own.d, CASE WHEN eps <> 0 THEN greatest(least(close / eps, 100), -100) / 25 END AS pe FROM own ASOF LEFT JOIN ep ON own.cik = ep.cik AND own.d >= ep.d)"""
register(
    "m2_valuation",
    lambda spark, d: rounded(pn.valuation(_owned(spark, d), fx.statements(spark, d)).select("symbol", "d", "valuation", "valuation_missing"), "valuation"),
    f"WITH {ST}, {OWN}, {VAL} SELECT symbol, d, round(coalesce(pe, 0), 6) AS valuation, (pe IS NULL)::INT::DOUBLE AS valuation_missing FROM va",
)
EVT = "fi AS (SELECT DISTINCT cik, filed FROM st), et AS (SELECT symbol, d, filed, datediff('day', filed, d) AS n FROM own ASOF LEFT JOIN fi ON own.cik = fi.cik AND own.d >= fi.filed)"
register(
    "m3_event_proximity",
    lambda spark, d: rounded(pn.event_proximity(_owned(spark, d), fx.statements(spark, d)).select("symbol", "d", "event_proximity", "event_missing"), "event_proximity"),
    f"WITH {ST}, {OWN}, {EVT} SELECT symbol, d, round(CASE WHEN n <= 30 THEN exp(-n / 10) ELSE 0 END, 6)::DOUBLE AS event_proximity, (filed IS NULL)::INT::DOUBLE AS event_missing FROM et",
)


def _last(c: str, before: bool = False) -> str:
    return f"last_value({c} IGNORE NULLS) OVER (PARTITION BY cik ORDER BY filed ROWS BETWEEN UNBOUNDED PRECEDING AND {'1 PRECEDING' if before else 'CURRENT ROW'})"


PIV = ", ".join(f"arg_max(value, period_end) FILTER (WHERE tag = '{t}') AS {t}" for t in TAGS)
FREE = "(NetCashProvidedByUsedInOperatingActivities - coalesce(PaymentsToAcquirePropertyPlantAndEquipment, 0))"
DEBT = "CASE WHEN coalesce(LongTermDebtCurrent, 0) <> 0 THEN LongTermDebtCurrent ELSE LongTermDebt END"
FUND = {
    "revenue_growth": "CASE WHEN pr <> 0 THEN Revenues / pr END - 1", "operating_margin": "CASE WHEN Revenues <> 0 THEN OperatingIncomeLoss / Revenues END", "fcf_margin": f"CASE WHEN Revenues <> 0 THEN {FREE} / Revenues END",
    "debt_assets": f"CASE WHEN Assets <> 0 THEN {DEBT} / Assets END", "dilution": "CASE WHEN ps <> 0 THEN CommonStockSharesOutstanding / ps END - 1",
    "accruals": "CASE WHEN Assets <> 0 THEN (NetIncomeLoss - NetCashProvidedByUsedInOperatingActivities) / Assets END", "liquidity": "CASE WHEN LiabilitiesCurrent <> 0 THEN AssetsCurrent / LiabilitiesCurrent END - 1",
}
THEN = f"""f1 AS (SELECT cik, filed, {PIV} FROM st WHERE form = '10-K' GROUP BY 1, 2), f2 AS (SELECT cik, filed, {', '.join(f'{_last(t)} AS {t}' for t in TAGS)} FROM f1),
f3 AS (SELECT *, {_last('Revenues', True)} AS pr, {_last('CommonStockSharesOutstanding', True)} AS ps FROM f2), f4 AS (SELECT cik, filed, {', '.join(f'CASE WHEN ({v}) IS NOT NULL THEN greatest(least({v}, 3), -3) END AS {k}' for k, v in FUND.items())} FROM f3),
f5 AS (SELECT cik, filed, {', '.join(f'{_last(k)} AS {k}' for k in FUND)} FROM f4),
fu AS (SELECT symbol, d, {', '.join(FUND)} FROM own ASOF LEFT JOIN f5 ON own.cik = f5.cik AND own.d >= f5.filed)"""
register(
    "m4_then_known",
    lambda spark, d: rounded(pn.then_known(_owned(spark, d), fx.statements(spark, d), TAGS).select("symbol", "d", *pn.FUNDAMENTALS, *(f"{c}_missing" for c in pn.FUNDAMENTALS)), *pn.FUNDAMENTALS),
    f"WITH {ST}, {OWN}, {THEN} SELECT symbol, d, {', '.join(f'round(coalesce({k}, 0), 6) AS {k}, ({k} IS NULL)::INT::DOUBLE AS {k}_missing' for k in FUND)} FROM fu",
)


def _market(spark, d):
    """A row for each date: the market's returns and deviation, and the volatility context."""
    b = fx.bars(spark, d, "p_brand").where(F.col("symbol") == fx.BENCHMARK)
    m = ind.realized_vol(ind.returns(b, (1, 21)), (21,)).select("d", F.col("r1").alias("m_r1"), F.col("r21").alias("m_r21"), F.col("vol21").alias("m_vol"))
    return m.join(fusion.vol_context(b).select("d", *VOL_COLS), "d")


def _features(spark, d):
    """The whole panel: temporal, context, valuation, filings, fundamentals and news columns."""
    facts = fx.statements(spark, d)
    x = pn.price_features(_owned(spark, d), _market(spark, d))
    x = pn.then_known(pn.event_proximity(pn.valuation(x, facts), facts), facts, TAGS)
    shifted = fx.news(spark, d).withColumn("published_at", F.col("published_at") - F.make_dt_interval(days=F.lit(10_000)))
    return pn.news_features(x, shifted).drop("cik", "close")


PRICE_COLS = ["r1", "range", "gap", "volume_z", "vol21", "atr14", "breakout60", "rsi14", "sma50_d", "sma200_d", "relative_r21", "spy_r1", "spy_r21", "vix", "vix9d", "vix3m", "vix6m", "vvix", "vix_curve_9d_3m", "vix_curve_1m_3m", "implied_realized_spread", "vol_context_missing"]
MORE_COLS = ["valuation", "valuation_missing", "event_proximity", "event_missing", *(c + m for c in pn.FUNDAMENTALS for m in ("", "_missing")), "news_sentiment", "news_missing"]
PRICES = f"""p1 AS (SELECT *, close / {lag('close', 1)} - 1 AS r1, close / {lag('close', 21)} - 1 AS r21, {lag('close', 1)} AS pc, ln(1 + volume) AS lv FROM bars),
p2 AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, CASE WHEN r1 IS NOT NULL THEN greatest(r1, 0) END AS g, CASE WHEN r1 IS NOT NULL THEN greatest(-r1, 0) END AS l, {full('stddev_samp', 'r1', 21)} AS vol21 FROM p1),
p3 AS (SELECT symbol, d, close, r1, r21, (high - low) / close AS range, open / pc - 1 AS gap, (lv - {full('avg', 'lv', 21)}) / ({full('stddev_samp', 'lv', 21)} + 1e-8) AS volume_z, vol21, {full('avg', 'tr', 14)} / close AS atr14,
  (close - {full('min', 'close', 60)}) / ({full('max', 'close', 60)} - {full('min', 'close', 60)} + 1e-8) - 0.5 AS breakout60, {full('avg', 'g', 14)} / ({full('avg', 'g', 14)} + {full('avg', 'l', 14)} + 1e-8) - 0.5 AS rsi14,
  close / {full('avg', 'close', 50)} - 1 AS sma50_d, close / {full('avg', 'close', 200)} - 1 AS sma200_d FROM p2),
mk AS (SELECT p3.d, p3.r1 AS spy_r1, p3.r21 AS spy_r21, p3.vol21 AS mv, vols.* EXCLUDE (d, symbol, open, high, low, close, volume, r1) FROM p3 JOIN vols ON vols.d = p3.d WHERE p3.symbol = 'ALL'),
pf AS (SELECT p3.*, p3.r21 - spy_r21 AS relative_r21, spy_r1, spy_r21, v21 / 20 - 1 AS vix, coalesce(v9 / 20 - 1, 0) AS vix9d, coalesce(v63 / 20 - 1, 0) AS vix3m, coalesce(v126 / 20 - 1, 0) AS vix6m, coalesce(mk.vvix / 100 - 1, 0) AS vvix,
  coalesce(slope_9d_3m, 0) AS vix_curve_9d_3m, coalesce(slope_1m_3m, 0) AS vix_curve_1m_3m, coalesce((v21 - mv * sqrt(252) * 100) / 20, 0) AS implied_realized_spread,
  (v9 IS NULL OR v63 IS NULL OR v126 IS NULL OR mk.vvix IS NULL)::INT::DOUBLE AS vol_context_missing FROM p3 LEFT JOIN mk ON mk.d = p3.d WHERE p3.symbol <> 'ALL')"""
NWS = """nd AS (SELECT symbol, published_at::DATE - 10000 AS d, avg(stance * confidence * reliability) AS v FROM news WHERE stance IS NOT NULL GROUP BY 1, 2), nr AS (SELECT symbol, d, avg(v) OVER (PARTITION BY symbol ORDER BY d ROWS 2 PRECEDING) AS ns FROM nd),
nw AS (SELECT own.symbol, own.d, ns FROM own ASOF LEFT JOIN nr ON own.symbol = nr.symbol AND own.d >= nr.d)"""
register(
    "m1_feature_panel",
    lambda spark, d: rounded(_features(spark, d).select("symbol", "d", *PRICE_COLS, *MORE_COLS), *PRICE_COLS, *MORE_COLS),
    f"""WITH {ST}, {NEWS}, {ALL}, {VOL}, own AS (SELECT *, {CIK} AS cik FROM bars WHERE symbol <> 'ALL'), {VAL}, {EVT}, {THEN}, {NWS}, {PRICES}
SELECT pf.symbol, pf.d, {', '.join(f'round(pf.{c}, 6) AS {c}' for c in PRICE_COLS)}, round(coalesce(pe, 0), 6) AS valuation, (pe IS NULL)::INT::DOUBLE AS valuation_missing, round(CASE WHEN n <= 30 THEN exp(-n / 10) ELSE 0 END, 6)::DOUBLE AS event_proximity, (filed IS NULL)::INT::DOUBLE AS event_missing,
  {', '.join(f'round(coalesce(fu.{k}, 0), 6) AS {k}, (fu.{k} IS NULL)::INT::DOUBLE AS {k}_missing' for k in FUND)}, round(coalesce(ns, 0), 6) AS news_sentiment, (ns IS NULL)::INT::DOUBLE AS news_missing
FROM pf JOIN va ON va.symbol = pf.symbol AND va.d = pf.d JOIN et ON et.symbol = pf.symbol AND et.d = pf.d JOIN fu ON fu.symbol = pf.symbol AND fu.d = pf.d JOIN nw ON nw.symbol = pf.symbol AND nw.d = pf.d""",
)
register(
    "a16_daily_news",
    lambda spark, d: rounded(pn.news_features(fx.bars(spark, d, "p_brand", False).select("symbol", "d"), fx.news(spark, d).withColumn("published_at", F.col("published_at") - F.make_dt_interval(days=F.lit(10_000)))), "news_sentiment"),
    f"WITH {NEWS}, {BRAND}, own AS (SELECT * FROM bars), {NWS} SELECT symbol, d, round(coalesce(ns, 0), 6) AS news_sentiment, (ns IS NULL)::INT::DOUBLE AS news_missing FROM nw",
)
INPUTS = ["r1", "range", "gap"]


def _ridge(spark, d):
    """Zero, momentum and ridge baselines by split; the ridge is fitted on the first 70 per cent."""
    stocks, bench = _brands(spark, d)
    x = ev.dual_labels(ind.range_gap(ind.returns(stocks, (1,))).withColumnRenamed("day_range", "range"), bench).join(ev.chronological_split(bench).select("d", "split"), "d")
    x = x.where("r1 is not null and gap is not null and excess5 is not null")
    w = pn.ridge(x.where("split = 'train'"), INPUTS, "excess5")
    y = x.withColumns({"zero": F.lit(0.0), "momentum": F.col("r1") * 5**0.5, "ridge": pn.linear(w, INPUTS)})
    y = y.select("split", "excess5", F.expr("stack(3, 'zero', zero, 'momentum', momentum, 'ridge', ridge) as (model, q50)"))
    bands = y.where("split = 'train'").groupBy("model").agg(*(F.percentile(F.col("excess5") - F.col("q50"), q).alias(f"o{int(q * 100)}") for q in (0.1, 0.9)))
    y = y.join(F.broadcast(bands), "model").withColumns({"q10": F.col("q50") + F.col("o10"), "q90": F.col("q50") + F.col("o90")})
    return rounded(ev.forecast_metrics(y, "excess5", "model", "split"), "pinball", "coverage", "direction", "brier", digits=4)


RB = f"""{LABELS}, sp0 AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT d FROM bars WHERE symbol = 'ALL')),
sp AS (SELECT d, CASE WHEN i < floor(n * 0.7) - 22 THEN 'train' WHEN i < floor(n * 0.7) THEN 'embargo' WHEN i < floor(n * 0.85) - 22 THEN 'validation' WHEN i < floor(n * 0.85) THEN 'embargo' ELSE 'test' END AS split FROM sp0)"""
register("m9_baselines", _ridge)
H = 21


def _cohort_panel(spark, d):
    """The momentum baseline and its 21-session excess, with ties and halves rounded away."""
    stocks, bench = _brands(spark, d)
    x = ev.dual_labels(stocks.withColumn("q50", ind.ret(1)), bench)
    return x.select("symbol", "d", F.round("q50", 8).alias("q50"), F.round("excess21", 8).alias("excess21"))


COH = f"""{LABELS}, cp AS (SELECT d, round(r1, 8) AS q, round(e21, 8) AS e FROM lab WHERE r1 IS NOT NULL AND e21 IS NOT NULL), dy AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i FROM (SELECT DISTINCT d FROM cp)),
ct AS (SELECT d, quantile_cont(q, 0.9) AS cut FROM cp GROUP BY d HAVING count(*) >= 8), pk AS (SELECT cp.d, avg(e) - 0.0016 AS r FROM cp JOIN ct USING (d) WHERE q >= cut GROUP BY 1),
cw AS (SELECT i % 21 AS off, i, r, exp(sum(ln(1 + r)) OVER (PARTITION BY i % 21 ORDER BY i)) AS lv FROM pk JOIN dy USING (d)), cd AS (SELECT *, 1 - lv / max(lv) OVER (PARTITION BY off ORDER BY i) AS dd FROM cw),
co AS (SELECT off, count(*) AS cohorts, avg(r) * 12 AS annualized, avg(r) / (stddev_pop(r) + 1e-9) * sqrt(12) AS sharpe, max(dd) AS max_drawdown FROM cd GROUP BY 1)"""
C = ("annualized", "sharpe", "max_drawdown")
register(
    "m17_cohorts",
    lambda spark, d: rounded(pn.cohorts(_cohort_panel(spark, d), "q50", "excess21", H), *C),
    f"WITH {COH} SELECT off AS \"offset\", cohorts, {', '.join(f'round({c}, 6) AS {c}' for c in C)} FROM co",
)
register(
    "m17_staggered_utility",
    lambda spark, d: rounded(pn.staggered(pn.cohorts(_cohort_panel(spark, d).withColumn("model", F.lit("momentum")), "q50", "excess21", H, "model"), "model"), "utility", "sharpe", "max_drawdown", "worst_sharpe"),
    f"""WITH {COH}, ok AS (SELECT * FROM co WHERE cohorts >= 3), g AS (SELECT count(*) AS n, median(annualized) AS a, median(sharpe) AS s, median(max_drawdown) AS m, min(sharpe) AS w FROM ok)
SELECT 'momentum' AS model, n AS offsets, CASE WHEN n < 8 THEN 'insufficient' ELSE 'ok' END AS evidence, round(CASE WHEN n < 8 THEN -1 ELSE a - 0.5 * m END, 6) AS utility, round(CASE WHEN n < 8 THEN -99 ELSE s END, 6) AS sharpe, round(CASE WHEN n < 8 THEN 1 ELSE m END, 6) AS max_drawdown, CASE WHEN n >= 8 THEN round(w, 6) END AS worst_sharpe FROM g""",
)


def _model_metrics(spark, d):
    """Forward metrics of a model for each symbol, as the table of models; one horizon."""
    p = _panel(spark, d).where("q50 is not null and excess5 is not null")
    m = ev.forecast_metrics(p, "excess5", "symbol")
    ic = p.groupBy("symbol").agg(F.round(F.corr("q50", "excess5"), 6).alias("ic"), F.round(F.avg(F.when(F.col("q50") > 0, F.col("excess5"))) - 0.0016, 6).alias("alpha"), F.count_distinct("d").alias("sessions"))
    m = m.withColumns({c: F.round(c, 9) for c in ("pinball", "coverage", "direction")})
    return m.join(ic, "symbol").select(F.col("symbol").alias("model"), F.lit(5).alias("horizon"), "n", "pinball", "coverage", "direction", "ic", "alpha", "sessions")


MET = f"""{PANEL}, ok AS (SELECT * FROM pan WHERE q50 IS NOT NULL AND excess5 IS NOT NULL),
met AS (SELECT symbol AS model, count(*) AS n, round((avg(greatest(0.1 * (excess5 - q10), -0.9 * (excess5 - q10))) + avg(greatest(0.5 * (excess5 - q50), -0.5 * (excess5 - q50))) + avg(greatest(0.9 * (excess5 - q90), -0.1 * (excess5 - q90)))) / 3, 9) AS pinball,
  round(avg((excess5 BETWEEN q10 AND q90)::INT), 9) AS coverage, round(avg(((excess5 > 0) = (q50 > 0))::INT), 9) AS direction, round(corr(q50, excess5), 6) AS ic, round(avg(excess5) FILTER (WHERE q50 > 0) - 0.0016, 6) AS alpha, count(DISTINCT d) AS sessions FROM ok GROUP BY 1)"""
register(
    "m13_selection_score",
    lambda spark, d: _model_metrics(spark, d).select("model", F.round(pn.selection_score(F.col("ic"), F.col("alpha"), F.col("coverage"), F.col("pinball")), 6).alias("score")),
    f"WITH {MET} SELECT model, round(ic + 4 * alpha - 0.25 * abs(coverage - 0.8) - pinball, 6) AS score FROM met",
)
register(
    "m15_shadow_metrics",
    lambda spark, d: _model_metrics(spark, d),
    f"WITH {MET} SELECT *, 5 AS horizon FROM met",
)
register(
    "m18_promotion_gates",
    lambda spark, d: pn.promotion_gates(_model_metrics(spark, d)),
    f"""WITH {MET}, fl AS (SELECT model, concat_ws(',', CASE WHEN NOT coalesce(ic > 0, false) THEN 'ic' END, CASE WHEN NOT coalesce(alpha > 0, false) THEN 'alpha' END, CASE WHEN NOT coverage BETWEEN 0.75 AND 0.85 THEN 'coverage' END, CASE WHEN n < 10000 THEN 'rows' END, CASE WHEN sessions < 30 THEN 'sessions' END) AS failed FROM met)
SELECT model, failed = '' AS promoted, failed FROM fl""",
)
register(
    "m24_holding_gates",
    lambda spark, d: pn.holding_gates(_model_metrics(spark, d), _model_metrics(spark, d).groupBy("horizon").agg(F.round(F.max("pinball"), 9).alias("pinball"))),
    f"WITH {MET}, g AS (SELECT round(max(pinball), 9) AS p FROM met) SELECT model, coalesce(pinball <= 0.95 * p AND ic > 0 AND direction > 0.52 AND coverage BETWEEN 0.75 AND 0.85 AND n >= 200, false) AS serves FROM met, g",
)


def _beats(spark, d):
    m = _model_metrics(spark, d).withColumn("selection", pn.selection_score(F.col("ic"), F.col("alpha"), F.col("coverage"), F.col("pinball")))
    base = m.where("model in ('Brand#3', 'Brand#7', 'Brand#11')")
    return pn.beats_baselines(m, base)


register(
    "m25_beats_baselines",
    _beats,
    f"""WITH {MET}, s AS (SELECT *, ic + 4 * alpha - 0.25 * abs(coverage - 0.8) - pinball AS sel FROM met) SELECT a.model, 5 AS horizon, bool_and(a.pinball < b.pinball AND a.sel > b.sel) AS beats FROM s a, s b WHERE b.model IN ('Brand#3', 'Brand#7', 'Brand#11') GROUP BY 1""",
)


def _calibrated(spark, d):
    """The offsets of each symbol applied to its own forecasts, crossed ones put in order."""
    p = _panel(spark, d).where("q50 is not null and excess5 is not null").withColumn("p", F.when(F.col("q50") > 0, 0.6).otherwise(0.4))
    rate = p.groupBy("symbol").agg(F.avg((F.col("excess5") > 0).cast("double")).alias("hit"), F.avg("p").alias("said"))
    logit = lambda c: F.log(F.greatest(F.least(c, F.lit(0.99)), F.lit(0.01)) / (1 - F.greatest(F.least(c, F.lit(0.99)), F.lit(0.01))))
    off = ev.calibration(p, "excess5", "symbol").drop("n").join(rate.select("symbol", (logit(F.col("hit")) - logit(F.col("said"))).alias("shift")), "symbol")
    return rounded(pn.apply_calibration(p, off, "symbol").select("symbol", "d", *((F.col(c) + 1e-9).alias(c) for c in ("q10", "q50", "q90", "p"))), "q10", "q50", "q90", "p")


def _logit(c: str) -> str:
    return f"ln(greatest(least({c}, 0.99), 0.01) / (1 - greatest(least({c}, 0.99), 0.01)))"


register(
    "m14_apply_calibration",
    _calibrated,
    f"""WITH {PANEL}, ok AS (SELECT *, CASE WHEN q50 > 0 THEN 0.6 ELSE 0.4 END AS p FROM pan WHERE q50 IS NOT NULL AND excess5 IS NOT NULL),
o AS (SELECT symbol, quantile_cont(excess5 - q50, 0.1) AS a, quantile_cont(excess5 - q50, 0.5) AS b, quantile_cont(excess5 - q50, 0.9) AS c, {_logit('avg((excess5 > 0)::INT)')} - {_logit('avg(p)')} AS sh FROM ok GROUP BY 1)
SELECT ok.symbol, d, round(q50 + a + 1e-9, 6) AS q10, round(q50 + b + 1e-9, 6) AS q50, round(q50 + c + 1e-9, 6) AS q90, round(1 / (1 + exp(-(ln(p / (1 - p)) + sh))) + 1e-9, 6) AS p FROM ok JOIN o ON ok.symbol = o.symbol""",
)


def _resolved(spark, d):
    """Every session's forecast with its own and the benchmark's return five sessions on."""
    stocks, bench = _brands(spark, d)
    own = ev.nth_next(stocks.select("symbol", "d"), stocks, 5).select("symbol", "d", "resolved_at", "realized")
    base = ev.nth_next(bench.select("symbol", "d"), bench, 5).select("d", F.col("realized").alias("b"))
    return rounded(own.join(base, "d", "left").select("symbol", "d", "resolved_at", "realized", (F.col("realized") - F.col("b")).alias("excess")), "realized", "excess")


register(
    "m16_resolved_excess",
    _resolved,
    f"""WITH {ALL}, l AS (SELECT *, lead(d, 5) OVER w AS ra, lead(close, 5) OVER w / close - 1 AS r FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY d))
SELECT x.symbol, x.d, x.ra AS resolved_at, round(x.r, 6) AS realized, round(x.r - b.r, 6) AS excess FROM l x LEFT JOIN l b ON b.symbol = 'ALL' AND b.d = x.d WHERE x.symbol <> 'ALL'""",
)
KIND = "CASE user_id % 3 WHEN 0 THEN 'graph' WHEN 1 THEN 'temporal' ELSE 'holding' END"


def _models(spark, d):
    e = fx.table(spark, d, "events")
    g = e.groupBy(F.col("user_id").alias("id"), F.expr(KIND).alias("kind")).agg(F.round(F.max("value"), 2).alias("score"), F.min("ts").alias("created_at"))
    return pn.finalists(g).select("id", "kind", "score", "place")


register(
    "m19_finalists",
    _models,
    f"WITH g AS (SELECT user_id AS id, {KIND} AS kind, round(max(value), 2) AS score, min(ts) AS at FROM events GROUP BY 1, 2) SELECT id, kind, score, row_number() OVER (PARTITION BY kind ORDER BY score DESC, g.at, id) AS place FROM g",
)
register(
    "m22_model_states",
    lambda spark, d: pn.latest_states(fx.table(spark, d, "events").select(F.col("user_id").alias("model"), F.col("event_type").alias("state"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("id"))),
    "SELECT user_id AS model, arg_max(event_type, (ts, event_id)) AS state, max(ts) AS since, count(*) AS transitions FROM events GROUP BY 1",
)


def _ramp(spark, d):
    """A graph and a temporal model for each user, with metrics from the user's events."""
    e = fx.table(spark, d, "events").groupBy(F.col("user_id").alias("u")).agg(F.count(F.lit(1)).alias("c"), F.round(F.avg("value"), 3).alias("v"))
    u, c, v = F.col("u"), F.col("c"), F.col("v")
    m = lambda k: F.struct((c * 3 + u % 20 + k).alias("sessions"), (c * 500 + u % 7 * 2000).alias("n"), (v / 1000 - 0.02).alias("ic"), (v / 500 - 0.05).alias("alpha"), (0.68 + u % 11 / 100).alias("least_cov"), (0.80 + u % 13 / 100).alias("most_cov"))
    rows = e.select(u.alias("id"), (u % 4).cast("int").alias("stage"), F.when(u % 29 > 0, m(0)).alias("graph"), F.when(u % 31 > 0, m(1)).alias("temporal"), (u % 5).alias("trained_with"), F.when(u % 23 > 0, u % 5).otherwise(9).alias("temporal_id"), (u % 9).alias("age"))
    return pn.activation(rows).select("id", "stage", "blend", "blocked")


M = "{k}s >= 21 AND n >= 5000 AND ic >= 0.01 AND al > 0"
register(
    "m23_activation_ramp",
    _ramp,
    """WITH e AS (SELECT user_id AS u, count(*) AS c, round(avg(value), 3) AS v FROM events GROUP BY 1), x AS (SELECT u, c * 3 + u % 20 AS s, c * 500 + u % 7 * 2000 AS n, v / 1000 - 0.02 AS ic, v / 500 - 0.05 AS al, 0.68 + u % 11 / 100 AS lo, 0.80 + u % 13 / 100 AS hi, greatest(1, u % 4) AS st,
  CASE WHEN u % 29 = 0 THEN 'graph missing' WHEN u % 31 = 0 THEN 'temporal model missing' WHEN u % 23 = 0 THEN 'mismatch' WHEN u % 9 > 7 THEN 'stale' END AS blocked FROM e),
y AS (SELECT *, CASE WHEN st < 2 AND s >= 21 AND n >= 5000 AND ic >= 0.01 AND al > 0 THEN 2 ELSE st END AS s2 FROM x), z AS (SELECT *, CASE WHEN s2 < 3 AND s >= 30 AND n >= 10000 AND lo >= 0.75 AND hi <= 0.85 AND al > 0 THEN 3 ELSE s2 END AS s3 FROM y),
w AS (SELECT *, CASE WHEN blocked IS NOT NULL THEN 0 WHEN s3 > 1 AND NOT (n < 1000 OR (ic > 0 AND lo >= 0.7 AND hi <= 0.9)) THEN s3 - 1 ELSE s3 END AS stage FROM z)
SELECT u AS id, stage::INT AS stage, CASE stage WHEN 0 THEN 0.0 WHEN 1 THEN 0.1 WHEN 2 THEN 0.25 ELSE 0.5 END::DOUBLE AS blend, blocked FROM w""",
)
