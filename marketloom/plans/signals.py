"""Queries of signals, regimes and fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.functions.columns import rounded
from marketloom.operators import fusion, signals
from marketloom.operators import indicators as ind
from marketloom.plans.indicators import BRANDS, full, lag
from marketloom.registry import register
from marketloom.sources import fixtures as fx

B = fx.bars_sql()
W = "(PARTITION BY symbol ORDER BY d)"

#: The panel of every indicator and all five rules.
PANEL = f"""{B},
p1 AS (SELECT *, row_number() OVER {W} AS n_bars, lag(close) OVER {W} AS pc, close / {lag('close', 1)} - 1 AS r1, close / {lag('close', 5)} - 1 AS r5,
  close / {lag('close', 21)} - 1 AS r21, close / {lag('close', 63)} - 1 AS r63, {lag('close', 21)} / {lag('close', 252)} - 1 AS r12_1,
  {full('avg', 'close', 20)} AS sma20, {full('avg', 'close', 50)} AS sma50, {full('avg', 'close', 200)} AS sma200, {full('max', 'close', 60)} AS hi60,
  {full('avg', 'close', 50, -1)} AS settled50 FROM bars),
p2 AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, CASE WHEN pc IS NOT NULL THEN greatest(close - pc, 0) END AS g,
  CASE WHEN pc IS NOT NULL THEN greatest(pc - close, 0) END AS l FROM p1),
p3 AS (SELECT *, CASE WHEN n_bars > 14 THEN avg(tr) OVER (PARTITION BY symbol ORDER BY d ROWS 13 PRECEDING) / close END AS atr_pct,
  {full('avg', 'g', 14)} AS mg, {full('avg', 'l', 14)} AS ml, {full('stddev_samp', 'r1', 60)} AS vol60, {full('stddev_samp', 'r1', 20)} AS sd_now,
  {full('stddev_samp', 'r1', 20, -60)} AS sd_before FROM p2),
p4 AS (SELECT *, CASE WHEN atr_pct > 0 THEN atr_pct ELSE 0.02 END AS a, CASE WHEN ml = 0 THEN 100 ELSE 100 - 100 / (1 + mg / ml) END AS rsi,
  CASE WHEN sd_before > 0 THEN sd_now / sd_before END AS vr, sd_now * sqrt(20) * close AS band, open / pc - 1 AS gap FROM p3),
bench AS (SELECT d, r63 AS b63, r21 AS b21 FROM p4 WHERE symbol = 'ALL'),
p5 AS (SELECT p4.*, b63, b21, CASE WHEN band > 0 THEN (close - sma20) / (2 * band) WHEN band = 0 THEN 0 END AS band_pos,
  CASE WHEN b63 IS NOT NULL THEN 0.6 * (r63 - b63) + 0.4 * (r21 - b21) END AS rel FROM p4 LEFT JOIN bench USING (d) WHERE symbol <> 'ALL'),
panel AS (SELECT *, row_number() OVER (PARTITION BY d, rel IS NOT NULL ORDER BY rel DESC, symbol) AS rk, row_number() OVER (PARTITION BY d, rel IS NOT NULL ORDER BY rel, symbol DESC) AS rkl FROM p5)"""


def _mom() -> str:
    parts = ["tanh(r12_1 / 0.3)", "tanh(r63 / 0.15)", "tanh(r21 / 0.08)", "CASE WHEN close > sma50 THEN 0.5 ELSE -0.5 END", "CASE WHEN close > sma200 THEN 0.5 ELSE -0.5 END", "tanh((r63 - coalesce(b63, 0)) / 0.1)"]
    return f"""SELECT d, symbol, 'momentum' AS node_id, CASE WHEN s > 0 THEN 'long' ELSE 'avoid' END AS direction, s AS score,
  ({' + '.join(f'(c{k} * s > 0)::INT' for k in range(6))}) / 6.0 AS confidence, 20 AS h, s * a * sqrt(20) * 0.5 AS er, a * sqrt(20) AS vol, -2 AS dn
  FROM (SELECT *, ({' + '.join(f'c{k}' for k in range(6))}) / 6 AS s FROM (SELECT *, {', '.join(f'{p} AS c{k}' for k, p in enumerate(parts))} FROM panel)) WHERE n_bars >= 260 AND abs(s) >= 0.1"""


SIGNALS = f"""{PANEL},
raw AS ({_mom()}
 UNION ALL SELECT d, symbol, 'reversal', 'long', least(1, (-z - 1.5) / 2 + (40 - rsi) / 80 + greatest(0, -band_pos)), 0.5, 5, least(-0.5 * r5, 2 * a * sqrt(5)), a * sqrt(5), -2.5
  FROM (SELECT *, r5 / (vol60 * sqrt(5)) AS z FROM panel WHERE vol60 > 0) WHERE n_bars >= 210 AND close >= sma200 AND z <= -1.5 AND rsi <= 40
 UNION ALL SELECT d, symbol, 'sector_rotation', CASE WHEN rk <= 3 AND st > 0 THEN 'long' ELSE 'avoid' END, st, 0.6, 20, st * a * sqrt(20) * 0.4, a * sqrt(20), -2
  FROM (SELECT *, tanh(rel / 0.06) AS st FROM panel WHERE rel IS NOT NULL) WHERE (rk <= 3 AND st > 0) OR (rkl <= 3 AND st < 0)
 UNION ALL SELECT d, symbol, 'gap', 'long', st, 0.4, 5, st * a * sqrt(5) * 0.5, a * sqrt(5), -2
  FROM (SELECT *, tanh(gap / a / 3) * 0.8 AS st FROM panel) WHERE n_bars >= 60 AND gap BETWEEN 0.015 AND 0.06 AND open >= settled50
 UNION ALL SELECT d, symbol, 'vol_contraction', 'long', st, 0.5, 20, st * a * sqrt(20) * 0.5, a * sqrt(20), -2
  FROM (SELECT *, round(least(0.9, 0.5 * (1 - vr) + 0.4 * (1 - (hi60 - close) / (hi60 * 0.03))), 4) AS st FROM panel)
  WHERE n_bars >= 260 AND vr < 0.7 AND close >= hi60 * 0.97 AND close >= sma50 AND close >= sma200),
sig AS (SELECT d AS as_of, symbol, node_id, direction, round(abs(score), 4) AS score, round(confidence, 3) AS confidence, h AS horizon_days,
  round(er, 5) AS expected_return, round(vol, 5) AS expected_volatility, round(dn * vol, 5) AS downside FROM raw)"""


def _node(name: str):
    return lambda spark, d: signals.shown(signals.price_signals(fx.bars(spark, d)).where(F.col("node_id") == name))


for number, name in ((1, "momentum"), (2, "reversal"), (3, "sector_rotation"), (5, "gap"), (6, "vol_contraction")):
    register(f"sg{number}_{name}", _node(name), f"WITH {SIGNALS} SELECT * FROM sig WHERE node_id = '{name}'")
register("k5_all_price_signals", lambda spark, d: signals.shown(signals.price_signals(fx.bars(spark, d))), fx.settled(f"WITH {SIGNALS} SELECT * FROM sig"))
register(
    "k1_top_signals",
    lambda spark, d: signals.top_k(signals.shown(signals.price_signals(fx.bars(spark, d))), 2),
    fx.settled(f"WITH {SIGNALS} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY as_of, node_id ORDER BY score DESC, symbol) AS rank FROM sig) WHERE rank <= 2"),
)

RISKY, SAFE = "ECONOMY", "LARGE"
VOL = f"""vr1 AS (SELECT *, close / {lag('close', 1)} - 1 AS r1, {full('avg', 'close', 50)} AS sma50, {full('avg', 'close', 200)} AS sma200 FROM bars WHERE symbol = 'ALL'),
vr2 AS (SELECT *, {', '.join(f"least(60, {full('stddev_samp', 'r1', n)} * sqrt(252) * 20) AS w{n}" for n in (9, 21, 63, 126))} FROM vr1),
vr2b AS (SELECT *, {', '.join(f"CASE WHEN {full('stddev_samp', 'r1', n)} IS NOT NULL THEN w{n} END AS v{n}" for n in (9, 21, 63, 126))} FROM vr2),
vols AS (SELECT *, {full('stddev_samp', 'v21', 21)} * 100 AS vvix, v9 / v63 - 1 AS slope_9d_3m, v21 / v63 - 1 AS slope_1m_3m, v63 / v126 - 1 AS slope_3m_6m,
  v21 / {lag('v21', 5)} - 1 AS vix_change_5d FROM vr2b)"""
SPREAD = ["realized21", "spread"]
VOL_COLS = ["v9", "v21", "v63", "v126", "vvix", "slope_9d_3m", "slope_1m_3m", "slope_3m_6m", "vix_change_5d"]
register(
    "w14_vol_context",
    lambda spark, d: rounded(fusion.vol_context(fx.bars(spark, d).where(F.col("symbol") == fx.BENCHMARK)).select("d", *VOL_COLS, *SPREAD), *VOL_COLS, *SPREAD),
    f"WITH {B}, {VOL}, sp AS (SELECT *, {full('stddev_samp', 'r1', 21)} * sqrt(252) * 100 AS realized21 FROM vols) SELECT d, {', '.join(f'round({c}, 6) AS {c}' for c in [*VOL_COLS, 'realized21'])}, round(v21 - realized21, 6) AS spread FROM sp",
)
BR = BRANDS.replace("bars AS (", "stocks AS (", 1)
REGIME = f"""{VOL},
br AS (SELECT d, avg((close > s)::INT) AS breadth FROM (SELECT *, {full('avg', 'close', 50)} AS s FROM stocks) WHERE s IS NOT NULL GROUP BY d),
cr AS (SELECT d, max(CASE WHEN symbol = '{RISKY}' THEN r END) - max(CASE WHEN symbol = '{SAFE}' THEN r END) AS credit
  FROM (SELECT symbol, d, close / {lag('close', 21)} - 1 AS r FROM bars WHERE symbol IN ('{RISKY}', '{SAFE}')) GROUP BY d),
rg0 AS (SELECT vols.*, breadth, credit, CASE WHEN sma200 IS NULL THEN 0 ELSE CASE WHEN close > sma50 THEN 1 ELSE -1 END + CASE WHEN close > sma200 THEN 1 ELSE -1 END END AS trend
  FROM vols LEFT JOIN br USING (d) LEFT JOIN cr USING (d)),
rg AS (SELECT *, CASE WHEN coalesce(v21 >= 28, false) OR ((coalesce(slope_9d_3m >= 0.08, false) OR coalesce(slope_1m_3m >= 0.05, false)) AND (coalesce(vvix >= 125, false) OR coalesce(vix_change_5d >= 0.35, false))) THEN 'stress'
  WHEN trend = 2 AND coalesce(v21 < 20, true) AND coalesce(breadth >= 0.55, true) THEN 'risk_on'
  WHEN trend <= -1 OR coalesce(credit <= -0.04, false) OR coalesce(breadth <= 0.35, false) THEN 'risk_off' ELSE 'neutral' END AS regime FROM rg0)"""


def _regimes(spark, d):
    return fusion.regimes(*fx.types_and_brands(spark, d), RISKY, SAFE)


register(
    "e1_regime",
    lambda spark, d: rounded(_regimes(spark, d).select("d", "trend", "breadth", "credit", "regime", "deployment"), "breadth", "credit"),
    f"WITH {B}, {BR}, {REGIME} SELECT d, trend, round(breadth, 6) AS breadth, round(credit, 6) AS credit, regime, CASE regime WHEN 'risk_on' THEN 1.0 WHEN 'neutral' THEN 0.6 WHEN 'risk_off' THEN 0.25 ELSE 0.0 END::DOUBLE AS deployment FROM rg",
)


def _fused(spark, d):
    # Read for the grid, the signals and the regimes: written once.
    bars, brands = fx.types_and_brands(spark, d)
    grid = bars.where(F.col("symbol") != fx.BENCHMARK).select(F.col("d").alias("as_of"), "symbol", F.row_number().over(ind.by_date()).alias("n_bars"))
    s = signals.price_signals(bars)
    every = s.unionByName(fusion.macro_signals(fusion.regimes(bars, brands, RISKY, SAFE), grid.select("as_of", "symbol")), allowMissingColumns=True)
    return fusion.fuse(every, grid)


FUSED_COLS = ["price_value", "context_value", "raw", "conflict", "production", "coverage", "gross", "final"]
FUSED = f"""{SIGNALS}, {BR}, {REGIME},
grid AS (SELECT d AS as_of, symbol, row_number() OVER {W} AS n_bars FROM bars WHERE symbol <> 'ALL'),
ev AS (SELECT d AS as_of, symbol, node_id, direction, abs(score) AS score, confidence, h AS horizon_days, er AS expected_return FROM raw
  UNION ALL SELECT as_of, symbol, 'macro_regime', CASE WHEN m >= 0 THEN 'long' ELSE 'avoid' END, abs(m), 1.0, 21, 0.0
  FROM (SELECT g.as_of, g.symbol, CASE regime WHEN 'risk_on' THEN 0.65 WHEN 'neutral' THEN 0.1 WHEN 'risk_off' THEN -0.5 ELSE -1.0 END AS m FROM grid g JOIN rg ON rg.d = g.as_of)),
ev2 AS (SELECT *, CASE WHEN node_id IN ('sector_rotation', 'macro_regime') THEN 'context' ELSE 'price' END AS family,
  CASE node_id WHEN 'momentum' THEN 0.4 WHEN 'reversal' THEN 0.2 WHEN 'gap' THEN 0.15 WHEN 'vol_contraction' THEN 0.25 ELSE 0.5 END::DOUBLE AS w,
  CASE WHEN direction = 'long' THEN 1 ELSE -1 END::DOUBLE AS sgn FROM ev),
ev3 AS (SELECT *, sgn * abs(score) * confidence AS alpha, CASE family WHEN 'price' THEN 0.2 ELSE 0.15 END::DOUBLE AS fw FROM ev2),
fu AS (SELECT as_of, symbol, sum(CASE WHEN family = 'price' THEN alpha * w END) AS price_value, sum(CASE WHEN family = 'context' THEN alpha * w END) AS context_value,
  sum(fw * alpha * w) AS raw, sum(greatest(fw * alpha * w, 0)) AS pos, sum(greatest(-fw * alpha * w, 0)) AS neg, sum(sgn * abs(expected_return) * fw * w * confidence) AS en,
  sum(fw * w * confidence) AS ed, avg(CASE WHEN direction = 'long' AND node_id <> 'macro_regime' THEN horizon_days END) AS hz,
  sum(CASE WHEN family = 'price' THEN w ELSE 0 END) AS pp, sum(CASE WHEN family = 'context' THEN w ELSE 0 END) AS cp FROM ev3 GROUP BY 1, 2),
fz AS (SELECT g.as_of, g.symbol, price_value, context_value, coalesce(raw, 0) AS raw,
  1 - 0.5 * CASE WHEN coalesce(pos + neg, 0) > 0 THEN 2 * least(pos, neg) / (pos + neg) ELSE 0 END AS conflict,
  0.2 * CASE WHEN n_bars >= 260 THEN 1 ELSE least(1, coalesce(pp, 0)) END + 0.15 * CASE WHEN n_bars >= 260 THEN 1 ELSE least(1, coalesce(cp, 0)) END AS coverage,
  CASE WHEN ed > 0 THEN en / ed ELSE 0 END AS gross, hz FROM grid g LEFT JOIN fu USING (as_of, symbol)),
fy AS (SELECT *, CASE WHEN raw > 0 THEN raw * conflict ELSE raw END AS production FROM fz),
fused AS (SELECT *, CASE WHEN raw > 0 AND hz IS NOT NULL THEN production - 0.0016 / greatest(abs(gross), 0.005) * 0.01 END AS final FROM fy)"""
register(
    "e2_fusion",
    lambda spark, d: rounded(_fused(spark, d), *FUSED_COLS, digits=9),
    fx.settled(f"WITH {FUSED} SELECT as_of, symbol, {', '.join(f'round({c}, 9) AS {c}' for c in FUSED_COLS)}, round(hz)::INT AS horizon_days FROM fused"),
)

#: Bars that climb, with five sessions of falling prices in every sixty-four: reversals occur.
_DIP = "(1 + 0.0012 * k) * CASE WHEN k % 64 BETWEEN 50 AND 54 THEN 1 - 0.014 * (k % 64 - 49) WHEN k % 64 BETWEEN 55 AND 62 THEN 1 - 0.00875 * (63 - k % 64) ELSE 1 END"
_SHAPED = ("open", "high", "low", "close")


def _dipping(spark, d):
    k = fx.bars(spark, d).withColumn("k", F.row_number().over(ind.by_date()))
    return k.withColumns({c: F.when(F.col("symbol") == fx.BENCHMARK, F.col(c)).otherwise((1000 + F.col(c)) * F.expr(_DIP)) for c in _SHAPED}).drop("k")


register(
    "sg2_reversal_dips",
    lambda spark, d: signals.shown(signals.price_signals(_dipping(spark, d)).where(F.col("node_id") == "reversal")),
    "WITH " + SIGNALS.replace("bars AS (", "bars0 AS (", 1).replace(",\np1 AS (", f""",
bars AS (SELECT symbol, d, {', '.join(f"CASE WHEN symbol = 'ALL' THEN {c} ELSE (1000 + {c}) * {_DIP} END AS {c}" for c in _SHAPED)}, volume FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY d) AS k FROM bars0)),
p1 AS (""", 1) + " SELECT * FROM sig WHERE node_id = 'reversal'",
)
