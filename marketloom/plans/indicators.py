"""Queries of the rolling indicators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketloom.functions.columns import rounded
from marketloom.operators import indicators as ind
from marketloom.registry import register
from marketloom.sources import fixtures as fx

B = fx.bars_sql()


def _bars_query(make, *cols, digits=6):
    return lambda spark, d: rounded(make(fx.bars(spark, d)).select("symbol", "d", *cols), *[c for c in cols if not c.startswith("above")], digits=digits)


def _w(n: int, end: int = 0) -> str:
    return f"(PARTITION BY symbol ORDER BY d ROWS BETWEEN {n - 1 - end} PRECEDING AND {f'{-end} PRECEDING' if end else 'CURRENT ROW'})"


def full(agg: str, col: str, n: int, end: int = 0) -> str:
    """SQL twin of a guarded rolling aggregate."""
    return f"CASE WHEN count({col}) OVER {_w(n, end)} = {n} THEN {agg}({col}) OVER {_w(n, end)} END"


def lag(col: str, k: int) -> str:
    return f"lag({col}, {k}) OVER (PARTITION BY symbol ORDER BY d)"


R = f"r AS (SELECT *, close / {lag('close', 1)} - 1 AS r1 FROM bars)"

register(
    "w1_returns",
    _bars_query(ind.returns, "r1", "r5", "r21", "r63", "r12_1"),
    f"WITH {B} SELECT symbol, d, " + ", ".join(f"round(close / {lag('close', k)} - 1, 6) AS r{k}" for k in (1, 5, 21, 63)) + f", round({lag('close', 21)} / {lag('close', 252)} - 1, 6) AS r12_1 FROM bars",
)
register(
    "w2_sma",
    _bars_query(ind.sma, "sma20", "sma50", "sma200", "above50", "above200", "dist50"),
    f"WITH {B}, s AS (SELECT *, {full('avg', 'close', 20)} AS s20, {full('avg', 'close', 50)} AS s50, {full('avg', 'close', 200)} AS s200 FROM bars) "
    "SELECT symbol, d, round(s20, 6) AS sma20, round(s50, 6) AS sma50, round(s200, 6) AS sma200, close > s50 AS above50, close > s200 AS above200, round(close / s50 - 1, 6) AS dist50 FROM s",
)
TR = f"tr AS (SELECT *, greatest(high - low, abs(high - {lag('close', 1)}), abs(low - {lag('close', 1)})) AS tr, row_number() OVER (PARTITION BY symbol ORDER BY d) AS rn FROM bars)"
ATR = f"atr AS (SELECT *, CASE WHEN rn > 14 THEN avg(tr) OVER {_w(14)} / close END AS atr_pct FROM tr)"
register("w3_atr_pct", _bars_query(ind.atr_pct, "atr_pct"), f"WITH {B}, {TR}, {ATR} SELECT symbol, d, round(atr_pct, 6) AS atr_pct FROM atr")
GL = (
    f"gl AS (SELECT *, close - {lag('close', 1)} AS dx, close / {lag('close', 1)} - 1 AS r1 FROM bars),"
    "g2 AS (SELECT *, CASE WHEN dx IS NOT NULL THEN greatest(dx, 0) END AS g, CASE WHEN dx IS NOT NULL THEN greatest(-dx, 0) END AS l,"
    " CASE WHEN r1 IS NOT NULL THEN greatest(r1, 0) END AS rg, CASE WHEN r1 IS NOT NULL THEN greatest(-r1, 0) END AS rl FROM gl),"
    f"g3 AS (SELECT *, {full('avg', 'g', 14)} AS mg, {full('avg', 'l', 14)} AS ml, {full('avg', 'rg', 14)} AS mrg, {full('avg', 'rl', 14)} AS mrl FROM g2),"
    "rsi AS (SELECT *, CASE WHEN ml = 0 THEN 100 ELSE 100 - 100 / (1 + mg / ml) END AS rsi, CASE WHEN mrg + mrl = 0 THEN 0 ELSE mrg / (mrg + mrl) - 0.5 END AS rsi_bounded FROM g3)"
)
register("w4_rsi", _bars_query(ind.rsi, "rsi", "rsi_bounded"), f"WITH {B}, {GL} SELECT symbol, d, round(rsi, 6) AS rsi, round(rsi_bounded, 6) AS rsi_bounded FROM rsi")
register(
    "w5_realized_vol",
    _bars_query(ind.realized_vol, "vol20", "ann20", "vol60", "ann60"),
    f"WITH {B}, {R}, v AS (SELECT *, {full('stddev_samp', 'r1', 20)} AS v20, {full('stddev_samp', 'r1', 60)} AS v60 FROM r) "
    "SELECT symbol, d, round(v20, 6) AS vol20, round(v20 * sqrt(252), 6) AS ann20, round(v60, 6) AS vol60, round(v60 * sqrt(252), 6) AS ann60 FROM v",
)
register(
    "w6_volume_z",
    _bars_query(ind.volume_z, "volume_z"),
    f"WITH {B}, v AS (SELECT *, ln(1 + volume) AS lv FROM bars) SELECT symbol, d, round((lv - {full('avg', 'lv', 21)}) / ({full('stddev_samp', 'lv', 21)} + 1e-8), 6) AS volume_z FROM v",
)
register(
    "w7_breakout",
    _bars_query(ind.breakout, "breakout", "from_high"),
    f"WITH {B}, v AS (SELECT *, {full('min', 'close', 60)} AS lo, {full('max', 'close', 60)} AS hi FROM bars) "
    "SELECT symbol, d, round((close - lo) / (hi - lo + 1e-8) - 0.5, 6) AS breakout, round(close / hi - 1, 6) AS from_high FROM v",
)
register(
    "w8_range_gap",
    _bars_query(ind.range_gap, "day_range", "gap"),
    f"WITH {B} SELECT symbol, d, round((high - low) / close, 6) AS day_range, round(open / {lag('close', 1)} - 1, 6) AS gap FROM bars",
)
VR = f"vr AS (SELECT *, {full('stddev_samp', 'r1', 20)} AS sd_now, {full('stddev_samp', 'r1', 20, -60)} AS sd_before FROM r)"
register(
    "w9_vol_ratio",
    _bars_query(ind.vol_ratio, "sd_now", "sd_before", "vol_ratio"),
    f"WITH {B}, {R}, {VR} SELECT symbol, d, round(sd_now, 6) AS sd_now, round(sd_before, 6) AS sd_before, round(CASE WHEN sd_before > 0 THEN sd_now / sd_before END, 6) AS vol_ratio FROM vr",
)
BP = f"bp AS (SELECT *, {full('stddev_samp', 'r1', 20)} * sqrt(20) * close AS band, {full('avg', 'close', 20)} AS s20 FROM r)"
register(
    "w10_band_pos",
    _bars_query(ind.band_pos, "band_pos"),
    f"WITH {B}, {R}, {BP} SELECT symbol, d, round(CASE WHEN band > 0 THEN (close - s20) / (2 * band) WHEN band = 0 THEN 0 END, 6) AS band_pos FROM bp",
)
BRANDS = fx.bars_sql("p_brand", benchmark=False)
register(
    "w13_breadth",
    lambda spark, d: rounded(ind.breadth(fx.bars(spark, d, "p_brand", False)), "breadth"),
    f"WITH {BRANDS}, v AS (SELECT *, {full('avg', 'close', 50)} AS s FROM bars) SELECT d, round(avg((close > s)::INT), 6) AS breadth, count(*) AS n_symbols FROM v WHERE s IS NOT NULL GROUP BY d",
)


def _asof(spark, d):
    bars = fx.bars(spark, d, "p_brand", True)
    calendar = bars.where(F.col("symbol") == fx.BENCHMARK).select("d")
    brands = F.transform(F.sequence(F.lit(1), F.lit(25)), lambda k: F.concat(F.lit("Brand#"), k.cast("string")))
    grid = calendar.select(F.explode(brands).alias("symbol"), "d", F.dayofweek("d").alias("weekday"))
    out = ind.asof_align(grid, bars.where(F.col("symbol") != fx.BENCHMARK).select("symbol", "d", "close"), "close", ["symbol"], "d")
    return rounded(out, "close")


register(
    "w15_asof_align",
    _asof,
    f"WITH {fx.bars_sql('p_brand')}, g AS (SELECT s.symbol, c.d FROM (SELECT d FROM bars WHERE symbol = 'ALL') c, (SELECT DISTINCT symbol FROM bars WHERE symbol <> 'ALL') s) "
    "SELECT g.symbol, g.d, dayofweek(g.d) + 1 AS weekday, round(b.close, 6) AS close FROM g ASOF LEFT JOIN bars b ON g.symbol = b.symbol AND g.d >= b.d",
)
register(
    "w16_drawdown",
    lambda spark, d: rounded(ind.drawdown(fx.equity_curve(spark, d)), "equity", "peak", "drawdown", "max_drawdown"),
    f"WITH {fx.EQUITY_SQL}, p AS (SELECT *, max(equity) OVER (PARTITION BY source ORDER BY d) AS peak FROM equity), q AS (SELECT *, 1 - equity / peak AS dd FROM p) "
    "SELECT source, d, round(equity, 6) AS equity, round(peak, 6) AS peak, round(dd, 6) AS drawdown, round(max(dd) OVER (PARTITION BY source ORDER BY d), 6) AS max_drawdown FROM q",
)
register(
    "w17_forward_returns",
    _bars_query(ind.forward_returns, "fwd5", "fwd21"),
    f"WITH {B} SELECT symbol, d, round(lead(close, 5) OVER (PARTITION BY symbol ORDER BY d) / close - 1, 6) AS fwd5, round(lead(close, 21) OVER (PARTITION BY symbol ORDER BY d) / close - 1, 6) AS fwd21 FROM bars",
)


def _cum_pnl(spark, d):
    days = fx.trades(spark, d).groupBy("exit_date").agg(F.sum("pnl").alias("day_pnl"))
    return rounded(days.withColumn("cum_pnl", F.sum("day_pnl").over(Window.orderBy("exit_date").rowsBetween(Window.unboundedPreceding, 0))), "day_pnl", "cum_pnl", digits=4)


register(
    "w18_cum_pnl",
    _cum_pnl,
    f"WITH {fx.TRADES_SQL}, x AS (SELECT exit_date, sum(pnl) AS p FROM trades GROUP BY 1) SELECT exit_date, round(p, 4) AS day_pnl, round(sum(p) OVER (ORDER BY exit_date ROWS UNBOUNDED PRECEDING), 4) AS cum_pnl FROM x",
)


def _ranks(spark, d):
    x = ind.returns(fx.bars(spark, d, "p_brand", False), (21,)).where("r21 is not null")
    order = Window.partitionBy("d").orderBy(F.desc("volume"), "symbol")
    out = x.withColumn("avg_rank", ind.average_rank("volume", "d")).withColumn("liquidity_rank", F.row_number().over(order))
    out = out.withColumn("momentum_rank", F.row_number().over(Window.partitionBy("d").orderBy(F.desc(F.round("r21", 9)), "symbol")))
    return out.select("symbol", "d", "avg_rank", "liquidity_rank", "momentum_rank", (F.col("liquidity_rank") + F.col("momentum_rank")).alias("rank_sum"))


register(
    "w19_ranks",
    _ranks,
    f"WITH {BRANDS}, x AS (SELECT * FROM (SELECT *, close / {lag('close', 21)} - 1 AS r21 FROM bars) WHERE r21 IS NOT NULL), y AS (SELECT *, rank() OVER (PARTITION BY d ORDER BY volume) + (count(*) OVER (PARTITION BY d, volume) - 1) / 2.0 AS avg_rank, "
    "row_number() OVER (PARTITION BY d ORDER BY volume DESC, symbol) AS liquidity_rank, row_number() OVER (PARTITION BY d ORDER BY round(r21, 9) DESC, symbol) AS momentum_rank FROM x) "
    "SELECT symbol, d, avg_rank, liquidity_rank, momentum_rank, liquidity_rank + momentum_rank AS rank_sum FROM y",
)
