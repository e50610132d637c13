"""Queries of option chains; a line item stands for a contract's quote on its shipping day."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.functions.columns import rounded
from marketloom.operators import options as opt
from marketloom.registry import register
from marketloom.sources import fixtures as fx

BRAND = fx.bars_sql("p_brand", benchmark=False)
EQUITY = 1_000_000.0
#: Days by which the tables' dates move, as option symbols carry years of this century only.
LATER = 3653


def _bars(spark, d):
    return fx.bars(spark, d, "p_brand", False).withColumn("d", F.date_add("d", LATER))


def _chain(spark, d):
    """Quotes of contracts; a sixth line's open interest is not known."""
    li, p = fx.table(spark, d, "lineitem"), fx.table(spark, d, "part").select("p_partkey", "p_brand")
    day = F.date_add(F.to_date("l_shipdate"), LATER)
    return li.join(p, li.l_partkey == p.p_partkey).select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"),
        F.col("p_brand").alias("symbol"),
        day.alias("d"),
        F.date_add(day, (10 + F.col("l_partkey") % 120).cast("int")).alias("expiry"),
        F.when(F.col("l_returnflag") == "R", "P").otherwise("C").alias("kind"),
        (60 + (F.col("l_orderkey") % 40) * 0.5).cast("double").alias("strike"),
        (F.col("l_tax") * 20).alias("bid"),
        (F.col("l_tax") * 20 * (1 + F.col("l_discount") * 2)).alias("ask"),
        F.when(F.col("l_linenumber") != 6, F.col("l_quantity") * 10).alias("open_interest"),
        (0.1 + F.col("l_discount") * 5).alias("iv"),
    )


CHAIN = f"""chain AS (SELECT l_orderkey * 100 + l_linenumber AS id, p_brand AS symbol, l_shipdate::DATE + {LATER} AS d, l_shipdate::DATE + {LATER} + (10 + l_partkey % 120)::INT AS expiry,
  CASE WHEN l_returnflag = 'R' THEN 'P' ELSE 'C' END AS kind, (60 + (l_orderkey % 40) * 0.5)::DOUBLE AS strike, l_tax * 20 AS bid, l_tax * 20 * (1 + l_discount * 2) AS ask,
  CASE WHEN l_linenumber <> 6 THEN l_quantity * 10 END AS open_interest, 0.1 + l_discount * 5 AS iv FROM lineitem JOIN part ON l_partkey = p_partkey)"""
SPOT = f"""{BRAND}, br AS (SELECT symbol, d + {LATER} AS d, close, close / lag(close) OVER (PARTITION BY symbol ORDER BY d) - 1 AS r FROM bars),
spot AS (SELECT symbol, d, close AS spot, CASE WHEN count(r) OVER w >= 15 THEN stddev_samp(r) OVER w * sqrt(252) END AS realized FROM br WINDOW w AS (PARTITION BY symbol ORDER BY d ROWS 19 PRECEDING))"""
_T = "(1 / (1 + 0.3275911 * abs(d1) / sqrt(2)))"
_ERF = f"(1 - {_T} * (0.254829592 + {_T} * (-0.284496736 + {_T} * (1.421413741 + {_T} * (-1.453152027 + {_T} * 1.061405429)))) * exp(-d1 * d1 / 2))"
RICH = f"""{CHAIN}, {SPOT}, c1 AS (SELECT c.*, spot, realized, datediff('day', c.d, expiry) AS dte, (bid + ask) / 2 AS mid FROM chain c ASOF LEFT JOIN spot s ON c.symbol = s.symbol AND c.d >= s.d),
c2 AS (SELECT *, (ln(spot / strike) + (0.04 + iv * iv / 2) * dte / 365) / (iv * sqrt(dte / 365)) AS d1 FROM c1),
rich AS (SELECT *, 0.5 * (1 + CASE WHEN d1 >= 0 THEN {_ERF} ELSE -{_ERF} END) - CASE WHEN kind = 'P' THEN 1 ELSE 0 END AS delta, CASE WHEN mid <> 0 THEN (ask - bid) / mid ELSE 1 END AS spread_pct FROM c2)"""


def _rich(spark, d):
    return opt.add_call_delta(_chain(spark, d), _bars(spark, d))


register(
    "sc8_call_delta",
    lambda spark, d: rounded(_rich(spark, d).select("id", "spot", "realized", "dte", "delta", "spread_pct"), "spot", "realized", "delta", "spread_pct", digits=5),
    f"WITH {RICH} SELECT id, round(spot, 5) AS spot, round(realized, 5) AS realized, dte, round(delta, 5) AS delta, round(spread_pct, 5) AS spread_pct FROM rich",
)


def _positions(spark, d):
    """A position in each quoted contract or one beside it, marked up to two days later."""
    c = _chain(spark, d).withColumn("strike", F.col("strike") + F.when(F.col("id") % 4 == 0, 0.25).otherwise(0.0))
    name = opt.occ_symbol(F.col("symbol"), F.col("expiry"), F.col("kind"), F.col("strike"))
    return c.select("id", "symbol", F.date_add("d", (F.col("id") % 3).cast("int")).alias("d"), F.when(F.col("open_interest").isNull(), F.col("symbol")).otherwise(name).alias("option_symbol"))


register(
    "sc9_mark_options",
    lambda spark, d: opt.mark_options(_positions(spark, d), _chain(spark, d), _bars(spark, d)).select("id", "option_symbol", F.round("mark", 6).alias("mark")),
    f"""WITH {CHAIN}, {SPOT}, p AS (SELECT id, symbol, d + (id % 3)::INT AS d, expiry, kind, strike + CASE WHEN id % 4 = 0 THEN 0.25 ELSE 0 END AS strike, open_interest IS NOT NULL AS good FROM chain),
q AS (SELECT symbol, expiry, kind, strike, d, max(bid) AS quoted FROM chain GROUP BY ALL),
pq AS (SELECT p.*, quoted FROM p ASOF LEFT JOIN q ON p.symbol = q.symbol AND p.expiry = q.expiry AND p.kind = q.kind AND p.strike = q.strike AND p.d >= q.d),
ps AS (SELECT pq.*, spot FROM pq ASOF LEFT JOIN spot s ON pq.symbol = s.symbol AND pq.d >= s.d)
SELECT id, CASE WHEN good THEN symbol || strftime(expiry, '%y%m%d') || kind || lpad((strike * 1000)::BIGINT::VARCHAR, 8, '0') ELSE symbol END AS option_symbol,
  CASE WHEN good THEN CASE WHEN quoted > 0 THEN round(quoted, 6) ELSE round(greatest(CASE WHEN kind = 'C' THEN spot - strike ELSE strike - spot END, 0.01), 2) END END AS mark FROM ps""",
)
register(
    "sc10_screen_options",
    lambda spark, d: opt.screen_options(_rich(spark, d)).select("id", F.array_join("flags", ",").alias("flags")),
    f"""WITH {RICH} SELECT id, concat_ws(',', CASE WHEN dte NOT BETWEEN 21 AND 120 THEN 'dte_out_of_range' END, CASE WHEN abs(delta) NOT BETWEEN 0.25 AND 0.7 THEN 'delta_out_of_range' END,
  CASE WHEN spread_pct > 0.15 THEN 'spread_too_wide' END, CASE WHEN open_interest IS NULL THEN 'missing_open_interest' WHEN open_interest < 100 THEN 'open_interest_too_low' END,
  CASE WHEN realized IS NULL THEN 'missing_realized' WHEN iv > 1.3 * realized THEN 'volatility_too_dear' END) AS flags FROM rich""",
)


def _calls(spark, d):
    targets = fx.fills(spark, d).withColumn("d", F.date_add("d", LATER)).groupBy("symbol", "d").agg(F.min(F.col("qty") * F.col("price")).alias("notional"))
    return opt.pick_calls(_rich(spark, d), targets, EQUITY).select("symbol", "d", "option_symbol", "premium", "contracts", F.round("delta", 5).alias("delta"))


register(
    "sc11_pick_calls",
    _calls,
    f"""WITH {RICH}, f AS (SELECT *, row_number() OVER (PARTITION BY symbol, d ORDER BY expiry, abs(delta - 0.5) + spread_pct, strike, -bid) AS k FROM rich WHERE kind = 'C' AND dte BETWEEN 25 AND 75 AND bid > 0 AND ask > 0
  AND spread_pct <= 0.15 AND open_interest >= 100 AND delta BETWEEN 0.25 AND 0.7 AND iv <= 1.3 * realized),
t AS (SELECT p_brand AS symbol, l_shipdate::DATE + {LATER} AS d, min(l_quantity * (l_extendedprice / l_quantity)) AS notional FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
x AS (SELECT symbol, d, expiry, strike, delta, round(mid, 2) AS premium, floor(least({EQUITY} * 0.015, notional) / (round(mid, 2) * 100))::BIGINT AS contracts FROM f JOIN t USING (symbol, d) WHERE k = 1)
SELECT symbol, d, symbol || strftime(expiry, '%y%m%d') || 'C' || lpad((strike * 1000)::BIGINT::VARCHAR, 8, '0') AS option_symbol, premium, contracts, round(delta, 5) AS delta FROM x WHERE contracts >= 1""",
)
