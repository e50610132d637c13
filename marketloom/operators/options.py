"""Option chains: deltas, marks, screens and the choice of a call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.columns import normal_cdf
from marketloom.operators.joins import latest_at

#: Rate, limits of a contract, days to expiry in which a call is sought, premium at risk.
RATE = 0.04
MIN_DTE, MAX_DTE, MIN_DELTA, MAX_DELTA, MAX_SPREAD, MIN_OPEN_INTEREST = 21, 120, 0.25, 0.70, 0.15, 100
PICK_DTE, MAX_IV_RV, PREMIUM_RISK = (25, 75), 1.3, 0.015
OCC = r"^\d{6}[CP]\d{8}$"
CONTRACT = ["symbol", "expiry", "kind", "strike"]


def spot_and_vol(bars: DataFrame) -> DataFrame:
    """``symbol, d, spot, realized``: the close and the annualised deviation of the last 20
    returns, null under 15 of them."""
    w = Window.partitionBy("symbol").orderBy("d")
    r = bars.select("symbol", "d", "close", (F.col("close") / F.lag("close").over(w) - 1).alias("r"))
    last = w.rowsBetween(-19, 0)
    vol = F.when(F.count("r").over(last) >= 15, F.stddev_samp("r").over(last) * 252**0.5)
    return r.select("symbol", "d", F.col("close").alias("spot"), vol.alias("realized"))


def known_at(rows: DataFrame, bars: DataFrame, values: list[str]) -> DataFrame:
    """``rows`` with the ``values`` of ``spot_and_vol`` at d or the last bar before. Looked up once
    for each pair of symbol and day that occurs; these do not grow with the rows of a day."""
    days = latest_at(rows.select("symbol", "d").distinct(), spot_and_vol(bars), values, ["symbol"], "d")
    days = days.select(F.col("symbol").alias("__symbol"), F.col("d").alias("__d"), *values)
    return rows.join(days, F.col("symbol").eqNullSafe(F.col("__symbol")) & (F.col("d") == F.col("__d")), "left").drop("__symbol", "__d")


def call_delta(spot: Column, strike: Column, iv: Column, years: Column) -> Column:
    """N(d1); 0 without volatility or time."""
    d1 = (F.log(spot / strike) + (RATE + iv * iv / 2) * years) / (iv * F.sqrt(years))
    return F.when((iv > 0) & (years > 0), normal_cdf(d1)).otherwise(0.0)


def add_call_delta(chain: DataFrame, bars: DataFrame) -> DataFrame:
    """The chain (``symbol, d, expiry, kind, strike, bid, ask, open_interest, iv``) with ``spot``
    and ``realized`` known at d, ``dte``, ``delta`` and ``spread_pct``. A put's delta is the
    call's minus one. Null without a price."""
    x = known_at(chain, bars, ["spot", "realized"])
    x = x.withColumn("dte", F.datediff("expiry", "d"))
    call = call_delta(F.col("spot"), F.col("strike"), F.col("iv"), F.col("dte") / 365)
    delta = F.when(F.col("spot").isNotNull(), call - F.when(F.col("kind") == "P", 1.0).otherwise(0.0))
    mid = (F.col("bid") + F.col("ask")) / 2
    return x.withColumn("delta", delta).withColumn("mid", mid).withColumn("spread_pct", F.when(mid != 0, (F.col("ask") - F.col("bid")) / mid).otherwise(1.0))


def occ_symbol(symbol: Column, expiry: Column, kind: Column, strike: Column) -> Column:
    """Symbol, yymmdd, C or P, the strike in thousandths in eight digits."""
    return F.concat(symbol, F.date_format(expiry, "yyMMdd"), kind, F.lpad(F.round(strike * 1000).cast("long").cast("string"), 8, "0"))


def _last_bid(positions: DataFrame, chain: DataFrame) -> DataFrame:
    """Positions with ``quoted``: the highest bid of the contract's last day with a quote at or
    before d. A contract's quotes and positions are one sorted stream, after one shuffle: an
    expiry bounds the days, and bids of a day need no aggregate when sorted. Positions that
    name no contract have no quote; they are dealt by day."""
    quotes = chain.where("d is not null").select(*CONTRACT, "d", F.struct(F.col("bid").alias("quoted")).alias("__v"), F.lit(0).alias("__side"))
    both = positions.withColumn("__side", F.lit(1)).unionByName(quotes, allowMissingColumns=True)
    w = Window.partitionBy(*CONTRACT, F.when(F.col("expiry").isNull(), F.col("d"))).orderBy("d", "__side", "__v").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("__v", F.last("__v", ignorenulls=True).over(w)).where("__side = 1").select(*positions.columns, F.col("__v.quoted").alias("quoted"))


def mark_options(positions: DataFrame, chain: DataFrame, bars: DataFrame) -> DataFrame:
    """Positions (``symbol, option_symbol, d``) with ``mark``: the contract's last bid known at
    d, or without a positive one the intrinsic value, 0.01 at least, in cents. Null if the
    symbol does not end like an option's, or without bid and price. Of several bids of a day the highest counts."""

    end = F.right("option_symbol", F.lit(15))
    good = end.rlike(OCC)
    day = F.concat_ws("-", F.concat(F.lit("20"), end.substr(1, 2)), end.substr(3, 2), end.substr(5, 2)).try_cast("date")
    p = positions.withColumns({"expiry": F.when(good, day), "kind": F.when(good, end.substr(7, 1)), "strike": F.when(good, end.substr(8, 8).try_cast("int") / 1000)})
    p = _last_bid(known_at(p, bars, ["spot"]), chain)
    inner = F.when(F.col("kind") == "C", F.col("spot") - F.col("strike")).otherwise(F.col("strike") - F.col("spot"))
    inner = F.when(inner.isNotNull(), F.round(F.greatest(inner, F.lit(0.01)), 2))
    known = F.col("expiry").isNotNull() & F.col("strike").isNotNull()
    return p.withColumn("mark", F.when(known, F.when(F.col("quoted") > 0, F.col("quoted")).otherwise(inner)))


def screen_options(enriched: DataFrame) -> DataFrame:
    """``flags`` of every contract, in the order of the checks; what is not known is flagged."""
    checks = (
        ("dte", F.col("dte").between(MIN_DTE, MAX_DTE), "dte_out_of_range"),
        ("delta", F.abs("delta").between(MIN_DELTA, MAX_DELTA), "delta_out_of_range"),
        ("spread_pct", F.col("spread_pct") <= MAX_SPREAD, "spread_too_wide"),
        ("open_interest", F.col("open_interest") >= MIN_OPEN_INTEREST, "open_interest_too_low"),
        ("realized", F.col("iv") <= MAX_IV_RV * F.col("realized"), "volatility_too_dear"),
    )
    flags = [F.when(F.col(c).isNull(), F.lit(f"missing_{c}")).when(~F.coalesce(ok, F.lit(False)), F.lit(flag)) for c, ok, flag in checks]
    return enriched.withColumn("flags", F.array_compact(F.array(*flags)))


def pick_calls(enriched: DataFrame, targets: DataFrame, equity: float) -> DataFrame:
    """For each target (``symbol, d, notional``) the call to buy: of the first expiry with one
    that qualifies, the nearest to a delta of a half after its spread; ties go to the lower
    strike, then the higher bid. Targets without such a call or with money for less than one contract have no row.

    The choice is an aggregate, so a symbol's chain is reduced before it is shuffled."""
    fit = (F.col("kind") == "C") & F.col("dte").between(*PICK_DTE) & (F.col("bid") > 0) & (F.col("ask") > 0) & (F.col("spread_pct") <= MAX_SPREAD)
    fit &= (F.col("open_interest") >= MIN_OPEN_INTEREST) & F.col("delta").between(MIN_DELTA, MAX_DELTA) & (F.col("iv") <= MAX_IV_RV * F.col("realized"))
    cost = F.abs(F.col("delta") - 0.5) + F.col("spread_pct")
    got = F.struct("expiry", cost.alias("cost"), "strike", (-F.col("bid")).alias("b"), "mid", "dte", "delta")
    best = enriched.where(fit).groupBy("symbol", "d").agg(F.min(got).alias("g")).select("symbol", "d", "g.*")
    x = targets.join(best, ["symbol", "d"]).withColumn("premium", F.round("mid", 2))
    n = F.floor(F.least(F.lit(equity * PREMIUM_RISK), F.col("notional")) / (F.col("premium") * 100))
    return x.withColumn("contracts", n).where("contracts >= 1").withColumn("option_symbol", occ_symbol(F.col("symbol"), F.col("expiry"), F.lit("C"), F.col("strike")))
