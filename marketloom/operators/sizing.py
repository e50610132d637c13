"""Sizing, capacity and loss limits as table operators over many cycles at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.operators.indicators import peak_since_reset

#: Risk and name caps as shares of equity, and the smallest order.
RISK_SHARE, NAME_SHARE, MIN_ORDER = 0.01, 0.08, 5.0
DAY_LOSS, WEEK_LOSS, PEAK_LOSS = 0.02, 0.05, 0.15
#: Days for which a switch stays on.
COOLDOWN = {"daily_loss": 1, "weekly_loss": 7, "drawdown_halt": 10}


def vol_target(candidates: DataFrame, equity: float, k: int) -> DataFrame:
    """``notional`` by volatility, score, coverage, the scenario's ``scale`` (null: 1) and the
    ``size_multiplier`` (0 to 1); the k best of a cycle of at least MIN_ORDER. Ties by symbol.
    What is ``held`` and what a scenario scales to nothing is left out."""
    base = F.least(F.lit(equity * RISK_SHARE) / F.col("atr"), F.lit(equity * NAME_SHARE))
    scale = F.coalesce("scale", F.lit(1.0))
    sized = candidates.withColumn("notional", base * F.least(F.lit(1.0), 0.5 + F.col("score")) * (0.5 + 0.5 * F.least(F.greatest("coverage", F.lit(0.0)), F.lit(1.0))) * scale * F.greatest(F.least("size_multiplier", F.lit(1.0)), F.lit(0.0)))
    sized = sized.where(~F.col("held") & (scale > 0)).where(F.col("notional") >= MIN_ORDER)
    w = Window.partitionBy("cycle").orderBy(F.desc("score"), "symbol")
    return sized.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fit_capacity(batch: DataFrame, capacity: str) -> DataFrame:
    """The largest head of each cycle's ranking whose orders, scaled to ``capacity``, all stay
    at or over MIN_ORDER; prefix sums and a running minimum, no loop."""
    w = Window.partitionBy("cycle").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    x = batch.withColumn("__sum", F.sum("notional").over(w)).withColumn("__min", F.min("notional").over(w))
    x = x.withColumn("__scale", F.least(F.lit(1.0), F.col(capacity) / F.col("__sum")))
    best = x.where(F.col("__min") * F.col("__scale") >= MIN_ORDER).groupBy("cycle").agg(F.max("rank").alias("__k"), F.max_by("__scale", "rank").alias("__s"))
    return x.join(best, "cycle").where(F.col("rank") <= F.col("__k")).withColumn("order_notional", F.col("notional") * F.col("__s")).drop("__sum", "__min", "__scale", "__k", "__s")


def breaches(curve: DataFrame) -> DataFrame:
    """By day: loss against the equity on or before one and seven days ago and against the
    running peak, and which limits that breaks."""
    w = Window.partitionBy("source").orderBy(F.datediff("d", F.lit("1970-01-01").cast("date")))
    peak = F.max("equity").over(Window.partitionBy("source").orderBy("d").rowsBetween(Window.unboundedPreceding, 0))

    def before(days: int):
        return F.last("equity").over(w.rangeBetween(Window.unboundedPreceding, -days))

    x = curve.withColumn("day_loss", 1 - F.col("equity") / before(1)).withColumn("week_loss", 1 - F.col("equity") / before(7)).withColumn("peak_loss", 1 - F.col("equity") / peak)
    return x.withColumn("tripped", (F.coalesce(F.col("day_loss") >= DAY_LOSS, F.lit(False))) | (F.coalesce(F.col("week_loss") >= WEEK_LOSS, F.lit(False))) | (F.col("peak_loss") >= PEAK_LOSS))


def switches(curve: DataFrame, reset: Column) -> DataFrame:
    """By day: which loss switches are on. Each trips on a loss over its limit (against the
    equity on or before one and seven days ago, and the peak since the last ``reset``) and
    stays on for COOLDOWN days, the day of the trip included."""
    day = F.datediff("d", F.lit("1970-01-01").cast("date"))
    x = breaches(curve).drop("tripped", "peak_loss").join(peak_since_reset(curve, reset).select("source", "d", "drawdown"), ["source", "d"])
    lost = {"daily_loss": F.col("day_loss") > DAY_LOSS, "weekly_loss": F.col("week_loss") > WEEK_LOSS, "drawdown_halt": F.col("drawdown") > PEAK_LOSS}

    def on(name: str) -> Column:
        w = Window.partitionBy("source").orderBy(day).rangeBetween(1 - COOLDOWN[name], 0)
        return F.max(F.coalesce(lost[name], F.lit(False))).over(w).alias(name)

    return x.select("source", "d", "day_loss", "week_loss", "drawdown", *(on(c) for c in lost))


def rejections(orders: DataFrame, most: int = 5) -> DataFrame:
    """By (mode, day) with a rejected order: the most rejections since a reset of that day, and
    ``rejected_orders``, the switch that more than ``most`` of them trip. ``orders`` has id, mode,
    ts, status and ``clears``, true where a person resets the count. A mode's day is one task."""
    day = Window.partitionBy("mode", F.to_date("ts")).orderBy("ts", "id")
    x = orders.select("id", "mode", "ts", (F.col("status") == "rejected").cast("long").alias("bad"), F.coalesce("clears", F.lit(False)).alias("clears"))
    x = x.withColumn("part", F.sum(F.col("clears").cast("int")).over(day.rowsBetween(Window.unboundedPreceding, 0)))
    g = x.groupBy("mode", F.to_date("ts").alias("d"), "part").agg(F.sum("bad").alias("bad"))
    return g.groupBy("mode", "d").agg(F.max("bad").alias("rejected")).where("rejected > 0").withColumn("rejected_orders", F.col("rejected") > most)


def block_bootstrap(returns: DataFrame, paths: int, blocks: int, length: int = 5, seed: int = 7) -> DataFrame:
    """By path: the total return of ``blocks`` blocks of ``length`` consecutive sessions drawn
    by hash, and its largest drawdown. ``returns`` (i from 0, r) is the portfolio's own series,
    so whole dates are sampled together."""
    n = returns.count()
    draws = returns.sparkSession.range(paths).select(F.col("id").alias("path"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    draws = draws.withColumn("start", F.pmod(F.xxhash64(F.lit(seed), "path", "block"), F.lit(max(1, n - length + 1))))
    steps = draws.select("path", "block", F.posexplode(F.sequence("start", F.col("start") + length - 1)).alias("k", "i"))
    x = steps.join(returns, "i")
    w = Window.partitionBy("path").orderBy("block", "k").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("level", F.exp(F.sum(F.log1p("r")).over(w)))
    x = x.withColumn("dd", 1 - F.col("level") / F.greatest(F.lit(1.0), F.max("level").over(w)))
    return x.groupBy("path").agg((F.max_by("level", F.struct("block", "k")) - 1).alias("total_return"), F.max("dd").alias("max_drawdown"))
