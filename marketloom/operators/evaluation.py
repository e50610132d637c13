"""Labels, splits and out-of-sample evaluation of forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.columns import ROUND_TRIP
from marketloom.operators import indicators as ind

MIN_NAMES = 8


def dual_labels(bars: DataFrame, bench: DataFrame, hs: tuple[int, ...] = (5, 21)) -> DataFrame:
    """``abs{h}`` and ``excess{h}`` (against the benchmark's sessions, as of the date), and
    whether they beat costs and zero."""
    own = ind.forward_returns(bars, hs)
    b = ind.forward_returns(bench, hs).select("d", *(F.col(f"fwd{h}").alias(f"b{h}") for h in hs))
    x = own.join(F.broadcast(b), "d", "left")  # the benchmark has a row a session
    for h in hs:
        x = x.withColumn(f"abs{h}", F.col(f"fwd{h}")).withColumn(f"excess{h}", F.col(f"fwd{h}") - F.col(f"b{h}"))
        x = x.withColumn(f"beats{h}", F.col(f"abs{h}") > ROUND_TRIP).withColumn(f"leads{h}", F.col(f"excess{h}") > 0)
    return x


def chronological_split(days: DataFrame, horizon: int = 21) -> DataFrame:
    """Dates as train (first 70 per cent), validation (to 85) or test, with an embargo of
    ``horizon`` + 1 sessions before each cut. Dates are numbered in one small table."""
    d = days.select("d").distinct()
    w = Window.orderBy("d")
    n = F.count(F.lit(1)).over(Window.partitionBy())
    x = d.withColumn("i", F.row_number().over(w) - 1).withColumn("n", n)
    a, b, gap = F.floor(F.col("n") * 0.70), F.floor(F.col("n") * 0.85), horizon + 1
    part = (
        F.when(F.col("i") < a - gap, "train").when(F.col("i") < a, "embargo").when(F.col("i") < b - gap, "validation").when(F.col("i") < b, "embargo").otherwise("test")
    )
    return x.select("d", "i", part.alias("split"))


def walk_forward(days: DataFrame, folds: int = 5, horizon: int = 21) -> DataFrame:
    """``fold, train_end, test_start, test_end``: expanding windows from 45 per cent of the
    sessions, sealed at 85, tests half open, an embargo before each test."""
    n = days.select("d").distinct().agg(F.count(F.lit(1)).alias("n"))
    first, last = F.floor(F.col("n") * 0.45), F.floor(F.col("n") * 0.85)
    x = n.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    start = first + F.floor((last - first) * F.col("fold") / folds)
    end = first + F.floor((last - first) * (F.col("fold") + 1) / folds)
    return x.select("fold", (start - (horizon + 1)).alias("train_end"), start.alias("test_start"), end.alias("test_end"))


def pinball(q: float, pred: Column, truth: Column) -> Column:
    """The mean quantile loss, as an aggregate."""
    e = truth - pred
    return F.avg(F.greatest(q * e, (q - 1) * e))


def rank_ic(x: DataFrame, pred: str, truth: str) -> DataFrame:
    """By date with MIN_NAMES names: correlation of average ranks. A date's ranks and
    correlation come from the one shuffle by date."""
    x = x.where(F.col(pred).isNotNull() & F.col(truth).isNotNull()).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("d"))).where(F.col("__n") >= MIN_NAMES)
    x = x.withColumn("__p", ind.average_rank(pred, "d")).withColumn("__t", ind.average_rank(truth, "d"))
    return x.groupBy("d").agg(F.count(F.lit(1)).alias("names"), F.corr("__p", "__t").alias("ic"))


def top_decile(x: DataFrame, pred: str, truth: str) -> DataFrame:
    """By date with MIN_NAMES names: mean truth, after costs, of the names at or over the
    interpolated 90 per cent quantile of the prediction."""
    x = x.where(F.col(pred).isNotNull() & F.col(truth).isNotNull())
    cut = x.groupBy("d").agg(F.percentile(pred, 0.9).alias("cut"), F.count(F.lit(1)).alias("names")).where(F.col("names") >= MIN_NAMES)
    return x.join(cut, "d").where(F.col(pred) >= F.col("cut") - 1e-12).groupBy("d", "names").agg((F.avg(truth) - ROUND_TRIP).alias("alpha"), F.count(F.lit(1)).alias("picked"))


def momentum_forecast(bars: DataFrame, h: int = 5) -> DataFrame:
    """The momentum baseline: the last return by the root of h, with fixed-width bands."""
    return bars.withColumn("q50", ind.ret(1) * h**0.5).withColumn("q10", F.col("q50") - 0.05).withColumn("q90", F.col("q50") + 0.05)


def forecast_metrics(x: DataFrame, truth: str, *by: str) -> DataFrame:
    """Pinball of the three quantiles, coverage of the band, directional accuracy, Brier score
    of the sign."""
    t = F.col(truth)
    return x.where(t.isNotNull() & F.col("q50").isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        ((pinball(0.1, F.col("q10"), t) + pinball(0.5, F.col("q50"), t) + pinball(0.9, F.col("q90"), t)) / 3).alias("pinball"),
        F.avg(t.between(F.col("q10"), F.col("q90")).cast("double")).alias("coverage"),
        F.avg(((t > 0) == (F.col("q50") > 0)).cast("double")).alias("direction"),
        F.avg(F.pow(F.when(F.col("q50") > 0, 0.6).otherwise(0.4) - (t > 0).cast("double"), 2)).alias("brier"),
    )


def eligible_windows(x: DataFrame, valid: Column, n: int = 60) -> DataFrame:
    """``eligible``: whether all of a symbol's last n rows are valid."""
    w = ind.by_date().rowsBetween(-(n - 1), 0)
    return x.withColumn("eligible", F.coalesce(F.sum(valid.cast("int")).over(w) == n, F.lit(False)))


def nth_next(events: DataFrame, bars: DataFrame, h: int) -> DataFrame:
    """The close h sessions after each event's own session: sessions are numbered once and
    joined by number, no correlated lookup."""
    i = bars.withColumn("i", F.row_number().over(ind.by_date())).select("symbol", "d", "i", "close")
    at = events.join(i.select("symbol", "d", "i", F.col("close").alias("entry")), ["symbol", "d"])
    later = i.select("symbol", (F.col("i") - h).alias("i"), F.col("d").alias("resolved_at"), F.col("close").alias("exit"))
    return at.join(later, ["symbol", "i"], "left").withColumn("realized", F.col("exit") / F.col("entry") - 1)


def calibration(x: DataFrame, truth: str, *by: str) -> DataFrame:
    """Offsets of the quantiles: 10, 50 and 90 per cent of the residuals, interpolated."""
    r = F.col(truth) - F.col("q50")
    return x.where(r.isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.percentile(r, q).alias(f"off{int(q * 100)}") for q in (0.1, 0.5, 0.9)))


def evenly_spaced(x: DataFrame, n: int, by: str, order: str) -> DataFrame:
    """At most n rows of each key at evenly spaced positions, first and last among them."""
    w, size = Window.partitionBy(by).orderBy(order), Window.partitionBy(by)
    y = x.withColumn("__i", F.row_number().over(w) - 1).withColumn("__n", F.count(F.lit(1)).over(size))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.floor(k * (F.col("__n") - 1) / (n - 1)))
    return y.where((F.col("__n") <= n) | F.array_contains(wanted, F.col("__i").cast("long"))).drop("__i", "__n")


#: A target's scale is never taken as smaller.
LEAST_SCALE = 0.005


def train_scaling(x: DataFrame, days: DataFrame, features: list[str], targets: list[str], horizon: int = 21) -> DataFrame:
    """``column, mean, scale``: mean and deviation (plus 1e-6) of features, scale of targets, over
    the rows of training sessions only (``chronological_split`` of ``days``)."""
    train = chronological_split(days, horizon).where("split = 'train'").select("d")
    mine = x.join(F.broadcast(train), "d", "left_semi")  # a row a session
    stats = mine.agg(*(F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("sd")).alias(c) for c in [*features, *targets]))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c)["mean"].alias("mean"), (F.col(c)["sd"] + 1e-6).alias("scale")) for c in features), *(F.struct(F.lit(c).alias("column"), F.lit(0.0).alias("mean"), F.greatest(F.col(c)["sd"], F.lit(LEAST_SCALE)).alias("scale")) for c in targets))
    return stats.select(F.inline(rows))


def mean_of_days(daily: DataFrame, value: str) -> DataFrame:
    """One row: how many dates have a value, its mean, deviation, and the mean over it."""
    x = daily.where(F.col(value).isNotNull() & ~F.isnan(value))
    g = x.agg(F.count(F.lit(1)).alias("dates"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return g.withColumn("ratio", F.col("mean") / F.nullif("sd", F.lit(0.0)))
