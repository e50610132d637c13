"""Rolling indicators over daily bars ``(symbol, d)``.

All of them use the one window of a symbol's rows by date, so a plan that combines them has a
single exchange and sort on the symbol. A rolling value is null until its frame is full, and
no value depends on a later bar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.columns import back, full, over

def by_date():
    """A symbol's bars by date."""
    return Window.partitionBy("symbol").orderBy("d")


def ret(k: int) -> Column:
    """Simple return over k sessions."""
    return F.col("close") / back("close", k) - 1


def returns(bars: DataFrame, ks: tuple[int, ...] = (1, 5, 21, 63)) -> DataFrame:
    """``r{k}`` for each k, and ``r12_1``: twelve months without the last one."""
    out = bars.withColumns({f"r{k}": ret(k) for k in ks})
    return out.withColumn("r12_1", back("close", 21) / back("close", 252) - 1)


def sma(bars: DataFrame, ns: tuple[int, ...] = (20, 50, 200)) -> DataFrame:
    """``sma{n}``, whether the close is above it, and its distance."""
    out = bars.withColumns({f"sma{n}": full(F.avg, F.col("close"), n) for n in ns})
    return out.withColumns({f"above{n}": F.col("close") > F.col(f"sma{n}") for n in ns} | {f"dist{n}": F.col("close") / F.col(f"sma{n}") - 1 for n in ns})


def true_range() -> Column:
    """The first bar has no previous close: its range is high - low."""
    pc = back("close", 1)
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc))


def atr_pct(bars: DataFrame, n: int = 14) -> DataFrame:
    """``atr_pct``: mean true range of n bars by price, from the (n+1)th bar on."""
    out = bars.withColumn("__tr", true_range())
    seen = F.row_number().over(by_date())
    return out.withColumn("atr_pct", F.when(seen > n, F.avg("__tr").over(over(n)) / F.col("close"))).drop("__tr")


def rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    """``rsi``: simple means of gains and losses of price (100 if no loss); ``rsi_bounded``:
    gain / (gain + loss) - 1/2 of returns."""
    out = bars.withColumn("__d", F.col("close") - back("close", 1)).withColumn("__r", ret(1))

    zero = F.lit(0.0)
    gain = F.when(F.col("__d").isNotNull(), F.greatest(F.col("__d"), zero))
    loss = F.when(F.col("__d").isNotNull(), F.greatest(-F.col("__d"), zero))
    rgain = F.when(F.col("__r").isNotNull(), F.greatest(F.col("__r"), zero))
    rloss = F.when(F.col("__r").isNotNull(), F.greatest(-F.col("__r"), zero))
    out = out.withColumns({"__g": gain, "__l": loss, "__rg": rgain, "__rl": rloss})
    out = out.withColumns({c: full(F.avg, F.col(f"__{c[2:]}"), n) for c in ("m_g", "m_l", "m_rg", "m_rl")})
    out = out.withColumn("rsi", F.when(F.col("m_l") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("m_g") / F.col("m_l"))))
    total = F.col("m_rg") + F.col("m_rl")
    out = out.withColumn("rsi_bounded", F.when(total == 0, 0.0).otherwise(F.col("m_rg") / total - 0.5))
    return out.drop("__d", "__r", "__g", "__l", "__rg", "__rl", "m_g", "m_l", "m_rg", "m_rl")


def realized_vol(bars: DataFrame, ns: tuple[int, ...] = (20, 60)) -> DataFrame:
    """``vol{n}``: sample deviation of n returns; ``ann{n}``: by the square root of 252."""
    out = bars.withColumn("__r", ret(1))
    out = out.withColumns({f"vol{n}": full(F.stddev_samp, F.col("__r"), n) for n in ns})
    return out.withColumns({f"ann{n}": F.col(f"vol{n}") * 252**0.5 for n in ns}).drop("__r")


def volume_z(bars: DataFrame, n: int = 21) -> DataFrame:
    """``volume_z``: of log(1 + volume) against its last n."""
    out = bars.withColumn("__v", F.log1p("volume"))
    return out.withColumn("volume_z", (F.col("__v") - full(F.avg, F.col("__v"), n)) / (full(F.stddev_samp, F.col("__v"), n) + 1e-8)).drop("__v")


def breakout(bars: DataFrame, n: int = 60) -> DataFrame:
    """``breakout``: place of the close in the range of n closes, -1/2 to 1/2; ``from_high``."""
    lo, hi = full(F.min, F.col("close"), n), full(F.max, F.col("close"), n)
    return bars.withColumn("breakout", (F.col("close") - lo) / (hi - lo + 1e-8) - 0.5).withColumn("from_high", F.col("close") / hi - 1)


def range_gap(bars: DataFrame) -> DataFrame:
    """``day_range``: (high - low) / close; ``gap``: open against the close before."""
    return bars.withColumn("day_range", (F.col("high") - F.col("low")) / F.col("close")).withColumn("gap", F.col("open") / back("close", 1) - 1)


def vol_ratio(bars: DataFrame) -> DataFrame:
    """``sd_now`` over the last 20 returns, ``sd_before`` over those 61 to 80 back, the ratio."""
    out = bars.withColumn("__r", ret(1))
    out = out.withColumn("sd_now", full(F.stddev_samp, F.col("__r"), 20)).withColumn("sd_before", full(F.stddev_samp, F.col("__r"), 20, end=-60))
    return out.withColumn("vol_ratio", F.when(F.col("sd_before") > 0, F.col("sd_now") / F.col("sd_before"))).drop("__r")


def band_pos(bars: DataFrame) -> DataFrame:
    """``band_pos``: distance to the 20-bar mean in two 20-session deviations."""
    out = bars.withColumn("__r", ret(1))
    band = full(F.stddev_samp, F.col("__r"), 20) * 20**0.5 * F.col("close")
    return out.withColumn("band_pos", F.when(band > 0, (F.col("close") - full(F.avg, F.col("close"), 20)) / (2 * band)).otherwise(F.when(band == 0, 0.0))).drop("__r")


def forward_returns(bars: DataFrame, hs: tuple[int, ...] = (5, 21)) -> DataFrame:
    """``fwd{h}``: the return of the next h sessions, a label; null for the last h rows."""
    return bars.withColumns({f"fwd{h}": F.lead("close", h).over(by_date()) / F.col("close") - 1 for h in hs})


def breadth(bars: DataFrame, n: int = 50) -> DataFrame:
    """By date: the share of symbols above their n-bar mean, among those that have one."""
    out = bars.withColumn("__s", full(F.avg, F.col("close"), n)).where("__s is not null")
    return out.groupBy("d").agg(F.avg((F.col("close") > F.col("__s")).cast("double")).alias("breadth"), F.count(F.lit(1)).alias("n_symbols"))


def asof_align(left: DataFrame, right: DataFrame, value: str, by: list[str], at: str) -> DataFrame:
    """``left`` with the last non-null ``value`` of ``right`` at or before ``at``, by key.

    Both sides go into one sorted stream with a window, so a key's rows are sorted once and
    never joined as pairs. ``left`` and ``right`` share the columns ``by`` and ``at``.
    """
    rest = [c for c in left.columns if c not in (*by, at)]
    a = left.select(*by, at, F.lit(1).alias("__side"), F.lit(None).cast(right.schema[value].dataType).alias(value), F.struct(*rest).alias("__row"))
    b = right.select(*by, at, F.lit(0).alias("__side"), value, F.lit(None).cast(a.schema["__row"].dataType).alias("__row"))
    w = Window.partitionBy(*by).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn(value, F.last(value, ignorenulls=True).over(w))
    return both.where("__side = 1").select(*by, at, *(F.col(f"__row.{c}").alias(c) for c in rest), value)


def spread(bars: DataFrame) -> DataFrame:
    """``bars`` by symbol in as many partitions as a shuffle has. The windows of a symbol use this
    partitioning as it is; small bars are not merged into a task or two, long windows being
    work of the processor and not of bytes."""
    return bars.repartition(int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions")), "symbol")


def drawdown(curve: DataFrame) -> DataFrame:
    """Running ``peak``, ``drawdown`` from it, and the largest so far, by source."""
    w = Window.partitionBy("source").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    out = curve.withColumn("peak", F.max("equity").over(w)).withColumn("drawdown", 1 - F.col("equity") / F.col("peak"))
    return out.withColumn("max_drawdown", F.max("drawdown").over(w))


def peak_since_reset(curve: DataFrame, reset: Column) -> DataFrame:
    """``peak`` and ``drawdown`` since the last row, this one included, that ``reset`` marks."""
    w = Window.partitionBy("source").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    out = curve.withColumn("__part", F.sum(F.coalesce(reset, F.lit(False)).cast("int")).over(w))
    own = Window.partitionBy("source", "__part").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("peak", F.max("equity").over(own)).withColumn("drawdown", 1 - F.col("equity") / F.col("peak")).drop("__part")


def average_rank(col: str, by: str) -> Column:
    """Rank from 1 by value, ties sharing their mean rank."""
    return F.rank().over(Window.partitionBy(by).orderBy(col)) + (F.count(F.lit(1)).over(Window.partitionBy(by, col)) - 1) / 2.0
