"""Column functions of the engine: sign and size of evidence, buckets, costs, prices."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Directions that count as positive; one-way costs in basis points.
LONG_DIRECTIONS = ("long", "long_call")
DIRECTIONS = ("long", "long_call", "avoid", "short", "flat")
SPREAD_BPS, SLIPPAGE_BPS = 3, 5
ROUND_TRIP = (SPREAD_BPS + SLIPPAGE_BPS) * 2 / 10_000


def signed_alpha(direction: Column, score: Column, confidence: Column) -> Column:
    """Direction owns the sign, score the size: sign x |score| x confidence."""
    return F.when(direction.isin(*LONG_DIRECTIONS), 1.0).otherwise(-1.0) * F.abs(score) * confidence


def squash(x: Column, scale: float) -> Column:
    """tanh(x / scale)."""
    return F.tanh(x / scale)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def score_bucket(score: Column) -> Column:
    """s0 below .15, s1 below .30, s2 below .50, else s3, by absolute score."""
    a = F.abs(score)
    return F.when(a < 0.15, "s0").when(a < 0.30, "s1").when(a < 0.50, "s2").otherwise("s3")


def horizon_bucket(days: Column) -> Column:
    """short up to 10 days, medium up to 30, else long."""
    return F.when(days <= 10, "short").when(days <= 30, "medium").otherwise("long")


def annualise(ret: Column, periods: Column) -> Column:
    """Compounded; the base never falls under 1e-4."""
    return F.pow(F.greatest(1 + ret, F.lit(1e-4)), periods) - 1


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution by a rational approximation (error below 1.5e-7)."""
    z = F.abs(x) / (2**0.5)
    t = 1 / (1 + 0.3275911 * z)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-z * z)
    return 0.5 * (1 + F.when(x >= 0, erf).otherwise(-erf))


def over(n: int, *, by: str = "symbol", order: str = "d", end: int = 0):
    """The window of the last n rows of a symbol, ending ``-end`` rows back."""
    return Window.partitionBy(by).orderBy(order).rowsBetween(end - n + 1, end)


def full(agg, col: Column, n: int, *, by: str = "symbol", order: str = "d", end: int = 0) -> Column:
    """``agg`` over n rows; null unless all n values are there."""
    w = over(n, by=by, order=order, end=end)
    return F.when(F.count(col).over(w) == n, agg(col).over(w))


def back(col: str, k: int, *, by: str = "symbol", order: str = "d") -> Column:
    """The value k rows before."""
    return F.lag(col, k).over(Window.partitionBy(by).orderBy(order))


def rounded(df, *names: str, digits: int = 6):
    """``df`` with the named columns rounded once, for output."""
    return df.withColumns({n: F.round(n, digits) for n in names})
