"""Contracts of rows: what is accepted, why a row is not, and scores of accepted forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.columns import DIRECTIONS, clamp


def reasons(*checks: tuple[str, Column]) -> Column:
    """The names of the checks that fail, in order; a check that is null fails."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks)))


def check_signals(df: DataFrame) -> DataFrame:
    """``reasons`` of each signal: score and confidence in [0, 1], a horizon of a day or more,
    a known direction. Rows without reasons are valid; nothing is clamped."""
    return df.withColumn(
        "reasons",
        reasons(
            ("score", F.col("score").between(0, 1)),
            ("confidence", F.col("confidence").between(0, 1)),
            ("horizon", F.col("horizon_days") >= 1),
            ("direction", F.col("direction").isin(*DIRECTIONS)),
        ),
    )


def check_forecasts(df: DataFrame) -> DataFrame:
    """``reasons`` of each forecast: a horizon of 5 or 21, ordered finite quantiles, a
    probability in [0, 1], provenance."""
    finite = ~(F.isnan("q10") | F.isnan("q50") | F.isnan("q90"))
    return df.withColumn(
        "reasons",
        reasons(
            ("horizon", F.col("horizon").isin(5, 21)),
            ("finite", finite),
            ("order", (F.col("q10") <= F.col("q50")) & (F.col("q50") <= F.col("q90"))),
            ("probability", F.col("p_positive").between(0, 1)),
            ("provenance", F.length("model_id") > 0),
        ),
    )


def model_score(edge: Column, p: Column, excess: Column, width: Column) -> Column:
    """Edge, probability and excess, damped by the width of the band, within -1 and 1."""
    raw = 0.5 * F.tanh(edge / 0.04) + 0.3 * (2 * p - 1) + 0.2 * F.tanh(excess / 0.04)
    return clamp(raw * F.least(F.lit(1.0), 0.08 / width), -1.0, 1.0)


def forecast_vote(df: DataFrame, min_edge: float = 0.0, cost: float = 0.0016) -> DataFrame:
    """``direction`` and ``score``: long if the median after costs and the probability agree,
    avoid if absolute and excess are both negative. Positive excess with a negative absolute
    median is neither."""
    long_ = (F.col("q50") - cost > min_edge) & (F.col("p_positive") >= 0.5)
    avoid = (F.col("q50") < -0.005) & (F.col("excess") < 0)
    out = df.withColumn("direction", F.when(long_, "long").when(avoid, "avoid"))
    return out.withColumn("score", F.least(F.lit(1.0), F.abs("excess") / 0.06)).where("direction is not null")


#: The two families of returns of a forecast, and what says where it comes from.
FAMILIES = ("abs", "ex")
PROVENANCE = ("model_id", "manifest_id", "feature_hash")


def check_dual_forecasts(df: DataFrame, strict: bool = False) -> DataFrame:
    """``reasons`` of each forecast of absolute (``abs_``) and excess (``ex_``) returns: a horizon
    of 5 or 21, six finite quantiles, ordered in both families, two probabilities in [0, 1],
    all of the provenance. With ``strict`` a row with reasons raises when it is read."""
    every = [f"{f}_{q}" for f in FAMILIES for q in ("q10", "q50", "q90")]
    number = lambda c: F.abs(c) < float("inf")  # noqa: E731 - false for NaN, which counts as largest
    checks = [("horizon", F.col("horizon").isin(5, 21))]
    checks += [(f"finite_{c}", number(c)) for c in every]
    checks += [(f"order_{f}", (F.col(f"{f}_q10") <= F.col(f"{f}_q50")) & (F.col(f"{f}_q50") <= F.col(f"{f}_q90"))) for f in FAMILIES]
    checks += [(f"probability_{f}", F.col(f"p_{f}").between(0, 1)) for f in FAMILIES]
    checks += [(c, F.length(F.trim(c)) > 0) for c in PROVENANCE]
    out = df.withColumn("reasons", reasons(*checks))
    if strict:
        refused = F.raise_error(F.concat(F.lit("forecast refused: "), F.array_join("reasons", ",")))
        out = out.withColumn("reasons", F.when(F.size("reasons") == 0, F.col("reasons")).otherwise(refused.cast("array<string>")))
    return out


def admitted(forecasts: DataFrame, as_of: Column, model_id: str, feature_hash: str) -> DataFrame:
    """Forecasts that may act on a cycle: valid, made for its ``as_of``, by the model that is in
    charge, under the present features. Without a model in charge none are."""
    ok = (F.size("reasons") == 0) & (F.col("as_of") == as_of) & (F.col("model_id") == model_id) & (F.col("feature_hash") == feature_hash)
    return check_dual_forecasts(forecasts).where(ok & F.lit(bool(model_id))).drop("reasons")


def dual_score(cost: float = 0.0016) -> Column:
    """``model_score`` of a forecast's own columns; a band is never taken as narrower than 0.01."""
    return model_score(F.col("abs_q50") - cost, F.col("p_abs"), F.col("ex_q50"), F.greatest(F.lit(0.01), F.col("abs_q90") - F.col("abs_q10")))


def dual_vote(df: DataFrame, min_edge: float = 0.0, min_p: float = 0.5, cost: float = 0.0016) -> DataFrame:
    """``direction, score, confidence, expected_return`` by absolute economics; score and
    confidence are those of the excess return, the confidence within 0.2 and 0.9."""
    long_ = (F.col("abs_q50") - cost > min_edge) & (F.col("p_abs") >= min_p)
    out = df.withColumn("direction", F.when(long_, "long").when((F.col("abs_q50") < -0.005) & (F.col("ex_q50") < 0), "avoid")).where("direction is not null")
    p = F.when(F.col("direction") == "long", F.col("p_ex")).otherwise(1 - F.col("p_ex"))
    return out.withColumn("score", F.least(F.lit(1.0), F.abs("ex_q50") / 0.06)).withColumn("confidence", clamp(p, 0.2, 0.9)).withColumn("expected_return", F.col("abs_q50"))
