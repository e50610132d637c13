"""Queries of row contracts and forecast scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.functions.columns import rounded
from marketloom.operators import contracts as con
from marketloom.registry import register
from marketloom.sources import fixtures as fx

T = fx.TRADES_SQL


def _signals(spark, d):
    """Signals from trades; some break a rule."""
    t = fx.trades(spark, d)
    direction = F.when(F.col("id") % 11 == 0, "sideways").when(F.col("id") % 2 == 0, "long").otherwise("avoid")
    return t.select("id", "score", (F.col("ret") * 12).alias("confidence"), (F.col("horizon_days") - 3).alias("horizon_days"), direction.alias("direction"))


SIG = f"{T}, s AS (SELECT id, score, ret * 12 AS confidence, horizon_days - 3 AS horizon_days, CASE WHEN id % 11 = 0 THEN 'sideways' WHEN id % 2 = 0 THEN 'long' ELSE 'avoid' END AS direction FROM trades)"
register(
    "sc2_check_signals",
    lambda spark, d: con.check_signals(_signals(spark, d)).select("id", F.array_join("reasons", ",").alias("reasons")),
    f"""WITH {SIG} SELECT id, concat_ws(',', CASE WHEN NOT coalesce(score BETWEEN 0 AND 1, false) THEN 'score' END, CASE WHEN NOT coalesce(confidence BETWEEN 0 AND 1, false) THEN 'confidence' END,
  CASE WHEN NOT coalesce(horizon_days >= 1, false) THEN 'horizon' END, CASE WHEN direction NOT IN ('long', 'avoid') THEN 'direction' END) AS reasons FROM s""",
)


def _forecasts(spark, d):
    t = fx.trades(spark, d)
    return t.select(
        "id", F.when(F.col("id") % 3 == 0, 5).when(F.col("id") % 3 == 1, 21).otherwise(10).alias("horizon"), (F.col("ret") - 0.04).alias("q10"), F.col("ret").alias("q50"),
        (F.col("ret") + 0.06 - F.col("score") * 0.1).alias("q90"), (0.5 + F.col("ret") * 5).alias("p_positive"), (F.col("ret") - 0.02).alias("excess"), F.when(F.col("id") % 7 > 0, "m1").otherwise("").alias("model_id"),
    )


FC = f"{T}, f AS (SELECT id, CASE id % 3 WHEN 0 THEN 5 WHEN 1 THEN 21 ELSE 10 END AS horizon, ret - 0.04 AS q10, ret AS q50, ret + 0.06 - score * 0.1 AS q90, 0.5 + ret * 5 AS p, ret - 0.02 AS excess, CASE WHEN id % 7 > 0 THEN 'm1' ELSE '' END AS model_id FROM trades)"
register(
    "sc18_check_forecasts",
    lambda spark, d: con.check_forecasts(_forecasts(spark, d)).select("id", F.array_join("reasons", ",").alias("reasons")),
    f"""WITH {FC} SELECT id, concat_ws(',', CASE WHEN horizon NOT IN (5, 21) THEN 'horizon' END, CASE WHEN NOT (q10 <= q50 AND q50 <= q90) THEN 'order' END, CASE WHEN p NOT BETWEEN 0 AND 1 THEN 'probability' END, CASE WHEN model_id = '' THEN 'provenance' END) AS reasons FROM f""",
)
register(
    "e11_model_score",
    lambda spark, d: rounded(_forecasts(spark, d).where("q90 > q10").select("id", con.model_score(F.col("q50") - 0.0016, F.col("p_positive"), F.col("excess"), F.col("q90") - F.col("q10")).alias("model_score")), "model_score"),
    f"WITH {FC} SELECT id, round(greatest(least((0.5 * tanh((q50 - 0.0016) / 0.04) + 0.3 * (2 * p - 1) + 0.2 * tanh(excess / 0.04)) * least(1, 0.08 / (q90 - q10)), 1), -1), 6) AS model_score FROM f WHERE q90 > q10",
)
register(
    "sg16_forecast_vote",
    lambda spark, d: rounded(con.forecast_vote(_forecasts(spark, d).withColumns({c: F.round(c, 9) for c in ("q50", "excess", "p_positive")})).select("id", "direction", "score"), "score"),
    f"""WITH {FC}, g AS (SELECT id, round(q50, 9) AS q50, round(excess, 9) AS excess, round(p, 9) AS p FROM f), v AS (SELECT *, CASE WHEN q50 - 0.0016 > 0 AND p >= 0.5 THEN 'long' WHEN q50 < -0.005 AND excess < 0 THEN 'avoid' END AS direction FROM g)
SELECT id, direction, round(least(1, abs(excess) / 0.06), 6) AS score FROM v WHERE direction IS NOT NULL""",
)

#: Forecasts of both families; some break a rule, some are of another day or model.
_DUAL = """id, entry_date AS as_of, CASE id % 3 WHEN 0 THEN 5 WHEN 1 THEN 21 ELSE 10 END AS horizon, ret - 0.04 AS abs_q10, ret AS abs_q50, ret + 0.06 - score * 0.1 AS abs_q90,
  ret - 0.05 AS ex_q10, ret - 0.02 AS ex_q50, CASE WHEN id % 13 = 0 THEN CAST('NaN' AS DOUBLE) ELSE ret + 0.02 - score * 0.05 END AS ex_q90, 0.5 + ret * 4 AS p_abs, 0.5 + ret * 6 AS p_ex,
  CASE id % 7 WHEN 0 THEN ' ' WHEN 1 THEN 'm2' ELSE 'm1' END AS model_id, CASE WHEN id % 5 = 0 THEN NULL ELSE 'data' END AS manifest_id, CASE WHEN id % 4 = 0 THEN 'old' ELSE 'h1' END AS feature_hash"""
DUAL = f"{T}, f AS (SELECT {_DUAL} FROM trades)"
_NUM = "coalesce(NOT isnan({c}) AND abs({c}) < 'inf'::DOUBLE, false)"
_WHY = ["CASE WHEN horizon NOT IN (5, 21) THEN 'horizon' END"]
_WHY += [f"CASE WHEN NOT {_NUM.format(c=f'{f}_{q}')} THEN 'finite_{f}_{q}' END" for f in con.FAMILIES for q in ("q10", "q50", "q90")]
_WHY += [f"CASE WHEN NOT ({f}_q10 <= {f}_q50 AND {f}_q50 <= {f}_q90) THEN 'order_{f}' END" for f in con.FAMILIES]
_WHY += [f"CASE WHEN p_{f} NOT BETWEEN 0 AND 1 THEN 'probability_{f}' END" for f in con.FAMILIES]
_WHY += [f"CASE WHEN coalesce(length(trim({c})) = 0, true) THEN '{c}' END" for c in con.PROVENANCE]
WHY = f"concat_ws(',', {', '.join(_WHY)})"


def _dual(spark, d):
    return fx.trades(spark, d).selectExpr(*[c.strip() for c in _split(_DUAL)])


def _split(columns: str) -> list[str]:
    """Select items at commas outside brackets."""
    out, depth = [""], 0
    for ch in columns:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return out


register("sc18_dual_forecasts", lambda spark, d: con.check_dual_forecasts(_dual(spark, d)).select("id", F.array_join("reasons", ",").alias("reasons")), f"WITH {DUAL} SELECT id, {WHY} AS reasons FROM f")


def _admitted(spark, d):
    """Each day's forecasts of the model in charge, as that day's cycle takes them in."""
    x = con.admitted(_dual(spark, d), F.col("as_of"), "m1", "h1")
    return x.select("id", "as_of", F.round(con.dual_score(), 6).alias("model_score"))


ADMIT = f"{DUAL}, a AS (SELECT * FROM f WHERE {WHY} = '' AND model_id = 'm1' AND feature_hash = 'h1')"
register(
    "e11_admitted_scores",
    _admitted,
    f"WITH {ADMIT} SELECT id, as_of, round(greatest(least((0.5 * tanh((abs_q50 - 0.0016) / 0.04) + 0.3 * (2 * p_abs - 1) + 0.2 * tanh(ex_q50 / 0.04)) * least(1, 0.08 / greatest(0.01, abs_q90 - abs_q10)), 1), -1), 6) AS model_score FROM a",
)
register(
    "sg16_dual_vote",
    lambda spark, d: rounded(con.dual_vote(con.admitted(_dual(spark, d), F.col("as_of"), "m1", "h1").withColumns({c: F.round(c, 9) for c in ("abs_q50", "ex_q50", "p_abs", "p_ex")})).select("id", "direction", "score", "confidence", "expected_return"), "score", "confidence", "expected_return"),
    f"""WITH {ADMIT}, g AS (SELECT id, round(abs_q50, 9) AS q, round(ex_q50, 9) AS e, round(p_abs, 9) AS p, round(p_ex, 9) AS x FROM a), v AS (SELECT *, CASE WHEN q - 0.0016 > 0 AND p >= 0.5 THEN 'long' WHEN q < -0.005 AND e < 0 THEN 'avoid' END AS direction FROM g)
SELECT id, direction, round(least(1, abs(e) / 0.06), 6) AS score, round(greatest(0.2, least(0.9, CASE direction WHEN 'long' THEN x ELSE 1 - x END)), 6) AS confidence, round(q, 6) AS expected_return FROM v WHERE direction IS NOT NULL""",
)
