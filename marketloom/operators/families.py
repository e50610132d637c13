"""Fusion of five families of evidence: budgets by family, priors over all enabled nodes of one,
learned reliability by regime, states for coverage, conflict, expectation after costs."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.columns import LONG_DIRECTIONS, ROUND_TRIP, signed_alpha
from marketloom.operators.fusion import CONFLICT_PENALTY, MACRO
from marketloom.operators.nodes import AVAILABLE, Evaluated

#: Budgets of the families, priors of their nodes, and how far reliability goes.
COMPANY = {"business": 0.30, "catalyst": 0.20, "quality": 0.15, "context": 0.15, "price": 0.20}
FUND = {"context": 0.50, "price": 0.50}
PRIORS = {
    "business": {"business_fundamentals": 1.0},
    "catalyst": {"company_catalyst": 0.50, "earnings_drift": 0.25, "news_sentiment": 0.10, "insider": 0.075, "congress_trades": 0.075},
    "quality": {"quality_value": 1.0},
    "context": {"sector_rotation": 0.45, "macro_regime": 0.45, "hypothesis": 0.10},
    "price": {"momentum": 0.40, "reversal": 0.20, "gap": 0.15, "vol_contraction": 0.25},
}
EXPERIMENTAL = ("reversal", "news_sentiment", "congress_trades", "insider", "hypothesis", "gap", "vol_contraction")
FLOOR, EXPERIMENTAL_FLOOR, CEILING = 0.50, 0.25, 1.50


def priors(disabled: tuple[str, ...] = ()) -> dict[str, dict[str, float]]:
    """By family the shares of its enabled nodes; what is switched off gives its share away."""
    out = {}
    for family, nodes in PRIORS.items():
        left = {n: p for n, p in nodes.items() if n not in disabled}
        total = sum(left.values())
        out[family] = {n: p / total for n, p in left.items()} if total else {}
    return out


def _map(values: Mapping[str, float | str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def reliability(multipliers: DataFrame) -> DataFrame:
    """(node_id, by): for each node its multiplier by regime, a map, with ``*`` for all others.
    ``multipliers`` has node_id, regime (null: everywhere), multiplier. Clamped by what a node is."""
    floor = F.when(F.col("node_id").isin(*EXPERIMENTAL), EXPERIMENTAL_FLOOR).otherwise(FLOOR)
    m = F.greatest(floor, F.least(F.lit(CEILING), F.col("multiplier")))
    one = multipliers.where("multiplier is not null").groupBy("node_id", F.coalesce("regime", F.lit("*")).alias("regime")).agg(F.max(m).alias("m"))
    return one.groupBy("node_id").agg(F.map_from_entries(F.collect_list(F.struct("regime", "m"))).alias("by"))


def fuse(done: Evaluated, grid: DataFrame, multipliers: DataFrame, disabled: tuple[str, ...] = ()) -> DataFrame:
    """A row for each (as_of, symbol) of ``grid`` (with ``regime``, ``is_fund``): the value of each
    family, raw score, conflict, production score, coverage, gross and net expectation, horizon
    and, for what may be traded, the final score.

    The regime is evidence of the context family. A family's priors stand over all its enabled
    nodes, so evidence that is missing gives its weight to no one. Coverage counts the priors of
    nodes that ran or were verified neutral; blocked and unavailable ones lower it. Conflict
    shrinks positive scores only. Sums by family come out of one aggregation; only then the
    budgets of a company or a fund weigh them. A null multiplier or a node without one counts 1.
    """
    shares = priors(disabled)
    family = {n: f for f, nodes in shares.items() for n in nodes}
    prior = {n: p for nodes in shares.values() for n, p in nodes.items()}
    level = _map(MACRO)[F.col("regime")]
    macro = grid.where("regime is not null").select(
        "as_of", "symbol", F.lit("macro_regime").alias("node_id"), F.when(level >= 0, "long").otherwise("avoid").alias("direction"), F.abs(level).alias("score"),
        F.lit(1.0).alias("confidence"), F.lit(21).alias("horizon_days"), F.lit(0.0).alias("expected_return"),
    )
    signals = macro if "macro_regime" not in disabled else macro.limit(0)
    if done.signals is not None:
        signals = signals.unionByName(done.signals)
    marks = signals.withColumn("seen", F.lit(False))
    if done.seen is not None:
        marks = marks.unionByName(done.seen.withColumn("seen", F.lit(True)), allowMissingColumns=True)
    # a row a session: the regimes; a row a node: the multipliers
    days = grid.groupBy("as_of").agg(F.max("regime").alias("regime"))
    x = marks.join(F.broadcast(days), "as_of", "left").join(F.broadcast(reliability(multipliers)), "node_id", "left")
    x = x.withColumn("family", _map(family)[F.col("node_id")]).where("family is not null")
    times = F.coalesce(F.try_element_at("by", F.coalesce("regime", F.lit("*"))), F.try_element_at("by", F.lit("*")), F.lit(1.0))
    floor = F.when(F.col("node_id").isin(*EXPERIMENTAL), EXPERIMENTAL_FLOOR).otherwise(FLOOR)
    x = x.withColumn("w", _map(prior)[F.col("node_id")] * F.greatest(floor, F.least(F.lit(CEILING), times)))
    there = ~F.col("seen")
    part = F.when(there, signed_alpha(F.col("direction"), F.col("score"), F.col("confidence")) * F.col("w"))
    sign = F.when(F.col("direction").isin(*LONG_DIRECTIONS), 1.0).otherwise(-1.0)
    own = F.when(there, F.col("w") * F.col("confidence"))
    sums = []
    for f in COMPANY:
        mine = F.col("family") == f
        sums += [
            F.sum(F.when(mine, part)).alias(f"{f}_value"), F.sum(F.when(mine, F.greatest(part, F.lit(0.0)))).alias(f"{f}_up"), F.sum(F.when(mine, F.greatest(-part, F.lit(0.0)))).alias(f"{f}_down"),
            F.sum(F.when(mine, sign * F.abs("expected_return") * own)).alias(f"{f}_gain"), F.sum(F.when(mine, own)).alias(f"{f}_mass"),
            F.collect_set(F.when(mine, F.col("node_id"))).alias(f"{f}_nodes"),
        ]
    is_long = there & F.col("direction").isin(*LONG_DIRECTIONS) & (F.col("node_id") != "macro_regime")
    fused = x.groupBy("as_of", "symbol").agg(*sums, F.avg(F.when(is_long, F.col("horizon_days").cast("double"))).alias("horizon"))
    out = grid.select("as_of", "symbol", "is_fund").join(fused, ["as_of", "symbol"], "left")
    weight = {f: F.when(F.col("is_fund"), FUND.get(f, 0.0)).otherwise(COMPANY[f]) for f in COMPANY}
    always = {f: [n for n in nodes if done.node_states.get(n) in AVAILABLE] for f, nodes in shares.items()}

    def total(kind: str) -> Column:
        return reduce(lambda a, b: a + b, (weight[f] * F.coalesce(f"{f}_{kind}", F.lit(0.0)) for f in COMPANY))

    def covered(f: str) -> Column:
        nodes = F.array_union(F.coalesce(f"{f}_nodes", F.array().cast("array<string>")), F.array(*map(F.lit, always[f])).cast("array<string>"))
        return weight[f] * F.least(F.lit(1.0), F.aggregate(nodes, F.lit(0.0), lambda a, n: a + F.coalesce(_map(shares[f])[n], F.lit(0.0)))) if shares[f] else F.lit(0.0)

    out = out.withColumn("raw", total("value")).withColumn("__up", total("up")).withColumn("__down", total("down")).withColumn("__gain", total("gain")).withColumn("__mass", total("mass"))
    both = F.col("__up") + F.col("__down")
    out = out.withColumn("conflict", 1 - CONFLICT_PENALTY * F.when(both > 0, 2 * F.least("__up", "__down") / both).otherwise(0.0))
    out = out.withColumn("production", F.when(F.col("raw") > 0, F.col("raw") * F.col("conflict")).otherwise(F.col("raw")))
    out = out.withColumn("coverage", reduce(lambda a, b: a + b, (covered(f) for f in COMPANY))).withColumn("gross", F.when(F.col("__mass") > 0, F.col("__gain") / F.col("__mass")).otherwise(0.0))
    traded = (F.col("raw") > 0) & F.col("horizon").isNotNull()
    penalty = ROUND_TRIP / F.greatest(F.abs("gross"), F.lit(0.005)) * 0.01
    return out.select(
        "as_of", "symbol", *(F.when(weight[f] > 0, F.col(f"{f}_value")).alias(f"{f}_value") for f in COMPANY), "raw", "conflict", "production", "coverage", "gross",
        (F.col("gross") - ROUND_TRIP).alias("net"), F.round("horizon").cast("int").alias("horizon_days"), F.when(traded, F.col("production") - penalty).alias("final"),
    )
