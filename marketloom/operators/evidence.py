"""Signals from filings, disclosures, events and memos, and what is made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.columns import clamp, signed_alpha
from marketloom.operators.joins import latest_at, next_after, within_days

#: Drift thresholds, weights of disclosed sizes, insider value buckets.
SURPRISE_MIN, REACTION_MIN, EVENT_DAYS = 0.04, 0.005, 14
SIZE_WEIGHT = {1: 0.2, 2: 0.4, 3: 0.6, 4: 0.8, 5: 0.9, 6: 1.0, 7: 1.0, 8: 1.0}
UNKNOWN_SIZE = 0.3
INSIDER = ((5e6, 1.0), (5e5, 0.8), (1e5, 0.5))
#: What a node's state counts as, the worst first.
STATES = ("human_disabled", "blocked", "running", "verified_neutral", "unavailable")
MACRO_GRAPH = {"risk_on": 1.0, "neutral": 0.3, "risk_off": -0.5, "stress": -1.0}
#: The evidence graph, its layers, activations and weights.
GRAPH_INPUTS = {
    "tanh": ("momentum", "vol_contraction", "neural", "reversal", "earnings_drift", "business_fundamentals", "sector_rotation", "gap", "company_catalyst", "news_sentiment", "congress_trades", "insider", "hypothesis", "strategy_context"),
    "gate": ("quality_value", "macro_regime"),
}
GRAPH_INNER = {
    "trend_confirmation": (("momentum", "reversal", "vol_contraction", "neural"), 0.25),
    "catalyst_confirmation": (("earnings_drift", "company_catalyst", "news_sentiment", "gap", "congress_trades", "insider"), 0.30),
    "fundamental_confirmation": (("business_fundamentals", "quality_value"), 0.22),
    "risk_adjusted_conviction": (("sector_rotation", "macro_regime", "hypothesis", "strategy_context"), 0.20),
}
GRAPH_OUTPUTS = {
    "output_5d": (("trend_confirmation", "catalyst_confirmation", "risk_adjusted_conviction"), 0.33),
    "output_21d": (("trend_confirmation", "fundamental_confirmation", "risk_adjusted_conviction"), 0.33),
}
LEAK = 0.05


def earnings_drift(decisions: DataFrame, reports: DataFrame, bars: DataFrame) -> DataFrame:
    """For each decision (symbol, as_of) ``state`` and, if running, ``score``: the first report
    of the 14 days before whose surprise and first reaction are large enough. Without any
    report the state is unavailable, with none that is enough verified_neutral.

    Reports of one date go by id, then surprise. A reaction is known only once the bar after the report is at or before the decision.
    """
    r = latest_at(reports, bars.withColumn("before", F.col("close")), ["before"], ["symbol"], "d")
    r = next_after(r, bars.select("symbol", "d", F.col("close").alias("after"), F.col("d").alias("after_d")), ["after", "after_d"], ["symbol"], "d")
    r = r.withColumn("reaction", F.col("after") / F.col("before") - 1).withColumnRenamed("d", "reported")
    x = within_days(decisions, r, EVENT_DAYS, "symbol", "as_of", "reported").where("after_d <= as_of")
    hit = (F.col("surprise") >= SURPRISE_MIN) & (F.col("reaction") > REACTION_MIN)
    score = F.least(F.lit(1.0), 0.6 * F.col("surprise") / 0.15 + 0.4 * F.least("reaction", F.lit(0.08)) / 0.08)
    g = x.groupBy("symbol", "as_of").agg(F.count(F.lit(1)).alias("reports"), F.min_by(F.when(hit, score), F.when(hit, F.struct("reported", "report_id", "surprise"))).alias("score"))
    state = F.when(F.col("reports").isNull(), "unavailable").when(F.col("score").isNull(), "verified_neutral").otherwise("running")
    return decisions.join(g, ["symbol", "as_of"], "left").select("symbol", "as_of", "reports", "score", state.alias("state"))


def disclosure_clusters(decisions: DataFrame, buys: DataFrame) -> DataFrame:
    """Purchases published in the 14 days before: the largest size's weight, more for several
    filers, 1 at most."""
    sizes = F.create_map(*[x for k, v in SIZE_WEIGHT.items() for x in (F.lit(k), F.lit(v))])
    x = within_days(decisions, buys.withColumn("w", F.coalesce(sizes[F.col("size")], F.lit(UNKNOWN_SIZE))), EVENT_DAYS, "symbol", "as_of", "published")
    g = x.groupBy("symbol", "as_of").agg(F.max("w").alias("w"), F.count_distinct("filer").alias("filers"))
    return g.select("symbol", "as_of", "filers", F.least(F.lit(1.0), F.col("w") * (0.5 + 0.25 * F.col("filers"))).alias("score"), F.lit(0.4).alias("confidence"))


def insider_score(value: Column) -> Column:
    """By the value of a filing's purchases."""
    out = F.lit(0.3)
    for least, score in reversed(INSIDER):
        out = F.when(value >= least, score).otherwise(out)
    return out


def insider_signals(decisions: DataFrame, filings: DataFrame) -> DataFrame:
    """A signal for each filing of the 14 days before."""
    x = within_days(decisions, filings, EVENT_DAYS, "symbol", "as_of", "published")
    return x.select("symbol", "as_of", "filing_id", insider_score(F.col("value")).alias("score"))


def annual_states(facts: DataFrame, tags: tuple[str, ...]) -> DataFrame:
    """(cik, filed, one column a tag): what annual reports said as of each filing date, the
    latest period of that date, carried forward."""
    f = facts.where(F.col("form").isin("10-K", "10-K/A") & F.col("tag").isin(*tags))
    day = f.groupBy("cik", "filed").agg(*(F.max_by(F.when(F.col("tag") == t, F.col("value")), F.when(F.col("tag") == t, F.col("period_end"))).alias(t) for t in tags))
    w = Window.partitionBy("cik").orderBy("filed").rowsBetween(Window.unboundedPreceding, 0)
    return day.select("cik", "filed", *(F.last(t, ignorenulls=True).over(w).alias(t) for t in tags))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def _debt() -> Column:
    split = F.coalesce("LongTermDebtCurrent", F.lit(0.0))
    return F.when(split != 0, split).otherwise(F.col("LongTermDebt"))


def fundamentals(facts: DataFrame, tags: tuple[str, ...]) -> DataFrame:
    """By (cik, filed), each clipped to +-3 or null: growth and dilution against the last filing
    that had the number, margins, debt, accruals and liquidity."""
    x = annual_states(facts, tags)
    w = Window.partitionBy("cik").orderBy("filed").rowsBetween(Window.unboundedPreceding, -1)
    c = F.col
    free = c("NetCashProvidedByUsedInOperatingActivities") - F.coalesce("PaymentsToAcquirePropertyPlantAndEquipment", F.lit(0.0))
    values = {
        "revenue_growth": _ratio(c("Revenues"), F.last("Revenues", ignorenulls=True).over(w)) - 1,
        "operating_margin": _ratio(c("OperatingIncomeLoss"), c("Revenues")),
        "fcf_margin": _ratio(free, c("Revenues")),
        "debt_assets": _ratio(_debt(), c("Assets")),
        "dilution": _ratio(c("CommonStockSharesOutstanding"), F.last("CommonStockSharesOutstanding", ignorenulls=True).over(w)) - 1,
        "accruals": _ratio(c("NetIncomeLoss") - c("NetCashProvidedByUsedInOperatingActivities"), c("Assets")),
        "liquidity": _ratio(c("AssetsCurrent"), c("LiabilitiesCurrent")) - 1,
    }
    return x.select("cik", "filed", *(F.when(v.isNotNull(), clamp(v, -3.0, 3.0)).alias(k) for k, v in values.items()))


def quality_score(facts: DataFrame, as_of: str) -> DataFrame:
    """By issuer: the mean of what the latest annual period, as filed by ``as_of``, says about
    quality, each part within -1 and 1; direction by its sign; ``passes`` over -1/2."""
    f = facts.where(F.col("form").isin("10-K", "10-K/A") & (F.col("filed") <= F.lit(as_of).cast("date")))
    tags = ("Revenues", "OperatingIncomeLoss", "Assets", "StockholdersEquity", "EarningsPerShareDiluted", "NetCashProvidedByUsedInOperatingActivities", "PaymentsToAcquirePropertyPlantAndEquipment", "LongTermDebt", "LongTermDebtCurrent", "AssetsCurrent", "LiabilitiesCurrent", "CommonStockSharesOutstanding")
    period = f.groupBy("cik", "period_end").agg(*(F.max_by(F.when(F.col("tag") == t, F.col("value")), F.when(F.col("tag") == t, F.col("filed"))).alias(t) for t in tags))
    w = Window.partitionBy("cik").orderBy("period_end")
    x = period.withColumns({"p_rev": F.lag("Revenues").over(w), "p_shares": F.lag("CommonStockSharesOutstanding").over(w), "later": F.lead("period_end").over(w)}).where("later is null")
    c = F.col
    free = c("NetCashProvidedByUsedInOperatingActivities") - F.coalesce("PaymentsToAcquirePropertyPlantAndEquipment", F.lit(0.0))
    parts = [
        (_ratio(c("StockholdersEquity"), c("Assets")) - 0.2) / 0.3,
        F.when(c("EarningsPerShareDiluted") > 0, 0.5).when(c("EarningsPerShareDiluted").isNotNull(), -0.5),
        _ratio(c("OperatingIncomeLoss"), c("Revenues")) / 0.20,
        _ratio(free, c("Revenues")) / 0.15,
        F.when(c("Revenues") != 0, (_ratio(c("Revenues"), c("p_rev")) - 1) / 0.25),
        (0.5 - _ratio(_debt(), c("Assets"))) / 0.5,
        _ratio(c("AssetsCurrent"), c("LiabilitiesCurrent")) - 1,
        -(_ratio(c("CommonStockSharesOutstanding"), c("p_shares")) - 1) / 0.10,
    ]
    known = F.array_compact(F.array(*(F.when(p.isNotNull(), clamp(p, -1.0, 1.0)) for p in parts)))
    score = F.aggregate(known, F.lit(0.0), lambda a, v: a + v) / F.size(known)
    out = x.select("cik", "period_end", F.size(known).alias("n_parts"), F.when(F.size(known) > 0, score).alias("score"))
    return out.where("n_parts > 0").withColumn("direction", F.when(F.col("score") >= 0, "long").otherwise("avoid")).withColumn("passes", F.col("score") > -0.5)


def snapshot_passes(gross: Column, roe: Column, debt: Column, etf: Column) -> Column:
    """The veto on a snapshot of fundamentals: what isn't known passes, funds always do."""
    ok = F.coalesce(gross > 0.05, F.lit(True)) & F.coalesce(roe > -0.10, F.lit(True)) & F.coalesce(debt < 400, F.lit(True))
    return etf | ok


def memo_vote(decisions: DataFrame, dossiers: DataFrame) -> DataFrame:
    """The vote of the latest memo at each decision: ``state``, ``direction``, ``confidence``
    (0.1 at least)."""
    x = latest_at(decisions, dossiers, ["stance", "quality"], ["symbol"], "d")
    state = F.when(F.col("stance").isNull(), "unavailable").when(F.col("stance") == "neutral", "verified_neutral").otherwise("running")
    return x.withColumn("state", state).withColumn("direction", F.when(state == "running", F.when(F.col("stance") == "bullish", "long").otherwise("avoid"))).withColumn("confidence", F.when(state == "running", F.greatest(F.lit(0.1), F.coalesce("quality", F.lit(0.0)))))


def catalyst_vote(memo: Column, news: Column, news_age_hours: Column) -> Column:
    """Memo and fresh news (6 h at most) blended, or whichever there is; null if neither."""
    fresh = F.when(news_age_hours <= 6, news)
    return F.when(memo.isNotNull() & fresh.isNotNull(), 0.65 * memo + 0.35 * fresh).otherwise(F.coalesce(memo, fresh))


def headline_vote(headlines: DataFrame) -> DataFrame:
    """By (symbol, day): classified headlines of the two days up to it that are strong, not yet
    in the price and of a horizon of 30 days at most; two or more make a vote."""
    x = headlines.where(~F.col("priced") & (F.abs(F.col("stance") * F.col("confidence")) >= 0.25) & (F.col("horizon_days") <= 30))
    x = x.withColumn("day", F.explode(F.array(F.to_date("published_at"), F.date_add(F.to_date("published_at"), 1))))
    g = x.groupBy("symbol", "day").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("stance") * F.col("confidence")).alias("mean"))
    return g.where("n >= 2").select("symbol", "day", "n", F.when(F.col("mean") >= 0, "long").otherwise("avoid").alias("direction"), F.least(F.lit(1.0), F.abs("mean")).alias("score"))


def standing_views(decisions: DataFrame, views: DataFrame, days: int = 3) -> DataFrame:
    """The latest view of each symbol at a decision, while it is valid (``days``), if it has a
    direction and a conviction of .3."""
    x = latest_at(decisions, views.withColumn("made", F.col("d")), ["made", "stance", "conviction"], ["symbol"], "d")
    return x.where((F.datediff("d", "made") < days) & (F.col("stance") != "neutral") & (F.col("conviction") >= 0.3))


def node_states(grid: DataFrame, nodes: list[str], signals: DataFrame, states: DataFrame) -> DataFrame:
    """``state`` of each (as_of, symbol, node): disabled, then blocked, then running if there is
    a signal, then what the node said about itself, else unavailable."""
    cells = grid.select("as_of", "symbol", F.explode(F.array(*map(F.lit, nodes))).alias("node_id"))
    said = states.groupBy("as_of", "symbol", "node_id").agg(F.min(F.array_position(F.array(*map(F.lit, STATES)), F.col("state"))).alias("p"))
    have = signals.select("as_of", "symbol", "node_id").distinct().withColumn("s", F.lit(STATES.index("running") + 1))
    x = cells.join(said, ["as_of", "symbol", "node_id"], "left").join(have, ["as_of", "symbol", "node_id"], "left")
    at = F.least(F.coalesce("p", F.lit(len(STATES))), F.coalesce("s", F.lit(len(STATES))))
    return x.select("as_of", "symbol", "node_id", F.element_at(F.array(*map(F.lit, STATES)), at.cast("int")).alias("state"))


def graph_bases(signals: DataFrame, regimes: DataFrame) -> DataFrame:
    """(as_of, symbol, one column a node): mean signed evidence; the regime as a level; a node
    without a signal is 0."""
    nodes = [n for kind in GRAPH_INPUTS.values() for n in kind if n != "macro_regime"]
    s = signals.withColumn("a", signed_alpha(F.col("direction"), F.col("score"), F.col("confidence")))
    g = s.groupBy("as_of", "symbol").agg(*(F.coalesce(F.avg(F.when(F.col("node_id") == n, F.col("a"))), F.lit(0.0)).alias(n) for n in nodes))
    level = F.create_map(*[x for k, v in MACRO_GRAPH.items() for x in (F.lit(k), F.lit(v))])[F.col("regime")]
    return g.join(regimes.select(F.col("d").alias("as_of"), level.alias("macro_regime")), "as_of", "left").fillna(0.0, ["macro_regime"])


def graph_score(bases: DataFrame) -> DataFrame:
    """The graph's two outputs, a pass of columns for each layer."""
    x = bases.withColumns({n: F.tanh(n) for n in GRAPH_INPUTS["tanh"]} | {n: 2 / (1 + F.exp(-clamp(F.col(n), -30.0, 30.0))) - 1 for n in GRAPH_INPUTS["gate"]})
    for layer, leak in ((GRAPH_INNER, LEAK), (GRAPH_OUTPUTS, 1.0)):
        z = {n: sum((F.col(s) * w for s in sources[1:]), F.col(sources[0]) * w) for n, (sources, w) in layer.items()}
        x = x.withColumns({n: F.when(v >= 0, v).otherwise(v * leak) for n, v in z.items()})
    return x.select("as_of", "symbol", *GRAPH_OUTPUTS)


def blend(score: Column, learned: Column, share: Column, complete: Column, ceiling: Column) -> Column:
    """(1 - b) x score + b x learned where the learned score is complete; b within .05 and .40
    and the permitted ceiling, and 0 stays 0."""
    b = F.when(complete & (share > 0) & learned.isNotNull(), F.least(clamp(share, 0.05, 0.40), ceiling)).otherwise(0.0)
    return score * (1 - b) + F.coalesce(learned, F.lit(0.0)) * b


def mandate_contribution(stance: Column, tilt: Column, confidence: Column, score: Column, coverage: Column, edge: Column) -> Column:
    """+-.15 x confidence by a tilt or, without one, a list; only for what stands on its own."""
    sign = F.when(F.coalesce(tilt, stance) == "favor", 1.0).when(F.coalesce(tilt, stance) == "avoid", -1.0).otherwise(0.0)
    return F.when((F.abs(score) >= 0.10) & (coverage >= 0.50) & (edge > 0), sign * confidence * 0.15).otherwise(0.0)


def select_candidates(fused: DataFrame, min_final: float = 0.15, probe_min: float = 0.25) -> DataFrame:
    """What of the fused rows becomes a candidate, and how (``entry_mode, size``).

    Rows have final, production, net (expected, after costs), passes, etf, ready, families (an
    array). Without a ready dossier a company is a probe of a quarter if its score and the
    families quality, context and price are there, else it goes.
    """
    x = fused.where((F.col("final") >= min_final) & F.col("passes"))
    probe = ~F.col("etf") & ~F.col("ready")
    enough = (F.col("production") >= probe_min) & (F.size(F.array_intersect("families", F.array(F.lit("quality"), F.lit("context"), F.lit("price")))) == 3) & (F.col("net") > 0)
    x = x.where(~probe | enough)
    return x.withColumn("entry_mode", F.when(probe, "probe").otherwise("normal")).withColumn("size", F.when(probe, 0.25).otherwise(1.0))


def sleeves(ranked: DataFrame, total: int = 25) -> DataFrame:
    """``sleeve, place`` of each cycle's shortlist: 13 by score, then 4 by quality, 4 by
    catalyst, 4 by what is unknown, then by score again; a symbol is taken once.

    Each sleeve ranks what the ones before left; ties by dollar volume, then symbol.
    """
    orders = (("combined", 13, ["score"]), ("quality", 4, ["quality"]), ("catalyst", 4, ["catalyst"]), ("exploration", 4, ["unavailable"]), ("combined_fill", total, ["score"]))
    x = ranked.withColumns({"sleeve": F.lit(None).cast("string"), "place": F.lit(None).cast("long")})
    for name, most, by in orders:
        w = Window.partitionBy("cycle", F.col("sleeve").isNull()).orderBy(*(F.desc(c) for c in [*by, "dollar_volume"]), "symbol")
        taken = F.count("sleeve").over(Window.partitionBy("cycle"))
        x = x.withColumn("k", F.row_number().over(w)).withColumn("t", taken)
        fits = F.col("sleeve").isNull() & (F.col("k") <= most) & (F.col("t") + F.col("k") <= total)
        x = x.withColumns({"sleeve": F.when(fits, name).otherwise(F.col("sleeve")), "place": F.when(fits, F.col("t") + F.col("k")).otherwise(F.col("place"))})
    return x.where("sleeve is not null").select("cycle", "symbol", "sleeve", "place")


def reliability(evidence: DataFrame, cells: DataFrame, overall: DataFrame, floor: float = 0.5, ceiling: float = 1.5) -> DataFrame:
    """``multiplier`` of each (node, regime): the regime's own cell, else the node's, else 1;
    clamped. The tables have a row a node and regime and are small."""
    x = evidence.join(cells.select("node", "regime", F.col("multiplier").alias("own")), ["node", "regime"], "left").join(overall.select("node", F.col("multiplier").alias("all")), "node", "left")
    return x.withColumn("multiplier", clamp(F.coalesce("own", "all", F.lit(1.0)), floor, ceiling)).drop("own", "all")
