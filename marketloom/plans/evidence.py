"""Queries of signals from filings, disclosures and memos, and of what is made of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.functions.columns import rounded
from marketloom.operators import evidence as evi
from marketloom.operators import signals, stats
from marketloom.plans.signals import REGIME, RISKY, SAFE, SIGNALS, BR, _regimes  # noqa: F401
from marketloom.plans.stats import CARD, EV, _evidence
from marketloom.registry import register
from marketloom.sources import fixtures as fx

T, FILLS, OE, NEWS, ST = fx.TRADES_SQL, fx.FILLS_SQL, fx.ORDER_EVENTS_SQL, fx.NEWS_SQL, fx.STATEMENTS_SQL
BRAND = fx.bars_sql("p_brand", benchmark=False)


def _decisions(spark, d):
    return fx.trades(spark, d).select("symbol", F.trunc("entry_date", "week").alias("as_of")).distinct()


DEC = f"{T}, dec AS (SELECT DISTINCT symbol, date_trunc('week', entry_date)::DATE AS as_of FROM trades)"


def _drift(spark, d):
    reports = fx.trades(spark, d).where("score > 0.6").select("symbol", F.col("entry_date").alias("d"), F.col("ret").alias("surprise"), F.col("id").alias("report_id"))
    return rounded(evi.earnings_drift(_decisions(spark, d), reports, fx.bars(spark, d, "p_brand", False)), "score")


register(
    "sg4_earnings_drift",
    _drift,
    f"""WITH {DEC}, {BRAND}, r0 AS (SELECT symbol, entry_date AS d, ret AS surprise, id FROM trades WHERE score > 0.6),
r1 AS (SELECT r0.*, b.close AS before FROM r0 ASOF LEFT JOIN bars b ON r0.symbol = b.symbol AND r0.d >= b.d), r2 AS (SELECT r1.*, b.close AS after, b.d AS after_d FROM r1 ASOF LEFT JOIN bars b ON r1.symbol = b.symbol AND r1.d < b.d),
x AS (SELECT dec.*, r2.d, id, surprise, after / before - 1 AS re FROM dec JOIN r2 ON dec.symbol = r2.symbol AND r2.d <= as_of AND r2.d >= as_of - 14 AND after_d <= as_of),
g AS (SELECT symbol, as_of, count(*) AS reports, arg_min(least(1, 0.6 * surprise / 0.15 + 0.4 * least(re, 0.08) / 0.08), (d, id, surprise)) FILTER (WHERE surprise >= 0.04 AND re > 0.005) AS score FROM x GROUP BY 1, 2)
SELECT symbol, as_of, reports, round(score, 6) AS score, CASE WHEN reports IS NULL THEN 'unavailable' WHEN score IS NULL THEN 'verified_neutral' ELSE 'running' END AS state FROM dec LEFT JOIN g USING (symbol, as_of)""",
)


def _disclosed(spark, d):
    buys = fx.fills(spark, d).where("side = 'buy' and qty > 40").select("symbol", F.col("d").alias("published"), (F.col("qty") % 10).cast("int").alias("size"), F.col("account").alias("filer"))
    return rounded(evi.disclosure_clusters(_decisions(spark, d), buys), "score")


register(
    "sg7_disclosure_clusters",
    _disclosed,
    f"""WITH {DEC}, {FILLS}, b AS (SELECT symbol, d, account, CASE qty % 10 WHEN 1 THEN 0.2 WHEN 2 THEN 0.4 WHEN 3 THEN 0.6 WHEN 4 THEN 0.8 WHEN 5 THEN 0.9 WHEN 6 THEN 1 WHEN 7 THEN 1 WHEN 8 THEN 1 ELSE 0.3 END AS w FROM fills WHERE side = 'buy' AND qty > 40)
SELECT dec.symbol, as_of, count(DISTINCT account) AS filers, round(least(1, max(w) * (0.5 + 0.25 * count(DISTINCT account))), 6)::DOUBLE AS score, 0.4::DOUBLE AS confidence FROM dec JOIN b ON dec.symbol = b.symbol AND d <= as_of AND d >= as_of - 14 GROUP BY 1, 2""",
)


def _insiders(spark, d):
    f = fx.trades(spark, d).where("ret > 0.05").select("symbol", F.col("exit_date").alias("published"), F.col("id").alias("filing_id"), (F.col("pnl") * 1000).alias("value"))
    return evi.insider_signals(_decisions(spark, d), f)


register(
    "sg8_insider_clusters",
    _insiders,
    f"""WITH {DEC} SELECT dec.symbol, as_of, id AS filing_id, CASE WHEN pnl * 1000 >= 5e6 THEN 1.0 WHEN pnl * 1000 >= 5e5 THEN 0.8 WHEN pnl * 1000 >= 1e5 THEN 0.5 ELSE 0.3 END::DOUBLE AS score
FROM dec JOIN trades t ON dec.symbol = t.symbol AND ret > 0.05 AND exit_date <= as_of AND exit_date >= as_of - 14""",
)
AS_OF = "1998-01-01"
PIV = ", ".join(f"max(value) FILTER (WHERE tag = '{t}') AS {t}" for t in fx.STATEMENT_TAGS)
PARTS = [
    "(CASE WHEN Assets <> 0 THEN StockholdersEquity / Assets END - 0.2) / 0.3", "CASE WHEN EarningsPerShareDiluted > 0 THEN 0.5 WHEN EarningsPerShareDiluted IS NOT NULL THEN -0.5 END", "CASE WHEN Revenues <> 0 THEN OperatingIncomeLoss / Revenues END / 0.2",
    "CASE WHEN Revenues <> 0 THEN (NetCashProvidedByUsedInOperatingActivities - coalesce(PaymentsToAcquirePropertyPlantAndEquipment, 0)) / Revenues END / 0.15", "CASE WHEN Revenues <> 0 AND pr <> 0 THEN (Revenues / pr - 1) / 0.25 END",
    "(0.5 - CASE WHEN Assets <> 0 THEN CASE WHEN coalesce(LongTermDebtCurrent, 0) <> 0 THEN LongTermDebtCurrent ELSE LongTermDebt END / Assets END) / 0.5", "CASE WHEN LiabilitiesCurrent <> 0 THEN AssetsCurrent / LiabilitiesCurrent END - 1",
    "-(CASE WHEN ps <> 0 THEN CommonStockSharesOutstanding / ps END - 1) / 0.1",
]
register(
    "sg9_quality_composite",
    lambda spark, d: evi.quality_score(fx.statements(spark, d), AS_OF).withColumn("score", F.round(F.col("score") + 1e-9, 6)),
    f"""WITH {ST}, p AS (SELECT cik, period_end, {PIV} FROM st WHERE form = '10-K' AND filed <= DATE '{AS_OF}' GROUP BY 1, 2),
q AS (SELECT *, lag(Revenues) OVER w AS pr, lag(CommonStockSharesOutstanding) OVER w AS ps, row_number() OVER (PARTITION BY cik ORDER BY period_end DESC) AS k FROM p WINDOW w AS (PARTITION BY cik ORDER BY period_end)),
z AS (SELECT cik, period_end, list_filter([{', '.join(f'greatest(least({p}, 1), -1) + 0 * ({p})' for p in PARTS)}], lambda v: v IS NOT NULL) AS e FROM q WHERE k = 1)
SELECT cik, period_end, len(e) AS n_parts, round(list_avg(e) + 1e-9, 6) AS score, CASE WHEN list_avg(e) >= 0 THEN 'long' ELSE 'avoid' END AS direction, list_avg(e) > -0.5 AS passes FROM z WHERE len(e) > 0""",
)
register(
    "sg10_snapshot_veto",
    lambda spark, d: fx.trades(spark, d).select("id", evi.snapshot_passes(F.when(F.col("id") % 5 > 0, F.col("ret")), F.when(F.col("id") % 7 > 0, F.col("ret") - 0.12), F.when(F.col("id") % 3 > 0, F.col("score") * 500), F.col("source") == "P").alias("passes")),
    f"WITH {T} SELECT id, source = 'P' OR ((id % 5 = 0 OR ret > 0.05) AND (id % 7 = 0 OR ret - 0.12 > -0.10) AND (id % 3 = 0 OR score * 500 < 400)) AS passes FROM trades",
)
STANCE = "CASE id % 4 WHEN 0 THEN 'neutral' WHEN 1 THEN 'bearish' ELSE 'bullish' END"


def _dossiers(spark, d):
    t = fx.trades(spark, d).where("score > 0.7").select("symbol", F.col("exit_date").alias("d"), "id", F.expr(STANCE).alias("stance"), F.when(F.col("id") % 3 > 0, F.col("ret") * 8).alias("quality"))
    return t.groupBy("symbol", "d").agg(F.max_by(F.struct("stance", "quality"), "id").alias("m")).select("symbol", "d", "m.*")


DOS = f"{T}, dos AS (SELECT symbol, exit_date AS d, arg_max({STANCE}, id) AS stance, arg_max(CASE WHEN id % 3 > 0 THEN ret * 8 ELSE -99 END, id) AS q FROM trades WHERE score > 0.7 GROUP BY 1, 2), dec AS (SELECT DISTINCT symbol, date_trunc('week', entry_date)::DATE AS as_of FROM trades)"


def _memo(spark, d):
    out = evi.memo_vote(_decisions(spark, d).withColumnRenamed("as_of", "d"), _dossiers(spark, d))
    return rounded(out.select("symbol", F.col("d").alias("as_of"), "state", "direction", "confidence"), "confidence")


register(
    "sg11_memo_vote",
    _memo,
    f"""WITH {DOS}, x AS (SELECT dec.*, stance, CASE WHEN q > -99 THEN q ELSE 0 END AS q FROM dec ASOF LEFT JOIN dos ON dec.symbol = dos.symbol AND dec.as_of >= dos.d)
SELECT symbol, as_of, CASE WHEN stance IS NULL THEN 'unavailable' WHEN stance = 'neutral' THEN 'verified_neutral' ELSE 'running' END AS state, CASE stance WHEN 'bullish' THEN 'long' WHEN 'bearish' THEN 'avoid' END AS direction,
  CASE WHEN stance <> 'neutral' THEN round(greatest(0.1, q), 6) END AS confidence FROM x""",
)
register(
    "sg12_catalyst_vote",
    lambda spark, d: fx.news(spark, d).select("doc_id", F.round(evi.catalyst_vote(F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 7 / 7), F.col("stance"), (F.col("doc_id") % 12).cast("double")), 6).alias("vote")),
    f"""WITH {NEWS}, x AS (SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN doc_id % 7 / 7 END AS m, CASE WHEN doc_id % 12 <= 6 THEN stance END AS n FROM news)
SELECT doc_id, round(CASE WHEN m IS NOT NULL AND n IS NOT NULL THEN 0.65 * m + 0.35 * n ELSE coalesce(m, n) END, 6) AS vote FROM x""",
)


def _headlines(spark, d):
    n = fx.news(spark, d).where("stance is not null")
    return rounded(evi.headline_vote(n.select("symbol", "published_at", "stance", "confidence", (F.col("doc_id") % 11 == 0).alias("priced"), (F.col("doc_id") % 40).alias("horizon_days"))), "score")


register(
    "sg13_headline_vote",
    _headlines,
    f"""WITH {NEWS}, x AS (SELECT symbol, unnest([published_at::DATE, published_at::DATE + 1]) AS day, stance * confidence AS s FROM news WHERE stance IS NOT NULL AND doc_id % 11 <> 0 AND abs(stance * confidence) >= 0.25 AND doc_id % 40 <= 30)
SELECT symbol, day, count(*) AS n, CASE WHEN avg(s) >= 0 THEN 'long' ELSE 'avoid' END AS direction, round(least(1, abs(avg(s))), 6) AS score FROM x GROUP BY 1, 2 HAVING count(*) >= 2""",
)


def _views(spark, d):
    v = _dossiers(spark, d).select("symbol", "d", "stance", F.coalesce("quality", F.lit(0.3)).alias("conviction"))
    return rounded(evi.standing_views(_decisions(spark, d).withColumnRenamed("as_of", "d"), v).select("symbol", F.col("d").alias("as_of"), "made", "stance", "conviction"), "conviction")


register(
    "sg14_standing_views",
    _views,
    f"""WITH {DOS}, x AS (SELECT dec.*, dos.d AS made, stance, CASE WHEN q > -99 THEN q ELSE 0.3 END AS conviction FROM dec ASOF JOIN dos ON dec.symbol = dos.symbol AND dec.as_of >= dos.d)
SELECT symbol, as_of, made, stance, round(conviction, 6) AS conviction FROM x WHERE datediff('day', made, as_of) < 3 AND stance <> 'neutral' AND conviction >= 0.3""",
)
NODES = ["momentum", "reversal", "gap", "vol_contraction", "sector_rotation", "news_sentiment"]


def _states(spark, d):
    bars = fx.bars(spark, d)
    grid = bars.where(F.col("symbol") != fx.BENCHMARK).select(F.col("d").alias("as_of"), "symbol", "volume")
    said = grid.where("volume % 2 = 0").select("as_of", "symbol", F.lit("news_sentiment").alias("node_id"), F.lit("verified_neutral").alias("state"))
    off = grid.where("volume % 7 = 0").select("as_of", "symbol", F.lit("momentum").alias("node_id"), F.lit("human_disabled").alias("state"))
    bad = grid.where("volume % 5 = 0").select("as_of", "symbol", F.lit("gap").alias("node_id"), F.lit("blocked").alias("state"))
    return evi.node_states(grid, NODES, signals.price_signals(bars), said.unionByName(off).unionByName(bad))


register(
    "sg17_node_states",
    _states,
    f"""WITH {SIGNALS}, g AS (SELECT d AS as_of, symbol, volume, unnest({NODES}) AS node_id FROM bars WHERE symbol <> 'ALL'), h AS (SELECT DISTINCT d AS as_of, symbol, node_id, 1 AS s FROM raw)
SELECT as_of, symbol, node_id, CASE WHEN node_id = 'momentum' AND volume % 7 = 0 THEN 'human_disabled' WHEN node_id = 'gap' AND volume % 5 = 0 THEN 'blocked' WHEN s = 1 THEN 'running' WHEN node_id = 'news_sentiment' AND volume % 2 = 0 THEN 'verified_neutral' ELSE 'unavailable' END AS state FROM g LEFT JOIN h USING (as_of, symbol, node_id)""",
)


def _graph_sql() -> str:
    """The same graph, unrolled as SQL."""
    def node(n: str) -> str:
        return f"coalesce(avg(CASE WHEN node_id = '{n}' THEN (CASE WHEN direction = 'long' THEN 1 ELSE -1 END) * abs(score) * confidence END), 0)"

    inputs = [n for kind in evi.GRAPH_INPUTS.values() for n in kind if n != "macro_regime"]
    act = {n: f"tanh(b_{n})" for n in evi.GRAPH_INPUTS["tanh"]} | {n: f"(2 / (1 + exp(-greatest(-30, least(30, b_{n})))) - 1)" for n in evi.GRAPH_INPUTS["gate"]}
    inner = {n: " + ".join(f"{act[s]} * {w}" for s in ss) for n, (ss, w) in evi.GRAPH_INNER.items()}
    return f"""gb AS (SELECT d AS as_of, symbol, {', '.join(f'{node(n)} AS b_{n}' for n in inputs)} FROM raw GROUP BY 1, 2),
gc AS (SELECT gb.*, CASE regime WHEN 'risk_on' THEN 1.0 WHEN 'neutral' THEN 0.3 WHEN 'risk_off' THEN -0.5 WHEN 'stress' THEN -1.0 ELSE 0.0 END::DOUBLE AS b_macro_regime FROM gb LEFT JOIN rg ON rg.d = gb.as_of),
gz AS (SELECT as_of, symbol, {', '.join(f'{v} AS {n}' for n, v in inner.items())} FROM gc),
ga AS (SELECT as_of, symbol, {', '.join(f'CASE WHEN {n} >= 0 THEN {n} ELSE 0.05 * {n} END AS {n}' for n in inner)} FROM gz)
SELECT as_of, symbol, {', '.join(f"round({' + '.join(f'{s} * {w}' for s in ss)}, 6) AS {n}" for n, (ss, w) in evi.GRAPH_OUTPUTS.items())} FROM ga"""


register(
    "e9_graph_score",
    lambda spark, d: rounded(evi.graph_score(evi.graph_bases(signals.price_signals(fx.bars(spark, d)), _regimes(spark, d))), "output_5d", "output_21d"),
    f"WITH {SIGNALS}, {BR}, {REGIME}, {_graph_sql()}",
)
register(
    "e6_mandate",
    lambda spark, d: rounded(fx.trades(spark, d).select("id", evi.mandate_contribution(F.when(F.col("id") % 3 == 0, "favor").when(F.col("id") % 3 == 1, "avoid"), F.when(F.col("id") % 5 == 0, "avoid"), F.col("score"), F.col("ret") * 8 - 0.2, F.col("score") + 0.3, F.col("ret")).alias("contribution")).withColumn("contribution", F.col("contribution") + 1e-10), "contribution"),
    f"""WITH {T} SELECT id, round(CASE WHEN abs(ret * 8 - 0.2) >= 0.1 AND score + 0.3 >= 0.5 AND ret > 0 THEN CASE WHEN id % 5 = 0 THEN -1 WHEN id % 3 = 0 THEN 1 WHEN id % 3 = 1 THEN -1 ELSE 0 END * score * 0.15 ELSE 0 END + 1e-10, 6) AS contribution FROM trades""",
)
register(
    "e10_blend",
    lambda spark, d: rounded(fx.trades(spark, d).select("id", evi.blend(F.col("score"), F.when(F.col("id") % 4 > 0, F.col("ret") * 5), F.col("id") % 10 / 10, F.col("id") % 3 > 0, F.lit(0.25)).alias("blended")).withColumn("blended", F.col("blended") + 1e-9), "blended"),
    f"""WITH {T}, x AS (SELECT id, score, CASE WHEN id % 4 > 0 THEN ret * 5 END AS l, CASE WHEN id % 3 > 0 AND id % 10 > 0 AND id % 4 > 0 THEN least(greatest(least(id % 10 / 10, 0.4), 0.05), 0.25) ELSE 0 END AS b FROM trades)
SELECT id, round(score * (1 - b) + coalesce(l, 0) * b + 1e-9, 6) AS blended FROM x""",
)


def _candidates(spark, d):
    t = fx.trades(spark, d)
    fams = F.when(F.col("id") % 3 > 0, F.array(F.lit("price"), F.lit("context"), F.lit("quality"))).otherwise(F.array(F.lit("price"), F.lit("context")))
    rows = t.select("id", "symbol", F.col("score").alias("final"), (F.col("score") * 0.9).alias("production"), F.col("ret").alias("net"), (F.col("id") % 8 > 0).alias("passes"), (F.col("source") == "P").alias("etf"), (F.col("id") % 5 > 1).alias("ready"), fams.alias("families"))
    return evi.select_candidates(rows).select("id", "entry_mode", "size")


register(
    "e7_candidates",
    _candidates,
    f"""WITH {T}, x AS (SELECT id, score, ret, source <> 'P' AND id % 5 <= 1 AS probe FROM trades WHERE score >= 0.15 AND id % 8 > 0)
SELECT id, CASE WHEN probe THEN 'probe' ELSE 'normal' END AS entry_mode, CASE WHEN probe THEN 0.25 ELSE 1.0 END::DOUBLE AS size FROM x WHERE NOT probe OR (score * 0.9 >= 0.25 AND id % 3 > 0 AND ret > 0)""",
)


def _reliability(spark, d):
    e = _evidence(spark, d)
    cells = stats.multipliers(stats.node_scorecard(e, "node", "regime")).where("n >= 30 and regime <> '1-URGENT'")
    overall = stats.multipliers(stats.node_scorecard(e, "node")).where("node <> 'F'")
    return rounded(evi.reliability(e.select("node", "regime").distinct(), cells, overall), "multiplier")


MULT = f"round(greatest(least(CASE WHEN n < 50 THEN 1 ELSE least(greatest(1 + 2 * information_ratio * n / (n + {stats.SHRINK_N}), 0.25), 1.5) END, 1.5), 0.5), 6)"
register(
    "e8_reliability",
    _reliability,
    f"""WITH {EV}, c AS ({CARD.format(by='node, regime')}), o AS ({CARD.format(by='node')}), a AS (SELECT node, regime, {MULT} AS m FROM c WHERE n >= 30 AND regime <> '1-URGENT'), b AS (SELECT node, {MULT} AS m FROM o WHERE node <> 'F')
SELECT DISTINCT c.node, c.regime, coalesce(a.m, b.m, 1) AS multiplier FROM c LEFT JOIN a ON a.node = c.node AND a.regime = c.regime LEFT JOIN b ON b.node = c.node""",
)


def _ranked(spark, d):
    f = fx.fills(spark, d).groupBy(F.trunc("d", "year").alias("cycle"), F.concat_ws("/", "symbol", (F.col("seq") % 4).cast("string")).alias("symbol")).agg(F.sum("qty").alias("q"), F.count(F.lit(1)).alias("n"))
    return f.select("cycle", "symbol", (F.col("q") % 101).alias("score"), (F.col("q") % 13).alias("quality"), (F.col("q") % 17).alias("catalyst"), (F.col("n") % 5).alias("unavailable"), F.col("q").alias("dollar_volume"))


def _sleeve_sql() -> str:
    ctes, before = [], "rk"
    out = [f"{FILLS}, rk AS (SELECT *, NULL::VARCHAR AS sleeve, NULL::BIGINT AS place, q % 101 AS score, q % 13 AS quality, q % 17 AS catalyst, n % 5 AS unavailable FROM (SELECT date_trunc('year', d)::DATE AS cycle, symbol || '/' || (seq % 4)::VARCHAR AS symbol, sum(qty) AS q, count(*) AS n FROM fills GROUP BY 1, 2))"]
    for i, (name, most, by) in enumerate((("combined", 13, "score"), ("quality", 4, "quality"), ("catalyst", 4, "catalyst"), ("exploration", 4, "unavailable"), ("combined_fill", 25, "score"))):
        ctes.append(f"""s{i} AS (SELECT * REPLACE (CASE WHEN f THEN '{name}' ELSE sleeve END AS sleeve, CASE WHEN f THEN t + k ELSE place END AS place) FROM (SELECT *, sleeve IS NULL AND k <= {most} AND t + k <= 25 AS f FROM
  (SELECT * EXCLUDE (k, t, f), row_number() OVER (PARTITION BY cycle, sleeve IS NULL ORDER BY {by} DESC, q DESC, symbol) AS k, count(sleeve) OVER (PARTITION BY cycle) AS t FROM (SELECT *, 0 AS k, 0 AS t, true AS f FROM {before}))))""" if i == 0 else
            f"""s{i} AS (SELECT * REPLACE (CASE WHEN f2 THEN '{name}' ELSE sleeve END AS sleeve, CASE WHEN f2 THEN t2 + k2 ELSE place END AS place) FROM (SELECT *, sleeve IS NULL AND k2 <= {most} AND t2 + k2 <= 25 AS f2 FROM
  (SELECT * EXCLUDE (k2, t2, f2), row_number() OVER (PARTITION BY cycle, sleeve IS NULL ORDER BY {by} DESC, q DESC, symbol) AS k2, count(sleeve) OVER (PARTITION BY cycle) AS t2 FROM (SELECT *{', 0 AS k2, 0 AS t2, true AS f2' if i == 1 else ''} FROM {before}))))""")
        before = f"s{i}"
    return "WITH " + ", ".join(out + ctes) + " SELECT cycle, symbol, sleeve, place FROM s4 WHERE sleeve IS NOT NULL"


register("e13_sleeves", lambda spark, d: evi.sleeves(_ranked(spark, d)), _sleeve_sql())


def _probe(spark, d):
    """Of each cycle (a day) the best candidate that isn't held: edge, probability and width."""
    from pyspark.sql import Window

    t = fx.trades(spark, d)
    held = fx.fills(spark, d).where("side = 'sell'").select("symbol", F.col("d").alias("cycle"))
    x = t.select(F.col("entry_date").alias("cycle"), "symbol", "id", (F.col("ret") / 4).alias("edge"), (0.5 + F.col("ret")).alias("p"), F.col("score").alias("width"))
    x = x.where("edge >= 0.0075 and p >= 0.57 and width <= 0.15").join(held, ["symbol", "cycle"], "left_anti")
    return x.withColumn("k", F.row_number().over(Window.partitionBy("cycle").orderBy(F.desc("edge"), "id"))).where("k = 1").select("cycle", "symbol", "id", F.round("edge", 6).alias("edge"))


register(
    "e14_probe",
    _probe,
    f"""WITH {T}, {FILLS}, x AS (SELECT entry_date AS cycle, symbol, id, ret / 4 AS edge FROM trades t WHERE ret / 4 >= 0.0075 AND 0.5 + ret >= 0.57 AND score <= 0.15 AND NOT EXISTS (SELECT 1 FROM fills f WHERE f.side = 'sell' AND f.symbol = t.symbol AND f.d = t.entry_date))
SELECT cycle, symbol, id, round(edge, 6) AS edge FROM (SELECT *, row_number() OVER (PARTITION BY cycle ORDER BY edge DESC, id) AS k FROM x) WHERE k = 1""",
)
