"""Queries of trade, curve and evidence statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketloom.functions.columns import rounded
from marketloom.operators import stats
from marketloom.registry import register
from marketloom.sources import fixtures as fx

B = fx.bars_sql()
T = fx.TRADES_SQL


def _stats_sql(by: str, source: str) -> str:
    return f"""SELECT {by}, count(*) AS n, round(avg((ret > 0)::INT), 6) AS win_rate, round(avg(ret) FILTER (WHERE ret > 0), 6) AS avg_win,
  round(avg(ret) FILTER (WHERE ret <= 0), 6) AS avg_loss, round(CASE WHEN sum(CASE WHEN ret <= 0 THEN -ret ELSE 0 END) > 0 THEN sum(CASE WHEN ret > 0 THEN ret ELSE 0 END) / sum(CASE WHEN ret <= 0 THEN -ret ELSE 0 END) END, 6) AS profit_factor,
  round(avg(horizon_days), 6) AS holding_days FROM {source} GROUP BY {by}"""


S = ("win_rate", "avg_win", "avg_loss", "profit_factor", "holding_days")
register("a4_trade_stats_by_regime", lambda spark, d: rounded(stats.trade_statistics(fx.trades(spark, d), "regime"), *S), f"WITH {T} {_stats_sql('regime', 'trades')}")
register(
    "a4_trade_stats_by_node",
    lambda spark, d: rounded(stats.trade_statistics(stats.by_node(fx.trades(spark, d)), "node"), *S),
    f"WITH {T}, x AS (SELECT *, unnest(nodes) AS node FROM trades) {_stats_sql('node', 'x')}",
)


def _evidence(spark, d):
    e = stats.by_node(fx.trades(spark, d))
    return e.withColumn("alpha", F.when(F.col("id") % 2 == 0, 1.0).otherwise(-1.0) * F.abs("score"))


C = ("expectancy", "hit_rate", "avg_win", "avg_loss", "profit_factor", "information_ratio")
CARD = """SELECT {by}, count(*) AS n, avg(a) AS expectancy, avg((a > 0)::INT) AS hit_rate, avg(a) FILTER (WHERE a > 0) AS avg_win, avg(a) FILTER (WHERE a <= 0) AS avg_loss,
  CASE WHEN sum(CASE WHEN a <= 0 THEN -a ELSE 0 END) > 0 THEN sum(CASE WHEN a > 0 THEN a ELSE 0 END) / sum(CASE WHEN a <= 0 THEN -a ELSE 0 END) END AS profit_factor,
  CASE WHEN stddev_samp(a) > 0 THEN avg(a) / stddev_samp(a) ELSE 0 END AS information_ratio FROM ev GROUP BY {by}"""
EV = f"{T}, ev AS (SELECT *, ret * (CASE WHEN id % 2 = 0 THEN 1 ELSE -1 END) * abs(score) AS a FROM (SELECT *, unnest(nodes) AS node FROM trades))"


def _r(cols) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


register("a6_node_scorecard", lambda spark, d: rounded(stats.node_scorecard(_evidence(spark, d), "node", "regime"), *C), f"WITH {EV}, c AS ({CARD.format(by='node, regime')}) SELECT node, regime, n, {_r(C)} FROM c")
register(
    "a7_multipliers",
    lambda spark, d: rounded(stats.multipliers(stats.node_scorecard(_evidence(spark, d), "node")), "information_ratio", "multiplier").select("node", "n", "information_ratio", "multiplier"),
    f"WITH {EV}, c AS ({CARD.format(by='node')}) SELECT node, n, round(information_ratio, 6) AS information_ratio, round(CASE WHEN n < 50 THEN 1 ELSE least(greatest(1 + 2 * information_ratio * n / (n + {stats.SHRINK_N}), 0.25), 1.5) END, 6) AS multiplier FROM c",
)
M = ("total_return", "cagr", "volatility", "sharpe", "sortino", "max_drawdown", "calmar")
register(
    "a3_equity_metrics",
    lambda spark, d: rounded(stats.equity_metrics(fx.equity_curve(spark, d)), *M),
    f"""WITH {fx.EQUITY_SQL}, i AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY d) AS i, count(*) OVER (PARTITION BY source) AS n FROM equity),
s AS (SELECT *, unnest(['overall', CASE WHEN i <= floor(n * 0.7) THEN 'in_sample' ELSE 'out_of_sample' END]) AS segment FROM i),
r AS (SELECT *, equity / lag(equity) OVER w - 1 AS r, 1 - equity / max(equity) OVER w AS dd FROM s WINDOW w AS (PARTITION BY source, segment ORDER BY d)),
g AS (SELECT source, segment, count(*) AS sessions, arg_max(equity, d) / arg_min(equity, d) - 1 AS total_return, avg(r) AS mean, stddev_samp(r) AS sd, sqrt(avg(r * r) FILTER (WHERE r < 0)) AS down, max(dd) AS max_drawdown FROM r GROUP BY 1, 2),
h AS (SELECT *, CASE WHEN total_return > -1 THEN pow(1 + total_return, 252.0 / (sessions - 1)) - 1 END AS cagr FROM g WHERE sessions >= 3)
SELECT source, segment, sessions - 1 AS sessions, round(total_return, 6) AS total_return, round(cagr, 6) AS cagr, round(sd * sqrt(252), 6) AS volatility, round(CASE WHEN sd > 0 THEN mean / sd * sqrt(252) ELSE 0 END, 6) AS sharpe,
  round(CASE WHEN down > 0 THEN mean / down * sqrt(252) END, 6) AS sortino, round(max_drawdown, 6) AS max_drawdown, round(CASE WHEN max_drawdown > 0 THEN cagr / max_drawdown END, 6) AS calmar FROM h""",
)
register(
    "a5_buy_and_hold",
    lambda spark, d: rounded(stats.buy_and_hold(fx.bars(spark, d)), "net_return"),
    f"WITH {B} SELECT symbol, count(*) AS sessions, round(arg_max(close, d) / arg_min(close, d) - 1 - 0.0016, 6) AS net_return FROM bars GROUP BY 1",
)
BUCKET = "CASE WHEN abs(score) < 0.15 THEN 's0' WHEN abs(score) < 0.3 THEN 's1' WHEN abs(score) < 0.5 THEN 's2' ELSE 's3' END"
HB = "CASE WHEN horizon_days <= 10 THEN 'short' WHEN horizon_days <= 30 THEN 'medium' ELSE 'long' END"


#: Trades as records keep them: kind of asset, version of the evidence, whether they qualify.
KEPT = "nodes[1] AS evidence_version, CASE nodes[0] WHEN 'R' THEN 'option' ELSE 'stock' END AS asset_type, horizon_days >= 2 AS qualified"
KEPT_SQL = KEPT.replace("[1]", "[2]").replace("[0]", "[1]")


def _analogs(spark, d):
    t = fx.trades(spark, d).selectExpr("score", "regime", "horizon_days", "entry_date", "exit_date", "ret", "source", *KEPT.split(", "))
    q = t.select(stats.score_bucket(F.col("score")).alias("bucket"), "regime", stats.horizon_bucket(F.col("horizon_days")).alias("horizon"), F.col("asset_type").alias("asset"), F.col("evidence_version").alias("evidence"), F.trunc("entry_date", "month").alias("as_of")).distinct()
    q = q.withColumn("expected", F.dayofyear("as_of") / 5000 - 0.02)
    return rounded(stats.analog_intervals(t, q, sources=("F", "O")).withColumn("expected", F.col("expected") + 1e-9), "expected", "ci_low", "ci_high", "p_positive", digits=6)


register(
    "a9_analog_intervals",
    _analogs,
    f"""WITH {T}, t AS (SELECT {BUCKET} AS bucket, regime, {HB} AS horizon, exit_date, ret, source, date_trunc('month', entry_date)::DATE AS as_of, {KEPT_SQL} FROM trades),
q AS (SELECT *, dayofyear(as_of) / 5000 - 0.02 AS e FROM (SELECT DISTINCT bucket, regime, horizon, asset_type AS asset, evidence_version AS evidence, as_of FROM t)),
c AS (SELECT q.bucket, q.regime, q.horizon, q.asset, q.evidence, q.as_of, e, list_sort(list(ret) FILTER (WHERE ret IS NOT NULL)) AS r, count(ret) AS n, avg(ret) AS m, avg((ret > 0)::INT) AS p FROM q
  LEFT JOIN t ON q.bucket = t.bucket AND q.regime = t.regime AND q.horizon = t.horizon AND q.asset = t.asset_type AND q.evidence = t.evidence_version AND t.qualified AND t.source IN ('F', 'O') AND t.exit_date < q.as_of GROUP BY ALL),
z AS (SELECT *, e * 0.5 AS h, greatest(0.02, abs(e) * 3) AS g, n >= 25 AS k FROM c)
SELECT bucket, regime, horizon, asset, evidence, as_of, n, round(CASE WHEN k THEN 0.5 * e + 0.5 * m ELSE h END + 1e-9, 6) AS expected, round(CASE WHEN k THEN r[floor(n * 0.1)::INT + 1] ELSE greatest(-0.95, h - 2 * g) END, 6) AS ci_low, round(CASE WHEN k THEN r[floor(n * 0.9)::INT + 1] ELSE h + 2 * g END, 6) AS ci_high,
  round(CASE WHEN k THEN p ELSE 0.5 * (1 + sign(h) * (1 - (1 / (1 + 0.3275911 * abs(h / g) / sqrt(2))) * (0.254829592 + (1 / (1 + 0.3275911 * abs(h / g) / sqrt(2))) * (-0.284496736 + (1 / (1 + 0.3275911 * abs(h / g) / sqrt(2))) * (1.421413741 + (1 / (1 + 0.3275911 * abs(h / g) / sqrt(2))) * (-1.453152027 + (1 / (1 + 0.3275911 * abs(h / g) / sqrt(2))) * 1.061405429)))) * exp(-(h / g) * (h / g) / 2))) END, 6) AS p_positive,
  CASE WHEN NOT k THEN 'low' WHEN n >= 150 THEN 'high' ELSE 'medium' END AS confidence FROM z""",
)
CATALYST = "CASE doc_id % 4 WHEN 0 THEN 'earnings' WHEN 1 THEN 'product' WHEN 2 THEN 'legal' ELSE 'other' END"


def _decayed(spark, d):
    x = rounded(stats.decayed_news(fx.news(spark, d).withColumn("catalyst", F.expr(CATALYST)), 7), "score", "weight")
    return x.withColumn("catalysts", F.array_join(F.transform(F.map_entries("catalysts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ","))


register(
    "a15_decayed_news",
    _decayed,
    f"""WITH {fx.NEWS_SQL}, e AS (SELECT *, {CATALYST} AS catalyst, unnest(generate_series(published_at::DATE, published_at::DATE + INTERVAL 6 DAY, INTERVAL 1 DAY))::DATE AS d FROM news WHERE stance IS NOT NULL),
x AS (SELECT *, exp(-(epoch_us((d + 1)::TIMESTAMP) - epoch_us(published_at)) / 3.6e9 / 48) * confidence * coalesce(reliability, 0.5) AS w FROM e), k AS (SELECT symbol, d, catalyst, count(*) AS n FROM x GROUP BY ALL),
s AS (SELECT symbol, d, string_agg(catalyst || '=' || n, ',' ORDER BY catalyst) AS catalysts FROM k GROUP BY ALL)
SELECT x.symbol, x.d, count(*) AS n, round(sum(stance * w) / sum(w), 6) AS score, round(sum(w), 6) AS weight, any_value(s.catalysts) AS catalysts FROM x JOIN s ON x.symbol = s.symbol AND x.d = s.d GROUP BY 1, 2""",
)
register(
    "a17_latest_facts",
    lambda spark, d: rounded(stats.deterministic_facts(fx.filing_facts(spark, d)), "growth").withColumns({c: F.round(c, 2) for c in ("latest", "before")}),
    f"""WITH {fx.FACTS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY cik, tag ORDER BY filed DESC, period_end DESC) AS k FROM facts),
g AS (SELECT cik, tag, max(CASE WHEN k = 1 THEN value END) AS latest, max(CASE WHEN k = 2 THEN value END) AS before, max(filed)::DATE AS filed FROM k WHERE k <= 2 GROUP BY 1, 2)
SELECT cik, tag, round(latest, 2) AS latest, round(before, 2) AS before, filed, round(latest / before - 1, 6) AS growth FROM g""",
)


def _ledger(spark, d):
    c = fx.table(spark, d, "conversations")
    month = F.concat(F.lit("m"), F.lpad((F.col("conv_id") % 12).cast("string"), 2, "0"))
    return c.select(month.alias("month"), F.col("role").alias("purpose"), (F.ceil(F.char_length("text") / 4) * 2).alias("cost"), ((F.col("conv_id") + F.col("turn")) % 4 == 0).alias("cache_hit"))


register(
    "a19_spend",
    lambda spark, d: stats.spend(_ledger(spark, d), 9_000.0, 2_500.0),
    """WITH l AS (SELECT 'm' || lpad((conv_id % 12)::VARCHAR, 2, '0') AS month, role AS purpose, (conv_id + turn) % 4 = 0 AS hit, ceil(length(text) / 4.0) * 2 AS cost FROM conversations),
g AS (SELECT month, purpose, grouping_id(month, purpose) AS level, count(*) AS calls, sum(hit::INT)::BIGINT AS cache_hits, sum(cost)::BIGINT AS cost FROM l GROUP BY ROLLUP (month, purpose)),
m AS (SELECT *, max(cost) FILTER (WHERE level = 1) OVER (PARTITION BY month) AS mc, CASE level WHEN 0 THEN 2500.0 WHEN 1 THEN 9000.0 END::DOUBLE AS cap FROM g)
SELECT month, purpose, calls, cache_hits, cost, CASE WHEN cap IS NOT NULL THEN greatest(cap - cost, 0) END AS remaining, CASE WHEN cap IS NOT NULL THEN cost < cap AND mc < 9000 END AS allowed FROM m""",
)


def _digest(spark, d):
    """Orders of each local day by status, and the most frequent rejected symbol."""
    o = fx.order_events(spark, d).withColumn("day", F.to_date("ts"))
    g = o.groupBy("day").agg(*(F.count(F.when(F.col("status") == s, 1)).alias(s) for s in ("filled", "placed", "cancelled", "rejected")))
    top = o.where("status = 'rejected'").groupBy("day", "symbol").agg(F.count(F.lit(1)).alias("k"))
    top = top.withColumn("r", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("k"), "symbol"))).where("r = 1").select("day", F.col("symbol").alias("top_rejected"))
    return g.join(top, "day", "left")


register(
    "a20_day_digest",
    _digest,
    f"""WITH {fx.ORDER_EVENTS_SQL}, g AS (SELECT ts::DATE AS day, {', '.join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in ("filled", "placed", "cancelled", "rejected"))} FROM oe GROUP BY 1),
t AS (SELECT ts::DATE AS day, symbol, count(*) AS k FROM oe WHERE status = 'rejected' GROUP BY 1, 2), u AS (SELECT day, symbol AS top_rejected, row_number() OVER (PARTITION BY day ORDER BY k DESC, symbol) AS r FROM t)
SELECT g.*, top_rejected FROM g LEFT JOIN u ON g.day = u.day AND r = 1""",
)
register(
    "a24_distinct_counts",
    lambda spark, d: fx.trades(spark, d).groupBy("source").agg(F.count_distinct("symbol").alias("symbols"), F.count_distinct("exit_date").alias("sessions"), F.count_distinct("regime").alias("regimes")),
    f"WITH {T} SELECT source, count(DISTINCT symbol) AS symbols, count(DISTINCT exit_date) AS sessions, count(DISTINCT regime) AS regimes FROM trades GROUP BY 1",
)


_TAGS = [tag for tags in stats.ALIASES.values() for tag in tags]
_RATIOS = ["revenue_growth", "dilution_rate", "equity_to_assets", "gross_margin", "operating_margin", "net_margin", "current_ratio", "accrual_ratio", "earnings_quality"]
_SUMS = [*stats.ALIASES, "free_cash_flow", "total_debt"]


def _tagged(spark, d):
    """Facts of customers: an order's tag by its key, its value gained or lost, by year."""
    o = fx.table(spark, d, "orders")
    tag = F.array(*map(F.lit, _TAGS))[(F.col("o_orderkey") % len(_TAGS)).cast("int")]
    value = F.when(F.col("o_orderstatus") == "P", 0.0).otherwise(F.when(F.col("o_orderkey") % 5 == 0, -1).otherwise(1) * F.col("o_totalprice"))
    end = F.make_date(F.year("o_orderdate"), F.lit(12), F.lit(31))
    g = o.groupBy((F.col("o_custkey") % 400).alias("cik"), tag.alias("tag"), end.alias("period_end")).agg(F.sum(value).alias("value"))
    return g.select("*", F.date_add("period_end", F.when(F.length("tag") % 2 == 0, 45).otherwise(80)).alias("filed"), F.when(F.year("period_end") % 4 == 0, "10-Q").otherwise("10-K").alias("form"))


def _latest_sql(tag: str) -> str:
    return f"max_by(value, (filed, period_end)) FILTER (WHERE tag = '{tag}')"


def _first_sql(name: str) -> str:
    return f"coalesce({', '.join(_latest_sql(t) for t in stats.ALIASES[name])})"


register(
    "a17_issuer_facts",
    lambda spark, d: rounded(rounded(stats.issuer_facts(_tagged(spark, d)), *_SUMS, digits=2), *_RATIOS),
    f"""WITH t AS (SELECT o_custkey % 400 AS cik, [{', '.join(repr(t) for t in _TAGS)}][o_orderkey % {len(_TAGS)} + 1] AS tag, make_date(year(o_orderdate), 12, 31) AS period_end,
  CASE WHEN o_orderstatus = 'P' THEN 0 ELSE CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE 1 END * o_totalprice END AS v FROM orders),
f AS (SELECT cik, tag, period_end, sum(v) AS value, period_end + CASE WHEN length(tag) % 2 = 0 THEN 45 ELSE 80 END AS filed, CASE WHEN year(period_end) % 4 = 0 THEN '10-Q' ELSE '10-K' END AS form FROM t GROUP BY 1, 2, 3),
l AS (SELECT cik, {', '.join(f'{_first_sql(n)} AS {n}' for n in stats.ALIASES)} FROM f GROUP BY 1),
y AS (SELECT cik, period_end, {_first_sql('revenue')} AS r, {_first_sql('shares')} AS s FROM f WHERE form = '10-K' GROUP BY 1, 2),
z AS (SELECT cik, list(r ORDER BY period_end DESC) FILTER (WHERE r IS NOT NULL) AS rs, list(s ORDER BY period_end DESC) FILTER (WHERE s IS NOT NULL) AS ss FROM y GROUP BY 1),
a AS (SELECT l.*, rs[1] / nullif(rs[2], 0) - 1 AS revenue_growth, ss[1] / nullif(ss[2], 0) - 1 AS dilution_rate, operating_cash_flow - abs(capex) AS free_cash_flow, CASE WHEN debt_current IS NOT NULL OR debt_noncurrent IS NOT NULL THEN coalesce(debt_current, 0) + coalesce(debt_noncurrent, 0) END AS total_debt,
  equity / nullif(assets, 0) AS equity_to_assets, gross_profit / nullif(revenue, 0) AS gross_margin, operating_income / nullif(revenue, 0) AS operating_margin, net_income / nullif(revenue, 0) AS net_margin, current_assets / nullif(current_liabilities, 0) AS current_ratio,
  (net_income - operating_cash_flow) / nullif(assets, 0) AS accrual_ratio, operating_cash_flow / nullif(abs(net_income), 0) AS earnings_quality FROM l LEFT JOIN z USING (cik))
SELECT cik, {', '.join(f'round({c}, 2) AS {c}' for c in _SUMS)}, {', '.join(f'round({c}, 6) AS {c}' for c in _RATIOS)}, ({' + '.join(f'({c} IS NOT NULL)::INT' for c in [*_SUMS, *_RATIOS])})::INT AS available_fields FROM a""",
)
