"""Queries of intervals, projections, dossiers, status, nodes, sources and discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.functions.columns import rounded
from marketloom.operators import rollups as roll
from marketloom.operators import stats
from marketloom.plans.memos import CHECKED, _checked
from marketloom.registry import register
from marketloom.sources import fixtures as fx

T, ST, OE, NEWS = fx.TRADES_SQL, fx.STATEMENTS_SQL, fx.ORDER_EVENTS_SQL, fx.NEWS_SQL
BRAND = fx.bars_sql("p_brand", benchmark=False)
PRIORS = {"A": 0.30, "N": 0.25, "R": 0.20, "O": 0.15, "F": 0.10}


def _sourced(spark, d):
    return fx.trades(spark, d).withColumn("source", F.when(F.col("source") == "F", "live").when(F.col("source") == "O", "paper").otherwise("research"))


_W = " + ".join(f"(u >= {s!r})::INT" for s in roll.poisson_steps())
BOOT = f"""{T}, ts AS (SELECT *, CASE source WHEN 'F' THEN 'live' WHEN 'O' THEN 'paper' ELSE 'research' END AS src FROM trades),
bl AS (SELECT src, ('0x' || substr(md5(id::VARCHAR), 1, 3))::BIGINT AS block, count(*) AS n, sum(ret) AS s FROM ts GROUP BY 1, 2),
dr AS (SELECT draw, block, {_W} AS w FROM (SELECT draw, block, ('0x' || substr(md5(draw || ':' || block), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM range(1, 501) r(draw), range(4096) b(block))),
mn AS (SELECT src, draw, sum(w * s) / sum(w * n) AS m FROM bl JOIN dr USING (block) WHERE w > 0 GROUP BY 1, 2),
rk AS (SELECT src, m, row_number() OVER (PARTITION BY src ORDER BY m) - 1 AS k, count(*) OVER (PARTITION BY src) AS c FROM mn),
ci AS (SELECT src, max(m) FILTER (WHERE k = floor(c * 0.1)) AS lo, max(m) FILTER (WHERE k = floor(c * 0.9)) AS hi FROM rk GROUP BY 1),
ag AS (SELECT src, count(*) AS n, avg(ret) AS mean, avg(greatest(1, horizon_days)) AS h, avg((ret > 0)::INT) AS p FROM ts GROUP BY 1)"""
register(
    "a10_bootstrap_mean",
    lambda spark, d: rounded(roll.bootstrap_mean(_sourced(spark, d), "source", "ret", "id"), "mean", "ci_low", "ci_high"),
    f"WITH {BOOT} SELECT src AS source, n, round(mean, 6) AS mean, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high FROM ag JOIN ci USING (src)",
)
register(
    "a11_portfolio_projection",
    lambda spark, d: rounded(roll.portfolio_projection(_sourced(spark, d)), "apr", "apr_low", "apr_high", "prob_positive", digits=5),
    f"""WITH {BOOT} SELECT src AS source, n, round(greatest(1 + mean, 1e-4) ** (252 / h) - 1, 5) AS apr, round(greatest(-0.99, greatest(1 + lo, 1e-4) ** (252 / h) - 1), 5) AS apr_low, round(greatest(1 + hi, 1e-4) ** (252 / h) - 1, 5) AS apr_high,
  round(p, 5) AS prob_positive, CASE WHEN src = 'live' AND n >= 50 THEN 'high' WHEN src IN ('live', 'paper') AND n >= 30 THEN 'medium' ELSE 'low' END AS confidence FROM ag JOIN ci USING (src)""",
)


def _brand(cik: str):
    return F.concat(F.lit("Brand#"), (1 + F.col(cik) % 25).cast("string"))


def _dossiers(spark, d):
    facts = fx.statements(spark, d).where("value <> 0").groupBy(_brand("cik").alias("symbol")).agg(F.count_distinct("tag").alias("available_fields"))
    m = _checked(spark, d).withColumn("kind", F.when(F.col("doc_id") % 2 == 0, "fundamental").otherwise("catalyst"))
    return roll.dossiers(facts, m, "doc_id")


register(
    "a18_dossiers",
    _dossiers,
    f"""WITH {ST}, {CHECKED}, f AS (SELECT 'Brand#' || (1 + cik % 25)::VARCHAR AS symbol, count(DISTINCT tag) AS available_fields FROM st WHERE value <> 0 GROUP BY 1),
l AS (SELECT symbol, arg_max(stance, doc_id) FILTER (WHERE doc_id % 2 = 0) AS fs, arg_max(citations, doc_id) FILTER (WHERE doc_id % 2 = 0) AS fc, arg_max(stance, doc_id) FILTER (WHERE doc_id % 2 = 1) AS cs, arg_max(citations, doc_id) FILTER (WHERE doc_id % 2 = 1) AS cc FROM checked WHERE errors = '' GROUP BY 1),
n AS (SELECT *, least(1, available_fields / 8) AS q0, CASE WHEN fc IS NOT NULL THEN least(1, CASE fc WHEN '' THEN 0 ELSE len(string_split(fc, ',')) END / 2) END AS q1, CASE WHEN cc IS NOT NULL THEN least(1, CASE cc WHEN '' THEN 0 ELSE len(string_split(cc, ',')) END / 2) END AS q2 FROM f LEFT JOIN l USING (symbol))
SELECT symbol, available_fields, round((q0 + coalesce(q1, 0) + coalesce(q2, 0)) / (1 + (q1 IS NOT NULL)::INT + (q2 IS NOT NULL)::INT), 4)::DOUBLE AS quality, CASE WHEN fs IS NULL AND cs IS NULL THEN 'unsupported' ELSE 'ready' END AS status,
  sha256(concat_ws('|', '{roll.SCHEMA}', symbol, available_fields::VARCHAR, coalesce(fs, '-'), coalesce(fc, '-'), coalesce(cs, '-'), coalesce(cc, '-'))) AS source_hash FROM n""",
)


def _components(spark, d):
    """Reports of an hour: its orders by provider; a value over 400 is severe or unknown."""
    o = fx.order_events(spark, d)
    severity = F.when(F.col("status") == "rejected", F.when(F.col("notional") > 400, "fatal").otherwise("degraded")).when((F.col("status") == "cancelled") & (F.col("notional") > 400), "stale").otherwise("ok")
    return o.select(F.date_trunc("hour", "ts").alias("run"), F.concat_ws("-", "mode", "provider").alias("component"), severity.alias("severity"), F.concat_ws(" ", "side", "symbol").alias("message"))


register(
    "a21_status_rollup",
    lambda spark, d: roll.status_rollup(_components(spark, d)).withColumns({"run": F.unix_seconds("run"), "alerts": F.array_join("alerts", "; ")}),
    f"""WITH {OE}, c AS (SELECT date_trunc('hour', ts) AS run, mode || '-' || provider AS component, side || ' ' || symbol AS message, CASE WHEN status = 'rejected' THEN CASE WHEN notional > 400 THEN 3 ELSE 1 END WHEN status = 'cancelled' AND notional > 400 THEN 2 ELSE 0 END AS rank FROM oe),
w AS (SELECT run, component, max((rank, message)) AS w FROM c GROUP BY 1, 2)
SELECT epoch(run)::BIGINT AS run, ['ok', 'degraded', 'stale', 'error'][max(w[1]) + 1] AS status, count(*) AS n_components, coalesce(string_agg(component || ': ' || w[2], '; ' ORDER BY component) FILTER (WHERE w[1] > 0), '') AS alerts FROM w GROUP BY run""",
)
_PRIOR = "CASE node " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in PRIORS.items()) + " ELSE 0 END"
register(
    "a23_node_summary",
    lambda spark, d: rounded(roll.node_summary(stats.by_node(fx.trades(spark, d)), PRIORS, 0.07).withColumn("expectancy", F.col("expectancy") + 1e-10), "expectancy", "win_rate", "effective_weight"),
    f"""WITH {T}, x AS (SELECT node, id, ret, unnest([false, true]) AS closed, unnest([entry_date, exit_date]) AS tm FROM (SELECT *, unnest(nodes) AS node FROM trades)),
w AS (SELECT node, (date_trunc('week', tm) + INTERVAL 7 DAY)::DATE AS as_of, count(*) FILTER (WHERE closed) AS n, coalesce(sum(ret) FILTER (WHERE closed), 0) AS s, coalesce(sum(ret * ret) FILTER (WHERE closed), 0) AS ss, count(*) FILTER (WHERE closed AND ret > 0) AS wins,
  count(*) FILTER (WHERE NOT closed) AS signals_7d, arg_max(id, (tm, id)) FILTER (WHERE closed AND ret <= -0.07) AS bad FROM x GROUP BY 1, 2),
r AS (SELECT node, as_of, signals_7d, last_value(bad IGNORE NULLS) OVER v AS last_bad, (sum(n) OVER v)::BIGINT AS n, sum(s) OVER v AS s, sum(ss) OVER v AS ss, (sum(wins) OVER v)::BIGINT AS wins FROM w WINDOW v AS (PARTITION BY node ORDER BY as_of ROWS UNBOUNDED PRECEDING)),
q AS (SELECT *, s / n AS mean, CASE WHEN n > 1 THEN sqrt(greatest((ss - s * s / n) / (n - 1), 0)) END AS sd FROM r)
SELECT node, as_of, n AS n_trades, round(CASE WHEN n > 0 THEN mean END + 1e-10, 6) AS expectancy, round(CASE WHEN n > 0 THEN wins / n END, 6) AS win_rate, signals_7d, last_bad,
  round(({_PRIOR}) * CASE WHEN n < 50 THEN 1 ELSE least(greatest(1 + 2 * CASE WHEN sd > 1e-9 THEN mean / sd ELSE 0 END * n / (n + {stats.SHRINK_N}), 0.25), 1.5) END, 6) AS effective_weight FROM q""",
)


def _sources(spark, d):
    n = fx.news(spark, d)
    sections = n.where("source = 'src1'").select("symbol", F.col("doc_id").alias("accession"), F.lit("document").alias("section"), F.col("published_at").alias("filed"), "body")
    heads = n.where("source is null or source <> 'src1'").select("symbol", F.col("doc_id").alias("news_id"), F.col("published_at").alias("published"), "title")
    facts = fx.statements(spark, d).select(_brand("cik").alias("symbol"), F.concat_ws("-", "cik", F.year("period_end")).alias("accession"), "tag", "period_end", "filed", "value")
    return roll.source_catalog(sections, facts, heads, fx.bars(spark, d, "p_brand", False).withColumn("close", F.round("close", 4)), **roll.CATALOG)


register(
    "a25_source_catalog",
    lambda spark, d: _sources(spark, d).withColumn("text", F.md5("text")),
    f"""WITH {NEWS}, {ST}, {BRAND}, a AS (SELECT symbol, 'FACT:' || cik || '-' || year(period_end) || ':' || tag AS source_id, 'sec_fact' AS kind, filed AS tm, period_end || ' ' || printf('%.2f', value) AS text, 200 AS cap FROM (SELECT *, 'Brand#' || (1 + cik % 25)::VARCHAR AS symbol FROM st)
UNION ALL SELECT symbol, 'NEWS:' || doc_id, 'company_news', published_at::DATE, title, 12 FROM news WHERE source IS DISTINCT FROM 'src1'
UNION ALL SELECT symbol, 'SEC:' || doc_id || ':document', 'filing_section', published_at::DATE, substr(body, 1, 12000), 1000000000 FROM news WHERE source = 'src1'
UNION ALL SELECT symbol, 'BAR:' || d, 'bar', d, printf('%.4f', round(close, 4)), 65 FROM bars),
o AS (SELECT symbol, source_id, kind, cap, max((tm, text)) AS l FROM a GROUP BY 1, 2, 3, 4), k AS (SELECT *, row_number() OVER (PARTITION BY symbol, kind ORDER BY l[1] DESC, source_id) AS k FROM o)
SELECT symbol, source_id, kind, l[1]::DATE AS "at", md5(l[2]) AS text FROM k WHERE k <= cap""",
)


def _ranked(spark, d):
    e = stats.by_node(fx.trades(spark, d)).withColumn("alpha", F.when(F.col("id") % 2 == 0, 1.0).otherwise(-1.0) * F.col("score"))
    s = e.groupBy(F.trunc("entry_date", "week").alias("as_of"), "symbol", "node").agg(F.avg("alpha").alias("alpha"))
    m = fx.bars(spark, d, "p_brand", False).groupBy("symbol").agg(F.avg(F.col("close") * F.col("volume")).alias("dollar_volume")).withColumn("name", F.concat(F.lit("Maker "), F.right("symbol", F.lit(1))))
    weeks = s.select("as_of").distinct().withColumn("m", F.month("as_of"))
    mandates = weeks.select(
        "as_of", (F.col("m") / 12).alias("confidence"), F.when(F.col("m") % 2 == 0, F.array(F.lit("MAKER 3"), F.lit("#7"))).otherwise(F.array().cast("array<string>")).alias("favored"),
        F.array(F.lit("brand#1"), F.lit("maker 3")).alias("avoided"), F.create_map(F.lit("Brand#5"), F.lit(0.12)).alias("direct"),
    )
    ranked = roll.discovery_ranking(s, PRIORS, m, mandates)
    return rounded(ranked.withColumns({c: F.col(c) + 1e-10 for c in ("alpha", "score")}), "alpha", "liquidity", "mandate", "score")


register(
    "e12_discovery_ranking",
    _ranked,
    f"""WITH {T}, {BRAND}, s AS (SELECT date_trunc('week', entry_date)::DATE AS as_of, symbol, node, avg(CASE WHEN id % 2 = 0 THEN 1 ELSE -1 END * score) AS alpha FROM (SELECT *, unnest(nodes) AS node FROM trades) GROUP BY 1, 2, 3),
a AS (SELECT as_of, symbol, sum(alpha * ({_PRIOR})) AS alpha FROM s GROUP BY 1, 2), v AS (SELECT symbol, avg(close * volume) AS dv, lower(symbol || ' Maker ' || right(symbol, 1)) AS txt FROM bars GROUP BY 1),
x AS (SELECT as_of, symbol, alpha, least(log10(greatest(1, dv)) / 10, 1) AS liquidity, CASE WHEN symbol = 'Brand#5' THEN 0.12 ELSE month(as_of) / 12 * 0.15 * CASE WHEN month(as_of) % 2 = 0 AND (txt LIKE '%maker 3%' OR txt LIKE '%#7%') THEN 1 WHEN txt LIKE '%brand#1%' OR txt LIKE '%maker 3%' THEN -1 ELSE 0 END END AS mandate FROM a JOIN v USING (symbol)),
y AS (SELECT *, 0.9 * alpha + 0.1 * liquidity + mandate AS score FROM x)
SELECT as_of, symbol, round(alpha + 1e-10, 6) AS alpha, round(liquidity, 6) AS liquidity, round(mandate, 6)::DOUBLE AS mandate, round(score + 1e-10, 6) AS score, row_number() OVER (PARTITION BY as_of ORDER BY score DESC, symbol DESC) AS rank FROM y""",
)
