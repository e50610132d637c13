"""Queries of records, sets, exits and sector assignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.functions.columns import rounded
from marketloom.operators import records as rec
from marketloom.operators import stats
from marketloom.plans.indicators import full, lag
from marketloom.plans.stats import CARD, EV, _evidence
from marketloom.registry import register
from marketloom.sources import fixtures as fx

STOCKS = fx.bars_sql("p_brand", "stocks", benchmark=False)
SECTORS = fx.bars_sql("p_type", "sectors", benchmark=False)
OE, T, FACTS, EQ, FILLS = fx.ORDER_EVENTS_SQL, fx.TRADES_SQL, fx.FACTS_SQL, fx.EQUITY_SQL, fx.FILLS_SQL


def _both(spark, d):
    return fx.bars(spark, d, "p_brand", False), fx.bars(spark, d, "p_type", False)


def _redact_sql(col: str) -> str:
    for p in rec.SECRET_PATTERNS:
        col = f"regexp_replace({col}, '{p.replace(chr(39), chr(39) * 2)}', '{rec.MASK}', 'g')"
    return col


register(
    "src16_redact_text",
    lambda spark, d: fx.table(spark, d, "documents").select("doc_id", F.sha2(rec.redact_text(F.col("text")), 256).alias("redacted_sha256"), (rec.redact_text(F.col("text")) != F.col("text")).alias("changed")),
    f"SELECT doc_id, sha256(r) AS redacted_sha256, r <> text AS changed FROM (SELECT doc_id, text, {_redact_sql('text')} AS r FROM documents)",
)
RR = f"s AS (SELECT * FROM (SELECT symbol, d, close / {lag('close', 1)} - 1 AS r FROM stocks) WHERE r IS NOT NULL), t AS (SELECT * FROM (SELECT symbol AS sector, d, close / {lag('close', 1)} - 1 AS x FROM sectors) WHERE x IS NOT NULL)"
register(
    "w11_sector_proxy",
    lambda spark, d: rec.sector_proxy(*_both(spark, d)),
    f"""WITH {STOCKS}, {SECTORS}, {RR}, c AS (SELECT s.symbol, s.d, sector, CASE WHEN count(*) OVER w = 60 THEN round(corr(r, x) OVER w, 6) END AS c FROM s JOIN t ON s.d = t.d WINDOW w AS (PARTITION BY symbol, sector ORDER BY s.d ROWS 59 PRECEDING))
SELECT symbol, d, sector, c AS correlation FROM (SELECT *, row_number() OVER (PARTITION BY symbol, d ORDER BY c DESC, sector) AS k FROM c WHERE c IS NOT NULL AND NOT isnan(c)) WHERE k = 1""",
)
register(
    "w12_assign_sector",
    lambda spark, d: rec.assign_sector(*_both(spark, d)),
    f"""WITH {STOCKS}, {SECTORS}, {RR}, s1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY d DESC) AS k FROM s) WHERE k <= 126), t1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY d DESC) AS k FROM t) WHERE k <= 126),
g AS (SELECT symbol, sector, count(*) AS n, round(corr(r, x), 6) AS c FROM s1 JOIN t1 ON s1.d = t1.d GROUP BY 1, 2 HAVING count(*) >= 60)
SELECT symbol, sector, n, c AS correlation FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY c DESC, sector) AS k FROM g WHERE c IS NOT NULL AND NOT isnan(c)) WHERE k = 1""",
)


def _exits(spark, d):
    bars = fx.bars(spark, d, "p_type", False)
    return rounded(rec.first_exit(bars, bars), "entry", "exit", "ret")


register(
    "j13_first_exit",
    _exits,
    f"""WITH {SECTORS}, h AS (SELECT e.symbol, e.d AS entry_d, e.close AS entry, min(b.d) AS exit_d, arg_min(b.close, b.d) AS exit FROM sectors e JOIN sectors b ON e.symbol = b.symbol AND b.d > e.d
  AND (b.close <= e.close * (1 - 0.036) OR datediff('day', e.d, b.d) >= 30) GROUP BY 1, 2, 3)
SELECT symbol, entry_d, round(entry, 6) AS entry, exit_d, round(exit, 6) AS exit, CASE WHEN exit <= entry * (1 - 0.036) THEN 'stop_loss' ELSE 'time_stop' END AS reason, round(exit / entry - 1, 6) AS ret FROM h""",
)
register(
    "p13_validity_intervals",
    lambda spark, d: rec.validity(fx.filing_facts(spark, d).select("cik", "tag", "filed", F.round("value", 2).alias("value")), ["cik", "tag"], "filed"),
    f"WITH {FACTS} SELECT cik, tag, filed, round(value, 2) AS value, lead(filed) OVER (PARTITION BY cik, tag ORDER BY filed) AS valid_to FROM facts",
)
register(
    "src13_replace_by_source",
    lambda spark, d: rec.replace_source(fx.trades(spark, d).select("id", "symbol", "source"), fx.trades(spark, d).where("ret > 0.05").select("id", "symbol"), "F"),
    f"WITH {T} SELECT id, symbol, source FROM trades WHERE source IS DISTINCT FROM 'F' UNION ALL SELECT id, symbol, 'F' FROM trades WHERE ret > 0.05",
)


def _three(spark, d):
    t = fx.trades(spark, d)
    return [t.where("ret > 0.09").select("id"), t.where("score > 0.9").select("id"), t.where("horizon_days < 5").select("id")]


register(
    "k4_ordered_distinct",
    lambda spark, d: rec.ordered_distinct(_three(spark, d), "id"),
    f"WITH {T} SELECT id, min(p) AS priority FROM (SELECT id, 0 AS p FROM trades WHERE ret > 0.09 UNION ALL SELECT id, 1 FROM trades WHERE score > 0.9 UNION ALL SELECT id, 2 FROM trades WHERE horizon_days < 5) GROUP BY id",
)
register(
    "k6_set_difference",
    lambda spark, d: _three(spark, d)[2].join(_three(spark, d)[1], "id", "left_anti").distinct(),
    f"WITH {T} SELECT id FROM trades WHERE horizon_days < 5 EXCEPT SELECT id FROM trades WHERE score > 0.9",
)
register(
    "k8_intersect",
    lambda spark, d: _three(spark, d)[0].intersect(_three(spark, d)[2]),
    f"WITH {T} SELECT id FROM trades WHERE ret > 0.09 INTERSECT SELECT id FROM trades WHERE horizon_days < 5",
)
register(
    "k2_ordered_page",
    lambda spark, d: fx.trades(spark, d).select("id", F.round("pnl", 4).alias("pnl")).orderBy(F.desc("pnl"), "id").offset(50).limit(50),
    f"WITH {T} SELECT id, round(pnl, 4) AS pnl FROM trades ORDER BY round(pnl, 4) DESC, id LIMIT 50 OFFSET 50",
)


def _curves(spark, d):
    daily = fx.equity_curve(spark, d).select(F.date_add("d", 9100).alias("d"), "equity")
    intraday = fx.order_events(spark, d).select("ts", F.col("notional").alias("equity"))
    return rec.merge_curves(daily, intraday).withColumn("equity", F.round("equity", 6))


register(
    "k7_merged_curves",
    _curves,
    f"""WITH {EQ}, {OE}, dd AS (SELECT d + 9100 AS d, equity FROM equity)
SELECT d::TIMESTAMP AS ts, round(equity, 6) AS equity, 'daily' AS kind FROM dd WHERE d NOT IN (SELECT ts::DATE FROM oe) UNION ALL SELECT ts, round(notional, 6), 'intraday' FROM oe""",
)
FEATURES = ["open", "close", "volume", "r1", "sma20", "flat"]
register(
    "m26_feature_activity",
    lambda spark, d: rounded(rec.feature_activity(rec.trend_features(fx.bars(spark, d, "p_type", False)), FEATURES), "sd"),
    f"""WITH {SECTORS}, x AS (SELECT *, close / {lag('close', 1)} - 1 AS r1, {full('avg', 'close', 20)} AS sma20, 1.0 AS flat FROM sectors)
{' UNION ALL '.join(f"SELECT '{c}' AS feature, round(stddev_pop({c}), 6) AS sd, coalesce(stddev_pop({c}) > 1e-8, false) AS active FROM x" for c in FEATURES)}""",
)
register(
    "m27_dataset_fingerprint",
    lambda spark, d: fx.filing_facts(spark, d).groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_set(F.col("cik").cast("string"))), ","), 256).alias("owners_sha256")),
    f"WITH {FACTS} SELECT tag, count(*) AS n, sha256(string_agg(DISTINCT cik::VARCHAR, ',' ORDER BY cik::VARCHAR)) AS owners_sha256 FROM facts GROUP BY 1",
)


def _positions(spark, d, where):
    f = fx.fills(spark, d).where(where)
    return f.groupBy("account", "symbol").agg(F.sum(F.when(F.col("side") == "sell", -F.col("qty")).otherwise(F.col("qty"))).alias("qty"))


def _mismatch(spark, d):
    """Positions of all fills against those of the fills that are booked as final."""
    from marketloom.operators.joins import mismatches

    ours = _positions(spark, d, "true")
    booked = fx.table(spark, d, "lineitem").where("l_linestatus = 'F'").join(fx.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    signed = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    theirs = booked.groupBy(F.col("l_suppkey").alias("account"), F.col("p_brand").alias("symbol")).agg(F.sum(signed).alias("qty"))
    return mismatches(ours, theirs, ["account", "symbol"], "qty")


POS = "SELECT account, symbol, sum(CASE WHEN side = 'sell' THEN -qty ELSE qty END) AS qty FROM fills WHERE {w} GROUP BY 1, 2"
register(
    "j8_position_mismatch",
    _mismatch,
    f"""WITH {FILLS}, a AS ({POS.format(w='true')}), b AS (SELECT l_suppkey AS account, p_brand AS symbol, sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) AS qty FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'F' GROUP BY 1, 2), j AS (SELECT coalesce(a.account, b.account) AS account, coalesce(a.symbol, b.symbol) AS symbol, a.qty AS ours, b.qty AS theirs FROM a FULL JOIN b ON a.account = b.account AND a.symbol = b.symbol)
SELECT *, CASE WHEN theirs IS NULL THEN 'only_ours' WHEN ours IS NULL THEN 'only_theirs' ELSE 'quantity' END AS kind FROM j WHERE theirs IS NULL OR ours IS NULL OR abs(ours - theirs) > 1e-9""",
)
STATUS = "CASE node WHEN 'A' THEN 'experimental' WHEN 'N' THEN 'experimental' WHEN 'R' THEN 'probation' ELSE 'production' END"


def _promotions(spark, d):
    card = stats.node_scorecard(_evidence(spark, d), "node").withColumn("status", F.expr(STATUS))
    up = (F.col("status") == "experimental") & (F.col("n") >= 30) & (F.col("expectancy") > 0)
    top = (F.col("status") == "probation") & (F.col("n") >= 100) & (F.col("profit_factor") > 1.2)
    return card.withColumn("proposed", F.when(up, "probation").when(top, "production")).select("node", "n", "status", "proposed")


register(
    "a8_promotions",
    _promotions,
    f"WITH {EV}, c AS ({CARD.format(by='node')}), s AS (SELECT *, {STATUS} AS status FROM c) SELECT node, n, status, CASE WHEN status = 'experimental' AND n >= 30 AND expectancy > 0 THEN 'probation' WHEN status = 'probation' AND n >= 100 AND profit_factor > 1.2 THEN 'production' END AS proposed FROM s",
)
register(
    "w11_sector_relative",
    lambda spark, d: rounded(rec.sector_relative(*_both(spark, d)), "sector_return", "relative"),
    f"""WITH {STOCKS}, {SECTORS}, {RR}, c AS (SELECT s.symbol, s.d, sector, CASE WHEN count(*) OVER w = 60 THEN round(corr(r, x) OVER w, 6) END AS c FROM s JOIN t ON s.d = t.d WINDOW w AS (PARTITION BY symbol, sector ORDER BY s.d ROWS 59 PRECEDING)),
p AS (SELECT symbol, d, sector, c AS correlation FROM (SELECT *, row_number() OVER (PARTITION BY symbol, d ORDER BY c DESC, sector) AS k FROM c WHERE c IS NOT NULL AND NOT isnan(c)) WHERE k = 1),
o AS (SELECT symbol, d, close / {lag('close', 21)} - 1 AS own FROM stocks), q AS (SELECT symbol AS sector, d, close / {lag('close', 21)} - 1 AS sr FROM sectors)
SELECT p.symbol, p.d, p.sector, correlation, round(sr, 6) AS sector_return, round(own - sr, 6) AS relative FROM p JOIN o ON o.symbol = p.symbol AND o.d = p.d LEFT JOIN q ON q.sector = p.sector AND q.d = p.d""",
)
register(
    "k1_both_ends",
    lambda spark, d: rec.both_ends(fx.trades(spark, d).select("exit_date", "id", F.round("pnl", 4).alias("pnl")), ["exit_date"], "pnl", "id", 3),
    f"""WITH {T}, x AS (SELECT exit_date, id, round(pnl, 4) AS pnl FROM trades), y AS (SELECT *, row_number() OVER (PARTITION BY exit_date ORDER BY pnl DESC, id) AS t, row_number() OVER (PARTITION BY exit_date ORDER BY pnl, id DESC) AS b FROM x)
SELECT exit_date, id, pnl, 'top' AS "end", t AS rank FROM y WHERE t <= 3 UNION ALL SELECT exit_date, id, pnl, 'bottom', b FROM y WHERE b <= 3""",
)
register(
    "k6_both_differences",
    lambda spark, d: rec.differences(_three(spark, d)[2], _three(spark, d)[1], "id"),
    f"""WITH {T}, a AS (SELECT DISTINCT id FROM trades WHERE horizon_days < 5), b AS (SELECT DISTINCT id FROM trades WHERE score > 0.9)
SELECT id, 'left' AS side FROM (SELECT id FROM a EXCEPT SELECT id FROM b) UNION ALL SELECT id, 'right' FROM (SELECT id FROM b EXCEPT SELECT id FROM a)""",
)
register(
    "m27_whole_fingerprint",
    lambda spark, d: rec.fingerprint(fx.filing_facts(spark, d), "cik", "1997-06-30", "features-1"),
    f"""WITH {FACTS}, m AS (SELECT * FROM facts WHERE filed <= DATE '1997-06-30'), o AS (SELECT DISTINCT cik::VARCHAR AS o FROM m), b AS (SELECT left(sha256(o), 3) AS block, sha256(string_agg(o, ',' ORDER BY o)) AS h, count(*) AS n FROM o GROUP BY 1),
w AS (SELECT sum(n)::BIGINT AS owners, sha256(string_agg(h, '' ORDER BY block)) AS h FROM b), s AS (SELECT count(*) AS facts, max(filed)::DATE::VARCHAR AS newest FROM m)
SELECT owners, facts, newest, sha256(w.h || '|1997-06-30|' || facts || '|' || newest || '|features-1') AS sha256 FROM w, s""",
)
register(
    "j9_approvals_with_orders",
    # approvals: orders that wait (status P), with each of their lines
    lambda spark, d: fx.table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("approval"), "o_orderdate").join(fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("approval"), "l_linenumber", "l_quantity"), "approval").select("approval", F.to_date("o_orderdate").alias("asked"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("qty")),
    "SELECT o_orderkey AS approval, o_orderdate::DATE AS asked, l_linenumber AS line, l_quantity AS qty FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'",
)
register(
    "j10_without_membership",
    # documents that no label covers
    lambda spark, d: fx.table(spark, d, "documents").select("doc_id").join(fx.table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti"),
    "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
)
#: An audit trail from order events: scans with their candidates, decisions with their reasons.
_AUDIT = """CASE status WHEN 'cancelled' THEN 'cycle_end' ELSE 'risk_decision' END AS event_type, CASE WHEN id % 31 = 0 THEN '{broken' WHEN status = 'cancelled' THEN '{"candidates": ' || id % 9 || '}'
 WHEN status = 'rejected' THEN '{"verdict": "REJECTED", "reasons": ["' || CASE id % 6 WHEN 0 THEN 'stale (age 5)' WHEN 1 THEN 'duplicate: within 60 min' WHEN 2 THEN ' budget (3.5' WHEN 3 THEN 'stale' WHEN 4 THEN 'open positions' ELSE 'deployment: full' END || '", "second"]}'
 ELSE '{"verdict": "APPROVED", "reasons": []}' END AS payload"""


def _day(spark, d):
    o = fx.order_events(spark, d)
    return rec.day_digest(o.selectExpr("ts", "mode", _AUDIT.split(", CASE")[0], "CASE" + _AUDIT.split(", CASE", 1)[1]), o)


register(
    "a20_whole_digest",
    _day,
    f"""WITH {OE}, au AS (SELECT ts::DATE AS day, mode, {_AUDIT} FROM oe), js AS (SELECT *, try_cast(payload AS JSON) AS j FROM au),
s AS (SELECT day, mode, count(*) AS scans, coalesce(sum((j->>'candidates')::BIGINT), 0)::BIGINT AS candidates FROM js WHERE event_type = 'cycle_end' GROUP BY 1, 2),
v AS (SELECT day, mode, left(trim(regexp_extract(j->'reasons'->>0, '^([^(:]*)', 1)), 60) AS reason, count(*) AS k FROM js WHERE event_type = 'risk_decision' AND j->>'verdict' = 'REJECTED' GROUP BY 1, 2, 3),
b AS (SELECT day, mode, string_agg(reason || '=' || k, ', ' ORDER BY r) AS top_vetoes FROM (SELECT *, row_number() OVER (PARTITION BY day, mode ORDER BY k DESC, reason) AS r FROM v) WHERE r <= 4 GROUP BY 1, 2),
g AS (SELECT ts::DATE AS day, mode, {', '.join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in ("filled", "placed", "cancelled", "rejected"))} FROM oe GROUP BY 1, 2)
SELECT day, mode, filled, placed, cancelled, rejected, coalesce(scans, 0) AS scans, coalesce(candidates, 0) AS candidates, coalesce(top_vetoes, '') AS top_vetoes FROM g LEFT JOIN s USING (day, mode) LEFT JOIN b USING (day, mode)""",
)
