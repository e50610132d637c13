"""Queries of weights, review, positions and outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.functions.columns import rounded, score_bucket
from marketloom.operators import portfolio as pf
from marketloom.operators.joins import within_cooldown
from marketloom.registry import register
from marketloom.sources import fixtures as fx

BRAND = fx.bars_sql("p_brand", benchmark=False)
FILLS, OE, T, EQ = fx.FILLS_SQL, fx.ORDER_EVENTS_SQL, fx.TRADES_SQL, fx.EQUITY_SQL


def _monthly(spark, d):
    """Candidates by month and brand, from the month's trades."""
    f = fx.fills(spark, d).groupBy(F.trunc("d", "month").alias("cycle"), "symbol").agg(F.sum("qty").alias("q"), F.count(F.lit(1)).alias("n"))
    return f.select("cycle", "symbol", (F.col("q") % 97 / 97).alias("score"), ((F.col("q") % 13 - 2) / 100).alias("expected"), (0.01 + F.col("n") % 7 / 100).alias("atr"), F.when(F.col("q") % 5 == 0, 0.25).otherwise(1.0).alias("size"))


CAND = f"""{FILLS}, cand AS (SELECT date_trunc('month', d)::DATE AS cycle, symbol, sum(qty) % 97 / 97 AS score, (sum(qty) % 13 - 2) / 100 AS expected, 0.01 + count(*) % 7 / 100 AS atr, CASE WHEN sum(qty) % 5 = 0 THEN 0.25 ELSE 1.0 END::DOUBLE AS size FROM fills GROUP BY 1, 2)"""
register(
    "p2_target_weights",
    lambda spark, d: rounded(pf.target_weights(_monthly(spark, d)), "weight"),
    f"""WITH RECURSIVE {CAND}, top AS (SELECT *, greatest(0, score * expected / atr) AS raw FROM (SELECT *, row_number() OVER (PARTITION BY cycle ORDER BY score DESC, symbol) AS k FROM cand WHERE expected > 0) WHERE k <= 12),
r(cycle, symbol, size, w, i) AS (SELECT cycle, symbol, size, (CASE WHEN sum(raw) OVER (PARTITION BY cycle) > 0 THEN least(0.08, 0.7 * raw / sum(raw) OVER (PARTITION BY cycle)) ELSE 0 END)::DOUBLE, 0 FROM top
  UNION ALL SELECT cycle, symbol, size, CASE WHEN 0.7 - s <= 1e-6 OR room <= 1e-6 OR w >= 0.08 THEN w ELSE w + least(0.08 - w, (0.7 - s) * (0.08 - w) / room) END, i + 1
  FROM (SELECT *, sum(w) OVER (PARTITION BY cycle) AS s, sum(greatest(0.08 - w, 0)) OVER (PARTITION BY cycle) AS room FROM r WHERE i < 12))
SELECT cycle, symbol, round(w * size, 6) AS weight FROM r WHERE i = 12""",
)


def _holdings(spark, d):
    f = fx.fills(spark, d).groupBy(F.trunc("d", "month").alias("cycle"), "symbol").agg(F.sum("qty").alias("q"), F.count(F.lit(1)).alias("n"))
    q = F.col("q")
    return f.select("cycle", "symbol", F.lit(10_000.0).alias("equity"), (q * 7).alias("current"), F.when(q % 3 == 0, 0.0).otherwise((q % 11) / 200).alias("target"), (q % 50 / 100).alias("held_score"), F.lit(0.4).alias("best_new"), (q % 4).cast("int").alias("sessions"), (F.col("n") % 4).cast("int").alias("outside"), (q % 6 != 0).alias("ready"))


register(
    "p3_rebalance_sells",
    lambda spark, d: rounded(pf.rebalance_sells(_holdings(spark, d)), "gain", "over", "amount"),
    f"""WITH {FILLS}, h AS (SELECT date_trunc('month', d)::DATE AS cycle, symbol, sum(qty) AS q, count(*) AS n FROM fills GROUP BY 1, 2),
p AS (SELECT cycle, symbol, q * 7 AS cur, CASE WHEN q % 3 = 0 THEN 0 ELSE (q % 11) / 200 END AS tgt, 0.4 - q % 50 / 100 AS gain, n % 4 AS outs, q FROM h WHERE q % 6 <> 0 AND (q % 4)::INT >= 1),
e AS (SELECT *, cur - 10000 * tgt AS dlt FROM p), c AS (SELECT *, least(dlt, cur * 0.5, 3000) AS wish FROM e WHERE dlt >= 5 AND ((tgt = 0 AND outs >= 2) OR 0.4 >= q % 50 / 100 + 0.05)),
k AS (SELECT *, row_number() OVER (PARTITION BY cycle ORDER BY gain DESC, dlt / 10000 DESC, symbol) AS rank FROM c WHERE wish >= 5),
a AS (SELECT *, least(wish, 3000 - coalesce(sum(wish) OVER (PARTITION BY cycle ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS amount FROM k WHERE rank <= 2)
SELECT cycle, symbol, rank, round(gain, 6) AS gain, round(dlt / 10000, 6) AS over, round(amount, 6) AS amount FROM a WHERE amount >= 5""",
)
DEPLOYED = "CASE day(d) % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.6 WHEN 2 THEN 0.25 ELSE 0.0 END"
register(
    "p5_cycle_budget",
    lambda spark, d: fx.equity_curve(spark, d).select("d", F.round(pf.cycle_budget(F.col("equity"), F.expr(DEPLOYED).cast("double")) + 1e-9, 6).alias("budget")),
    f"WITH {EQ} SELECT d, round(least(equity * 0.1, 1000) * {DEPLOYED} + 1e-9, 6) AS budget FROM equity",
)


def _review(spark, d):
    """Orders of an account and day as one cycle."""
    e = fx.table(spark, d, "events")
    o = fx.orders_of(e).join(e.select(F.col("event_id").alias("id"), "user_id"), "id")
    again = within_cooldown(fx.order_events(spark, d)).select("id", F.lit(True).alias("again"))
    o = o.join(again, "id", "left")
    cycle = F.concat_ws("/", "user_id", F.to_date("ts").cast("string"))
    u = F.col("user_id")
    rows = o.select(cycle.alias("cycle"), "id", "ts", "symbol", "side", "notional", (u % 19 == 0).alias("switched"), F.when(u % 17 > 0, (F.col("id") % 6).cast("int")).alias("age"), F.coalesce("again", F.lit(False)).alias("repeat"),
        (1_000.0 + u % 7 * 500).alias("equity"), (40.0 + u % 5 * 20).alias("budget"), (u % 13).cast("int").alias("open_positions"), (F.col("id") % 50).cast("double").alias("held"), (u % 9 * 150.0).alias("deployed"), (20.0 + u % 3 * 100).alias("cash"))
    return rounded(pf.review_orders(rows), "approved")


register("p6_review_orders", _review)
#: Positions by one step a fill, in plain order: the recurrence itself.
STEPS = f"""{FILLS}, f AS (SELECT *, row_number() OVER (PARTITION BY account, symbol ORDER BY d, seq) AS k FROM fills),
r(account, symbol, k, d, seq, price, held, cost, sold, entry) AS (
  SELECT account, symbol, k, d, seq, price, CASE WHEN side = 'sell' THEN 0 ELSE qty END::DOUBLE, CASE WHEN side = 'sell' THEN 0 ELSE price END::DOUBLE, 0::DOUBLE, 0::DOUBLE FROM f WHERE k = 1
  UNION ALL SELECT f.account, f.symbol, f.k, f.d, f.seq, f.price, CASE WHEN side = 'sell' THEN greatest(held - qty, 0) ELSE held + qty END, CASE WHEN side = 'sell' THEN cost ELSE (held * cost + qty * f.price) / (held + qty) END,
  CASE WHEN side = 'sell' THEN least(held, qty) ELSE 0 END, cost FROM r JOIN f ON f.account = r.account AND f.symbol = r.symbol AND f.k = r.k + 1)"""
def _off_ties(df, *names):
    """Rounded to four digits, a little off exact halves, which sums in another order miss."""
    return df.withColumns({n: F.round(F.col(n) + 1e-7, 4) for n in names})


register(
    "p8_average_cost",
    lambda spark, d: _off_ties(pf.average_cost(fx.fills(spark, d)).select("account", "symbol", "seq", "held", "avg_cost", "sold", "realized"), "held", "avg_cost", "sold", "realized"),
    f"WITH RECURSIVE {STEPS} SELECT account, symbol, seq, round(held + 1e-7, 4) AS held, CASE WHEN held > 0 THEN round(cost + 1e-7, 4) END AS avg_cost, round(sold + 1e-7, 4) AS sold, round(CASE WHEN sold > 0 THEN (price - entry) * sold ELSE 0 END + 1e-7, 4) AS realized FROM r",
)


def _trips(spark, d):
    x = pf.round_trips(pf.average_cost(fx.fills(spark, d)))
    return _off_ties(x.withColumn("score_bucket", score_bucket(F.col("ret"))).select("seq", "account", "symbol", "exit_date", "qty", "pnl", "ret", "score_bucket"), "qty", "pnl", "ret")


register(
    "p9_round_trips",
    _trips,
    f"""WITH RECURSIVE {STEPS} SELECT seq, account, symbol, d AS exit_date, round(sold + 1e-7, 4) AS qty, round((price - entry) * sold + 1e-7, 4) AS pnl, round(price / entry - 1 + 1e-7, 4) AS ret,
  CASE WHEN abs(price / entry - 1) < 0.15 THEN 's0' WHEN abs(price / entry - 1) < 0.3 THEN 's1' WHEN abs(price / entry - 1) < 0.5 THEN 's2' ELSE 's3' END AS score_bucket FROM r WHERE sold > 0""",
)
register(
    "a22_net_pnl",
    lambda spark, d: rounded(pf.net_pnl(pf.average_cost(fx.fills(spark, d)), fx.bars(spark, d, "p_brand", False)), "realized", "unrealized", "day_pnl", "net", digits=3),
    f"""WITH RECURSIVE {STEPS}, {BRAND}, l AS (SELECT account, symbol, sum(CASE WHEN sold > 0 THEN (price - entry) * sold ELSE 0 END) AS rz, arg_max(held, k) AS held, arg_max(cost, k) AS cost FROM r GROUP BY 1, 2),
m AS (SELECT symbol, max(close) FILTER (WHERE k = 1) AS mk, max(close) FILTER (WHERE k = 2) AS pr FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY d DESC) AS k FROM bars) GROUP BY 1)
SELECT account, round(sum(rz), 3) AS realized, round(sum(held * (mk - cost)), 3) AS unrealized, round(sum(held * (mk - coalesce(pr, mk))), 3) AS day_pnl, round(sum(rz) + sum(held * (mk - cost)), 3) AS net FROM l JOIN m USING (symbol) GROUP BY 1""",
)


def _replay(spark, d):
    bars = fx.bars(spark, d, "p_type", False)
    return rounded(pf.replay(bars.where("volume % 3 = 0"), bars), "entry", "sold_at", "net_ret")


register(
    "p10_outcome_replay",
    _replay,
    f"""WITH {fx.bars_sql('p_type', benchmark=False)}, s AS (SELECT symbol, d AS signal_d, lead(d) OVER w AS entry_d, lead(open) OVER w * 1.0008 AS entry, volume FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY d)),
q AS (SELECT * FROM s WHERE volume % 3 = 0 AND entry_d IS NOT NULL),
x AS (SELECT q.symbol, signal_d, entry_d, entry, min(b.d) AS exit_d, arg_min(b.close, b.d) AS ex FROM q JOIN bars b ON b.symbol = q.symbol AND b.d > entry_d AND (b.close <= entry * (1 - 0.036) OR datediff('day', entry_d, b.d) >= 30) GROUP BY 1, 2, 3, 4)
SELECT symbol, signal_d, entry_d, round(entry, 6) AS entry, exit_d, round(ex * 0.9992, 6) AS sold_at, CASE WHEN ex <= entry * (1 - 0.036) THEN 'stop_loss' ELSE 'time_stop' END AS reason, round(ex * 0.9992 / entry - 1, 6) AS net_ret, 'backtest' AS source FROM x""",
)
register(
    "sc13_prices_and_quantities",
    lambda spark, d: fx.order_events(spark, d).select("id", pf.limit_price(F.col("side"), F.col("notional")).alias("limit"), F.when(F.col("notional") >= 1, pf.quantity(F.col("notional") * 10_000, F.round("notional", 2), F.col("id") % 4 == 0)).alias("qty")),
    f"WITH {OE} SELECT id, round(notional * CASE WHEN side = 'buy' THEN 1.001 ELSE 0.999 END + 1e-9, 2) AS \"limit\", CASE WHEN notional >= 1 THEN CASE WHEN id % 4 = 0 THEN floor(notional * 10000 / (round(notional, 2) * 100)) ELSE round(notional * 10000 / round(notional, 2), 6) END END::DOUBLE AS qty FROM oe",
)
KIND = "CASE id % 3 WHEN 0 THEN 'approval' WHEN 1 THEN 'suggestion' ELSE 'question' END"
NOW = "2024-01-20 00:00:00"


def _expiry(spark, d):
    o = fx.order_events(spark, d)
    items = o.select("id", F.expr(KIND).alias("kind"), F.when(F.col("status") == "placed", "pending").otherwise(F.col("status")).alias("status"), (F.col("ts") + F.make_dt_interval(hours=(F.col("id") % 72).cast("int"))).alias("expires_at"))
    return pf.expired(items, F.lit(NOW).cast("timestamp")).select("id", "kind", "status")


register(
    "p12_expiry",
    _expiry,
    f"""WITH {OE} SELECT id, {KIND} AS kind, CASE WHEN status = 'placed' THEN CASE WHEN ts + to_hours((id % 72)::INT) < TIMESTAMP '{NOW}' THEN CASE id % 3 WHEN 0 THEN 'expired' WHEN 1 THEN 'adopted' ELSE 'status_quo' END ELSE 'pending' END ELSE status END AS status FROM oe""",
)


def _stale(spark, d):
    f = fx.filing_facts(spark, d).where("value > 0").groupBy("cik", "tag").agg(F.max(F.when(F.col("form") == "10-K", F.col("filed"))).alias("activated_at"))
    return pf.staleness(f.withColumn("made_under", F.when(F.col("cik") % 2 == 0, "neutral").otherwise("stress")), F.lit("1999-06-01").cast("date"), F.lit("neutral"), 120).select("cik", "tag", "stale_reason")


register(
    "p14_staleness",
    _stale,
    f"""WITH {fx.FACTS_SQL}, a AS (SELECT cik, tag, max(filed) FILTER (WHERE form = '10-K') AS at FROM facts WHERE value > 0 GROUP BY 1, 2)
SELECT cik, tag, CASE WHEN a.at IS NULL THEN 'none active' WHEN datediff('day', a.at, DATE '1999-06-01') > 120 THEN 'too old' WHEN cik % 2 <> 0 THEN 'regime changed' END AS stale_reason FROM a""",
)
register(
    "j7_trade_evidence",
    lambda spark, d: fx.trades(spark, d).select("id", "ret", F.posexplode("nodes").alias("place", "node")).join(fx.fills(spark, d).select(F.col("seq").alias("id"), "account", "side"), "id").select("id", "place", "node", "account", "side", F.round("ret", 6).alias("ret")),
    f"WITH {T}, {FILLS} SELECT id, place::INT AS place, nodes[place + 1] AS node, account, side, round(ret, 6) AS ret FROM (SELECT *, unnest(range(len(nodes))) AS place FROM trades) t JOIN fills f ON f.seq = t.id",
)


def _approvals(spark, d):
    o = fx.order_events(spark, d)
    return o.where("status = 'placed'").select("id", F.lit("pending").alias("state")).join(o.select("id", "symbol", "side", F.round("notional", 4).alias("notional")), "id")


register("j9_pending_approvals", _approvals, f"WITH {OE} SELECT id, 'pending' AS state, symbol, side, round(notional, 4) AS notional FROM oe WHERE status = 'placed'")


def _decisions(spark, d):
    """Of each mode's last cycle (a day): every symbol considered, the last verdict, what was filled."""
    o = fx.order_events(spark, d).withColumn("cycle", F.to_date("ts"))
    last = o.groupBy("mode").agg(F.max("cycle").alias("cycle"))
    now = o.join(F.broadcast(last), ["mode", "cycle"])
    seen = now.select("mode", "cycle", "symbol").distinct()
    verdict = now.groupBy("mode", "symbol").agg(F.max_by("status", F.struct("ts", "id")).alias("verdict"))
    entry = now.where("status = 'filled'").groupBy("mode", "symbol").agg(F.round(F.sum("notional"), 4).alias("filled"))
    return seen.join(verdict, ["mode", "symbol"], "left").join(entry, ["mode", "symbol"], "left")


register(
    "j11_decision_view",
    _decisions,
    f"""WITH {OE}, l AS (SELECT mode, max(ts::DATE) AS cycle FROM oe GROUP BY 1) SELECT oe.mode, l.cycle, symbol, arg_max(status, (ts, id)) AS verdict, round(sum(notional) FILTER (WHERE status = 'filled'), 4) AS filled FROM oe JOIN l ON oe.mode = l.mode AND oe.ts::DATE = l.cycle GROUP BY ALL""",
)
