"""Queries of joins, ingestion, sizing and order bookkeeping."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketloom.functions import columns as col
from marketloom.functions.columns import rounded
from marketloom.operators import indicators as ind
from marketloom.operators import joins, sizing
from marketloom.plans.indicators import ATR, TR
from marketloom.registry import register
from marketloom.sources import fixtures as fx

B = fx.bars_sql()
BRAND = fx.bars_sql("p_brand", benchmark=False)
T, OE, NEWS, FACTS, EQ = fx.TRADES_SQL, fx.ORDER_EVENTS_SQL, fx.NEWS_SQL, fx.FACTS_SQL, fx.EQUITY_SQL


def _decisions(spark, d):
    """The distinct (symbol, entry date) of all trades."""
    return fx.trades(spark, d).select("symbol", F.col("entry_date").alias("d")).distinct()


register(
    "j1_asof_bars",
    lambda spark, d: rounded(joins.latest_at(_decisions(spark, d), fx.bars(spark, d, "p_brand", False).withColumn("bar_d", F.col("d")), ["bar_d", "close"], ["symbol"], "d"), "close"),
    f"WITH {T}, {BRAND}, q AS (SELECT DISTINCT symbol, entry_date AS d FROM trades) SELECT q.symbol, q.d, b.d AS bar_d, round(b.close, 6) AS close FROM q ASOF LEFT JOIN bars b ON q.symbol = b.symbol AND q.d >= b.d",
)
register(
    "j5_reaction",
    lambda spark, d: rounded(
        joins.next_after(
            joins.latest_at(_decisions(spark, d), fx.bars(spark, d, "p_brand", False).withColumn("before", F.col("close")), ["before"], ["symbol"], "d"),
            fx.bars(spark, d, "p_brand", False).withColumn("after", F.col("close")), ["after"], ["symbol"], "d",
        ).withColumn("reaction", F.col("after") / F.col("before") - 1),
        "before", "after", "reaction",
    ),
    f"""WITH {T}, {BRAND}, q AS (SELECT DISTINCT symbol, entry_date AS d FROM trades), x AS (SELECT q.*, b.close AS before FROM q ASOF LEFT JOIN bars b ON q.symbol = b.symbol AND q.d >= b.d),
y AS (SELECT x.*, b.close AS after FROM x ASOF LEFT JOIN bars b ON x.symbol = b.symbol AND x.d < b.d)
SELECT symbol, d, round(before, 6) AS before, round(after, 6) AS after, round(after / before - 1, 6) AS reaction FROM y""",
)
register(
    "j2_point_in_time_facts",
    lambda spark, d: joins.latest_at(
        fx.table(spark, d, "orders").join(fx.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("cik"), F.col("o_orderpriority").alias("tag"), F.to_date("o_orderdate").alias("filed")).distinct(),
        fx.filing_facts(spark, d).withColumn("value", F.round("value", 2)), ["period_end", "value"], ["cik", "tag"], "filed",
    ),
    f"""WITH {FACTS}, q AS (SELECT DISTINCT c_nationkey AS cik, o_orderpriority AS tag, o_orderdate::DATE AS filed FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT q.cik, q.tag, q.filed, f.period_end, round(f.value, 2) AS value FROM q ASOF LEFT JOIN facts f ON q.cik = f.cik AND q.tag = f.tag AND q.filed >= f.filed""",
)


def _news_window(spark, d):
    days = fx.order_events(spark, d).select("symbol", F.date_trunc("day", "ts").alias("as_of")).distinct()
    pairs = joins.within_days(days, fx.news(spark, d).select("symbol", "published_at", "doc_id", "stance"), 14, "symbol", "as_of", "published_at")
    return rounded(pairs.groupBy("symbol", "as_of").agg(F.count(F.lit(1)).alias("n"), F.avg("stance").alias("stance")), "stance")


register(
    "j4_news_before",
    _news_window,
    f"""WITH {OE}, {NEWS}, q AS (SELECT DISTINCT symbol, date_trunc('day', ts)::TIMESTAMP AS as_of FROM oe)
SELECT q.symbol, as_of, count(*) AS n, round(avg(stance), 6) AS stance FROM q JOIN news n ON q.symbol = n.symbol AND published_at <= as_of AND published_at >= as_of - INTERVAL 14 DAY GROUP BY ALL""",
)
register(
    "j12_cooldown_repeats",
    lambda spark, d: joins.within_cooldown(fx.order_events(spark, d)).select("id", "symbol", "side", "mode", "before_id"),
    f"""WITH {OE}, x AS (SELECT *, lag(ts) OVER w AS before, lag(id) OVER w AS before_id FROM oe WHERE status NOT IN ('rejected', 'cancelled') WINDOW w AS (PARTITION BY symbol, side, mode ORDER BY ts, id))
SELECT id, symbol, side, mode, before_id FROM x WHERE epoch_us(ts) - epoch_us(before) <= 3600000000""",
)
register(
    "src6_upsert_last_write",
    lambda spark, d: joins.last_write(fx.order_events(spark, d).withColumn("day", F.to_date("ts")), ["symbol", "day"], [F.col("ts"), F.col("id")]).select("symbol", "day", "id", "side", "status", F.round("notional", 4).alias("notional")),
    f"WITH {OE} SELECT symbol, day, id, side, status, round(notional, 4) AS notional FROM (SELECT *, ts::DATE AS day, row_number() OVER (PARTITION BY symbol, ts::DATE ORDER BY ts DESC, id DESC) AS k FROM oe) WHERE k = 1",
)


def _insert_ignore(spark, d):
    o = fx.order_events(spark, d).select("symbol", F.hour("ts").alias("hour"), "id", "mode")
    base = joins.insert_ignore(o.where("mode = 'paper'").limit(0), o.where("mode = 'paper'"), ["symbol", "hour"], [F.col("id")])
    return joins.insert_ignore(base, o.where("mode = 'live'"), ["symbol", "hour"], [F.col("id")])


register(
    "src7_insert_ignore",
    _insert_ignore,
    f"""WITH {OE}, o AS (SELECT symbol, hour(ts) AS hour, id, mode FROM oe), k AS (SELECT *, row_number() OVER (PARTITION BY symbol, hour ORDER BY mode = 'live', id) AS k FROM o)
SELECT symbol, hour, id, mode FROM k WHERE k = 1""",
)
register(
    "src9_freshness",
    lambda spark, d: joins.freshness(fx.bars(spark, d, "p_brand", False), "2000-06-30"),
    f"WITH {BRAND} SELECT symbol, max(d) AS last_d, count(*) AS n_bars, datediff('day', max(d), DATE '2000-06-30') AS age_days, datediff('day', max(d), DATE '2000-06-30') > 4 AS stale FROM bars WHERE d <= DATE '2000-06-30' GROUP BY 1",
)
PROVIDERS = ("purchase", "click", "view", "signup", "error")


register(
    "src10_resolve_quotes",
    lambda spark, d: joins.resolve_quotes(fx.order_events(spark, d).withColumnRenamed("notional", "price"), PROVIDERS, 21_600).withColumns({"price": F.round("price", 4), "change_pct": F.round("change_pct", 6)}),
    f"""WITH {OE}, l AS (SELECT *, row_number() OVER (PARTITION BY symbol, provider ORDER BY ts DESC, id DESC) AS k, first_value(notional) OVER (PARTITION BY symbol, provider, ts::DATE ORDER BY ts, id) AS o, max(ts) OVER (PARTITION BY symbol) AS now FROM oe),
r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY list_position(['purchase', 'click', 'view', 'signup', 'error'], provider)) AS j FROM l WHERE k = 1 AND epoch_us(now) - epoch_us(ts) <= 21600000000)
SELECT symbol, provider, round(notional, 4) AS price, ts, CASE WHEN o <> 0 THEN round(notional / o - 1, 6) END AS change_pct FROM r WHERE j = 1""",
)


def _normalized_news(spark, d):
    n = fx.news(spark, d).where(F.length(F.trim("title")) > 0)
    stable = F.substring(F.sha2(F.concat_ws("|", "title", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss"), F.concat(F.lit("doc://"), F.coalesce("source", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"))), 256), 1, 16)
    return n.select("doc_id", stable.alias("news_id"), F.sha2("body", 256).alias("content_hash"), F.substring("body", 1, 500).alias("summary"))


register(
    "src12_normalize_news",
    _normalized_news,
    f"""WITH {NEWS} SELECT doc_id, substr(sha256(title || '|' || strftime(published_at, '%Y-%m-%d %H:%M:%S') || '|doc://' || coalesce(source, '') || '/' || doc_id::VARCHAR), 1, 16) AS news_id, sha256(body) AS content_hash, substr(body, 1, 500) AS summary FROM news WHERE length(trim(title)) > 0""",
)
register(
    "src14_missing_history",
    lambda spark, d: fx.table(spark, d, "part").select(F.concat_ws("/", "p_brand", "p_type").alias("symbol")).distinct().join(
        fx.table(spark, d, "lineitem").join(fx.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.concat_ws("/", "p_brand", "p_type").alias("symbol")).agg(F.count_distinct(F.to_date("l_shipdate")).alias("n")), "symbol", "left",
    ).select("symbol", F.coalesce("n", F.lit(0)).alias("n_bars")).where("n_bars < 400").orderBy(F.desc("n_bars"), "symbol"),
    "SELECT p_brand || '/' || p_type AS symbol, count(DISTINCT l_shipdate::DATE) AS n_bars FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1 HAVING count(DISTINCT l_shipdate::DATE) < 400 ORDER BY 2 DESC, 1",
)
register(
    "sc1_signed_alpha",
    lambda spark, d: fx.trades(spark, d).select("id", F.round(col.signed_alpha(F.when(F.col("id") % 3 == 0, "long").when(F.col("id") % 3 == 1, "avoid").otherwise("long_call"), F.col("score"), F.lit(0.5)), 9).alias("alpha")),
    f"WITH {T} SELECT id, round(CASE WHEN id % 3 = 1 THEN -1 ELSE 1 END * abs(score) * 0.5, 9) AS alpha FROM trades",
)
register(
    "sc4_sc5_buckets",
    lambda spark, d: fx.trades(spark, d).groupBy(col.score_bucket(F.col("score")).alias("score_bucket"), col.horizon_bucket(F.col("horizon_days")).alias("horizon_bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ret"), 9).alias("ret")),
    f"""WITH {T} SELECT CASE WHEN abs(score) < 0.15 THEN 's0' WHEN abs(score) < 0.3 THEN 's1' WHEN abs(score) < 0.5 THEN 's2' ELSE 's3' END AS score_bucket,
  CASE WHEN horizon_days <= 10 THEN 'short' WHEN horizon_days <= 30 THEN 'medium' ELSE 'long' END AS horizon_bucket, count(*) AS n, round(avg(ret), 9) AS ret FROM trades GROUP BY 1, 2""",
)
register(
    "sc6_annualise",
    lambda spark, d: fx.trades(spark, d).select("id", F.round(col.annualise(F.col("ret"), 252.0 / F.greatest("horizon_days", F.lit(1))), 6).alias("annual")),
    f"WITH {T} SELECT id, round(pow(greatest(1 + ret, 1e-4), 252.0 / greatest(horizon_days, 1)) - 1, 6) AS annual FROM trades",
)
register(
    "p11_idempotent_orders",
    lambda spark, d: fx.order_events(spark, d).withColumn("key", F.concat_ws("-", "symbol", "side", F.date_format("ts", "yyyy-MM-dd"), "mode")).groupBy("key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("attempts")),
    f"WITH {OE} SELECT symbol || '-' || side || '-' || strftime(ts, '%Y-%m-%d') || '-' || mode AS key, min(id) AS id, count(*) AS attempts FROM oe GROUP BY 1",
)


def _candidates(spark, d):
    x = ind.atr_pct(fx.bars(spark, d)).where("atr_pct > 0 and symbol <> 'ALL'")
    return x.select(F.col("d").alias("cycle"), "symbol", F.col("atr_pct").alias("atr"), F.round(F.col("volume") % 97 / 97, 9).alias("score"), F.lit(0.6).alias("coverage"), F.when(F.dayofmonth("d") % 7 != 0, F.dayofmonth("d") % 5 / 4).alias("scale"), F.when(F.col("volume") % 3 == 0, 0.5).otherwise(1.2).alias("size_multiplier"), (F.dayofmonth("d") == F.length("symbol")).alias("held"))


CAND = f"{B}, {TR}, {ATR}, cand AS (SELECT d AS cycle, symbol, atr_pct AS atr, round(volume % 97 / 97, 9) AS score, 0.6::DOUBLE AS coverage, CASE WHEN day(d) % 7 <> 0 THEN day(d) % 5 / 4 END AS scale, CASE WHEN volume % 3 = 0 THEN 0.5 ELSE 1.2 END AS size_multiplier, day(d) = length(symbol) AS held FROM atr WHERE atr_pct > 0 AND symbol <> 'ALL')"
SIZED = f"{CAND}, s0 AS (SELECT *, least(10000 * 0.01 / atr, 10000 * 0.08) * least(1, 0.5 + score) * (0.5 + 0.5 * coverage) * coalesce(scale, 1) * least(size_multiplier, 1) AS notional FROM cand WHERE NOT held AND coalesce(scale, 1) > 0), sized AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cycle ORDER BY score DESC, symbol) AS rank FROM s0 WHERE notional >= 5) WHERE rank <= 4)"
register(
    "p1_vol_target",
    lambda spark, d: rounded(sizing.vol_target(_candidates(spark, d), 10_000, 4).drop("held"), "atr", "notional"),
    f"WITH {SIZED} SELECT cycle, symbol, round(atr, 6) AS atr, score, coverage, scale, size_multiplier::DOUBLE AS size_multiplier, round(notional, 6) AS notional, rank FROM sized",
)
register(
    "p4_fit_capacity",
    lambda spark, d: rounded(sizing.fit_capacity(sizing.vol_target(_candidates(spark, d), 10_000, 4).withColumn("cap", (F.dayofmonth("cycle") * 3).cast("double")), "cap").select("cycle", "symbol", "rank", "order_notional"), "order_notional"),
    f"""WITH {SIZED}, x AS (SELECT *, day(cycle) * 3.0 AS cap, sum(notional) OVER w AS s, min(notional) OVER w AS m FROM sized WINDOW w AS (PARTITION BY cycle ORDER BY rank ROWS UNBOUNDED PRECEDING)),
b AS (SELECT cycle, max(rank) AS k, arg_max(least(1, cap / s), rank) AS sc FROM x WHERE m * least(1, cap / s) >= 5 GROUP BY 1)
SELECT x.cycle, symbol, rank, round(notional * sc, 6) AS order_notional FROM x JOIN b ON x.cycle = b.cycle WHERE rank <= k""",
)
register(
    "p7_breaches",
    lambda spark, d: rounded(sizing.breaches(fx.equity_curve(spark, d)).select("d", "day_loss", "week_loss", "peak_loss", "tripped"), "day_loss", "week_loss", "peak_loss"),
    f"""WITH {EQ}, x AS (SELECT d, equity, last(equity) OVER (ORDER BY d RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING) AS e1, last(equity) OVER (ORDER BY d RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 7 DAY PRECEDING) AS e7,
  max(equity) OVER (ORDER BY d) AS pk FROM equity), y AS (SELECT d, 1 - equity / e1 AS dl, 1 - equity / e7 AS wl, 1 - equity / pk AS pl FROM x)
SELECT d, round(dl, 6) AS day_loss, round(wl, 6) AS week_loss, round(pl, 6) AS peak_loss, coalesce(dl >= 0.02, false) OR coalesce(wl >= 0.05, false) OR pl >= 0.15 AS tripped FROM y""",
)


def _streaks(spark, d):
    x = ind.returns(fx.bars(spark, d), (1,)).withColumn("r1", F.round("r1", 9))
    return joins.streaks(x, ["symbol"], "d", F.col("r1") < 0).select("symbol", "d", "streak")


register(
    "w20_streaks",
    _streaks,
    f"""WITH {B}, x AS (SELECT symbol, d, coalesce(round(close / lag(close) OVER (PARTITION BY symbol ORDER BY d) - 1, 9) < 0, false) AS f FROM bars),
y AS (SELECT *, sum((NOT f)::INT) OVER (PARTITION BY symbol ORDER BY d) AS i FROM x) SELECT symbol, d, (sum(f::INT) OVER (PARTITION BY symbol, i ORDER BY d))::BIGINT AS streak FROM y""",
)


def _bootstrap(spark, d):
    r = ind.returns(fx.bars(spark, d), (1,)).where("symbol = 'ALL' and r1 is not null")
    series = r.select((F.row_number().over(Window.orderBy("d")) - 1).cast("long").alias("i"), F.col("r1").alias("r"))
    return rounded(sizing.block_bootstrap(series, 500, 6), "total_return", "max_drawdown")


register("a13_block_bootstrap", _bootstrap)
