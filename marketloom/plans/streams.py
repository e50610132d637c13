"""Queries that run as streams over the given tables."""

from __future__ import annotations


from pyspark.sql import functions as F

from marketloom.functions.columns import rounded
from marketloom.registry import register
from marketloom.sources import fixtures as fx
from marketloom.streaming import stateful, streams


def _storm(spark, d):
    orders = fx.orders_of(streams.stream_table(spark, d, "events"))
    return streams.run_available(streams.rejection_storm(orders), "st7", ["day", "mode"])


register(
    "st7_rejection_storm",
    _storm,
    f"WITH {fx.ORDER_EVENTS_SQL} SELECT date_trunc('day', ts)::TIMESTAMP AS day, mode, count(*) AS rejected, count(*) > 5 AS storm FROM oe WHERE status = 'rejected' GROUP BY 1, 2",
)


def _news(spark, d):
    labels = fx.table(spark, d, "labels")
    news = fx.news_of(streams.stream_table(spark, d, "documents"), labels)
    return rounded(streams.rolling_news(streams.run_available(streams.hourly_news(news), "st5", ["symbol", "hour_end"])), "score")


register(
    "st5_rolling_news",
    _news,
    f"""WITH {fx.NEWS_SQL}, x AS (SELECT *, unnest(range(168)) AS k, date_trunc('hour', published_at) AS b FROM news WHERE stance IS NOT NULL),
y AS (SELECT *, b + INTERVAL 1 HOUR + k * INTERVAL 1 HOUR AS window_end FROM x), z AS (SELECT *, exp(-(epoch_us(window_end) - epoch_us(published_at)) / 3.6e9 / 48) * confidence * reliability AS w FROM y)
SELECT symbol, window_end, count(*) AS n, round(sum(stance * w) / sum(w), 6) AS score FROM z GROUP BY 1, 2""",
)


OE = fx.ORDER_EVENTS_SQL


def _orders(spark, d):
    return fx.orders_of(streams.stream_table(spark, d, "events"))


#: How late rows come, and how far a watermark lags behind: the last rows do not come out, unless the stream ends.
LATE = 30
PASSED = "(SELECT epoch_ms(max(ts)) - 1800000 FROM {}) * 1000"


def _marks(spark, d):
    e = fx.table(spark, d, "events").select(F.col("event_type").alias("source"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("equity"))
    return streams.append_available(stateful.throttled_marks(stateful.arriving(e, "ts", LATE, "st1-in", ends=True)), "st1")


register(
    "st1_throttled_marks",
    _marks,
    """WITH RECURSIVE e AS (SELECT event_type AS source, ts, value AS equity, row_number() OVER (PARTITION BY event_type ORDER BY ts, value) AS k FROM events),
r(source, k, ts, equity, last, kept) AS (SELECT source, k, ts, equity, epoch_us(ts), true FROM e WHERE k = 1
  UNION ALL SELECT e.source, e.k, e.ts, e.equity, CASE WHEN epoch_us(e.ts) - r.last >= 300000000 THEN epoch_us(e.ts) ELSE r.last END, epoch_us(e.ts) - r.last >= 300000000 FROM r JOIN e ON e.source = r.source AND e.k = r.k + 1)
SELECT source, ts, equity FROM r WHERE kept""",
)


def _switches(spark, d):
    """Rejected orders, and fills of 450 or more, at which a person looks and clears the switch."""
    o = fx.order_events(spark, d).where("status = 'rejected' or (status = 'filled' and notional >= 450)")
    x = o.select("mode", "ts", (F.col("status") == "filled").alias("clears"))
    return streams.append_available(stateful.rejection_switches(stateful.arriving(x, "ts", LATE, "st7-in")), "st7")


register(
    "st7_rejection_switches",
    _switches,
    f"""WITH RECURSIVE {fx.ORDER_EVENTS_SQL}, o AS (SELECT mode, ts, epoch_us(ts) AS u, status = 'filled' AS c FROM oe WHERE status = 'rejected' OR (status = 'filled' AND notional >= 450)),
e AS (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY u, c) AS k FROM o),
r(mode, k, day, n, trip, clr, out) AS (SELECT mode, 0::BIGINT, NULL::BIGINT, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, [NULL::BIGINT] FROM (SELECT DISTINCT mode FROM e)
  UNION ALL SELECT mode, k, CASE WHEN NOT c AND t IS NULL THEN u // 86400000000 ELSE day END, m, CASE WHEN c THEN NULL WHEN t IS NULL AND m > 5 THEN u ELSE t END, CASE WHEN c THEN NULL WHEN t IS NULL AND m > 5 THEN u + 1800000000 ELSE x END,
    CASE WHEN over THEN [trip, n, clr, 0] WHEN c AND t IS NOT NULL THEN [t, n, u, 1] ELSE [NULL::BIGINT] END
  FROM (SELECT *, CASE WHEN c THEN 0 WHEN t IS NOT NULL THEN n ELSE (CASE WHEN day IS DISTINCT FROM u // 86400000000 OR over THEN 0 ELSE n END) + 1 END AS m
    FROM (SELECT e.mode, e.k, e.u, e.c, r.day, r.n, r.trip, r.clr, coalesce(r.clr <= e.u, false) AS over, CASE WHEN coalesce(r.clr <= e.u, false) THEN NULL ELSE r.trip END AS t, CASE WHEN coalesce(r.clr <= e.u, false) THEN NULL ELSE r.clr END AS x
      FROM r JOIN e ON e.mode = r.mode AND e.k = r.k + 1 AND e.u < {PASSED.format("o")}))),
z AS (SELECT mode, out FROM r WHERE out[1] IS NOT NULL UNION ALL
  SELECT mode, [trip, n, clr, 0] FROM (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY k DESC) AS b FROM r) WHERE b = 1 AND clr <= {PASSED.format("o")})
SELECT mode, make_timestamp(out[1]) AS tripped_at, out[2] AS rejected, make_timestamp(out[3]) AS cleared_at, CASE out[4] WHEN 0 THEN 'cooldown' ELSE 'manual' END AS how FROM z""",
)
register("st2_fresh_orders", lambda spark, d: streams.append_available(streams.fresh_orders(_orders(spark, d)).select("symbol", "side", "mode", F.col("ts").alias("ts")), "st2").select("symbol", "side", "mode").distinct(), f"WITH {OE} SELECT DISTINCT symbol, side, mode FROM oe WHERE status NOT IN ('rejected', 'cancelled')")
def _cooldown(spark, d):
    """Live orders in order of time, in several batches: the first of an hour by what they do."""
    o = _orders_table(spark, d)
    return streams.append_available(stateful.once_within(stateful.arriving(o, "ts", 0, "st2-in"), "what", "ts", 1 / 24, "1 minute"), "st2")


def _orders_table(spark, d):
    alive = fx.order_events(spark, d).where("status not in ('rejected', 'cancelled')")
    return alive.select(F.concat_ws("/", "symbol", "side", "mode").alias("what"), "ts")


register(
    "st2_cooldown_rows",
    _cooldown,
    f"""WITH RECURSIVE {OE}, e AS (SELECT symbol || '/' || side || '/' || mode AS what, ts, row_number() OVER (PARTITION BY symbol, side, mode ORDER BY ts) AS k FROM oe WHERE status NOT IN ('rejected', 'cancelled')),
r(what, k, ts, first, kept) AS (SELECT what, k, ts, ts, true FROM e WHERE k = 1
  UNION ALL SELECT e.what, e.k, e.ts, CASE WHEN e.ts - r.first >= INTERVAL 1 HOUR THEN e.ts ELSE r.first END, e.ts - r.first >= INTERVAL 1 HOUR FROM r JOIN e ON e.what = r.what AND e.k = r.k + 1)
SELECT what, ts FROM r WHERE kept""",
)
register(
    "st3_latest_bars",
    lambda spark, d: rounded(streams.run_available(streams.latest_bars(_orders(spark, d)), "st3", ["symbol", "day"]), "close", digits=4),
    f"WITH {OE} SELECT symbol, date_trunc('day', ts)::TIMESTAMP AS day, round(arg_max(notional, (ts, id)), 4) AS close, max(ts) AS \"at\", count(*) AS ticks FROM oe GROUP BY 1, 2",
)


def _feed(spark, d):
    """Headlines, those of one source again after 20 days, and all again after 45."""
    news = fx.news(spark, d).where("body is not null")
    days = F.array(F.lit(0), F.when(F.col("source") == "src0", 20), F.lit(45))
    again = news.select("source", F.sha2("body", 256).alias("content_hash"), "published_at", F.explode(F.array_compact(days)).alias("k"))
    feed = again.select("content_hash", F.expr("published_at + make_dt_interval(k)").alias("published_at"))
    return streams.append_available(stateful.once_within(stateful.arriving(feed, "published_at", LATE, "st4-in", batches=6), "content_hash", "published_at", 30, "30 minutes"), "st4")


register(
    "st4_unique_news",
    _feed,
    f"""WITH RECURSIVE {fx.NEWS_SQL}, f AS (SELECT sha256(body) AS h, published_at + to_days(k::INT) AS ts FROM (SELECT *, unnest(CASE WHEN source = 'src0' THEN [0, 20, 45] ELSE [0, 45] END) AS k FROM news WHERE body IS NOT NULL)),
e AS (SELECT h, ts, row_number() OVER (PARTITION BY h ORDER BY ts) AS k FROM f),
r(h, k, ts, first, kept) AS (SELECT h, k, ts, ts, true FROM e WHERE k = 1
  UNION ALL SELECT e.h, e.k, e.ts, CASE WHEN e.ts - r.first >= INTERVAL 30 DAY THEN e.ts ELSE r.first END, e.ts - r.first >= INTERVAL 30 DAY FROM r JOIN e ON e.h = r.h AND e.k = r.k + 1)
SELECT h AS content_hash, ts AS published_at FROM r WHERE kept""",
)
register(
    "st6_scan_sessions",
    lambda spark, d: streams.append_available(streams.scan_sessions(_orders(spark, d).where("status = 'filled'")), "st6"),
    f"""WITH {OE}, x AS (SELECT mode, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 1800000000 THEN 0 ELSE 1 END AS fresh FROM oe WHERE status = 'filled' WINDOW w AS (PARTITION BY mode ORDER BY ts)),
y AS (SELECT *, sum(fresh) OVER (PARTITION BY mode ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x), z AS (SELECT mode, min(ts) AS began, max(ts) + INTERVAL 30 MINUTE AS stale_at, count(*) AS scans FROM y GROUP BY mode, s)
SELECT * FROM z WHERE stale_at < (SELECT max(ts) FROM oe WHERE status = 'filled') - INTERVAL 1 DAY""",
)
def _matched(spark, d):
    o = fx.order_events(spark, d)
    one = lambda status: stateful.arriving(o.where(F.col("status") == status), "ts", LATE, "st8-in")
    return streams.pairs(streams.append_available(stateful.matched_blocks(one("placed"), one("filled")), "st8"))


register(
    "st8_matched_orders",
    _matched,
    f"""WITH {OE}, w AS (SELECT least(max(ts) FILTER (WHERE status = 'placed'), max(ts) FILTER (WHERE status = 'filled')) - INTERVAL 1 HOUR AS t FROM oe)
SELECT o.id, o.symbol, o.mode, o.ts, f.id AS fill_id, f.ts AS filled_at FROM oe o LEFT JOIN oe f ON f.status = 'filled' AND f.symbol = o.symbol AND f.mode = o.mode AND f.ts >= o.ts AND f.ts <= o.ts + INTERVAL 6 HOUR
WHERE o.status = 'placed' AND (f.id IS NOT NULL OR o.ts + INTERVAL 6 HOUR < (SELECT t FROM w))""",
)


def _quotes(spark, d):
    q = streams.run_available(streams.latest_quotes(_orders(spark, d)), "st9", ["symbol"])
    now = q.agg(F.max("at").alias("now"))
    return rounded(q.join(F.broadcast(now)).withColumn("live", F.unix_micros("now") - F.unix_micros("at") <= 30_000_000).drop("now"), "price", digits=4)


register(
    "st9_latest_quotes",
    _quotes,
    f"WITH {OE}, q AS (SELECT symbol, arg_max(notional, (ts, id)) AS p, max(ts) AS t FROM oe GROUP BY 1) SELECT symbol, round(p, 4) AS price, t AS \"at\", epoch_us((SELECT max(ts) FROM oe)) - epoch_us(t) <= 30000000 AS live FROM q",
)
