"""Queries of memos, stances, mandates and views; documents and events stand for their texts.

The JSON texts are made by expressions that both engines read."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.functions.columns import rounded
from marketloom.operators import memos
from marketloom.registry import register
from marketloom.sources import fixtures as fx

BRAND = fx.bars_sql("p_brand", benchmark=False)
#: A memo of each document: every fifth is cut off, some have no number or cite another symbol's source.
MEMO = """CASE WHEN doc_id % 5 = 4 THEN '{"stance":' WHEN doc_id % 31 = 7 THEN '[1]' ELSE '{"stance":"' || CASE doc_id % 4 WHEN 0 THEN 'Attractive' WHEN 1 THEN 'avoid' WHEN 2 THEN 'neutral' ELSE 'hold' END
  || '","confidence":' || CASE WHEN doc_id % 7 = 3 THEN '"high"' ELSE CAST(doc_id % 3 AS STRING) || '.' || CAST(doc_id % 10 AS STRING) END || ',"horizon_days":' || CAST(doc_id % 300 AS STRING)
  || ',"citations":[{"source_id":"NEWS:' || CAST(doc_id + 1 AS STRING) || '"}' || CASE WHEN doc_id % 3 > 0 THEN ',{"source_id":"NEWS:' || CAST(doc_id AS STRING) || '","claim":"c"},"NEWS:' || CAST(doc_id AS STRING) || '"' ELSE '' END || ']}' END"""
MEMOS = f"mm AS (SELECT doc_id, 'Brand#' || (1 + doc_id % 25)::VARCHAR AS symbol, {MEMO} AS raw FROM documents)"


def _memos(spark, d):
    return fx.news(spark, d).select("doc_id", "symbol", F.expr(MEMO).alias("raw"))


def _checked(spark, d):
    catalog = fx.news(spark, d).select("symbol", F.concat(F.lit("NEWS:"), "doc_id").alias("source_id"))
    return memos.validate_memos(_memos(spark, d), catalog, "doc_id")


CHECKED = f"""{MEMOS}, mj AS (SELECT doc_id, symbol, raw, CASE WHEN json_valid(raw) THEN raw END AS j FROM mm), mo AS (SELECT *, CASE WHEN json_type(j) = 'OBJECT' THEN j END AS o FROM mj),
mc AS (SELECT doc_id, symbol, unnest(json_extract(o, '$.citations[*]')) AS c, unnest(range(len(json_extract(o, '$.citations[*]')))) AS pos FROM mo WHERE o IS NOT NULL),
ms AS (SELECT doc_id, symbol, pos, CASE WHEN json_type(c) = 'OBJECT' THEN c->>'$.source_id' ELSE c->>'$' END AS sid FROM mc),
mk AS (SELECT ms.doc_id, string_agg(sid, ',' ORDER BY pos) AS found FROM ms JOIN mm k ON sid = 'NEWS:' || k.doc_id::VARCHAR AND k.symbol = ms.symbol GROUP BY 1),
mv AS (SELECT mo.doc_id, symbol, o, found, lower(coalesce(o->>'$.stance', 'neutral')) AS stance, try_cast(o->>'$.confidence' AS DOUBLE) AS conf, try_cast(o->>'$.horizon_days' AS DOUBLE) AS hz FROM mo LEFT JOIN mk USING (doc_id)),
me AS (SELECT *, CASE WHEN o IS NULL THEN 'memo missing' WHEN conf IS NULL OR hz IS NULL THEN 'invalid confidence or horizon' ELSE concat_ws(',', CASE WHEN stance NOT IN ('attractive', 'neutral', 'avoid') THEN 'invalid stance' END,
  CASE WHEN stance <> 'neutral' AND found IS NULL THEN 'directional memo has no verified citation' END) END AS errors FROM mv),
checked AS (SELECT doc_id, symbol, errors, CASE WHEN errors = '' THEN stance END AS stance, CASE WHEN errors = '' THEN least(greatest(conf, 0), 1) END AS confidence, CASE WHEN errors = '' THEN least(greatest(hz, 1), 180)::INT END AS horizon_days,
  CASE WHEN errors = '' THEN coalesce(found, '') END AS citations FROM me)"""
register(
    "sc14_validate_memos",
    lambda spark, d: _checked(spark, d).withColumns({"errors": F.array_join("errors", ","), "citations": F.array_join("citations", ",")}),
    f"WITH {CHECKED} SELECT * FROM checked",
)

#: A hypothesis of each event: no thesis in some, a stance without a direction, tickers in small letters.
HYPOTHESIS = """CASE WHEN event_id % 17 = 5 THEN 'thesis' ELSE '{"thesis":"' || CASE WHEN event_id % 6 = 1 THEN '' ELSE 't' END || '","stances":[{"symbol":" ' || chr(CAST(97 + user_id % 26 AS INT)) || '","direction":"' || CASE event_id % 3 WHEN 0 THEN 'long' WHEN 1 THEN 'avoid' ELSE 'up' END
  || '","conviction":' || CAST(event_id % 2 AS STRING) || '.' || CAST(event_id % 10 AS STRING) || ',"horizon_days":' || CAST(user_id % 60 AS STRING) || '},{"symbol":"' || chr(CAST(65 + event_id % 26 AS INT)) || '","direction":"long","conviction":"0.5","horizon_days":10},{"symbol":"9","direction":"long","conviction":1,"horizon_days":9},{"direction":"long"}],"watchlist":["'
  || chr(CAST(97 + event_id % 26 AS INT)) || '","A.B","' || chr(CAST(97 + event_id % 26 AS INT)) || '","' || chr(CAST(65 + user_id % 26 AS INT)) || 'Q","?"]}' END"""


def _hypotheses(spark, d):
    return fx.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("activated_at"), F.when(F.col("event_type") == "error", "north_star").otherwise("short_term").alias("tier"), F.expr(HYPOTHESIS).alias("raw"))


def _letters(spark, d):
    """The known tickers: a letter for each user of a purchase in the upper half of values."""
    return fx.table(spark, d, "events").where("event_type = 'purchase' and value > 100").select(F.expr("chr(CAST(65 + user_id % 16 AS INT))").alias("symbol")).distinct()


def _stances(spark, d):
    return memos.validate_stances(_hypotheses(spark, d), _letters(spark, d))


STANCED = f"""hy AS (SELECT event_id AS id, ts AS activated_at, CASE WHEN event_type = 'error' THEN 'north_star' ELSE 'short_term' END AS tier, {HYPOTHESIS} AS raw FROM events),
kn AS (SELECT DISTINCT chr(CAST(65 + user_id % 16 AS INT)) AS symbol FROM events WHERE event_type = 'purchase' AND value > 100),
hv AS (SELECT * FROM hy WHERE json_valid(raw)), ho AS (SELECT * FROM hv WHERE coalesce(raw->>'$.thesis', '') <> ''),
s1 AS (SELECT id, unnest(json_extract(raw, '$.stances[*]')) AS s, unnest(range(len(json_extract(raw, '$.stances[*]')))) AS pos FROM ho WHERE tier <> 'north_star'),
s2 AS (SELECT id, pos, upper(trim(s->>'$.symbol')) AS symbol, s->>'$.direction' AS direction, try_cast(s->>'$.conviction' AS DOUBLE) AS c, try_cast(s->>'$.horizon_days' AS DOUBLE) AS h FROM s1),
s3 AS (SELECT id, pos, symbol, direction, least(greatest(c, 0), 1) AS conviction, least(greatest(h, 3), 40)::INT AS horizon_days FROM s2 WHERE c IS NOT NULL AND h IS NOT NULL AND regexp_matches(symbol, '^[A-Z][A-Z.\\-]{{0,5}}$') AND direction IN ('long', 'avoid')),
w1 AS (SELECT id, unnest(json_extract_string(raw, '$.watchlist[*]')) AS w, unnest(range(len(json_extract_string(raw, '$.watchlist[*]')))) AS pos FROM ho WHERE tier <> 'north_star'),
w2 AS (SELECT id, upper(trim(w)) AS symbol, min(pos) AS pos FROM w1 WHERE regexp_matches(upper(trim(w)), '^[A-Z][A-Z.\\-]{{0,5}}$') AND upper(trim(w)) NOT IN (SELECT symbol FROM kn) GROUP BY 1, 2)"""
register(
    "sc15_validate_stances",
    lambda spark, d: _stances(spark, d).select("id", "tier", F.expr("array_join(transform(stances, s -> concat_ws(':', s.symbol, s.direction, CAST(round(s.conviction * 100) AS INT), s.horizon_days)), ',')").alias("stances"), F.array_join("watchlist", ",").alias("watchlist")),
    f"""WITH {STANCED}, sl AS (SELECT id, string_agg(concat_ws(':', symbol, direction, round(conviction * 100)::INT, horizon_days), ',' ORDER BY pos) AS stances FROM s3 GROUP BY 1), wl AS (SELECT id, string_agg(symbol, ',' ORDER BY pos) AS watchlist FROM w2 GROUP BY 1)
SELECT id, tier, coalesce(stances, '') AS stances, coalesce(watchlist, '') AS watchlist FROM ho LEFT JOIN sl USING (id) LEFT JOIN wl USING (id)""",
)
#: A mandate of each event: expiries in the past and without sense, tilts of three kinds, some without their own confidence.
MANDATE = """'{"thesis":"' || CASE WHEN event_id % 9 = 2 THEN ' ' ELSE 't' END || '","confidence":' || CAST(event_id % 2 AS STRING) || '.' || CAST(user_id % 10 AS STRING) || ',"horizon_days":' || CAST(event_id % 400 AS STRING) || ',"expiry":"' || CASE event_id % 4 WHEN 0 THEN 'soon' WHEN 1 THEN '2023-05-01 00:00:00' ELSE '2024-06-01 00:00:00' END
  || '","favored_themes":["a",{"text":"b"},"a"," "],"favored_symbols":["' || chr(CAST(97 + user_id % 26 AS INT)) || '",{"symbol":"' || chr(CAST(65 + event_id % 26 AS INT)) || '"},"' || chr(CAST(65 + user_id % 26 AS INT)) || '"],"portfolio_tilts":[{"symbol":"' || chr(CAST(65 + event_id % 26 AS INT)) || '","direction":"'
  || CASE event_id % 3 WHEN 0 THEN 'Favor' WHEN 1 THEN 'avoid' ELSE 'hold' END || '"},{"symbol":"' || chr(CAST(65 + user_id % 26 AS INT)) || '","direction":"favor","confidence":7}]}'"""


def _mandates(spark, d):
    raw = fx.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("created_at"), F.expr(MANDATE).alias("raw"))
    m = memos.validate_mandates(raw, _letters(spark, d))
    tilts = F.expr("array_join(transform(tilts, s -> concat_ws(':', s.symbol, s.direction, CAST(round(s.confidence * 100) AS INT))), ',')")
    return m.select("id", "confidence", "horizon_days", F.unix_seconds("expires_at").alias("expires"), F.array_join("themes", ",").alias("themes"), F.array_join("favored", ",").alias("favored"), F.coalesce(tilts, F.lit("")).alias("tilts"))


register(
    "sc16_validate_mandates",
    _mandates,
    f"""WITH kn AS (SELECT DISTINCT chr(CAST(65 + user_id % 16 AS INT)) AS symbol FROM events WHERE event_type = 'purchase' AND value > 100), m0 AS (SELECT event_id AS id, ts, {MANDATE} AS raw FROM events), m AS (SELECT *, least(greatest((raw->>'$.confidence')::DOUBLE, 0), 1) AS confidence FROM m0 WHERE trim(raw->>'$.thesis') <> ''),
f1 AS (SELECT id, unnest(json_extract(raw, '$.favored_symbols[*]')) AS s, unnest([0, 1, 2]) AS pos FROM m), f2 AS (SELECT id, upper(CASE WHEN json_type(s) = 'OBJECT' THEN s->>'$.symbol' ELSE s->>'$' END) AS symbol, min(pos) AS pos FROM f1 GROUP BY 1, 2),
fl AS (SELECT id, string_agg(symbol, ',' ORDER BY pos) AS favored FROM f2 JOIN kn USING (symbol) GROUP BY 1),
t1 AS (SELECT id, confidence, unnest(json_extract(raw, '$.portfolio_tilts[*]')) AS s, unnest([0, 1]) AS pos FROM m),
tl AS (SELECT id, string_agg(concat_ws(':', s->>'$.symbol', lower(s->>'$.direction'), round(100 * least(coalesce((s->>'$.confidence')::DOUBLE, confidence), 1))::INT), ',' ORDER BY pos) AS tilts FROM t1 WHERE lower(s->>'$.direction') IN ('favor', 'avoid') AND s->>'$.symbol' IN (SELECT symbol FROM kn) GROUP BY 1)
SELECT id, confidence, least(greatest((raw->>'$.horizon_days')::INT, 3), 180) AS horizon_days, epoch(date_trunc('second', CASE WHEN try_cast(raw->>'$.expiry' AS TIMESTAMP) > ts THEN try_cast(raw->>'$.expiry' AS TIMESTAMP) ELSE ts + INTERVAL 30 DAY END))::BIGINT AS expires,
  'a,b' AS themes, coalesce(favored, '') AS favored, coalesce(tilts, '') AS tilts FROM m LEFT JOIN fl USING (id) LEFT JOIN tl USING (id)""",
)
VIEW = """CASE WHEN doc_id % 13 = 6 THEN 'none' ELSE '{"direction":"' || CASE doc_id % 5 WHEN 0 THEN 'long' WHEN 1 THEN 'avoid' WHEN 2 THEN 'neutral' WHEN 3 THEN 'short' ELSE 'long' END || '","conviction":' || CASE WHEN doc_id % 11 = 3 THEN 'null' ELSE CAST(doc_id % 2 AS STRING) || '.' || CAST(doc_id % 10 AS STRING) END
  || CASE WHEN doc_id % 7 = 0 THEN '' ELSE ',"horizon_days":' || CAST(doc_id % 120 AS STRING) END || ',"red_flags":["' || source || '","b","c","d","e"]}' END"""
register(
    "sc17_validate_views",
    lambda spark, d: memos.validate_views(fx.table(spark, d, "documents").select("doc_id", F.expr(VIEW).alias("raw"))).withColumn("red_flags", F.array_join("red_flags", ",")),
    f"""WITH r AS (SELECT doc_id, source, {VIEW} AS raw FROM documents), v AS (SELECT doc_id, source, raw->>'$.direction' AS direction, try_cast(raw->>'$.conviction' AS DOUBLE) AS c, try_cast(raw->>'$.horizon_days' AS INT) AS h FROM (SELECT * FROM r WHERE json_valid(raw)))
SELECT doc_id, direction, least(greatest(c, 0), 1) AS conviction, least(greatest(coalesce(h, 40), 10), 90) AS horizon_days, source || ',b,c,d' AS red_flags FROM v WHERE direction IN ('long', 'avoid') AND least(greatest(c, 0), 1) >= 0.3""",
)
register(
    "sc19_veto_reason",
    lambda spark, d: fx.news(spark, d).select("doc_id", memos.veto_reason(F.split("body", "\n")).alias("reason")),
    "SELECT doc_id, substr(trim(regexp_extract(string_split(text, chr(10))[1], '^[^(:]*')), 1, 60) AS reason FROM documents",
)


def _active(spark, d):
    h = _stances(spark, d).where("tier = 'short_term'")
    bars = fx.bars(spark, d, "p_brand", False).select(F.expr("chr(CAST(64 + CAST(substring(symbol, 7) AS INT) AS INT))").alias("symbol"), "d", "close", F.when(F.col("high") > F.col("low"), (F.col("high") - F.col("low")) / F.col("close")).alias("atr_pct"))
    decisions = fx.order_events(spark, d).select(F.date_trunc("hour", "ts").alias("as_of"))
    out = memos.hypothesis_stances(h, decisions, bars)
    return rounded(out.withColumn("as_of", F.unix_seconds("as_of")), "score", "expected_return", "expected_volatility")


register(
    "sg15_hypothesis_stances",
    _active,
    f"""WITH {STANCED}, {BRAND}, dc AS (SELECT DISTINCT date_trunc('hour', ts) AS as_of FROM events), a AS (SELECT as_of, max((activated_at, id)) AS h FROM dc JOIN ho ON tier = 'short_term' AND activated_at <= as_of GROUP BY 1),
b AS (SELECT chr((64 + substr(symbol, 7)::INT)::INT) AS symbol, arg_max(close, d) AS close, arg_max(CASE WHEN high > low THEN (high - low) / close ELSE 0.02 END, d) AS atr FROM bars WHERE d < DATE '2024-01-01' GROUP BY 1)
SELECT epoch(as_of)::BIGINT AS as_of, s3.symbol, id, direction, round(conviction, 6) AS score, horizon_days, round(CASE WHEN direction = 'long' THEN 1 ELSE -1 END * conviction * atr * sqrt(horizon_days) * 0.5, 6) AS expected_return, round(atr * sqrt(horizon_days), 6) AS expected_volatility
FROM a JOIN s3 ON s3.id = h[2] JOIN b ON b.symbol = s3.symbol WHERE conviction > 0""",
)
