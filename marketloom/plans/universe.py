"""Queries of readers and of the universe."""

from __future__ import annotations

from html import unescape
from html.entities import html5

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketloom.functions.columns import rounded
from marketloom.functions.tables import register_tables
from marketloom.operators import redaction as red
from marketloom.operators import universe as uni
from marketloom.registry import register
from marketloom.sources import fixtures as fx
from marketloom.sources.fixtures import shared_path
from marketloom.sources.jsonl_sink import register_sink

BRAND = fx.bars_sql("p_brand", benchmark=False)
PAIR = fx.bars_sql("p_brand || '/' || p_type", benchmark=False)


def _write(df, label, **options):
    path = shared_path(df.sparkSession, label)
    df.write.options(**options).csv(path)
    return path


def _daily(spark, d):
    """Bars written as CSV by symbol and read back; odd days lack a volume, some a close."""
    b = fx.bars(spark, d, "p_brand", False).select("symbol", F.col("d").alias("Date"), F.col("open").alias("Open"), F.col("high").alias("High"), F.col("low").alias("Low"), F.when(F.dayofmonth("d") != 13, F.col("close")).alias("Close"), F.when(F.dayofmonth("d") % 2 == 0, F.col("volume")).alias("Volume"))
    path = shared_path(spark, "src1")
    b.repartition("symbol").write.partitionBy("symbol").option("header", True).csv(path)
    return rounded(uni.read_daily_csv(spark, path), "open", "high", "low", "close")


register(
    "src1_daily_csv",
    _daily,
    f"WITH {BRAND} SELECT symbol, d, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, CASE WHEN day(d) % 2 = 0 THEN volume ELSE 0 END::DOUBLE AS volume FROM bars WHERE day(d) <> 13",
)


def _vol_csv(spark, d):
    b = fx.bars(spark, d, "p_brand").where("symbol = 'ALL'")
    path = _write(b.select(F.date_format("d", "M/d/yyyy").alias("DATE"), F.when(F.dayofmonth("d") % 3 > 0, F.col("open")).alias("OPEN"), F.when(F.dayofmonth("d") != 13, F.col("close")).alias("VIX")), "src2", header=True)
    return rounded(uni.read_vol_csv(spark, path, "^VIX"), "open", "high", "low", "close")


register(
    "src2_vol_csv",
    _vol_csv,
    f"WITH {fx.bars_sql('p_brand')} SELECT '^VIX' AS symbol, d, round(CASE WHEN day(d) % 3 > 0 THEN open ELSE close END, 6) AS open, round(close, 6) AS high, round(close, 6) AS low, round(close, 6) AS close, 0.0::DOUBLE AS volume FROM bars WHERE symbol = 'ALL' AND day(d) <> 13",
)
ENDING = "CASE p_size % 9 WHEN 0 THEN ' Warrants' WHEN 1 THEN ' Preferred Stock' WHEN 2 THEN ' ADR' WHEN 3 THEN ' Depositary Shares' ELSE ' Common Stock' END"


def _directory(spark, d):
    p = fx.table(spark, d, "part")
    symbol = F.when(F.col("p_partkey") % 23 == 0, F.concat(F.lit("9"), "p_partkey")).otherwise(F.concat(F.lit(" p"), "p_partkey"))
    rows = p.select(symbol.alias("Symbol"), F.concat("p_brand", F.expr(ENDING)).alias("Security Name"), F.when(F.col("p_size") % 10 == 0, "Y").otherwise("N").alias("Test Issue"), F.when(F.col("p_size") % 11 == 0, "Y").otherwise("N").alias("ETF"), F.when(F.col("p_partkey") % 2 == 0, "NYSE").alias("Exchange"))
    return uni.read_listings(spark, _write(rows, "src3", header=True, sep="|", ignoreLeadingWhiteSpace=False))


LIST = f"""lst AS (SELECT 'P' || p_partkey AS symbol, p_brand || {ENDING} AS name, CASE WHEN p_partkey % 2 = 0 THEN 'NYSE' ELSE 'NASDAQ' END AS exchange,
  CASE WHEN p_size % 9 IN (2, 3) THEN 'adr' ELSE 'common' END AS security_type, p_size % 9 IN (2, 3) AS is_adr FROM part WHERE p_partkey % 23 <> 0 AND p_size % 9 > 1 AND p_size % 10 <> 0 AND p_size % 11 <> 0)"""
register("src3_listings", _directory, f"WITH {LIST} SELECT * FROM lst")


def _facts_json(spark, d):
    """One JSON document for each issuer; every row stands twice, once with another accession."""
    f = fx.filing_facts(spark, d)
    entry = F.struct(F.col("filed").cast("string").alias("filed"), F.when(F.month("filed") == 2, F.col("period_end").cast("string")).alias("end"), F.round("value", 2).alias("val"), "form", F.lit("a").alias("accn"))
    rows = f.groupBy("cik", "tag").agg(F.collect_list(entry).alias("r"))
    units = F.struct(F.create_map(F.lit("USD"), F.concat("r", F.transform("r", lambda e: e.withField("accn", F.lit("b")).withField("val", e["val"] + 1)))).alias("units"))
    tags = rows.groupBy("cik").agg(F.map_from_entries(F.collect_list(F.struct("tag", units))).alias("m"))
    return tags.select("cik", F.to_json(F.struct(F.create_map(F.lit("us-gaap"), "m").alias("facts"))).alias("body"))


WANTED = ["1-URGENT", "2-HIGH", "5-LOW"]
register(
    "src4_explode_facts",
    lambda spark, d: uni.explode_facts(_facts_json(spark, d), WANTED).select("cik", "tag", "period_end", "filed", "value", "unit", "form", "accession"),
    EXPLODED := f"WITH {fx.FACTS_SQL} SELECT cik::VARCHAR AS cik, tag, period_end, filed::DATE AS filed, round(value, 2) AS value, 'USD' AS unit, form, 'a' AS accession FROM facts WHERE tag IN ('1-URGENT', '2-HIGH', '5-LOW')",
)


def _facts_sql(spark, d):
    """The same through the table function, from SQL."""
    register_tables(spark)
    return spark.sql(
        """SELECT cik, tag, period_end, filed, min_by(value, (accession, value)) AS value, unit, min_by(form, (accession, value)) AS form, min(accession) AS accession
        FROM (SELECT CAST(d.cik AS STRING) AS cik, f.* FROM {docs} d, LATERAL facts(d.body, array('1-URGENT', '2-HIGH', '5-LOW')) f) GROUP BY cik, tag, period_end, filed, unit""",
        docs=_facts_json(spark, d),
    )


register("u5_facts", _facts_sql, EXPLODED)


def _catalog(spark, d):
    p = fx.table(spark, d, "part")
    before = p.where("p_size < 20").select(F.concat(F.lit("P"), "p_partkey").alias("symbol"), F.lit("0").alias("cik"), F.lit("1999-01-01").cast("date").alias("first_seen"), F.lit("1999-06-01").cast("date").alias("last_seen"))
    listed = p.where("p_size >= 15").select(F.concat(F.lit("P"), "p_partkey").alias("symbol"))
    tickers = fx.table(spark, d, "supplier").select(F.concat(F.lit("P"), "s_suppkey").alias("symbol"), F.col("s_nationkey").cast("string").alias("cik"))
    return uni.refresh_catalog(before, listed, tickers, "2000-01-01")


register(
    "src5_refresh_catalog",
    _catalog,
    """SELECT 'P' || p_partkey AS symbol, CASE WHEN p_size >= 15 THEN s_nationkey::VARCHAR ELSE '0' END AS cik, p_size >= 15 AS active, CASE WHEN p_size < 20 THEN DATE '1999-01-01' ELSE DATE '2000-01-01' END AS first_seen,
  CASE WHEN p_size >= 15 THEN DATE '2000-01-01' ELSE DATE '1999-06-01' END AS last_seen FROM part LEFT JOIN supplier ON s_suppkey = p_partkey""",
)
register(
    "src8_asof_tail",
    lambda spark, d: rounded(uni.asof_tail(fx.bars(spark, d, "p_brand", False), "1996-06-30", 60).select("symbol", "d", "close", "age"), "close"),
    f"WITH {BRAND} SELECT symbol, d, round(close, 6) AS close, age FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY d DESC) AS age FROM bars WHERE d <= DATE '1996-06-30') WHERE age <= 60",
)


def _headed(spark, d):
    p = fx.table(spark, d, "pages")
    heads = F.when(F.col("page_id") % 4 > 0, F.concat(F.lit("<p>Item 1. Item 7: Item 1A - short</p><style>item 8. no</style><h2>ITEM&nbsp;7a. risk &amp; rates</h2> Item&#32;1:"), F.coalesce("html", F.lit("")), F.lit("<b>Item 2.</b> end"))).otherwise(F.col("html"))
    return p.select("page_id", heads.alias("html"))


def _filings(spark, d):
    return uni.filing_sections(_headed(spark, d)).select("page_id", "section", F.char_length("body").alias("chars"), "sha256")


def _sections_sql(spark, d):
    register_tables(spark)
    return spark.sql("SELECT p.page_id, s.section, char_length(s.body) AS chars, s.sha256 FROM {pages} p, LATERAL sections(p.html) s", pages=_headed(spark, d))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


#: HTML's named references, those that count without a semicolon, and numbers that do not stand for themselves.
NAMES = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in html5.items())
LEGACY = "|".join(sorted((k for k in html5 if not k.endswith(";")), key=len, reverse=True))
ODD = {n: unescape(f"&#{n};") for n in (*range(0xA0), *range(0xFDD0, 0xFDF0), *(p << 16 | q for p in range(17) for q in (0xFFFE, 0xFFFF)))}
NUMBERS = ", ".join(f"({n}, {_quoted(c)})" for n, c in ODD.items() if c != chr(n))
#: From ``a`` (page_id, t0), ``d``: the texts with every reference replaced, each once, as browsers do.
DECODED = rf"""names(name, c) AS (VALUES {NAMES}), numbers(n, c) AS (VALUES {NUMBERS}),
d1 AS (SELECT page_id, unnest(string_split(t0, '&')) AS part, unnest(range(len(string_split(t0, '&')))) AS k FROM a),
d2 AS (SELECT *, CASE WHEN k > 0 THEN regexp_extract(part, '^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{{1,32}};?)', 1) ELSE '' END AS ref FROM d1),
d3 AS (SELECT *, regexp_extract(ref, '^({LEGACY})', 1) AS old, CASE WHEN ref[1] = '#' THEN ltrim(regexp_extract(ref, '([0-9a-fA-F]+)', 1), '0') END AS digits FROM d2),
d4 AS (SELECT *, CASE WHEN length(digits) > 7 THEN 1114112 WHEN digits = '' THEN 0 WHEN lower(ref[2]) = 'x' THEN ('0x' || digits)::BIGINT ELSE digits::BIGINT END AS num FROM d3),
d AS (SELECT page_id, string_agg(CASE WHEN k = 0 THEN part WHEN ref = '' THEN '&' || part ELSE
    CASE WHEN num IS NULL THEN coalesce(whole.c, begun.c || substr(ref, length(old) + 1), '&' || ref)
      WHEN odd.n IS NOT NULL THEN odd.c WHEN num BETWEEN 55296 AND 57343 OR num > 1114111 THEN chr(65533) ELSE chr(num::INT) END || substr(part, length(ref) + 1) END, '' ORDER BY k) AS t0
  FROM d4 LEFT JOIN names whole ON whole.name = ref LEFT JOIN names begun ON begun.name = old LEFT JOIN numbers odd ON odd.n = num GROUP BY 1)"""
register(
    "src11_filing_sections",
    _filings,
    SECTIONS := rf"""WITH h AS (SELECT page_id, CASE WHEN page_id % 4 > 0 THEN '<p>Item 1. Item 7: Item 1A - short</p><style>item 8. no</style><h2>ITEM&nbsp;7a. risk &amp; rates</h2> Item&#32;1:' || coalesce(html, '') || '<b>Item 2.</b> end' ELSE coalesce(html, '') END AS html FROM pages),
a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?>.*?</script>', ' ', 'g'), '(?is)<style.*?>.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g') AS t0 FROM h),
{DECODED},
b AS (SELECT page_id, trim(regexp_replace(t0, '[\s\x0B\x{{A0}}]+', ' ', 'g')) AS t FROM d),
m AS (SELECT page_id, t, regexp_replace(t, '(?i)\b(item\s+(?:1a|1b|1c|1|2|3|7a|7|8)\s*[.:-])', chr(1) || '\1', 'g') AS s FROM b),
p AS (SELECT page_id, t, unnest(string_split(s, chr(1))) AS part, unnest(range(len(string_split(s, chr(1))))) AS k FROM m),
q AS (SELECT page_id, t, k, part AS body, lower(regexp_extract(part, '^(?i)item\s+(1a|1b|1c|1|2|3|7a|7|8)\s*[.:-]', 1)) AS name FROM p),
r AS (SELECT page_id, name, arg_max(body, (length(body), -k)) AS body, max(t) AS t FROM q GROUP BY 1, 2),
z AS (SELECT *, max((name <> '')::INT) OVER (PARTITION BY page_id) AS has FROM r),
o AS (SELECT page_id, CASE WHEN has = 0 THEN 'document' ELSE 'item_' || name END AS section, CASE WHEN has = 0 THEN t ELSE body END AS body FROM z WHERE has = 0 OR name <> '')
SELECT page_id, section, length(body) AS chars, sha256(body) AS sha256 FROM o""",
)
register("u5_sections", _sections_sql, SECTIONS)
register(
    "src15_coverage",
    lambda spark, d: rounded(uni.coverage(fx.table(spark, d, "supplier").select(F.col("s_suppkey").alias("cik")), fx.filing_facts(spark, d).where("tag = '5-LOW' and year(period_end) = 1997")), "share"),
    f"WITH {fx.FACTS_SQL} SELECT count(*) AS issuers, count(f.cik) AS with_facts, round(count(f.cik) / count(*), 6) AS share FROM supplier LEFT JOIN (SELECT DISTINCT cik FROM facts WHERE tag = '5-LOW' AND year(period_end) = 1997) f ON f.cik = s_suppkey",
)


def _due(spark, d):
    p = fx.table(spark, d, "part")
    symbol = F.concat(F.lit("P"), "p_partkey").alias("symbol")
    inst = p.select(symbol, (F.col("p_size") % 5 > 0).alias("active"), F.when(F.col("p_size") % 7 > 0, F.col("p_size").cast("string")).alias("cik"))
    member = p.where("p_size % 3 = 0").select(symbol, (F.col("p_partkey") % 100).alias("rank"))
    tried = p.where("p_size % 4 > 0").select(symbol, F.when(F.col("p_size") % 2 == 0, "completed").otherwise("failed").alias("status"), F.date_sub(F.lit("2000-01-31").cast("date"), F.col("p_size").cast("int") % 15).alias("at"))
    return uni.refresh_due(inst, member, tried, "2000-01-31")


register(
    "src17_refresh_due",
    _due,
    """WITH x AS (SELECT 'P' || p_partkey AS symbol, p_size::VARCHAR AS cik, CASE WHEN p_size % 3 = 0 THEN p_partkey % 100 END AS rank, CASE WHEN p_size % 4 > 0 THEN CASE WHEN p_size % 2 = 0 THEN 'completed' ELSE 'failed' END END AS status,
  CASE WHEN p_size % 4 > 0 THEN DATE '2000-01-31' - (p_size % 15)::INT END AS "at" FROM part WHERE p_size % 5 > 0 AND p_size % 7 > 0)
SELECT * FROM x WHERE x.at IS NULL OR (status = 'completed' AND datediff('day', x.at, DATE '2000-01-31') >= 7) OR (status = 'failed' AND x.at < DATE '2000-01-31')""",
)


#: Records as they are logged: secrets under names at any depth, as objects, lists and scalars.
_BODY = """CASE id % 5 WHEN 0 THEN '{broken ' || id
WHEN 1 THEN '{"a": {"api_key": "k\\\\"' || id || '", "n": ' || id || '}, "Password": ' || id || ', "text": "token"}'
WHEN 2 THEN '{"token": {"value": "' || id || '", "more": [1, {"x": 2}]}, "list": [{"Secret_2": [["p' || id || '"]]}, ' || id || ']}'
WHEN 3 THEN '[{"account_number": null, "note": "say \\\\"token\\\\": ' || id || '"}, [[{"cookies": ["' || id || '"], "side": "' || side || '"}]]]'
ELSE '{"symbol": "' || symbol || '", "refresh_token": true, "tok\\\\u0065n": "' || id || '", "s": 1.50}' END"""


def _secrets(spark, d):
    e = fx.order_events(spark, d).selectExpr("id", f"{_BODY} AS body")
    return e.select("id", red.redact_json(F.col("body")).alias("body"))


register(
    "src16_redact_json",
    _secrets,
    # the masked text, shape by shape
    f"""WITH {fx.ORDER_EVENTS_SQL} SELECT id, CASE id % 5 WHEN 0 THEN '{{"redacted":"malformed"}}'
WHEN 1 THEN '{{"a": {{"api_key": "[redacted]", "n": ' || id || '}}, "Password": "[redacted]", "text": "token"}}'
WHEN 2 THEN '{{"token": "[redacted]", "list": [{{"Secret_2": "[redacted]"}}, ' || id || ']}}'
WHEN 3 THEN '[{{"account_number": "[redacted]", "note": "say \\"token\\": ' || id || '"}}, [[{{"cookies": "[redacted]", "side": "' || side || '"}}]]]'
ELSE '{{"symbol": "' || symbol || '", "refresh_token": "[redacted]", "tok\\u0065n": "[redacted]", "s": 1.50}}' END AS body FROM oe""",
)


def _sink(spark, d):
    """Order records appended to the sink in two goes, and read back as lines."""
    register_sink(spark)
    path = fx.shared_path(spark, "audit")
    e = fx.order_events(spark, d).selectExpr("id", "side", f"{_BODY} AS payload", "concat('order of ', symbol, ' token=abcdef', id) AS note", "symbol AS account_number")
    for part in (e.where("side = 'buy'"), e.where("side <> 'buy'")):
        part.write.format("redacted_jsonl").option("json", "payload").option("text", "note").mode("append").save(path)
    lines = spark.read.text(path, pathGlobFilter="*.jsonl")
    get = lambda p: F.get_json_object("value", p)
    return lines.select(get("$.id").cast("long").alias("id"), get("$.side").alias("side"), get("$.note").alias("note"), get("$.account_number").alias("account_number"), F.coalesce(get("$.payload.redacted"), F.lit("ok")).alias("state"), get("$.payload.a.n").cast("long").alias("n"), get("$.payload.token").alias("token"))


register(
    "src16_redacting_sink",
    _sink,
    f"""WITH {fx.ORDER_EVENTS_SQL} SELECT id, side, 'order of ' || symbol || ' [redacted]' AS note, '[redacted]' AS account_number, CASE id % 5 WHEN 0 THEN 'malformed' ELSE 'ok' END AS state,
  CASE id % 5 WHEN 1 THEN id END AS n, CASE id % 5 WHEN 2 THEN '[redacted]' WHEN 4 THEN '[redacted]' END AS token FROM oe""",
)


def _pairs(spark, d):
    li, p = fx.table(spark, d, "lineitem"), fx.table(spark, d, "part").withColumn("pair", F.concat_ws("/", "p_brand", "p_type"))
    u = F.col("l_extendedprice") / F.col("l_quantity")
    g = li.join(p, li.l_partkey == p.p_partkey).groupBy(F.col("pair").alias("symbol"), F.to_date("l_shipdate").alias("d"))
    return g.agg(fx.damped(F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"), F.sum("l_quantity").alias("volume"), F.max(u).alias("u")).drop("u")


LIQ = f"""{PAIR}, k AS (SELECT symbol, close, volume, row_number() OVER (PARTITION BY symbol ORDER BY d DESC) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
liq AS (SELECT symbol, max(CASE WHEN k = 1 THEN close END) AS price, avg(CASE WHEN k <= 20 THEN close * volume END) AS dv, max(n) AS history, coalesce(max(CASE WHEN k = 1 THEN close END) / max(CASE WHEN k = 22 THEN close END) - 1, -9) AS mom FROM k GROUP BY 1)"""
register(
    "a1_liquidity",
    lambda spark, d: rounded(uni.liquidity(_pairs(spark, d)), "price", "dollar_volume", "momentum_21d"),
    f"WITH {LIQ} SELECT symbol, round(price, 6) AS price, round(dv, 6) AS dollar_volume, history, round(mom, 6) AS momentum_21d FROM liq",
)


def _tiers(spark, d):
    m = uni.liquidity(_pairs(spark, d)).withColumns({c: F.round(c, 6) for c in ("dollar_volume", "momentum_21d")})
    must = fx.table(spark, d, "part").where("p_size > 49").select(F.concat_ws("/", "p_brand", "p_type").alias("symbol"), F.col("p_partkey").alias("place"))
    return uni.tiers(m, must.groupBy("symbol").agg(F.min("place").alias("place")), 2_000.0, 2_500.0, 100, 60)


register(
    "a2_universe_tiers",
    _tiers,
    f"""WITH {LIQ}, l2 AS (SELECT symbol, price, round(dv, 6) AS dv, history, round(mom, 6) AS mom FROM liq), res AS (SELECT *, row_number() OVER (ORDER BY dv DESC, symbol) AS lr FROM (SELECT * FROM l2 WHERE price >= 5 AND dv >= 2000 ORDER BY dv DESC, symbol LIMIT 100)),
sc AS (SELECT *, row_number() OVER (ORDER BY mom DESC, lr) AS mr FROM res), must AS (SELECT p_brand || '/' || p_type AS symbol, min(p_partkey) AS place FROM part WHERE p_size > 49 GROUP BY 1),
act AS (SELECT symbol, 0 AS late, place AS a, 0 AS b FROM must UNION ALL SELECT symbol, 1, lr + mr, lr FROM sc WHERE history >= 260 AND dv >= 2500 AND symbol NOT IN (SELECT symbol FROM must)),
top AS (SELECT *, row_number() OVER (ORDER BY late, a, b, symbol) AS rank FROM act)
SELECT 'research' AS tier, lr AS rank, symbol, 'liquidity' AS reason FROM res UNION ALL SELECT 'active', rank, symbol, CASE WHEN late = 0 THEN 'mandatory' ELSE 'liquidity+momentum' END FROM top WHERE rank <= 60""",
)


def _snapshot(spark, d):
    """One and three months' return and ATR of each symbol's last date, with 64 bars or more."""
    from marketloom.operators import indicators as ind

    x = ind.atr_pct(ind.returns(fx.bars(spark, d, "p_brand", False), (21, 63)))
    x = x.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("symbol")))
    last = x.where("n >= 64").groupBy("symbol").agg(F.max_by(F.struct("r21", "r63", "atr_pct"), "d").alias("s"), F.max("d").alias("d"))
    return rounded(last.select("symbol", "d", "s.*"), "r21", "r63", "atr_pct")


register(
    "a26_universe_snapshot",
    _snapshot,
    f"""WITH {BRAND}, p AS (SELECT *, lag(close) OVER w AS pc, close / lag(close, 21) OVER w - 1 AS r21, close / lag(close, 63) OVER w - 1 AS r63, count(*) OVER (PARTITION BY symbol) AS n FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY d)),
t AS (SELECT *, avg(greatest(high - low, abs(high - pc), abs(low - pc))) OVER (PARTITION BY symbol ORDER BY d ROWS 13 PRECEDING) / close AS atr FROM p)
SELECT symbol, max(d) AS d, round(arg_max(r21, d), 6) AS r21, round(arg_max(r63, d), 6) AS r63, round(arg_max(atr, d), 6) AS atr_pct FROM t WHERE n >= 64 GROUP BY symbol""",
)
register(
    "j10_without_bars",
    lambda spark, d: fx.table(spark, d, "part").select("p_partkey").join(fx.table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti"),
    "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)",
)
