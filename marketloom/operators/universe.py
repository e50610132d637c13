"""Readers of listings, bars, facts and filings, and the universe made of them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.functions.tables import Sections

#: Listing names and symbols that count, sizes of the tiers.
BAD_NAME = r"(?i)\b(warrants?|rights?|units?|preferred|preference|beneficial interest)\b"
ADR_NAME = r"(?i)\b(ADR|ADS|depositary)\b"
SYMBOL = "^[A-Z][A-Z0-9.-]{0,9}$"
MIN_PRICE, RESEARCH_DOLLARS, TRADE_DOLLARS = 5.0, 1e7, 5e7
MIN_HISTORY, RESEARCH_SIZE, ACTIVE_SIZE = 260, 1500, 250

DAILY = "Date date, Open double, High double, Low double, Close double, Volume double"


def _symbol_of_file() -> Column:
    """The folder ``symbol=X`` of the file, or its bare name. Folder names are escaped once by
    the writer and once as part of a URI."""
    folder = F.regexp_extract(F.col("_metadata.file_path"), "symbol=([^/]+)/", 1)
    return F.when(folder != "", F.url_decode(F.url_decode(folder))).otherwise(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)\.csv[^/]*$", 1))


def read_daily_csv(spark: SparkSession, path: str) -> DataFrame:
    """Daily bars from CSV files, one or more a symbol. Rows without a close go, a volume that
    is missing is 0."""
    raw = spark.read.schema(DAILY).option("header", True).csv(path)
    x = raw.select(_symbol_of_file().alias("symbol"), *(F.col(c).alias(c.lower()) for c in raw.columns if c != "symbol"))
    return x.where("close is not null").withColumnRenamed("date", "d").withColumn("volume", F.coalesce("volume", F.lit(0.0)))


def read_vol_csv(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """A volatility index from CSV: headers in any case, the close from CLOSE or the column
    named like the symbol; missing prices are the close; no volume."""
    raw = spark.read.option("header", True).csv(path)
    by = {c.lower().strip(): c for c in raw.columns}
    named = by.get("close") or by[symbol.lower().lstrip("^")]

    def number(name: str) -> Column:
        return F.expr(f"try_cast(`{by[name]}` as double)") if name in by else F.lit(None).cast("double")

    close = F.expr(f"try_cast(`{named}` as double)")
    d = F.coalesce(F.try_to_date(by["date"], "M/d/yyyy"), F.try_to_date(by["date"], "yyyy-MM-dd"))
    x = raw.select(F.lit(symbol).alias("symbol"), d.alias("d"), *(F.coalesce(number(c), close).alias(c) for c in ("open", "high", "low")), close.alias("close"), F.lit(0.0).alias("volume"))
    return x.where("close is not null and d is not null")


def listings(raw: DataFrame, symbol_col: str = "Symbol") -> DataFrame:
    """Common shares of a listing directory (columns Symbol, Security Name, Test Issue, ETF,
    Exchange): no trailer, no test issues, funds, warrants and the like; receipts marked."""
    x = raw.select(F.upper(F.trim(symbol_col)).alias("symbol"), F.trim(F.coalesce("Security Name", F.lit(""))).alias("name"), F.coalesce("Exchange", F.lit("NASDAQ")).alias("exchange"), "Test Issue", "ETF")
    flag = lambda c: F.coalesce(F.col(c) == "Y", F.lit(False))
    x = x.where(F.col("symbol").rlike(SYMBOL) & ~flag("Test Issue") & ~flag("ETF") & ~F.col("name").rlike(BAD_NAME))
    adr = F.col("name").rlike(ADR_NAME)
    return x.select("symbol", "name", "exchange", F.when(adr, "adr").otherwise("common").alias("security_type"), adr.alias("is_adr"))


def read_listings(spark: SparkSession, path: str, other: bool = False) -> DataFrame:
    """``listings`` of a pipe-delimited directory file; the other exchanges' files name the
    symbol column differently."""
    return listings(spark.read.option("header", True).option("sep", "|").csv(path), "ACT Symbol" if other else "Symbol")


FACT = "map<string, map<string, struct<units: map<string, array<struct<filed: string, end: string, val: double, form: string, accn: string>>>>>>"


def explode_facts(docs: DataFrame, tags: list[str], cik: str = "cik", body: str = "body") -> DataFrame:
    """Facts of nested JSON documents (facts: taxonomy: tag: units: unit: rows), wanted tags
    only. Rows without a filing date, period or value go; of one key the first by filing
    date, accession and value stays."""
    x = docs.select(F.col(cik).cast("string").alias("cik"), F.explode(F.from_json(body, f"facts {FACT}")["facts"]).alias("taxonomy", "by_tag"))
    x = x.select("cik", F.explode("by_tag").alias("tag", "fact")).where(F.col("tag").isin(tags))
    x = x.select("cik", "tag", F.explode("fact.units").alias("unit", "rows")).select("cik", "tag", "unit", F.inline("rows"))
    x = x.where("filed is not null and end is not null and val is not null")
    x = x.select("cik", "tag", F.to_date("end").alias("period_end"), F.to_date("filed").alias("filed"), F.col("val").alias("value"), "unit", "form", F.col("accn").alias("accession"))
    w = Window.partitionBy("cik", "tag", "period_end", "filed", "unit").orderBy("accession", "value")
    return x.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def refresh_catalog(before: DataFrame, listed: DataFrame, tickers: DataFrame, today: str) -> DataFrame:
    """The instruments after a full refresh: listed ones are active and seen today, with an
    issuer if there is one; others of ``before`` stay, inactive."""
    now = F.lit(today).cast("date")
    fresh = listed.join(tickers.select("symbol", "cik"), "symbol", "left").select("symbol", F.col("cik").alias("new_cik"), F.lit(True).alias("seen"))
    x = before.select("symbol", "cik", "first_seen", "last_seen").join(fresh, "symbol", "full_outer")
    seen = F.coalesce("seen", F.lit(False))
    return x.select("symbol", F.when(seen, F.col("new_cik")).otherwise(F.col("cik")).alias("cik"), seen.alias("active"), F.least(F.col("first_seen"), F.when(seen, now)).alias("first_seen"), F.when(seen, now).otherwise(F.col("last_seen")).alias("last_seen"))


def asof_tail(bars: DataFrame, as_of: str, lookback: int) -> DataFrame:
    """The last ``lookback`` bars of each symbol at or before ``as_of``: nothing later is read."""
    w = Window.partitionBy("symbol").orderBy(F.desc("d"))
    x = bars.where(F.col("d") <= F.lit(as_of).cast("date"))
    return x.withColumn("age", F.row_number().over(w)).where(F.col("age") <= lookback)


def refresh_due(instruments: DataFrame, membership: DataFrame, attempts: DataFrame, today: str) -> DataFrame:
    """Active instruments with an issuer that were never tried, succeeded a week ago or more,
    or failed on an earlier day; in research order, then by symbol (``place``)."""
    now = F.lit(today).cast("date")
    x = instruments.where("active and cik is not null").join(membership.select("symbol", "rank"), "symbol", "left").join(attempts.select("symbol", "status", "at"), "symbol", "left")
    due = F.col("at").isNull() | ((F.col("status") == "completed") & (F.datediff(now, "at") >= 7)) | ((F.col("status") == "failed") & (F.col("at") < now))
    return x.where(due).select("symbol", "cik", "rank", "status", "at")


def due_order() -> list[Column]:
    return [F.col("rank").asc_nulls_last(), F.col("symbol")]


def coverage(instruments: DataFrame, facts: DataFrame) -> DataFrame:
    """Issuers, issuers with facts, and their share."""
    have = facts.select("cik").distinct().withColumn("has", F.lit(1))
    x = instruments.select("cik").where("cik is not null").distinct().join(have, "cik", "left")
    return x.agg(F.count(F.lit(1)).alias("issuers"), F.count("has").alias("with_facts")).withColumn("share", F.col("with_facts") / F.col("issuers"))


def filing_sections(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", most_chars: int | None = None) -> DataFrame:
    """A row for each item of a filing: the longest text under one of its headings (contents
    pages repeat them); ``document`` if there is no heading. ``most_chars`` cuts the result.

    A null page counts as empty. Of equally long texts the first in the document stays. A page is
    read once, in Arrow batches, in time linear in its length (``functions.tables.Sections``);
    entities are far too many for column functions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = Sections()
        for batch in batches:
            for k, page in enumerate(batch.column(1).to_pylist()):  # one page's sections at a time
                names, bodies, hashes = [], [], []
                for name, body, digest in one.eval(page):
                    if most_chars is not None:
                        body = body[:most_chars]
                        digest = hashlib.sha256(body.encode()).hexdigest()
                    names.append(name)
                    bodies.append(body)
                    hashes.append(digest)
                ids = batch.column(0).take(pa.array([k] * len(names)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(names), pa.array(bodies), pa.array(hashes)], [id_col, "section", "body", "sha256"])

    x = pages.select(F.col(id_col), F.col(html_col).cast("string").alias("__html"))
    return x.mapInArrow(run, f"{id_col} {x.schema[id_col].dataType.simpleString()}, section string, body string, sha256 string")


def liquidity(bars: DataFrame) -> DataFrame:
    """By symbol: last price, mean dollar volume of 20 sessions, number of bars, 21-session
    momentum (-9 with fewer than 22 bars). Lists of 22 bars at most come out of a ranking."""
    w = Window.partitionBy("symbol").orderBy(F.desc("d"))
    x = bars.withColumn("k", F.row_number().over(w)).withColumn("history", F.count(F.lit(1)).over(Window.partitionBy("symbol")))
    x = x.where("k <= 22").groupBy("symbol").agg(
        F.max(F.when(F.col("k") == 1, F.col("close"))).alias("price"), F.avg(F.when(F.col("k") <= 20, F.col("close") * F.col("volume"))).alias("dollar_volume"),
        F.max("history").alias("history"), F.max(F.when(F.col("k") == 22, F.col("close"))).alias("base"),
    )
    return x.withColumn("momentum_21d", F.coalesce(F.col("price") / F.col("base") - 1, F.lit(-9.0))).drop("base")


def tiers(metrics: DataFrame, mandatory: DataFrame, research_dollars: float = RESEARCH_DOLLARS, trade_dollars: float = TRADE_DOLLARS, research_size: int = RESEARCH_SIZE, active_size: int = ACTIVE_SIZE) -> DataFrame:
    """``tier, rank, symbol, reason``: the research tier by dollar volume; the active tier with
    mandatory symbols (``symbol, place``) first, then tradable ones by the sum of their ranks
    by liquidity and momentum. Both are hard limits. Ties go by symbol.

    The research limit comes first, so the ranking without a key is of ``research_size`` rows.
    """
    top = metrics.where((F.col("price") >= MIN_PRICE) & (F.col("dollar_volume") >= research_dollars)).orderBy(F.desc("dollar_volume"), "symbol").limit(research_size)
    by = Window.partitionBy()
    x = top.withColumn("liquid", F.row_number().over(by.orderBy(F.desc("dollar_volume"), "symbol"))).withColumn("moving", F.row_number().over(by.orderBy(F.desc("momentum_21d"), "liquid")))
    research = x.select(F.lit("research").alias("tier"), F.col("liquid").alias("rank"), "symbol", F.lit("liquidity").alias("reason"))
    open_ = x.where((F.col("history") >= MIN_HISTORY) & (F.col("dollar_volume") >= trade_dollars)).select("symbol", F.lit(1).alias("later"), (F.col("liquid") + F.col("moving")).alias("a"), F.col("liquid").alias("b"))
    first = mandatory.select("symbol", F.lit(0).alias("later"), F.col("place").alias("a"), F.lit(0).alias("b"))
    both = first.unionByName(open_).groupBy("symbol").agg(F.min(F.struct("later", "a", "b")).alias("o"))
    active = both.orderBy("o", "symbol").limit(active_size).withColumn("rank", F.row_number().over(by.orderBy("o", "symbol")))
    reason = F.when(F.col("o.later") == 0, "mandatory").otherwise("liquidity+momentum")
    return research.unionByName(active.select(F.lit("active").alias("tier"), "rank", "symbol", reason.alias("reason")))
