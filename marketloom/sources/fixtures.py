"""Market tables derived from the given tables, each as a DataFrame and as DuckDB SQL.

The rules only have to be deterministic and to reach every branch of the operators. All
columns stay unrounded; outputs round once.
"""

from __future__ import annotations

import atexit
import uuid
from decimal import Decimal

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BENCHMARK = "ALL"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_MADE: list[tuple[SparkSession, str]] = []


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that all executors share, removed when the application ends."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


def clear() -> None:
    """Remove every folder that ``shared_path`` named; lazy results that read one are lost."""
    while _MADE:
        spark, path = _MADE.pop()
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clear_at_exit() -> None:
    try:
        clear()
    except (Py4JError, OSError):  # the session's gateway is gone before
        _MADE.clear()


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written in the shared folder and read back, for plans that read it repeatedly."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def damped(x: Column) -> Column:
    """10 ln(1 + x): raw unit prices, damped."""
    return 10 * F.log1p(x)


def bars(spark: SparkSession, sf_dir: str, key: str = "p_type", benchmark: bool = True) -> DataFrame:
    """Daily bars ``symbol, d, open, high, low, close, volume``.

    A line item is a trade; its part's ``key`` is the symbol, and with ``benchmark`` the
    symbol ALL gets every trade. One scan, one shuffle: both symbols of a trade come from
    one exploded row, and the aggregation is partial before the shuffle. A day opens with its
    trade of the lowest order and line, of several such ones at the lowest price. That order is
    one number, so that the aggregation hashes and does not sort.
    """
    return bars_by(spark, sf_dir, (key,), benchmark).drop("kind")


def bars_by(spark: SparkSession, sf_dir: str, keys: tuple[str, ...], benchmark: bool = True) -> DataFrame:
    """``bars`` by several keys of a part at once, told apart by ``kind``: the key's name, or ALL."""
    part = table(spark, sf_dir, "part").select("p_partkey", *keys)
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate")
    own = [F.struct(F.lit(k).alias("kind"), F.col(k).alias("symbol")) for k in keys]
    symbols = F.array(*own, F.struct(F.lit(BENCHMARK).alias("kind"), F.lit(BENCHMARK).alias("symbol"))) if benchmark else F.array(*own)
    u = F.col("l_extendedprice") / F.col("l_quantity")
    # Prices count to a billionth: cents by whole quantities under 3,000 are equal or differ by more.
    number, price = (F.col("l_orderkey").cast("long") * 100 + F.col("l_linenumber")).cast("decimal(18,0)"), (F.least(u, F.lit(9e9)) * 1e9).cast("long")
    li = li.select("l_partkey", F.to_date("l_shipdate").alias("d"), u.alias("u"), "l_extendedprice", "l_quantity", (number * F.lit(Decimal(10**19)) + price).alias("at"))
    ticks = li.join(part, li.l_partkey == part.p_partkey).select(F.inline(symbols), "d", "u", "l_extendedprice", "l_quantity", "at")
    daily = ticks.groupBy("kind", "symbol", "d").agg(
        damped(F.min("u")).alias("low"),
        damped(F.max("u")).alias("high"),
        damped(F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"),
        damped(F.min_by("u", "at")).alias("o"),
        F.sum("l_quantity").alias("volume"),
    )
    return daily.select("kind", "symbol", "d", F.greatest(F.least("o", "high"), F.col("low")).alias("open"), "high", "low", "close", "volume")


def types_and_brands(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Bars by type with the benchmark, and bars by brand: from one pass over the trades, written."""
    both = stored(bars_by(spark, sf_dir, ("p_type", "p_brand")), "bars")
    return both.where("kind <> 'p_brand'").drop("kind"), both.where("kind = 'p_brand'").drop("kind")


def bars_sql(key: str = "p_type", name: str = "bars", benchmark: bool = True) -> str:
    symbols = f"[{key}, '{BENCHMARK}']" if benchmark else f"[{key}]"
    return f"""{name} AS (SELECT symbol, d, greatest(least(o, high), low) AS open, high, low, close, volume FROM (
  SELECT symbol, d, 10 * ln(1 + min(u)) AS low, 10 * ln(1 + max(u)) AS high, 10 * ln(1 + sum(ep) / sum(q)) AS close,
         10 * ln(1 + arg_min(u, ok * 100 + ln)) AS o, sum(q) AS volume
  FROM (SELECT unnest({symbols}) AS symbol, l_shipdate::DATE AS d, l_extendedprice / l_quantity AS u, l_extendedprice AS ep, l_quantity AS q,
               l_orderkey AS ok, l_linenumber AS ln FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY symbol, d))"""


def settled(sql: str) -> str:
    """``sql`` whose bars open, of several trades of the lowest order and line, at the lowest price."""
    return sql.replace("arg_min(u, ok * 100 + ln)", "arg_min(u, (ok * 100 + ln, u))")


#: Rows of a large join that one task sorts; tasks below which a join is left to Spark.
ROWS_A_TASK, FEW_TASKS = 1_000_000, 8


def dealt(left: DataFrame, right: DataFrame, a: str, b: str, tasks: int) -> DataFrame:
    """``left`` and ``right`` where a = b, dealt into that many tasks if they are not few. Left to
    itself, Spark merges parts of a shuffle up to one task a core or to 64 MB of compressed rows,
    and numbers compress to a few bytes: a task then sorts ten million of them."""
    if tasks > FEW_TASKS:
        left, right = left.repartition(tasks, a), right.repartition(tasks, b)
    return left.join(right, F.col(a) == F.col(b))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed trades, one for each line item."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    tasks = -(-li.count() // ROWS_A_TASK)  # counted from the footers of the files
    x = dealt(li, o, "l_orderkey", "o_orderkey", tasks)
    return (
        dealt(x, p, "l_partkey", "p_partkey", tasks if p.count() > 4 * ROWS_A_TASK else 0)
        .select(
            (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"),
            F.col("p_brand").alias("symbol"),
            F.to_date("o_orderdate").alias("entry_date"),
            F.to_date("l_shipdate").alias("exit_date"),
            (F.col("l_discount") - F.col("l_tax")).alias("ret"),
            ((F.col("l_discount") - F.col("l_tax")) * F.col("l_extendedprice")).alias("pnl"),
            (F.col("o_totalprice") / 500_000.0).alias("score"),
            F.col("o_orderpriority").alias("regime"),
            F.col("o_orderstatus").alias("source"),
            F.array("l_returnflag", "l_linestatus").alias("nodes"),
            F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate")).alias("horizon_days"),
        )
    )


TRADES_SQL = """trades AS (SELECT l_orderkey * 100 + l_linenumber AS id, p_brand AS symbol, o_orderdate::DATE AS entry_date, l_shipdate::DATE AS exit_date,
  l_discount - l_tax AS ret, (l_discount - l_tax) * l_extendedprice AS pnl, o_totalprice / 500000.0 AS score, o_orderpriority AS regime,
  o_orderstatus AS source, [l_returnflag, l_linestatus] AS nodes, datediff('day', o_orderdate::DATE, l_shipdate::DATE) AS horizon_days
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders from the event table: ``id, ts, symbol, side, status, mode, notional``."""
    return orders_of(table(spark, sf_dir, "events"))


def orders_of(e: DataFrame) -> DataFrame:
    """Orders from events, a table or a stream."""
    side = F.when(F.col("event_type") == "purchase", "buy").when(F.col("event_type") == "signup", "sell").otherwise(F.when(F.col("event_id") % 2 == 0, "buy").otherwise("sell"))
    status = F.when(F.col("event_type") == "error", "rejected").when(F.col("event_type") == "view", "cancelled").when(F.col("event_type") == "purchase", "filled").otherwise("placed")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("Brand#"), (1 + F.col("user_id") % 25).cast("string")).alias("symbol"),
        side.alias("side"),
        status.alias("status"),
        F.when(F.col("user_id") % 2 == 0, "paper").otherwise("live").alias("mode"),
        F.col("value").alias("notional"),
        F.col("event_type").alias("provider"),
    )


ORDER_EVENTS_SQL = """oe AS (SELECT event_id AS id, ts, 'Brand#' || (1 + user_id % 25)::VARCHAR AS symbol,
  CASE event_type WHEN 'purchase' THEN 'buy' WHEN 'signup' THEN 'sell' ELSE CASE WHEN event_id % 2 = 0 THEN 'buy' ELSE 'sell' END END AS side,
  CASE event_type WHEN 'error' THEN 'rejected' WHEN 'view' THEN 'cancelled' WHEN 'purchase' THEN 'filled' ELSE 'placed' END AS status,
  CASE WHEN user_id % 2 = 0 THEN 'paper' ELSE 'live' END AS mode, value AS notional, event_type AS provider FROM events)"""


def equity_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One equity value for each order day. The running sum is over days, not rows."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders")
    step = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", -1).otherwise(0) * F.col("o_totalprice") / 1e4
    days = o.groupBy(F.to_date("o_orderdate").alias("d")).agg(F.sum(step).alias("s"))
    return days.select(F.lit("paper").alias("source"), "d", (10_000 + F.sum("s").over(Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0))).alias("equity"))


EQUITY_SQL = """equity AS (SELECT 'paper' AS source, d, 10000 + sum(s) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING) AS equity FROM (
  SELECT o_orderdate::DATE AS d, sum(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN -1 ELSE 0 END * o_totalprice / 1e4) AS s FROM orders GROUP BY 1))"""


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headlines from documents and labels: one every 17 minutes; null label: unclassified."""
    return news_of(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def news_of(d: DataFrame, l: DataFrame) -> DataFrame:
    """Headlines from documents (a table or a stream) and labels (a table)."""
    return d.join(l, "doc_id", "left").select(
        "doc_id",
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=F.col("doc_id") * 17)).alias("published_at"),
        F.concat(F.lit("Brand#"), (1 + F.col("doc_id") % 25).cast("string")).alias("symbol"),
        F.substring("text", 1, 160).alias("title"),
        F.col("source"),
        F.col("text").alias("body"),
        (F.col("quality") - F.col("toxic")).cast("double").alias("stance"),
        (0.5 + 0.4 * F.col("quality")).alias("confidence"),
        F.when(F.col("source") == "src0", 0.9).otherwise(0.6).alias("reliability"),
    )


NEWS_SQL = """news AS (SELECT d.doc_id, TIMESTAMP '2024-01-01' + to_minutes(d.doc_id * 17) AS published_at, 'Brand#' || (1 + d.doc_id % 25)::VARCHAR AS symbol,
  substr(text, 1, 160) AS title, source, text AS body, (quality - toxic)::DOUBLE AS stance, 0.5 + 0.4 * quality AS confidence,
  CASE WHEN source = 'src0' THEN 0.9 ELSE 0.6 END AS reliability FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def filing_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annual facts by issuer (a nation): tag, period end, filing date 45 days later."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    year = F.year("o_orderdate")
    end = F.make_date(year, F.lit(12), F.lit(31))
    return (
        o.join(c, o.o_custkey == c.c_custkey)
        .groupBy(F.col("c_nationkey").alias("cik"), F.col("o_orderpriority").alias("tag"), end.alias("period_end"))
        .agg(F.sum("o_totalprice").alias("value"))
        .withColumn("filed", F.date_add("period_end", 45))
        .withColumn("form", F.when(F.col("tag") == "5-LOW", "10-Q").otherwise("10-K"))
    )


FACTS_SQL = """facts AS (SELECT c_nationkey AS cik, o_orderpriority AS tag, make_date(year(o_orderdate), 12, 31) AS period_end, sum(o_totalprice) AS value,
  make_date(year(o_orderdate), 12, 31) + 45 AS filed, CASE WHEN o_orderpriority = '5-LOW' THEN '10-Q' ELSE '10-K' END AS form
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3, 5, 6)"""


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills: account, symbol, side, quantity, price, in order of ``seq``."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return li.join(p, li.l_partkey == p.p_partkey).select(
        F.col("l_suppkey").alias("account"),
        F.col("p_brand").alias("symbol"),
        F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"),
        F.col("l_quantity").alias("qty"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.to_date("l_shipdate").alias("d"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"),
    )


FILLS_SQL = """fills AS (SELECT l_suppkey AS account, p_brand AS symbol, CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side, l_quantity AS qty,
  l_extendedprice / l_quantity AS price, l_shipdate::DATE AS d, l_orderkey * 100 + l_linenumber AS seq FROM lineitem JOIN part ON l_partkey = p_partkey)"""


#: Tags of annual statements, in the order in which the fixture deals them.
STATEMENT_TAGS = (
    "Revenues", "OperatingIncomeLoss", "Assets", "StockholdersEquity", "EarningsPerShareDiluted", "NetCashProvidedByUsedInOperatingActivities", "PaymentsToAcquirePropertyPlantAndEquipment",
    "LongTermDebt", "AssetsCurrent", "LiabilitiesCurrent", "CommonStockSharesOutstanding", "NetIncomeLoss", "LongTermDebtCurrent",
)


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annual statement facts by issuer (a supplier; its number modulo 25 is the brand's): one
    row for each (issuer, year, tag) that line items deal a value to, filed 45 days later."""
    li = table(spark, sf_dir, "lineitem")
    tag = F.element_at(F.array(*map(F.lit, STATEMENT_TAGS)), (F.col("l_partkey") % len(STATEMENT_TAGS) + 1).cast("int"))
    g = li.groupBy(F.col("l_suppkey").alias("cik"), F.make_date(F.year("l_shipdate"), F.lit(12), F.lit(31)).alias("period_end"), tag.alias("tag")).agg(F.sum(F.col("l_extendedprice") * (0.5 - F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0))).alias("value"))
    return g.withColumn("filed", F.date_add("period_end", 45)).withColumn("form", F.when(F.col("cik") % 9 == 0, "10-Q").otherwise("10-K")).withColumn("value", F.round(F.col("value") + 1e-6, 2))


STATEMENTS_SQL = f"""st AS (SELECT *, (period_end + 45)::DATE AS filed, CASE WHEN cik % 9 = 0 THEN '10-Q' ELSE '10-K' END AS form FROM (SELECT l_suppkey AS cik, make_date(year(l_shipdate), 12, 31) AS period_end,
  {list(STATEMENT_TAGS)}[(l_partkey % {len(STATEMENT_TAGS)} + 1)::INT] AS tag, round(sum(l_extendedprice * (0.5 - CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END)) + 1e-6, 2) AS value FROM lineitem GROUP BY 1, 2, 3))"""
