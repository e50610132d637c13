"""Record keeping: redaction, validity intervals, set operations, exits, pair correlations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.columns import full
from marketloom.operators import indicators as ind
from marketloom.operators.joins import next_after

#: What counts as secret in free text, in the order of replacement.
SECRET_PATTERNS = (
    r"(?i)\bauthorization\s*[:=]\s*bearer\s+[^\s\"']+",
    r"(?i)\bbearer\s+[^\s\"']+",
    r"(?i)(?:token|key|secret|bearer|authorization|password)[\"'=:\s]+[^\s\"']{6,}",
    r"\d{7,}",
    r"[A-Za-z0-9+_\-]{28,}",
)
MASK = "[redacted]"


def redact_text(text: Column) -> Column:
    """The text with everything secret-shaped masked."""
    for pattern in SECRET_PATTERNS:
        text = F.regexp_replace(text, pattern, MASK)
    return text


def sector_proxy(stocks: DataFrame, sectors: DataFrame, n: int = 60) -> DataFrame:
    """By (symbol, d): the sector whose returns correlate most over the last n sessions.

    Stocks meet sectors on the date; the rolling correlation is one window by (symbol,
    sector). Correlations are rounded before they are compared, ties go by name.
    """
    s = stocks.withColumn("r", ind.ret(1)).where("r is not null").select("symbol", "d", "r")
    t = sectors.withColumn("x", ind.ret(1)).where("x is not null").select(F.col("symbol").alias("sector"), "d", "x")
    w = Window.partitionBy("symbol", "sector").orderBy("d").rowsBetween(-(n - 1), 0)
    both = s.join(t, "d").withColumn("c", F.when(F.count(F.lit(1)).over(w) == n, F.round(F.corr("r", "x").over(w), 6))).where("c is not null and not isnan(c)")
    best = Window.partitionBy("symbol", "d").orderBy(F.desc("c"), "sector")
    return both.withColumn("k", F.row_number().over(best)).where("k = 1").select("symbol", "d", "sector", F.col("c").alias("correlation"))


def sector_relative(stocks: DataFrame, sectors: DataFrame, n: int = 60, back: int = 21) -> DataFrame:
    """By (symbol, d): the sector of ``sector_proxy``, its return compounded over ``back`` sessions,
    and the stock's return over as many less that one. Null until both have the sessions."""
    w = Window.partitionBy("symbol").orderBy("d")
    full = w.rowsBetween(-(back - 1), 0)
    r = sectors.withColumn("r", ind.ret(1)).withColumn("k", F.count("r").over(full))
    r = r.withColumn("sector_return", F.when(F.col("k") == back, F.exp(F.sum(F.log1p("r")).over(full)) - 1)).select(F.col("symbol").alias("sector"), "d", "sector_return")
    own = stocks.withColumn("own", ind.ret(back)).select("symbol", "d", "own")
    x = sector_proxy(stocks, sectors, n).join(own, ["symbol", "d"]).join(r, ["sector", "d"], "left")
    return x.select("symbol", "d", "sector", "correlation", "sector_return", (F.col("own") - F.col("sector_return")).alias("relative"))


def both_ends(x: DataFrame, by: list[str], order: str, tie: str, k: int) -> DataFrame:
    """The k largest and the k smallest of each group, from one sorted window: ``end`` and ``rank``;
    what stands at both ends of a small group is given twice."""
    w = Window.partitionBy(*by)
    y = x.withColumn("__top", F.row_number().over(w.orderBy(F.desc(order), tie))).withColumn("__low", F.row_number().over(w.orderBy(F.asc(order), F.desc(tie))))
    ends = F.array(F.when(F.col("__top") <= k, F.struct(F.lit("top").alias("end"), F.col("__top").alias("rank"))), F.when(F.col("__low") <= k, F.struct(F.lit("bottom").alias("end"), F.col("__low").alias("rank"))))
    return y.where((F.col("__top") <= k) | (F.col("__low") <= k)).withColumn("__e", F.explode(F.array_compact(ends))).select(*x.columns, "__e.end", "__e.rank")


def differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of one side that the other lacks, with ``side``: one full comparison."""
    sides = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionAll(right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r")))
    g = sides.groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r")).where("l <> r")
    return g.select(key, F.when(F.col("l") == 1, "left").otherwise("right").alias("side"))


def fingerprint(facts: DataFrame, owner: str, as_of: str, feature_hash: str, newest: str = "filed") -> DataFrame:
    """One row: the hash of a data set, over its distinct owners in order, the date it is as of, how
    many facts it has and the newest, and the features. Owners are hashed apart, in blocks of
    their prefix, so that no list of all of them is made."""
    mine = facts.where(F.col(newest) <= F.lit(as_of).cast("date"))
    names = mine.select(F.col(owner).cast("string").alias("o")).distinct().withColumn("block", F.substring(F.sha2("o", 256), 1, 3))
    blocks = names.groupBy("block").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("o")), ","), 256).alias("h"), F.count(F.lit(1)).alias("n"))
    whole = blocks.agg(F.sum("n").alias("owners"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "h"))), lambda b: b["h"]), ""), 256).alias("h"))
    state = mine.agg(F.count(F.lit(1)).alias("facts"), F.max(newest).cast("string").alias("newest"))
    both = whole.unionByName(state, allowMissingColumns=True).agg(*(F.max(c).alias(c) for c in ("owners", "h", "facts", "newest")))  # a row each
    text = F.concat_ws("|", "h", F.lit(as_of), F.col("facts").cast("string"), "newest", F.lit(feature_hash))
    return both.select(F.coalesce("owners", F.lit(0)).alias("owners"), "facts", "newest", F.sha2(text, 256).alias("sha256"))


def assign_sector(stocks: DataFrame, sectors: DataFrame, last: int = 126, least: int = 60) -> DataFrame:
    """By symbol: the sector that correlates most over common dates of the last sessions."""
    def tail(x: DataFrame) -> DataFrame:
        y = x.withColumn("r", ind.ret(1)).where("r is not null")
        return y.withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("d")))).where(F.col("k") <= last).select("symbol", "d", "r")

    both = tail(stocks).join(tail(sectors).select(F.col("symbol").alias("sector"), "d", F.col("r").alias("x")), "d")
    g = both.groupBy("symbol", "sector").agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("r", "x"), 6).alias("c")).where((F.col("n") >= least) & F.col("c").isNotNull() & ~F.isnan("c"))
    w = Window.partitionBy("symbol").orderBy(F.desc("c"), "sector")
    return g.withColumn("k", F.row_number().over(w)).where("k = 1").select("symbol", "sector", "n", F.col("c").alias("correlation"))


def first_exit(entries: DataFrame, bars: DataFrame, horizon: int = 20, stop: float = 0.036) -> DataFrame:
    """Each entry (symbol, d, close) with its first bar at or under the stop, or at least
    1.5 horizons old. An exit by time is the first bar of that age or more, however much
    later, found by one as-of step. Stops inside that age are found by symbol and buckets of
    days, so no history is paired with all of another.
    """
    limit = int(horizon * 1.5)
    span = limit * 2
    epoch = F.lit("1970-01-01").cast("date")
    once = entries.select("symbol", F.col("d").alias("entry_d"), F.col("close").alias("entry")).distinct()
    due = next_after(once.withColumn("d", F.date_add("entry_d", limit - 1)), bars.select("symbol", "d", F.col("d").alias("time_d"), F.col("close").alias("time_close")), ["time_d", "time_close"], ["symbol"], "d").drop("d")
    # Prices are carried along and never joined on: made twice, a sum's last bit may differ.
    first = F.floor(F.datediff("entry_d", epoch) / span)
    e = due.withColumn("b", F.explode(F.array(first, first + 1)))
    h = bars.select(F.col("symbol").alias("__symbol"), "d", "close", F.floor(F.datediff("d", epoch) / span).alias("__b"))
    hit = (F.col("symbol") == F.col("__symbol")) & (F.col("b") == F.col("__b")) & (F.col("d") > F.col("entry_d")) & (F.col("close") <= F.col("entry") * (1 - stop)) & (F.datediff("d", "entry_d") < limit)
    both = e.join(h, hit, "left").groupBy("symbol", "entry_d", "entry", "time_d", "time_close").agg(F.min("d").alias("stop_d"), F.min_by("close", "d").alias("stop_close"))
    g = both.select("symbol", "entry_d", "entry", F.coalesce("stop_d", "time_d").alias("exit_d"), F.when(F.col("stop_d").isNotNull(), F.col("stop_close")).otherwise(F.col("time_close")).alias("exit")).where("exit_d is not null")
    reason = F.when(F.col("exit") <= F.col("entry") * (1 - stop), "stop_loss").otherwise("time_stop")
    return g.withColumn("reason", reason).withColumn("ret", F.col("exit") / F.col("entry") - 1)


def validity(rows: DataFrame, keys: list[str], start: str) -> DataFrame:
    """``valid_to``: where the next version of the key begins; null for the current one."""
    return rows.withColumn("valid_to", F.lead(start).over(Window.partitionBy(*keys).orderBy(start)))


def replace_source(base: DataFrame, new: DataFrame, source: str) -> DataFrame:
    """``base`` without the rows of ``source``, and ``new`` in their place."""
    return base.where(~F.col("source").eqNullSafe(F.lit(source))).unionByName(new.withColumn("source", F.lit(source)))


def ordered_distinct(lists: list[DataFrame], key: str) -> DataFrame:
    """The keys of several lists once each, with the number of the first list that has it."""
    parts = [x.select(key, F.lit(k).alias("priority")) for k, x in enumerate(lists)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(key).agg(F.min("priority").alias("priority"))


def merge_curves(daily: DataFrame, intraday: DataFrame) -> DataFrame:
    """Daily rows, but for days that have intraday rows, and those."""
    days = intraday.select(F.to_date("ts").alias("d")).distinct()
    kept = daily.join(days, "d", "left_anti").select(F.col("d").cast("timestamp").alias("ts"), "equity", F.lit("daily").alias("kind"))
    return kept.unionByName(intraday.select("ts", "equity", F.lit("intraday").alias("kind")))


def feature_activity(x: DataFrame, features: list[str], least: float = 1e-8) -> DataFrame:
    """A row for each feature: population deviation, and whether it is active. One pass."""
    one = x.agg(*(F.stddev_pop(c).alias(c) for c in features))
    return one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("sd")) for c in features)))).withColumn("active", F.coalesce(F.col("sd") > least, F.lit(False)))


def trend_features(bars: DataFrame) -> DataFrame:
    """A few panel columns, for activity and fingerprints."""
    return bars.withColumn("r1", ind.ret(1)).withColumn("sma20", full(F.avg, F.col("close"), 20)).withColumn("flat", F.lit(1.0))


def day_digest(audit: DataFrame, orders: DataFrame, top: int = 4) -> DataFrame:
    """By (day, mode): completed scans and their candidates, orders by status, and the ``top`` most
    frequent veto reasons with their counts, ties by name.

    ``audit`` has ts, mode, event_type, payload (JSON); ``orders`` ts, mode, status. Of a rejection
    only the first reason counts, without what follows a bracket or colon. Payloads that are not
    JSON count as empty. Reasons are few names, so a day's are ranked in one small group.
    """
    a = audit.select(F.to_date("ts").alias("day"), "mode", "event_type", F.from_json("payload", "candidates long, verdict string, reasons array<string>").alias("p"))
    scan = F.col("event_type") == "cycle_end"
    scans = a.where(scan).groupBy("day", "mode").agg(F.count(F.lit(1)).alias("scans"), F.coalesce(F.sum("p.candidates"), F.lit(0)).alias("candidates"))
    bare = F.substring(F.trim(F.regexp_extract(F.get("p.reasons", F.lit(0)), "^([^(:]*)", 1)), 1, 60)
    vetoes = a.where((F.col("event_type") == "risk_decision") & (F.col("p.verdict") == "REJECTED")).select("day", "mode", bare.alias("reason")).where("reason is not null")
    counted = vetoes.groupBy("day", "mode", "reason").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("day", "mode").orderBy(F.desc("k"), "reason")
    best = counted.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).groupBy("day", "mode").agg(F.array_sort(F.collect_list(F.struct("r", "reason", "k"))).alias("v"))
    best = best.select("day", "mode", F.array_join(F.transform("v", lambda x: F.concat_ws("=", x["reason"], x["k"].cast("string"))), ", ").alias("top_vetoes"))
    states = orders.groupBy(F.to_date("ts").alias("day"), "mode").agg(*(F.count(F.when(F.col("status") == s, 1)).alias(s) for s in ("filled", "placed", "cancelled", "rejected")))
    out = states.join(scans, ["day", "mode"], "full_outer").join(best, ["day", "mode"], "full_outer")
    return out.fillna(0, ["filled", "placed", "cancelled", "rejected", "scans", "candidates"]).fillna("", ["top_vetoes"])
