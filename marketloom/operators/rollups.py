"""Reports over evidence and trades: intervals, projections, dossiers, status, nodes, sources, discovery."""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.columns import annualise, clamp
from marketloom.operators.stats import SHRINK_N

#: Resamples and the interval's ends; severities, the mildest first; caps of a catalogue; shares of a rank.
RESAMPLES, ENDS = 500, (0.10, 0.90)
SEVERITIES = ("ok", "degraded", "stale", "error")
CATALOG = {"most_facts": 200, "most_bars": 65, "most_news": 12, "most_chars": 12_000}
ALPHA_SHARE, LIQUIDITY_SHARE, MANDATE_CAP = 0.9, 0.1, 0.15
SCHEMA = "dossier.1"
#: Hex digits of a hash that name a row's block: 4,096 blocks a group.
BLOCK_DIGITS = 3


def poisson_steps() -> list[float]:
    """P(X <= k) of Poisson(1) for k = 0, 1, ... until what is left is below 1e-9."""
    out = [math.exp(-1)]
    while 1 - out[-1] > 1e-9:
        out.append(out[-1] + math.exp(-1) / math.factorial(len(out)))
    return out


def _hex(x: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(x), 1, digits), 16, 10).cast("long")


def bootstrap_mean(rows: DataFrame, by: str, value: str, key: str, resamples: int = RESAMPLES) -> DataFrame:
    """By group ``n, mean, ci_low, ci_high``: the mean and, at a lower index, the 10 and 90 per
    cent points of its bootstrap distribution.

    Rows fall into 4,096 blocks by a hash of ``key``, and each resample weighs a block by a
    Poisson(1) draw that is a hash too. So a group of any size costs blocks times resamples,
    nothing is drawn row by row, and reruns agree. Null values do not count; a resample that draws no row is left out.
    """
    held = rows.where(F.col(value).isNotNull())
    blocks = held.groupBy(by, _hex(F.col(key).cast("string"), BLOCK_DIGITS).alias("block")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"))
    u = _hex(F.concat_ws(":", "draw", "block"), 8) / 2.0**32
    w = reduce(add, [(u >= step).cast("int") for step in poisson_steps()])
    x = blocks.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(resamples)))).withColumn("w", w)
    drawn = F.sum(F.col("w") * F.col("n"))
    means = x.groupBy(by, "draw").agg(F.when(drawn > 0, F.sum(F.col("w") * F.col("s")) / drawn).alias("m"))
    sorted_means = means.groupBy(by).agg(F.array_sort(F.collect_list("m")).alias("ms"))

    def point(share: float) -> Column:
        return F.get("ms", F.floor(F.size("ms") * share).cast("int"))

    whole = blocks.groupBy(by).agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("mean"))
    return whole.join(sorted_means, by).select(by, "n", "mean", point(ENDS[0]).alias("ci_low"), point(ENDS[1]).alias("ci_high"))


def portfolio_projection(trades: DataFrame) -> DataFrame:
    """By ``source`` (live, paper, others): the mean trade return and its interval, per year,
    the share of gains, the number of trades and how far to trust them. A horizon under a day counts as one, a null one as 20."""
    ci = bootstrap_mean(trades, "source", "ret", "id")
    held = trades.where("ret is not null")
    g = held.groupBy("source").agg(F.avg(F.greatest(F.lit(1), F.coalesce("horizon_days", F.lit(20)))).alias("holding"), F.avg((F.col("ret") > 0).cast("int")).alias("prob_positive"))
    years = 252.0 / F.col("holding")
    trust = F.when((F.col("source") == "live") & (F.col("n") >= 50), "high").when(F.col("source").isin("live", "paper") & (F.col("n") >= 30), "medium").otherwise("low")
    return ci.join(g, "source").select(
        "source", "n", annualise(F.col("mean"), years).alias("apr"), F.greatest(F.lit(-0.99), annualise(F.col("ci_low"), years)).alias("apr_low"), annualise(F.col("ci_high"), years).alias("apr_high"), "prob_positive", trust.alias("confidence"),
    )


def dossiers(facts: DataFrame, memos: DataFrame, key: str = "memo_id") -> DataFrame:
    """By symbol the newest accepted memo of each ``kind`` (fundamental, catalyst), with
    ``quality``, ``status`` and ``source_hash``.

    ``facts``: ``symbol, available_fields``; ``memos``: ``key, symbol, kind, errors, stance,
    citations``. Quality is the mean of shares, each 1 at most: fields of 8, citations of 2 by
    memo. Without a memo the status is unsupported. The hash changes with what the dossier rests on.
    """
    latest = memos.where((F.size("errors") == 0) & F.col("kind").isin("fundamental", "catalyst")).groupBy("symbol")

    def newest(kind: str) -> Column:
        return F.max_by(F.struct("stance", "citations"), F.when(F.col("kind") == kind, F.col(key))).alias(kind)

    x = facts.join(latest.agg(newest("fundamental"), newest("catalyst")), "symbol", "left")
    parts = [F.least(F.lit(1.0), F.col("available_fields") / 8), *(F.when(F.col(k).isNotNull(), F.least(F.lit(1.0), F.size(f"{k}.citations") / 2)) for k in ("fundamental", "catalyst"))]
    held = F.array_compact(F.array(*parts))
    quality = F.aggregate(held, F.lit(0.0), lambda a, v: a + v) / F.size(held)
    status = F.when(F.col("fundamental").isNotNull() | F.col("catalyst").isNotNull(), "ready").otherwise("unsupported")
    basis = F.concat_ws("|", F.lit(SCHEMA), "symbol", F.col("available_fields").cast("string"), *(c for k in ("fundamental", "catalyst") for c in (F.coalesce(f"{k}.stance", F.lit("-")), F.coalesce(F.array_join(f"{k}.citations", ","), F.lit("-")))))
    return x.select("symbol", "available_fields", F.round(quality, 4).alias("quality"), status.alias("status"), F.sha2(basis, 256).alias("source_hash"))


def status_rollup(components: DataFrame) -> DataFrame:
    """By ``run`` the worst severity and ``alerts``: for each component that is not ok its worst
    message, in order of component. ``components``: ``run, component, severity, message``; an
    unknown severity counts as error. Reports are reduced to one a component before a run gathers them."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")), F.lit(0))
    rank = F.when(rank == 0, len(SEVERITIES)).otherwise(rank) - 1
    worst = components.withColumn("rank", rank).groupBy("run", "component").agg(F.max(F.struct("rank", "message")).alias("w"))
    alert = F.when(F.col("w.rank") > 0, F.struct("component", F.concat_ws(": ", "component", "w.message").alias("text")))
    g = worst.groupBy("run").agg(F.max("w.rank").alias("rank"), F.count(F.lit(1)).alias("n_components"), F.transform(F.array_sort(F.collect_list(alert)), lambda a: a.text).alias("alerts"))
    return g.select("run", F.get(F.array(*map(F.lit, SEVERITIES)), F.col("rank").cast("int")).alias("status"), "n_components", "alerts")


def node_summary(trades: DataFrame, priors: dict[str, float], bad: float) -> DataFrame:
    """By node and Monday (``as_of``): what was known of its closed trades (``n_trades,
    expectancy, win_rate``), the signals of the week before, the last trade that lost ``bad`` or
    more, and the effective weight: the prior times the learned multiplier. One row for each
    week in which the node opened or closed a trade; ``trades``: a row by node and trade."""
    monday = F.date_add(F.trunc("at", "week"), 7).alias("as_of")
    both = F.array(F.struct(F.col("entry_date").alias("at"), F.lit(False).alias("closed")), F.struct(F.col("exit_date").alias("at"), F.lit(True).alias("closed")))
    x = trades.select("node", "id", "ret", F.explode(both).alias("e")).select("node", "id", "ret", "e.*")
    r = F.when(F.col("closed"), F.col("ret"))
    weeks = x.groupBy("node", monday).agg(
        F.count(r).alias("n"), F.coalesce(F.sum(r), F.lit(0.0)).alias("s"), F.coalesce(F.sum(r * r), F.lit(0.0)).alias("ss"), F.count(F.when(r > 0, 1)).alias("wins"),
        F.count(F.when(~F.col("closed"), 1)).alias("signals_7d"), F.max_by("id", F.when(r <= -bad, F.struct("at", "id"))).alias("bad_id"),
    )
    w = Window.partitionBy("node").orderBy("as_of").rowsBetween(Window.unboundedPreceding, 0)
    run = weeks.select("node", "as_of", "signals_7d", F.last("bad_id", ignorenulls=True).over(w).alias("last_bad"), *(F.sum(c).over(w).alias(c) for c in ("n", "s", "ss", "wins")))
    mean = F.col("s") / F.col("n")
    spread = F.sqrt(F.greatest((F.col("ss") - F.col("n") * mean * mean) / (F.col("n") - 1), F.lit(0.0)))
    ratio = F.when(spread > 1e-9, mean / spread).otherwise(0.0)
    learned = F.when(F.col("n") < 50, 1.0).otherwise(clamp(1 + 2 * ratio * F.col("n") / (F.col("n") + SHRINK_N), 0.25, 1.5))
    prior = F.create_map(*[F.lit(v) for kv in priors.items() for v in kv])[F.col("node")]
    some = F.col("n") > 0
    return run.select("node", "as_of", F.col("n").alias("n_trades"), F.when(some, mean).alias("expectancy"), F.when(some, F.col("wins") / F.col("n")).alias("win_rate"), "signals_7d", "last_bad", (F.coalesce(prior, F.lit(0.0)) * learned).alias("effective_weight"))


def source_catalog(sections: DataFrame, facts: DataFrame, news: DataFrame, bars: DataFrame, most_facts: int | None = None, most_news: int | None = None, most_bars: int | None = None, most_chars: int | None = None) -> DataFrame:
    """A row for each source that a symbol's memos may cite: ``symbol, source_id, kind, at, text``.

    Sections (``symbol, accession, section, filed, body``), facts (``symbol, accession, tag,
    period_end, filed, value``), headlines (``symbol, news_id, published, title``) and bars. A
    catalogue for a memo has the latest 200 facts, 12 headlines and 65 bars and 12,000
    characters a text (``CATALOG``); without these limits nothing is left out. Ties go by id. An
    id stands once a symbol, in its latest form.
    """

    cut = lambda c: F.col(c) if most_chars is None else F.substring(c, 1, most_chars)

    def last(df: DataFrame, n: int | None) -> DataFrame:
        if n is None:
            return df
        w = Window.partitionBy("symbol").orderBy(F.desc("at"), "source_id", "text")
        return df.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n).drop("k")

    def once(df: DataFrame) -> DataFrame:
        return df.groupBy("symbol", "source_id", "kind").agg(F.max(F.struct("at", "text")).alias("l")).select("symbol", "source_id", "kind", "l.*")

    s = sections.select("symbol", F.concat_ws(":", F.lit("SEC"), "accession", "section").alias("source_id"), F.lit("filing_section").alias("kind"), F.to_date("filed").alias("at"), cut("body").alias("text"))
    f = facts.select("symbol", F.concat_ws(":", F.lit("FACT"), "accession", "tag").alias("source_id"), F.lit("sec_fact").alias("kind"), F.to_date("filed").alias("at"), F.concat_ws(" ", F.col("period_end").cast("string"), F.format_string("%.2f", "value")).alias("text"))
    h = news.select("symbol", F.concat_ws(":", F.lit("NEWS"), "news_id").alias("source_id"), F.lit("company_news").alias("kind"), F.to_date("published").alias("at"), cut("title").alias("text"))
    b = bars.select("symbol", F.concat_ws(":", F.lit("BAR"), F.col("d").cast("string")).alias("source_id"), F.lit("bar").alias("kind"), F.col("d").alias("at"), F.format_string("%.4f", "close").alias("text"))
    return once(s).unionByName(last(once(f), most_facts)).unionByName(last(once(h), most_news)).unionByName(last(once(b), most_bars))


def discovery_ranking(signals: DataFrame, priors: dict[str, float], metrics: DataFrame, mandates: DataFrame) -> DataFrame:
    """By ``as_of`` all symbols in order of discovery: 0.9 of the alpha by fixed priors, 0.1 of
    liquidity, and what the mandate adds; ties go to the later symbol.

    ``signals``: ``as_of, symbol, node, alpha``; ``metrics``: ``symbol, name, dollar_volume``;
    ``mandates``: ``as_of, confidence, favored, avoided, direct`` (a map of symbols). A direct
    stance counts as it stands; else a favored, then an avoided term that symbol or name contain. Nodes without a prior count nothing, missing ones as 0.
    """
    prior = F.create_map(*[F.lit(v) for kv in priors.items() for v in kv])[F.col("node")]
    total = sum(priors.values()) or 1.0
    a = signals.groupBy("as_of", "symbol").agg((F.sum(F.coalesce(F.col("alpha") * prior, F.lit(0.0))) / total).alias("alpha"))
    x = a.join(metrics, "symbol", "left").join(mandates, "as_of", "left")
    text = F.lower(F.concat_ws(" ", "symbol", "name"))

    def names(terms: str) -> Column:
        return F.coalesce(F.exists(F.col(terms), lambda t: F.contains(text, F.lower(t))), F.lit(False))

    hint = F.when(names("favored"), 1.0).when(names("avoided"), -1.0).otherwise(0.0) * MANDATE_CAP * F.coalesce("confidence", F.lit(0.0))
    direct = F.coalesce(F.col("direct")[F.col("symbol")], F.lit(0.0))
    liquidity = clamp(F.log10(F.greatest(F.lit(1.0), F.coalesce("dollar_volume", F.lit(0.0)))) / 10, 0.0, 1.0)
    x = x.select("as_of", "symbol", "alpha", liquidity.alias("liquidity"), F.when(direct != 0, direct).otherwise(hint).alias("mandate"))
    x = x.withColumn("score", ALPHA_SHARE * F.col("alpha") + LIQUIDITY_SHARE * F.col("liquidity") + F.col("mandate"))
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("as_of").orderBy(F.desc("score"), F.desc("symbol"))))
