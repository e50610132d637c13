"""As-of, interval and first-match joins, keyed upserts, and difference reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Days of a key that one task of an as-of join takes.
BUCKET_DAYS = 90


def _asof(events: DataFrame, history: DataFrame, values: list[str], by: list[str], at: str, forward: bool, days: int) -> DataFrame:
    """The as-of step in two levels. A key is cut into buckets of time; within one, the rows of
    both sides are a sorted stream, in which the last non-null struct stands. What a bucket
    inherits is a row of its own at its beginning: each bucket of the history is reduced to
    its last struct, and those few rows of a key are run up. So a key with most rows is spread
    over its buckets, and nothing is paired or joined. ``forward`` runs from the end of time.
    """
    bucket = F.floor(F.unix_seconds(F.col(at).cast("timestamp")) / (days * 86_400)).alias("__b")
    pick = F.min_by if forward else F.max_by
    e = events.select("*", bucket, F.lit(1).alias("__side"))
    h = history.where(F.col(at).isNotNull()).select(*by, at, bucket, F.struct(*values).alias("__v"), F.lit(0).alias("__side"))
    ends = h.groupBy(*by, "__b").agg(pick("__v", at).alias("__v")).unionByName(e.select(*by, "__b").where("__b is not null").distinct(), allowMissingColumns=True)
    ends = ends.groupBy(*by, "__b").agg(F.first("__v", ignorenulls=True).alias("__v"))
    order = (lambda c: F.desc(c)) if forward else (lambda c: F.asc(c))
    past = Window.partitionBy(*by).orderBy(order("__b")).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("__v", F.last("__v", ignorenulls=True).over(past)).where("__v is not null").select(*by, "__b", "__v", F.lit(-1).alias("__side"))
    both = e.unionByName(h, allowMissingColumns=True).unionByName(carried, allowMissingColumns=True)
    # the carried row comes first; of one time, history counts backward-looking and not forward
    sort = [F.when(F.col("__side") == -1, 0).otherwise(1), order(at), F.desc("__side") if forward else F.asc("__side")]
    w = Window.partitionBy(*by, "__b").orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("__v", F.last("__v", ignorenulls=True).over(w)).where("__side = 1")
    return out.select(*events.columns, *(F.col(f"__v.{c}").alias(c) for c in values))


def latest_at(events: DataFrame, history: DataFrame, values: list[str], by: list[str], at: str, bucket_days: int = BUCKET_DAYS) -> DataFrame:
    """``events`` with the ``values`` of the last row of ``history`` at or before ``at``; nulls
    where there is none or ``at`` is null. See ``_asof``."""
    return _asof(events, history, values, by, at, False, bucket_days)


def next_after(events: DataFrame, history: DataFrame, values: list[str], by: list[str], at: str, bucket_days: int = BUCKET_DAYS) -> DataFrame:
    """``events`` with the ``values`` of the first row of ``history`` strictly after ``at``."""
    return _asof(events, history, values, by, at, True, bucket_days)


def within_days(decisions: DataFrame, items: DataFrame, days: int, key: str, at: str, published: str) -> DataFrame:
    """Pairs of a decision and an item published in the ``days`` before it. The day range is
    cut into buckets of that length, so the join is on (key, bucket): a decision looks into
    its own bucket and the one before."""
    span = days * 86_400
    second = F.unix_timestamp(F.col(at).cast("timestamp"))
    d = decisions.withColumn("__b", F.explode(F.array(F.floor(second / span), F.floor(second / span) - 1)))
    i = items.withColumn("__b", F.floor(F.unix_timestamp(F.col(published).cast("timestamp")) / span))
    pairs = d.join(i, [key, "__b"]).drop("__b")
    return pairs.where((F.col(published).cast("timestamp") <= F.col(at).cast("timestamp")) & (F.unix_timestamp(F.col(published).cast("timestamp")) >= second - span))


def last_write(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the last by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return rows.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def insert_ignore(base: DataFrame, delta: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``base`` and the rows of ``delta`` whose key it lacks, the first by ``order`` of each."""
    w = Window.partitionBy(*keys).orderBy(*order)
    fresh = delta.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k").join(base.select(*keys), keys, "left_anti")
    return base.unionByName(fresh)


def freshness(bars: DataFrame, as_of: str, limit: int = 4) -> DataFrame:
    """By symbol: last date, age in days, stale over ``limit``."""
    g = bars.where(F.col("d") <= F.lit(as_of).cast("date")).groupBy("symbol").agg(F.max("d").alias("last_d"), F.count(F.lit(1)).alias("n_bars"))
    age = F.datediff(F.lit(as_of).cast("date"), "last_d")
    return g.withColumn("age_days", age).withColumn("stale", age > limit)


def resolve_quotes(quotes: DataFrame, providers: tuple[str, ...], ttl_seconds: int) -> DataFrame:
    """By symbol: the last quote of the first provider in order that has one no older than the
    limit, seen from the symbol's newest quote; with its change since the provider's first
    quote of that day. ``quotes`` has symbol, provider, ts, id, price; other providers are
    left out."""
    q = quotes.where(F.col("provider").isin(*providers)).groupBy("symbol", "provider", F.to_date("ts").alias("day")).agg(
        F.max_by("price", F.struct("ts", "id")).alias("price"), F.min_by("price", F.struct("ts", "id")).alias("open"), F.max("ts").alias("ts")
    )
    last = q.groupBy("symbol", "provider").agg(F.max_by(F.struct("provider", "price", "open", "ts"), "day").alias("q"))
    fresh = last.withColumn("now", F.max("q.ts").over(Window.partitionBy("symbol"))).where(F.unix_micros("now") - F.unix_micros("q.ts") <= ttl_seconds * 1_000_000)
    rank = F.array_position(F.array(*map(F.lit, providers)), F.col("provider"))
    x = fresh.groupBy("symbol").agg(F.min_by("q", rank).alias("q")).select("symbol", "q.*")
    return x.select("symbol", "provider", "price", "ts", F.when(F.col("open") != 0, F.col("price") / F.col("open") - 1).alias("change_pct"))


def mismatches(ours: DataFrame, theirs: DataFrame, keys: list[str], qty: str) -> DataFrame:
    """Keys that one side lacks or whose quantities differ: full outer."""
    j = ours.select(*keys, F.col(qty).alias("ours")).join(theirs.select(*keys, F.col(qty).alias("theirs")), keys, "full_outer")
    kind = F.when(F.col("theirs").isNull(), "only_ours").when(F.col("ours").isNull(), "only_theirs").when(F.abs(F.col("ours") - F.col("theirs")) > 1e-9, "quantity")
    return j.withColumn("kind", kind).where("kind is not null")


def within_cooldown(orders: DataFrame, minutes: int = 60) -> DataFrame:
    """Orders, live ones only, that repeat symbol, side and mode within ``minutes``."""
    alive = orders.where(~F.col("status").isin("rejected", "cancelled"))
    w = Window.partitionBy("symbol", "side", "mode").orderBy("ts", "id")
    x = alive.withColumn("before", F.lag("ts").over(w)).withColumn("before_id", F.lag("id").over(w))
    gap = F.unix_micros("ts") - F.unix_micros("before")
    return x.where(gap <= minutes * 60_000_000)


def outside_counts(rows: DataFrame) -> DataFrame:
    """``outside``: for how many ranked cycles in a row a held symbol has stood outside the
    target set. ``rows`` has a row for each holding of a cycle: cycle (a running number),
    symbol, in_target, ranked, version.

    It starts anew when the scoring version changes and after a cycle without the holding; a
    cycle without a ranking leaves it as it is. A null version is a version of its own.
    """
    w = Window.partitionBy("symbol").orderBy("cycle")
    version = F.coalesce("version", F.lit("unversioned"))
    anew = F.coalesce((F.lag(version).over(w) != version) | (F.lag("cycle").over(w) != F.col("cycle") - 1), F.lit(False))
    x = rows.withColumn("__in", F.coalesce(F.col("ranked") & F.col("in_target"), F.lit(False))).withColumn("__out", F.coalesce(F.col("ranked") & ~F.col("in_target"), F.lit(False)))
    x = x.withColumn("__anew", anew).withColumn("__island", F.sum((F.col("__anew") | F.col("__in")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("symbol", "__island").orderBy("cycle").rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumn("outside", F.sum(F.col("__out").cast("int")).over(run)).drop("__in", "__out", "__anew", "__island")


def streaks(rows: DataFrame, key: list[str], order: str, flag: Column) -> DataFrame:
    """``streak``: how many rows in a row, up to this one, have ``flag``; 0 where it fails."""
    w = Window.partitionBy(*key).orderBy(order)
    x = rows.withColumn("__f", F.coalesce(flag, F.lit(False)))
    x = x.withColumn("__island", F.sum(F.when(~F.col("__f"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(*key, "__island").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumn("streak", F.sum(F.col("__f").cast("int")).over(run)).drop("__f", "__island")
