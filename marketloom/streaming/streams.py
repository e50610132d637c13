"""Event-time operators as Structured Streaming queries.

A stream runs with ``availableNow``: it takes what is there, in batches, and stops. Batches go
to Parquet in the shared folder in update mode; reading back, the last batch of a key wins,
so late rows inside the watermark correct what was written before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators.joins import last_write
from marketloom.sources.fixtures import shared_path
from marketloom.streaming.stateful import rocksdb


#: Fixed value: buckets in the time that a fill may come after its order.
PARTS = 3
#: Fixed value: matched orders that a task makes of blocks, on average.
TASK_PAIRS = 4_000_000


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables as a stream of files."""
    path = f"{sf_dir}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}{{,}}")  # a table is one file or a folder


def run_available(stream: DataFrame, label: str, keys: list[str]) -> DataFrame:
    """Run an updating stream over what is there; the last value of every key."""
    spark = stream.sparkSession
    path = shared_path(spark, label)
    out = f"{path}/rows"

    def keep(batch: DataFrame, number: int) -> None:
        # The batch number is part of the path: a batch that is run again replaces itself.
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return last_write(spark.read.parquet(out), keys, [F.col("batch")]).drop("batch")


def rejection_storm(orders: DataFrame, most: int = 5) -> DataFrame:
    """By (mode, day): rejected orders, and whether they are more than ``most``."""
    days = orders.where("status = 'rejected'").withWatermark("ts", "2 days").groupBy(F.window("ts", "1 day"), "mode")
    counted = days.agg(F.count(F.lit(1)).alias("rejected"))
    return counted.select(F.col("window.start").alias("day"), "mode", "rejected", (F.col("rejected") > most).alias("storm"))


def hourly_news(news: DataFrame) -> DataFrame:
    """By (symbol, hour): headlines, and their weights and weighted stances, decayed to the
    hour's end. The state is a row an hour and symbol, however long the score's window is."""
    x = news.where("stance is not null").withWatermark("published_at", "7 days").withColumn("w", F.window("published_at", "1 hour"))
    age = (F.unix_micros(F.col("w.end")) - F.unix_micros("published_at")) / 3.6e9
    x = x.withColumn("weight", F.exp(-age / 48) * F.col("confidence") * F.coalesce("reliability", F.lit(0.5)))
    g = x.groupBy("symbol", "w").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"), F.sum(F.col("stance") * F.col("weight")).alias("s"))
    return g.select("symbol", F.col("w.end").alias("hour_end"), "n", "weight", "s")


def rolling_news(hours: DataFrame, length_hours: int = 168) -> DataFrame:
    """By (symbol, hour): the score of the headlines of the last seven days, refreshed hourly,
    from what ``hourly_news`` has put together. An hour's sum fades by whole hours."""
    x = hours.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(length_hours - 1)))).withColumn("fade", F.exp(-F.col("k") / 48.0))
    g = x.groupBy("symbol", (F.col("hour_end") + F.make_dt_interval(hours=F.col("k"))).alias("window_end"))
    return g.agg(F.sum("n").alias("n"), (F.sum(F.col("s") * F.col("fade")) / F.sum(F.col("weight") * F.col("fade"))).alias("score"))


def fresh_orders(orders: DataFrame, minutes: int = 60) -> DataFrame:
    """Live orders, the first of each (symbol, side, mode) inside ``minutes``: repeats inside the
    watermark are dropped with state that expires."""
    alive = orders.where(~F.col("status").isin("rejected", "cancelled"))
    return alive.withWatermark("ts", f"{minutes} minutes").dropDuplicatesWithinWatermark(["symbol", "side", "mode"])


def latest_bars(ticks: DataFrame) -> DataFrame:
    """By (symbol, day): the last tick, updated by late ones inside the watermark."""
    g = ticks.withWatermark("ts", "3 days").groupBy("symbol", F.window("ts", "1 day"))
    return g.agg(F.max_by("notional", F.struct("ts", "id")).alias("close"), F.max("ts").alias("at"), F.count(F.lit(1)).alias("ticks")).select("symbol", F.col("window.start").alias("day"), "close", "at", "ticks")


def scan_sessions(scans: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """By mode: stretches of completed scans without a gap; a stretch's end is when the
    heartbeat went stale."""
    g = scans.withWatermark("ts", "1 day").groupBy("mode", F.session_window("ts", gap))
    return g.agg(F.count(F.lit(1)).alias("scans")).select("mode", F.col("session_window.start").alias("began"), F.col("session_window.end").alias("stale_at"), "scans")


def matched_orders(orders: DataFrame, fills: DataFrame, hours: int = 6) -> DataFrame:
    """Placed orders with the fills of the same symbol and mode in the ``hours`` after: a join
    of two streams, bounded in time on both sides; orders without a fill come out with nulls
    once the watermark has passed them.

    An order stands in one bucket of time, a fill in its own and in each before that can hold its
    orders: an order is held against the fills of little more than its ``hours``, not against all
    that the state holds of its symbol, and a symbol is spread over tasks.
    """
    span = hours * 3_600_000_000 // PARTS
    o = orders.where("status = 'placed'").select("id", "symbol", "mode", "ts", F.floor(F.unix_micros("ts") / span).alias("b")).withWatermark("ts", "1 hour")
    own = F.floor(F.unix_micros("filled_at") / span)
    f = fills.where("status = 'filled'").select(F.col("id").alias("fill_id"), F.col("symbol").alias("fs"), F.col("mode").alias("fm"), F.col("ts").alias("filled_at")).withWatermark("filled_at", "1 hour")
    f = f.withColumn("fb", F.explode(F.sequence(own - PARTS, own)))
    near = F.expr(f"symbol = fs and mode = fm and b = fb and filled_at >= ts and filled_at <= ts + interval {hours} hours")
    return o.join(f, near, "left_outer").select("id", "symbol", "mode", "ts", "fill_id", "filled_at")


def pairs(blocks: DataFrame, hours: int = 6) -> DataFrame:
    """The rows of ``matched_orders`` from what ``stateful.matched_blocks`` gave. Blocks are dealt
    into tasks by what comes out of them; rows are made only where they are read."""
    total = blocks.agg(F.sum("pairs")).first()[0] or 0
    x = blocks.repartition(total // TASK_PAIRS + 1) if total > TASK_PAIRS else blocks
    x = x.select("symbol", "mode", "fills", F.inline("orders"))
    # An order's own fills first: the rows of one order, not of a block, wait to be taken. Each order of a block has some.
    near = lambda f: f["fill_us"].isNull() | f["fill_us"].between(F.col("us"), F.col("us") + hours * 3_600_000_000)
    x = x.select("id", "symbol", "mode", "us", F.filter("fills", near).alias("fills")).select("id", "symbol", "mode", "us", F.inline_outer("fills"))
    return x.select("id", "symbol", "mode", F.timestamp_micros("us").alias("ts"), "fill_id", F.timestamp_micros("fill_us").alias("filled_at"))


def latest_quotes(quotes: DataFrame) -> DataFrame:
    """By symbol: the last quote; what reads it drops quotes older than their time to live."""
    return quotes.groupBy("symbol").agg(F.max_by("notional", F.struct("ts", "id")).alias("price"), F.max("ts").alias("at"))


def append_available(stream: DataFrame, label: str) -> DataFrame:
    """Run an appending stream over what is there; everything that came out."""
    spark = stream.sparkSession
    path = shared_path(spark, label)
    with rocksdb(spark):
        query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
