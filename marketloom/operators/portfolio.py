"""Target weights, rebalancing, order review, positions and outcomes, many cycles at once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from marketloom.functions.columns import SLIPPAGE_BPS, SPREAD_BPS
from marketloom.operators.joins import next_after
from marketloom.operators.records import first_exit
from marketloom.operators.scan import affine_scan, clamped_sum
from marketloom.operators.sizing import MIN_ORDER, NAME_SHARE

#: How many names, how much is deployed, and what a cycle may do.
MAX_NAMES, DEPLOY, PROBE_SIZE = 12, 0.70, 0.25
MAX_SELLS, MAX_TURNOVER, MAX_TRIM, HYSTERESIS = 2, 0.30, 0.50, 0.05
CYCLE_SHARE, CYCLE_CAP = 0.10, 1_000.0
MAX_DAILY, MAX_OPEN, STALE_DAYS, APPROVAL_SHARE = 3, 12, 4, 0.05
CLOSED = 1e-9
#: Days of a key that one task scans, and fills of a slot of keys up to which each key is stepped through as it stands.
BLOCK_DAYS = 90
SLOTS, WHOLE_ROWS = 16_384, 500_000
ONE_WAY = (SPREAD_BPS + SLIPPAGE_BPS) / 10_000


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def target_weights(candidates: DataFrame) -> DataFrame:
    """``weight`` of the MAX_NAMES best candidates of each cycle (columns cycle, symbol, score,
    expected, atr, size): in proportion to score x expected / atr, capped; what the cap leaves
    is given to the others by their room, in as many rounds as there are names. ``size`` scales
    a probe afterwards. Only MAX_NAMES rows of a cycle are ever in one array. Ties by symbol.
    """
    w = Window.partitionBy("cycle").orderBy(F.desc("score"), "symbol")
    top = candidates.where("expected > 0").withColumn("k", F.row_number().over(w)).where(F.col("k") <= MAX_NAMES)
    raw = F.greatest(F.lit(0.0), F.col("score") * F.col("expected") / F.coalesce("atr", F.lit(0.03)))
    g = top.groupBy("cycle").agg(F.array_sort(F.collect_list(F.struct("k", "symbol", raw.alias("raw"), "size"))).alias("e"))
    total = _total(F.transform("e", lambda x: x["raw"]))
    start = F.transform("e", lambda x: F.least(F.lit(NAME_SHARE), F.when(total > 0, DEPLOY * x["raw"] / total).otherwise(0.0)))

    def fill(ws: Column, _: Column) -> Column:
        room = F.aggregate(ws, F.lit(0.0), lambda a, x: a + F.greatest(NAME_SHARE - x, F.lit(0.0)))
        missing = DEPLOY - _total(ws)
        more = F.transform(ws, lambda x: F.when(x < NAME_SHARE, x + F.least(NAME_SHARE - x, missing * (NAME_SHARE - x) / room)).otherwise(x))
        return F.when((missing <= 1e-6) | (room <= 1e-6), ws).otherwise(more)

    weights = F.aggregate(F.sequence(F.lit(1), F.lit(MAX_NAMES)), start, fill)
    x = g.select("cycle", F.inline(F.arrays_zip(F.col("e.symbol").alias("symbol"), F.col("e.size").alias("size"), weights.alias("w"))))
    return x.select("cycle", "symbol", (F.col("w") * F.greatest(F.lit(0.0), F.least(F.lit(1.0), "size"))).alias("weight"))


def rebalance_sells(positions: DataFrame) -> DataFrame:
    """Which holdings each cycle trims, and by how much (``amount``).

    Positions have cycle, symbol, equity, current, target (a weight), held_score, best_new,
    sessions (since opened), outside (cycles), ready (a verified dossier). A holding is
    eligible after a session; it goes if outside the targets for two cycles or if the best
    new score beats its own; half at most, the best swaps first, within the turnover limit.
    """
    delta = F.col("current") - F.col("equity") * F.col("target")
    displaced = (F.col("target") == 0) & (F.col("outside") >= 2)
    improved = F.col("best_new") >= F.col("held_score") + HYSTERESIS
    x = positions.where(F.col("ready") & (F.col("sessions") >= 1) & (delta >= MIN_ORDER) & (displaced | improved))
    most = F.col("equity") * MAX_TURNOVER
    x = x.withColumn("wish", F.least(delta, F.col("current") * MAX_TRIM, most)).withColumn("gain", F.col("best_new") - F.col("held_score")).withColumn("over", delta / F.col("equity"))
    w = Window.partitionBy("cycle").orderBy(F.desc("gain"), F.desc("over"), "symbol")
    x = x.where(F.col("wish") >= MIN_ORDER).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= MAX_SELLS)
    used = F.coalesce(F.sum("wish").over(Window.partitionBy("cycle").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return x.withColumn("amount", F.least("wish", most - used)).where(F.col("amount") >= MIN_ORDER).select("cycle", "symbol", "rank", "gain", "over", "amount")


def cycle_budget(equity: Column, deployment: Column) -> Column:
    """What a cycle may spend: a share of equity, capped, by what the regime lets be deployed."""
    return F.least(equity * CYCLE_SHARE, F.lit(CYCLE_CAP)) * deployment


def review_orders(orders: DataFrame) -> DataFrame:
    """``verdict, reason, approved`` of every order, in order of submission inside its cycle.

    Orders have cycle, id, ts, symbol, side, notional, switched (a stop is active), age (of the
    data in days), repeat (within the cooldown), equity, budget, open_positions, held (of the
    symbol), deployed, cash. A cycle's orders are one small array, folded with what earlier
    ones have used up; checks that need no state stop an order before any cap does.
    """
    block = (
        F.when((F.col("side") == "buy") & F.col("switched"), "stopped")
        .when(F.col("age").isNull() | (F.col("age") > STALE_DAYS), "stale")
        .when(F.col("repeat"), "duplicate")
        .when(F.col("side") == "sell", "exit")
    )
    row = F.struct("ts", "id", "symbol", "notional", "equity", "held", block.alias("block"))
    g = orders.groupBy("cycle").agg(F.array_sort(F.collect_list(row)).alias("rows"), F.max("budget").alias("budget"), F.max("open_positions").alias("open_positions"), F.max("deployed").alias("deployed"), F.max("cash").alias("cash"))
    out_type = "array<struct<id: bigint, verdict: string, reason: string, approved: double>>"
    state = F.struct(F.col("budget").alias("budget"), F.lit(0).alias("buys"), F.col("deployed").alias("deployed"), F.col("cash").alias("cash"), F.array().cast(out_type).alias("out"))

    def step(s: Column, o: Column) -> Column:
        name_room = o["equity"] * NAME_SHARE - o["held"]
        cash_room = o["equity"] * DEPLOY - s["deployed"]
        room = F.least(s["budget"], name_room, cash_room, s["cash"])
        size = F.least(o["notional"], room)
        full = (
            F.when(s["buys"] >= MAX_DAILY, "daily limit").when(F.col("open_positions") + s["buys"] >= MAX_OPEN, "open positions")
            .when((o["notional"] > s["budget"]) & (s["budget"] < MIN_ORDER), "budget").when((F.least(o["notional"], s["budget"]) > name_room) & (name_room < MIN_ORDER), "single name")
            .when((F.least(o["notional"], s["budget"], name_room) > cash_room) & (cash_room < MIN_ORDER), "deployment").when((size < o["notional"]) & (s["cash"] < MIN_ORDER), "cash")
        )
        reject = F.coalesce(F.when(o["block"] != "exit", o["block"]), F.when(o["block"].isNull(), full))
        verdict = (
            F.when(reject.isNotNull(), "REJECTED").when(o["block"] == "exit", "APPROVED").when(o["notional"] > o["equity"] * APPROVAL_SHARE, "REQUIRES_HUMAN_APPROVAL")
            .when(size < o["notional"], "APPROVED_WITH_SIZE_REDUCTION").otherwise("APPROVED")
        )
        given = F.when(reject.isNotNull(), 0.0).when(o["block"] == "exit", o["notional"]).otherwise(size)
        spent = F.when(verdict.isin("APPROVED", "APPROVED_WITH_SIZE_REDUCTION") & o["block"].isNull(), size).otherwise(0.0)
        row = F.struct(o["id"].alias("id"), verdict.alias("verdict"), F.coalesce(reject, o["block"], F.lit("")).alias("reason"), given.alias("approved"))
        return F.struct((s["budget"] - spent).alias("budget"), (s["buys"] + F.when(spent > 0, 1).otherwise(0)).alias("buys"), (s["deployed"] + spent).alias("deployed"), (s["cash"] - spent).alias("cash"), F.array_append(s["out"], row).alias("out"))

    return g.select("cycle", F.inline(F.aggregate("rows", state, step)["out"]))


#: What a fill is given.
POSITIONS = ("held", "avg_cost", "sold", "realized", "entry_price")


def _stepped(fills: DataFrame) -> DataFrame:
    """``average_cost`` one fill after another, a key's fills a stream in its order; only the last
    position is held between Arrow batches."""
    key = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")).alias(f"__{c}") for c in ("account", "symbol")]  # null is an account of its own
    numbers = [F.coalesce(F.col("qty").cast("double"), F.lit(0.0)).alias("__qty"), F.coalesce(F.col("price").cast("double"), F.lit(float("nan"))).alias("__price")]
    names = fills.columns

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, held, cost = None, 0.0, 0.0
        for batch in batches:
            out = [[], [], [], [], []]
            add = [x.append for x in out]
            for a, s, side, q, p in zip(*(batch.column(c).to_pylist() for c in ("__account", "__symbol", "side", "__qty", "__price")), strict=True):
                if who != (a, s):
                    who, held, cost = (a, s), 0.0, 0.0
                sold = gain = 0.0
                entry = None
                if side == "sell":
                    after = max(held - q, 0.0)
                    after = after if after > CLOSED else 0.0
                    sold = held - after
                    if sold > 0:
                        gain, entry = (p - cost) * sold, cost
                else:
                    after = held + q
                    after = after if after > CLOSED else 0.0
                    if after > 0:
                        cost = (held * cost + q * p) / (held + q)
                held = after
                if not held:
                    cost = 0.0
                for put, v in zip(add, (held, cost if held else None, sold, gain, entry), strict=True):
                    put(v)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(x, pa.float64()) for x in out)], [*names, *POSITIONS])

    x = fills.select("*", *key, *numbers).repartition("__account", "__symbol").sortWithinPartitions("__account", "__symbol", "d", "seq")
    return x.mapInArrow(task, StructType([*fills.schema.fields, *(StructField(c, DoubleType()) for c in POSITIONS)]))


def average_cost(fills: DataFrame, block_days: int = BLOCK_DAYS, most: int = WHOLE_ROWS) -> DataFrame:
    """Fills with the position after each: ``held``, ``avg_cost``, ``sold`` and ``realized``.

    More is never sold than held; a holding under 1e-9 is closed. A key (account and symbol) of
    ordinary size is stepped through in one task. Keys in a slot (of ``SLOTS``, by hash) with more
    than ``most`` fills are cut into blocks (``_scanned``): slots are counted first, few rows a task.
    """
    slot = F.pmod(F.xxhash64("account", "symbol"), F.lit(SLOTS))
    hot = [r.slot for r in fills.groupBy(slot.alias("slot")).count().where(F.col("count") > most).select("slot").collect()]
    if not hot:
        return _stepped(fills)
    return _stepped(fills.where(~slot.isin(hot))).unionByName(_scanned(fills.where(slot.isin(hot)), block_days))


def _scanned(fills: DataFrame, block_days: int) -> DataFrame:
    """``average_cost`` of keys of any size. Both recurrences are scanned
    (``operators.scan``): held is a sum reflected at zero; a purchase mixes the cost before with
    its price, weighted by what was held and what is bought, a sale leaves it as it is. Blocks
    are ``block_days`` of an (account, symbol), so its rows spread over tasks.
    """
    key, order = ["__account", "__symbol"], ["d", "seq"]
    sell = F.col("side") == "sell"
    x = fills.withColumns({f"__{c}": F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in ("account", "symbol")})  # null is an account of its own
    x = x.withColumn("__block", F.floor(F.unix_date("d") / block_days)).withColumn("__change", F.when(sell, -F.col("qty")).otherwise(F.col("qty")))
    x = clamped_sum(x, key, "__block", order, "__change", "__held")
    closed = lambda c: F.when(F.col(c) > CLOSED, F.col(c)).otherwise(0.0)
    x = x.withColumn("held", closed("__held")).withColumn("__before", closed("__held_before"))
    bought = ~sell & (F.col("held") > 0)
    x = x.withColumn("__scale", F.when(bought, F.least(F.lit(1.0), F.col("__before") / F.col("held"))).when(sell & (F.col("held") > 0), 1.0).otherwise(0.0))
    x = x.withColumn("__shift", F.when(bought, (1 - F.col("__scale")) * F.col("price")).otherwise(0.0))
    block = [*key, "__block"]
    x = affine_scan(x, block, order, "__scale", "__shift")
    last = x.groupBy(*block).agg(F.max_by(F.struct("__scale", "__shift"), F.struct(*order)).alias("l")).select(*block, "l.*")
    v = Window.partitionBy(*key).orderBy("__block")
    begun = affine_scan(last, key, ["__block"], "__scale", "__shift").select(*block, F.coalesce(F.lag("__shift").over(v), F.lit(0.0)).alias("__start"))
    x = x.join(begun, block)
    w = Window.partitionBy(*block).orderBy(*order)
    cost = F.col("__scale") * F.col("__start") + F.col("__shift")
    x = x.withColumn("__cost", cost).withColumn("__avg", F.coalesce(F.lag("__cost").over(w), "__start")).withColumn("avg_cost", F.when(F.col("held") > 0, F.col("__cost")))
    x = x.withColumn("sold", F.when(sell, F.col("__before") - F.col("held")).otherwise(0.0))
    x = x.withColumn("realized", F.when(F.col("sold") > 0, (F.col("price") - F.col("__avg")) * F.col("sold")).otherwise(0.0)).withColumn("entry_price", F.when(F.col("sold") > 0, F.col("__avg")))
    return x.drop(*key, "__block", "__change", "__held", "__held_before", "__before", "__scale", "__shift", "__start", "__cost", "__avg")


def round_trips(positions: DataFrame) -> DataFrame:
    """A trade for every sale of ``average_cost``: entry, exit, quantity, gain and return."""
    x = positions.where("sold > 0")
    return x.select("account", "symbol", "seq", F.col("d").alias("exit_date"), "entry_price", F.col("price").alias("exit_price"), F.col("sold").alias("qty"), F.col("realized").alias("pnl"), (F.col("price") / F.col("entry_price") - 1).alias("ret"))


def net_pnl(positions: DataFrame, marks: DataFrame) -> DataFrame:
    """By account: realised gains, open holdings at the last mark, their sum, and the gain of
    the last day against the mark before. Holdings without a mark count at cost."""
    last = positions.groupBy("account", "symbol").agg(F.sum("realized").alias("realized"), F.max_by(F.struct("held", "avg_cost"), F.struct("d", "seq")).alias("p"))
    w = Window.partitionBy("symbol").orderBy(F.desc("d"))
    m = marks.withColumn("k", F.row_number().over(w)).where("k <= 2").groupBy("symbol").agg(F.max(F.when(F.col("k") == 1, F.col("close"))).alias("mark"), F.max(F.when(F.col("k") == 2, F.col("close"))).alias("prior"))
    x = last.join(m, "symbol", "left").withColumn("mark", F.coalesce("mark", "p.avg_cost"))
    open_ = F.when(F.col("p.held") > 0, F.col("p.held") * (F.col("mark") - F.col("p.avg_cost"))).otherwise(0.0)
    day = F.when(F.col("p.held") > 0, F.col("p.held") * (F.col("mark") - F.coalesce("prior", "mark"))).otherwise(0.0)
    g = x.groupBy("account").agg(F.sum("realized").alias("realized"), F.sum(open_).alias("unrealized"), F.sum(day).alias("day_pnl"))
    return g.withColumn("net", F.col("realized") + F.col("unrealized"))


def replay(signals: DataFrame, bars: DataFrame, horizon: int = 20, stop: float = 0.036) -> DataFrame:
    """The outcome of every signal (symbol, d): bought at the next bar's open after costs, left
    by ``first_exit``, sold after costs. Signals without a next bar or an exit give no row."""
    at = next_after(signals.select("symbol", "d"), bars.select("symbol", "d", F.col("d").alias("entry_d"), F.col("open").alias("o")), ["entry_d", "o"], ["symbol"], "d").where("entry_d is not null")
    entries = at.select("symbol", F.col("entry_d").alias("d"), (F.col("o") * (1 + ONE_WAY)).alias("close"))
    out = first_exit(entries, bars, horizon, stop).withColumn("sold_at", F.col("exit") * (1 - ONE_WAY))
    return at.select("symbol", F.col("d").alias("signal_d"), "entry_d").join(out, ["symbol", "entry_d"]).select("symbol", "signal_d", "entry_d", "entry", "exit_d", "sold_at", "reason", (F.col("sold_at") / F.col("entry") - 1).alias("net_ret"), F.lit("backtest").alias("source"))


def limit_price(side: Column, price: Column, bps: float = 10.0) -> Column:
    """A little over the price for buys, under it for sells; to the cent (halves go up)."""
    return F.round(price * F.when(side == "buy", 1 + bps / 10_000).otherwise(1 - bps / 10_000) + 1e-9, 2)


def quantity(notional: Column, limit: Column, option: Column) -> Column:
    """Shares to six digits, or whole contracts of a hundred."""
    return F.when(option, F.floor(notional / (limit * 100)).cast("double")).otherwise(F.round(notional / limit, 6))


def expired(items: DataFrame, now: Column) -> DataFrame:
    """``status`` of pending items past ``expires_at``: approvals expire, steering is adopted or
    leaves things as they are, by ``kind``."""
    late = (F.col("status") == "pending") & (F.col("expires_at") < now)
    after = F.when(F.col("kind") == "approval", "expired").when(F.col("kind") == "suggestion", "adopted").otherwise("status_quo")
    return items.withColumn("status", F.when(late, after).otherwise(F.col("status")))


def staleness(active: DataFrame, now: Column, regime: Column, days: int) -> DataFrame:
    """``stale_reason``: none active, older than ``days``, or made under another regime."""
    reason = F.when(F.col("activated_at").isNull(), "none active").when(F.datediff(now, "activated_at") > days, "too old").when(F.col("made_under") != regime, "regime changed")
    return active.withColumn("stale_reason", reason)
