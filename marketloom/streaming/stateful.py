"""Operators with state of their own: throttled marks, rejection switches, news within a retention.

Rows may come late and out of order, up to the watermark's delay. They wait in the state, which is
therefore bounded by that delay, and are taken in event-time order once the watermark has passed
them; results do not depend on how rows fall into batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from marketloom.sources.fixtures import shared_path, stored

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
DAY = 86_400_000_000


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that start in here keep their state in RocksDB, which these processors need."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def arriving(rows: DataFrame, at: str, late_minutes: int, label: str, batches: int = 4, files: int = 2, ends: bool = False) -> DataFrame:
    """``rows`` as a stream of ``batches`` micro-batches in order of arrival: each row comes up to
    ``late_minutes`` after its ``at``, by a hash of its content. A stream that ``ends`` has one
    row more, nulls a day after twice that delay: the watermark passes all others, and not it.
    The rows are made once and kept with their times of arrival."""
    spark = rows.sparkSession
    path = shared_path(spark, label)
    delay = F.pmod(F.xxhash64(*rows.columns), F.lit(late_minutes * 60_000_000 + 1))
    x = stored(rows.withColumn("__arrival", F.unix_micros(at) + delay), f"{label}-rows")
    edges = x.agg(F.percentile_approx("__arrival", [k / batches for k in range(1, batches)], F.lit(1000)).alias("e")).first().e or []
    for k, (low, high) in enumerate(zip([None, *edges], [*edges, None], strict=True)):
        part = x if low is None else x.where(F.col("__arrival") >= low)
        part = part if high is None else part.where(F.col("__arrival") < high)
        part.drop("__arrival").repartition(files).write.parquet(f"{path}/batch={k}")
    if ends:
        end = x.agg((F.max(at) + F.make_dt_interval(days=F.lit(1), mins=F.lit(2 * late_minutes))).alias(at))
        end.select(*(F.col(f.name) if f.name == at else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema)).write.parquet(f"{path}/batch={batches}")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/*")


class InOrder(StatefulProcessor):
    """Rows of a key, (time, value) pairs, in order of time once the watermark has passed them.

    The state is one row a key: what ``step`` keeps, and the times and values that wait. A
    timer stands on the first of those, or on what ``wake`` asks for.
    """

    #: What ``step`` keeps: long numbers, null at first.
    KEEPS: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = ", ".join(f"{c} long" for c in self.KEEPS)
        self.state = handle.getValueState("state", f"{fields}, times array<long>, marks array<double>")

    def step(self, kept: list, us: int, value: float, out: list) -> None:
        """Take one row: change ``kept``, append results to ``out``."""
        raise NotImplementedError

    def wake(self, kept: list) -> int | None:
        """A time at which something happens without a row."""
        return None

    def woken(self, kept: list, us: int, out: list) -> None:
        """The watermark has passed ``us``, and all rows before it are taken."""

    def frame(self, key: tuple, out: list) -> pd.DataFrame:
        raise NotImplementedError

    def _load(self) -> tuple[list, list]:
        if not self.state.exists():
            return [None] * len(self.KEEPS), []
        *kept, times, marks = self.state.get()
        return kept, list(zip(times, marks, strict=True))

    def _save(self, kept: list, waiting: list) -> None:
        self.state.update((*kept, [t for t, _ in waiting], [v for _, v in waiting]))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        nexts = [t for t in (waiting[0][0] if waiting else None, self.wake(kept)) if t is not None]
        if nexts:
            self.handle.registerTimer(min(nexts) // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept, waiting = self._load()
        for pdf in rows:
            waiting += zip(pdf["us"].tolist(), pdf["value"].tolist(), strict=True)
        self._save(kept, sorted(waiting))
        yield self.frame(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        kept, waiting = self._load()
        mark, out, n = timerValues.getCurrentWatermarkInMs() * 1000, [], 0
        while n < len(waiting) and waiting[n][0] < mark:
            self.step(kept, *waiting[n], out)
            n += 1
        self.woken(kept, mark, out)
        self._save(kept, waiting[n:])
        yield self.frame(key, out)


def _times(us: list[int]) -> pd.Series:
    return pd.to_datetime(pd.Series(us, dtype="int64"), unit="us", utc=True)


def in_order(rows: DataFrame, key: str, at: str, value: str, delay: str, processor: InOrder, schema: str) -> DataFrame:
    """``processor`` over a stream of rows by ``key``; results have the times that it gives."""
    x = rows.select(F.col(key), F.col(at), F.unix_micros(at).alias("us"), F.col(value).cast("double").alias("value")).withWatermark(at, delay)
    return x.groupBy(key).transformWithStateInPandas(processor, schema, "append", "EventTime")


class Throttle(InOrder):
    """One mark each ``gap`` since the last that was kept; of one time the smallest."""

    KEEPS = ("last",)

    def __init__(self, gap_us: int):
        self.gap = gap_us

    def step(self, kept, us, value, out):
        if kept[0] is None or us - kept[0] >= self.gap:
            kept[0] = us
            out.append((us, value))

    def frame(self, key, out):
        return pd.DataFrame({"source": pd.Series([key[0]] * len(out), dtype="object"), "ts": _times([t for t, _ in out]), "equity": pd.Series([v for _, v in out], dtype="float64")})


def throttled_marks(marks: DataFrame, minutes: int = 5, delay: str = "30 minutes") -> DataFrame:
    """Marks (source, ts, equity), one for each source per ``minutes`` since the last kept one."""
    return in_order(marks, "source", "ts", "equity", delay, Throttle(minutes * 60_000_000), "source string, ts timestamp, equity double")


class RejectionSwitch(InOrder):
    """Trips on more than ``most`` rejections of a day; clears by itself after ``cooldown``, or by
    hand. Either starts the count anew; rejections while it is on do not count."""

    KEEPS = ("day", "count", "tripped", "clears")

    def __init__(self, most: int, cooldown_us: int):
        self.most, self.cooldown = most, cooldown_us

    def _clear(self, kept, us, how, out):
        out.append((kept[2], kept[1], us, how))
        kept[1:] = [0, None, None]

    def step(self, kept, us, value, out):
        self.woken(kept, us, out)
        if value:  # cleared by hand
            if kept[2] is not None:
                self._clear(kept, us, "manual", out)
            kept[1] = 0
        elif kept[2] is None:
            if kept[0] != us // DAY:
                kept[0], kept[1] = us // DAY, 0
            kept[1] += 1
            if kept[1] > self.most:
                kept[2], kept[3] = us, us + self.cooldown

    def wake(self, kept):
        return kept[3]

    def woken(self, kept, us, out):
        if kept[3] is not None and kept[3] <= us:
            self._clear(kept, kept[3], "cooldown", out)

    def frame(self, key, out):
        col = lambda k, t: pd.Series([r[k] for r in out], dtype=t)
        return pd.DataFrame({"mode": pd.Series([key[0]] * len(out), dtype="object"), "tripped_at": _times([r[0] for r in out]), "rejected": col(1, "int64"), "cleared_at": _times([r[2] for r in out]), "how": col(3, "object")})


def rejection_switches(orders: DataFrame, most: int = 5, cooldown_minutes: int = 30, delay: str = "30 minutes") -> DataFrame:
    """Every time that the switch of a mode was on and has been cleared. ``orders`` has mode, ts
    and ``clears``: true where a person clears the switch, false for a rejected order."""
    return in_order(orders, "mode", "ts", "clears", delay, RejectionSwitch(most, cooldown_minutes * 60_000_000), "mode string, tripped_at timestamp, rejected long, cleared_at timestamp, how string")


#: Fixed value: groups into which keys are dealt, each with one row of state.
GROUPS = 1024


def once_within(rows: DataFrame, key: str, at: str, days: float, delay: str) -> DataFrame:
    """``key`` and ``at`` of rows whose key was not let through in the ``days`` before. A key's
    state is one time; it goes when the watermark is ``days`` past it. Rows of a key have to come
    in order, up to those of one batch. Keys are dealt into groups by hash: Python is called, and
    state read and written, once a group and not once a key."""
    span = round(days * DAY)

    def keep(_, pdfs, state):
        passed = state.getCurrentWatermarkMs() * 1000
        first = {k: us for k, us in zip(*state.get, strict=True) if us + span > passed} if state.exists else {}
        out = []
        if not state.hasTimedOut:
            # in order of time; a key may be null
            for us, k in sorted((r for pdf in pdfs for r in zip(pdf["us"].tolist(), pdf[key].tolist(), strict=True)), key=lambda r: r[0]):
                if k not in first or us - first[k] >= span:
                    first[k] = us
                    out.append((k, us))
        if first:
            state.update((list(first), list(first.values())))
            state.setTimeoutTimestamp(max((min(first.values()) + span) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame({key: pd.Series([k for k, _ in out], dtype="object"), at: _times([us for _, us in out])})

    x = rows.select(F.col(key).cast("string").alias(key), at, F.unix_micros(at).alias("us")).withWatermark(at, delay)
    x = x.withColumn("__group", F.pmod(F.xxhash64(key), F.lit(GROUPS)))
    return x.groupBy("__group").applyInPandasWithState(keep, f"{key} string, {at} timestamp", "keys array<string>, firsts array<long>", "append", "EventTimeTimeout")


#: Fixed values. A bucket of time is so many times as long as a fill may come after its order; the
#: orders of a block are of one part of that time; and a block has at most so many orders and fills.
SPANS = 2
PARTS = 4
BLOCK = 1024
_BLOCKS = "symbol string, mode string, ids array<string>, times array<long>, fill_ids array<string>, fill_times array<long>, pairs long"


def matched_blocks(orders: DataFrame, fills: DataFrame, hours: int = 6, delay: str = "1 hour") -> DataFrame:
    """The rows of ``streams.matched_orders`` over two streams, in blocks: ``symbol``, ``mode``, some
    ``orders`` and some ``fills`` (arrays of ids and times), and how many ``pairs`` of them are
    matches. Every match is in one block. An order without a fill comes out with a null one, once
    the watermark has passed it. ``streams.pairs`` makes rows of blocks.

    Matches grow with the square of a symbol's rows, what is kept and written here with the rows:
    an order or fill is in blocks of its bucket of time, by batch, and not once a match. The state
    of a symbol, mode and bucket is what the watermark has not passed.
    """
    span = hours * 3_600_000_000
    own, first = (F.floor((F.col("us") - late) / (SPANS * span)) for late in (0, span))

    def side(rows: DataFrame, status: str) -> DataFrame:
        x = rows.where((F.col("status") == status) & F.col("ts").isNotNull()).withWatermark("ts", delay)
        return x.select(F.col("symbol").cast("string"), F.col("mode").cast("string"), "ts", F.unix_micros("ts").alias("us"), F.col("id").cast("string").alias("id"), F.lit(status == "filled").alias("fill"))

    def meet(key, pdfs, state):
        passed = state.getCurrentWatermarkMs() * 1000
        *o, alone, fu, fi = state.get if state.exists else ([], [], [], [], [])
        ou, oi, alone = _longs(o[0]), _objects(o[1]), np.array(alone, bool)
        fu, fi = _longs(fu), _objects(fi)
        out = []
        if not state.hasTimedOut:
            new = pd.concat(list(pdfs))
            us, ids, fill = new["us"].to_numpy(), new["id"].to_numpy(object), new["fill"].to_numpy(bool)
            if any(pd.isna(k) for k in key[:2]):  # nulls are equal to nothing
                us, ids, fill = us[~fill], ids[~fill], fill[~fill]
            more = np.flatnonzero(fill)[np.argsort(us[fill], kind="stable")]
            out.append(_blocks(ou, oi, us[more], ids[more], span))  # orders of batches before, with new fills
            alone &= ~_found(ou, us[more], span)
            fu, fi = _merged(fu, fi, us[more], ids[more])
            more = np.flatnonzero(~fill)[np.argsort(us[~fill], kind="stable")]
            out.append(_blocks(us[more], ids[more], fu, fi, span))  # new orders, with all fills
            alone = _merged(ou, alone, us[more], ~_found(us[more], fu, span))[1]
            ou, oi = _merged(ou, oi, us[more], ids[more])
        over = ou + span < passed
        left = np.flatnonzero(over & alone)
        out.append([(oi[left[k : k + BLOCK]], ou[left[k : k + BLOCK]], [None], [None], len(left[k : k + BLOCK])) for k in range(0, len(left), BLOCK)])
        ou, oi, alone, fu, fi = ou[~over], oi[~over], alone[~over], fu[fu >= passed], fi[fu >= passed]
        if len(ou) or len(fu):
            state.update((ou.tolist(), oi.tolist(), alone.tolist(), fu.tolist(), fi.tolist()))
            state.setTimeoutTimestamp(max(int(ou[0] + span if len(ou) else fu[-1]) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        symbol, mode = (None if pd.isna(k) else k for k in key[:2])
        blocks = chain(*out)
        while some := list(islice(blocks, 64)):
            yield pd.DataFrame([(symbol, mode, *block) for block in some], columns=[f.split()[0] for f in _BLOCKS.split(", ")])

    o = side(orders, "placed").withColumn("b", own)
    f = side(fills, "filled").withColumn("b", F.explode(F.sequence(first, own)))
    state = "times array<long>, ids array<string>, alone array<boolean>, fill_times array<long>, fill_ids array<string>"
    x = o.unionByName(f).groupBy("symbol", "mode", "b").applyInPandasWithState(meet, _BLOCKS, state, "append", "EventTimeTimeout")
    x = x.withColumns({"id": F.col("ids").cast(f"array<{orders.schema['id'].dataType.simpleString()}>"), "us": F.col("times")})
    x = x.withColumns({"fill_id": F.col("fill_ids").cast(f"array<{fills.schema['id'].dataType.simpleString()}>"), "fill_us": F.col("fill_times")})
    return x.select("symbol", "mode", F.arrays_zip("id", "us").alias("orders"), F.arrays_zip("fill_id", "fill_us").alias("fills"), "pairs")


def _longs(values: list) -> np.ndarray:
    return np.array(values, np.int64)


def _objects(values: list) -> np.ndarray:
    out = np.empty(len(values), object)
    out[:] = values
    return out


def _merged(us: np.ndarray, values: np.ndarray, more_us: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two lists in order of time as one."""
    every = np.concatenate([us, more_us])
    order = np.argsort(every, kind="stable")
    return every[order], np.concatenate([values, more])[order]


def _found(ou: np.ndarray, fu: np.ndarray, span: int) -> np.ndarray:
    """Which orders have a fill in their span; both are in order of time."""
    return np.searchsorted(fu, ou + span, side="right") > np.searchsorted(fu, ou)


def _blocks(ou: np.ndarray, oi: np.ndarray, fu: np.ndarray, fi: np.ndarray, span: int) -> Iterator[tuple]:
    """Blocks with all pairs of an order and a fill in its span; both are in order of time."""
    low, high = np.searchsorted(fu, ou), np.searchsorted(fu, ou + span, side="right")
    at, k = np.flatnonzero(high > low), 0
    while k < len(at):
        some = at[k : k + BLOCK]
        some = some[ou[some] <= ou[some[0]] + span // PARTS]
        k += len(some)
        for j in range(low[some[0]], high[some[-1]], BLOCK):
            to = min(j + BLOCK, high[some[-1]])
            near = some[(low[some] < to) & (high[some] > j)]
            if len(near):
                yield oi[near], ou[near], fi[j:to], fu[j:to], int((np.minimum(high[near], to) - np.maximum(low[near], j)).sum())
