"""Streams over several micro-batches: late rows, switches that clear and trip again, state that goes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from marketloom.operators import sizing
from marketloom.streaming import stateful, streams

T0 = dt.datetime(2024, 1, 1, 9, 0)


def at(minutes: float) -> dt.datetime:
    return T0 + dt.timedelta(minutes=minutes)


def run(spark, stream, name):
    """The rows of a stream and how many rows of state it held at the end of each batch."""
    with stateful.rocksdb(spark):
        q = stream.writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect(), [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]


def test_a_switch_trips_clears_and_trips_again(spark):
    rejected = [at(k) for k in range(7)]  # trips at minute 5; minute 6 does not count
    again = [at(36 + k) for k in range(6)]  # after the cooldown a new count: trips at 41
    rows = [("paper", t, False) for t in rejected + again] + [("paper", at(50), True)]  # cleared by hand
    rows += [("paper", at(51 + k), False) for k in range(6)]  # trips at 56, its cooldown ends by timer
    rows += [("live", at(k), False) for k in range(5)] + [("paper", at(300), True), ("live", at(300), True)]
    stream = stateful.arriving(spark.createDataFrame(rows, "mode string, ts timestamp, clears boolean"), "ts", 30, "t7")
    out, _ = run(spark, stateful.rejection_switches(stream), "t7")
    got = sorted((r.mode, r.tripped_at, r.rejected, r.cleared_at, r.how) for r in out)
    assert got == [("paper", at(5), 6, at(35), "cooldown"), ("paper", at(41), 6, at(50), "manual"), ("paper", at(56), 6, at(86), "cooldown")]


def test_a_new_day_counts_anew(spark):
    late = [dt.datetime(2024, 1, 1, 23, 50 + k) for k in range(3)] + [dt.datetime(2024, 1, 2, 0, k) for k in range(4)]
    rows = [("paper", t, False) for t in late] + [("paper", dt.datetime(2024, 1, 2, 9), True)]
    out, _ = run(spark, stateful.rejection_switches(stateful.arriving(spark.createDataFrame(rows, "mode string, ts timestamp, clears boolean"), "ts", 30, "t7b")), "t7b")
    assert out == []


def test_marks_do_not_depend_on_batches(spark):
    rows = [("a", at(k * 1.7), float(k)) for k in range(300)] + [("b", at(k * 4), float(k)) for k in range(60)]
    df = spark.createDataFrame(rows, "source string, ts timestamp, equity double")
    results = []
    for n, batches in enumerate((1, 5)):
        out, held = run(spark, stateful.throttled_marks(stateful.arriving(df, "ts", 30, "t1", batches)), f"t1_{n}")
        results.append(sorted(map(tuple, out)))
        assert max(held) <= 4  # a row of state a source, and its timer
    assert results[0] == results[1]
    times = [t for s, t, _ in results[0] if s == "a"]
    assert all(b - a >= dt.timedelta(minutes=5) for a, b in zip(times, times[1:], strict=False)) and len(times) > 80


def test_state_of_old_news_goes(spark):
    rows = [(f"h{k}", dt.datetime(2024, 1, 1) + dt.timedelta(days=k)) for k in range(300)] + [("h0", dt.datetime(2024, 1, 20)), ("h0", dt.datetime(2024, 2, 5))]
    df = spark.createDataFrame(rows, "h string, ts timestamp")
    out, held = run(spark, stateful.once_within(stateful.arriving(df, "ts", 30, "t4", batches=10), "h", "ts", 30, "30 minutes"), "t4")
    assert sorted(r.ts.day for r in out if r.h == "h0") == [1, 5] and len(out) == 301
    assert max(held[3:]) < 100 and held[-1] < 100


def test_orders_without_a_fill_come_out(spark):
    o = [(k, "S", "paper", at(k * 60), "placed") for k in range(40)]
    f = [(100 + k, "S", "paper", at(k * 60 + 1), "filled") for k in range(0, 40, 10)]
    schema = "id long, symbol string, mode string, ts timestamp, status string"
    orders, fills = (stateful.arriving(spark.createDataFrame(x, schema), "ts", 30, "t8", batches=3, files=1) for x in (o, f))
    out, _ = run(spark, streams.matched_orders(orders, fills, hours=2), "t8")
    alone = {r.id for r in out if r.fill_id is None}
    assert {r.id: r.fill_id for r in out if r.fill_id} == {0: 100, 9: 110, 10: 110, 19: 120, 20: 120, 29: 130, 30: 130}
    assert alone and alone <= set(range(40)) - {0, 8, 9, 10, 18, 19, 20, 28, 29, 30} | {8, 18, 28} and {1, 2, 3, 11, 12} <= alone


def test_rejections_of_a_day_since_the_last_reset(spark):
    rows = [(k, "paper", at(k), "rejected", False) for k in range(7)] + [(20, "paper", at(2.5), "filled", True), (21, "live", at(1), "rejected", False)]
    out = sizing.rejections(spark.createDataFrame(rows, "id long, mode string, ts timestamp, status string, clears boolean"))
    assert {r.mode: (r.rejected, r.rejected_orders) for r in out.collect()} == {"paper": (4, False), "live": (1, False)}
    more = out.sparkSession.createDataFrame(rows + [(30 + k, "paper", at(30 + k), "rejected", False) for k in range(2)], "id long, mode string, ts timestamp, status string, clears boolean")
    assert sizing.rejections(more).where(F.col("mode") == "paper").first().rejected_orders


def test_a_stream_that_ends_gives_its_last_marks(spark):
    """The marks of the last half hour come out too, and nothing of the row that ends it; a null
    source is one like others."""
    rows = [(s, at(k * 1.7), float(k)) for s in ("a", None) for k in range(60)]
    df = spark.createDataFrame(rows, "source string, ts timestamp, equity double")
    out, _ = run(spark, stateful.throttled_marks(stateful.arriving(df, "ts", 30, "t1e", 3, ends=True)), "t1e")
    for source in ("a", None):
        assert sorted(r.equity for r in out if r.source == source) == [float(k) for k in range(0, 60, 3)]
    assert len(out) == 40


def test_rows_of_a_stream_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(pdfs):
        for pdf in pdfs:
            made.add(len(pdf))
            yield pdf

    df = spark.createDataFrame([(k, at(k)) for k in range(50)], "k long, ts timestamp")
    stateful.arriving(df.mapInPandas(count, df.schema), "ts", 30, "once")
    assert made.value == 50


def test_orders_meet_fills_of_near_buckets_only(spark):
    """Two days of orders and fills of one symbol: what the join compares grows with what it
    gives, not with the state; fills at both ends of the six hours count once."""
    o = [(k, "S", "paper", at(k * 15), "placed") for k in range(192)]
    f = [(1000 + k, "S", "paper", at(k * 15), "filled") for k in range(192)]
    df = [spark.createDataFrame(x, "id long, symbol string, mode string, ts timestamp, status string") for x in (o, f)]
    with_buckets = streams.matched_orders(*df)
    keys = with_buckets._jdf.queryExecution().optimizedPlan().toString()
    assert "(b#" in keys and "= fb#" in keys
    got = sorted((r.id, r.fill_id) for r in with_buckets.collect())
    assert got == [(k, 1000 + j) for k in range(192) for j in range(k, min(k + 25, 192))]


def test_news_is_kept_in_one_row_of_state_a_group(spark):
    """Many more keys than groups: the state has a row a group, and each key its own times; one
    comes again before and after its span, one is null."""
    day = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(days=k)
    rows = [(f"h{k}", day(k % 20)) for k in range(3 * stateful.GROUPS)]
    rows += [("h0", day(29)), ("h0", day(30)), ("h1", day(32)), (None, day(3)), (None, day(4))]
    stream = stateful.arriving(spark.createDataFrame(rows, "h string, ts timestamp"), "ts", 30, "t4g", batches=5)
    out, held = run(spark, stateful.once_within(stream, "h", "ts", 30, "30 minutes"), "t4g")
    assert sorted((str(r.h), r.ts) for r in out) == sorted([(str(h), t) for h, t in rows if (h, t) not in {("h0", day(29)), (None, day(4))}])
    assert max(held) <= stateful.GROUPS


def test_matched_orders_come_in_blocks(spark, monkeypatch):
    """What a stream keeps and writes of matched orders grows with the rows, not with the matches;
    rows made of blocks are those of the join, with ids and symbols that are null or come twice."""
    big = 1 << 60  # beyond what a double holds
    o = [(big + k, "S", "paper", at(k), "placed") for k in range(600)] + [(big, "S", "paper", at(0), "placed"), (None, "S", "live", at(0), "placed"), (7, None, "paper", at(3), "placed"), (8, "S", "paper", None, "placed")]
    f = [(k, "S", "paper", at(k), "filled") for k in range(600)] + [(None, "S", "paper", at(10), "filled"), (1, None, "paper", at(4), "filled"), (2, "S", "paper", None, "filled")]
    schema = "id long, symbol string, mode string, ts timestamp, status string"
    sides = [spark.createDataFrame(x, schema) for x in (o, f)]
    blocks = streams.append_available(stateful.matched_blocks(*(stateful.arriving(x, "ts", 30, "t8b", batches=3, files=1) for x in sides), hours=2), "t8b")
    written = blocks.agg(F.sum(F.size("orders") + F.size("fills"))).first()[0]
    rows = lambda df: sorted(map(str, (r[:] for r in df.collect())))
    plain = streams.matched_orders(*sides, hours=2)
    passed = (F.col("fill_id").isNotNull() | F.col("filled_at").isNotNull()) | (F.col("ts") < F.lit(at(599 - 180)))
    want = rows(plain.where(passed))
    assert rows(streams.pairs(blocks, hours=2)) == want and len(want) > 60_000
    assert blocks.agg(F.sum("pairs")).first()[0] == len(want)
    assert written < 10 * (len(o) + len(f))
    monkeypatch.setattr(streams, "TASK_PAIRS", 5_000)
    dealt = streams.pairs(blocks, hours=2)
    assert rows(dealt) == want and dealt.rdd.getNumPartitions() == len(want) // 5_000 + 1
