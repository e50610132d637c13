"""As-of joins in two levels against plain search: hot keys, empty buckets, nulls, equal times."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from marketloom.operators.joins import latest_at, next_after


@pytest.mark.parametrize("days", [1, 30, 10_000])
def test_equals_plain_search(spark, days):
    r = random.Random(5)
    t0 = dt.datetime(2019, 12, 20)
    when = lambda: t0 + dt.timedelta(hours=r.randrange(24 * 200))
    key = lambda: "hot" if r.random() < 0.9 else r.choice(["a", None])
    times = {k: sorted({when() for _ in range(n)}) for k, n in (("hot", 300), ("a", 4), (None, 3), ("only", 2))}
    history = [(k, t, float(i)) for k, ts in times.items() for i, t in enumerate(ts)]
    events = [(i, key(), when() if i % 20 else None) for i in range(400)] + [(1000 + i, k, t) for i, (k, t, _) in enumerate(history[::7])]
    e = spark.createDataFrame(events, "id long, k string, t timestamp").repartition(3)
    h = spark.createDataFrame(history, "k string, t timestamp, v double").repartition(3)
    back = {x.id: x.v for x in latest_at(e, h, ["v"], ["k"], "t", days).collect()}
    ahead = {x.id: x.v for x in next_after(e, h, ["v"], ["k"], "t", days).collect()}
    assert len(back) == len(ahead) == len(events)
    for i, k, t in events:
        past = [v for kk, tt, v in history if kk == k and t is not None and tt <= t]
        later = [v for kk, tt, v in history if kk == k and t is not None and tt > t]
        assert back[i] == (past[-1] if past else None) and ahead[i] == (later[0] if later else None)


def test_a_hot_key_is_spread(spark):
    """The window's keys: no bucket holds more than a small part of the hot key's rows."""
    rows = spark.range(50_000).select(F.lit("hot").alias("k"), (F.lit("2000-01-01").cast("timestamp") + F.make_dt_interval(hours=F.col("id"))).alias("t"), F.col("id").alias("v"))
    plan = latest_at(rows.select("k", "t"), rows, ["v"], ["k"], "t")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" in plan and "__b" in plan
    per = rows.groupBy(F.floor(F.unix_seconds("t") / (90 * 86_400))).count().agg(F.max("count")).first()[0]
    assert per <= 50_000 / 20
    assert latest_at(rows.select("k", "t"), rows, ["v"], ["k"], "t").where("v is null").count() == 0
