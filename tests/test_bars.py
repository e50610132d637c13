"""Bars derived from trades."""

from __future__ import annotations

import datetime as dt

import duckdb
import pytest

from marketloom.functions.columns import rounded
from marketloom.sources import fixtures as fx

LINES = "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp"


@pytest.mark.parametrize("turned", [False, True])
def test_first_trades_of_one_number_open_at_the_lowest_price(spark, tmp_path, turned):
    day = dt.datetime(2024, 1, 1)
    rows = [(k, 1, 1, 1.0, float(p), day + dt.timedelta(days=k)) for k in range(20) for p in ((40, 10, 25) if k % 2 else (10, 40, 25))]
    rows += [(k + 1, 1, 1, 1.0, 1.0, day + dt.timedelta(days=k)) for k in range(20)]
    spark.createDataFrame(rows[::-1] if turned else rows, LINES).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "PROMO")], "p_partkey long, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    out = rounded(fx.bars(spark, str(tmp_path)), "open", "low").select("symbol", "d", "open", "low")
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    sql = con.sql(fx.settled(f"WITH {fx.bars_sql()} SELECT symbol, d, round(open, 6), round(low, 6) FROM bars")).fetchall()
    got = sorted(map(tuple, out.collect()))
    assert len(got) == 40 and {r[2] for r in got} == {23.978953} and {r[3] for r in got} == {6.931472}
    assert got == sorted(sql)


def test_trades_of_large_tables_are_dealt_into_bounded_tasks(spark, data, monkeypatch):
    """A task of the join sorts a bounded number of rows, however large the table is."""
    whole = sorted(map(str, fx.trades(spark, data).collect()))
    monkeypatch.setattr(fx, "ROWS_A_TASK", 40)
    n = -(-fx.table(spark, data, "lineitem").count() // 40)
    small = fx.trades(spark, data)
    plan = small._jdf.queryExecution().optimizedPlan().toString()
    assert n > fx.FEW_TASKS and all(f"RepartitionByExpression [{k}" in plan for k in ("l_orderkey", "o_orderkey", "l_partkey", "p_partkey"))
    assert sorted(map(str, small.collect())) == whole and len(whole) > 5000
