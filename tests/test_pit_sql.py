"""SQL table functions for point-in-time reads."""

import datetime as dt

import pytest

from barloom.sources import pit_sql

D, FAR = dt.date(2024, 3, 1), dt.date(2099, 12, 31)


def day(i):
    return D + dt.timedelta(days=i)


@pytest.fixture(scope="module")
def sql(spark):
    pit_sql.register(
        spark,
        bars=spark.createDataFrame([(1, day(0), 10.0, 2.0, 0, 0), (1, day(3), 12.0, 2.0, 0, 0), (2, day(0), 5.0, 1.0, 1, 0), (3, day(0), 7.0, 1.0, 0, 1), (4, day(0), 8.0, 1.0, None, None)],
                                   "security_id int, trade_date date, close double, adj_factor double, is_suspended int, is_st int"),
        master=spark.createDataFrame([(i, day(-400 if i < 4 else -10)) for i in range(1, 5)], "security_id int, list_date date"),
        members=spark.createDataFrame([("I", i, f"c{i}", day(-5), day(5) if i == 1 else FAR) for i in range(1, 5)], "index_code string, security_id int, exchange_code string, in_date date, out_date date"),
        industries=spark.createDataFrame([(1, "l1", "A", day(-9), day(2)), (1, "l1", "B", day(2), FAR)], "security_id int, level string, industry string, in_date date, out_date date"),
        statements=spark.createDataFrame([(1, day(-50), day(-20), 0, {"x": 1.0}), (1, day(-50), day(1), 1, {"x": 2.0}), (1, day(-10), day(4), 0, {"y": 3.0})],
                                         "security_id int, report_date date, ann_date date, update_flag int, fields map<string,double>"),
    )
    return lambda text: sorted(tuple(r) for r in spark.sql(text).collect())


def test_reads_as_of_a_day(sql):
    on = lambda i: f"DATE '{day(i)}'"
    assert [r[0] for r in sql(f"SELECT * FROM members_on('I', {on(4)})")] == [1, 2, 3, 4]
    assert [r[0] for r in sql(f"SELECT * FROM members_on('I', {on(5)})")] == [2, 3, 4]
    assert sql(f"SELECT * FROM members_on('J', {on(0)})") == []
    assert [sql(f"SELECT industry FROM industry_on('l1', {on(i)})") for i in (-10, 1, 2)] == [[], [("A",)], [("B",)]]
    assert [sql(f"SELECT value FROM visible_item('x', {on(i)})") for i in (-21, -20, 1, 9)] == [[], [(1.0,)], [(2.0,)], [(2.0,)]]
    assert sql(f"SELECT security_id, close FROM last_price_by({on(2)}) WHERE security_id = 1") == [(1, 10.0)]
    assert sql(f"SELECT security_id, post_close, tradable FROM price_on({on(0)})") == [(1, 20.0, True), (2, 5.0, False), (3, 7.0, True), (4, 8.0, True)]
    assert sql(f"SELECT exchange_code FROM universe_on('I', {on(0)}, 120)") == [("c1",)]
    assert sql(f"SELECT exchange_code FROM universe_on('I', {on(0)}, 5)") == [("c1",), ("c4",)]


def test_filters_reach_the_table_and_no_python_runs(spark, sql):
    plan = spark.sql(f"SELECT * FROM universe_on('I', DATE '{D}', 120)")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
