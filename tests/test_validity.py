"""Master history, calendar seams, fingerprints, whole-day limit checks."""

import datetime as dt

import pytest

from barloom.functions import values as v
from barloom.operators import calendar as cal, factors, quality as q
from barloom.operators.scd2 import current_listing
from barloom.session import work_dir
from barloom.sources import lake

D = dt.date(2024, 1, 1)


def day(i):
    return D + dt.timedelta(days=i)


@pytest.fixture(scope="module")
def master(spark):
    rows = [(1, "600001.SH", "main", D, D), (1, "600009.SH", "main", D, day(5)), (2, "300002.SZ", "gem", D, D)]
    return spark.createDataFrame(rows, "security_id int, exchange_code string, board string, list_date date, valid_from date")


def test_a_renamed_security_is_one_row(spark, master):
    assert {(r[0], r[1]) for r in current_listing(master, "exchange_code").collect()} == {(1, "600009.SH"), (2, "300002.SZ")}
    bars = spark.createDataFrame([(1, day(7), 10.0, 1.0), (2, day(7), 10.0, 1.0)], "security_id int, trade_date date, close double, adj_factor double")
    facts = bars.selectExpr("trade_date", "security_id", "'f' as factor_name", "'1' as version", "close as value")
    assert factors.with_codes(facts, master).count() == 2


def test_links_cross_the_seams_of_a_replaced_range(spark):
    old = cal.build(spark.createDataFrame([(day(i), 1) for i in range(9)], "cal_date date, is_open int"))
    new = spark.createDataFrame([(day(i), int(i != 4)) for i in (3, 4, 5)], "cal_date date, is_open int")
    rows = {r.cal_date: r for r in cal.upsert(old, new).collect()}
    assert len(rows) == 9 and rows[day(5)].next_open == day(6) and rows[day(3)].prev_open == day(2) and rows[day(3)].next_open == day(5) and rows[day(6)].prev_open == day(5)


def test_equal_rows_do_not_cancel(spark):
    prints = [spark.createDataFrame([(1, "a")] * n, "x int, y string").agg(v.content_print(spark.createDataFrame([], "x int, y string")).alias("p")).first().p for n in (0, 1, 2, 4)]
    assert len(set(prints)) == 4


def test_manifest_is_about_what_was_written(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.createDataFrame([("s", "2024-01-02", 1), ("s", "2024-01-02", 1), ("s", "2024-01-03", 2)], "source string, dt string, x int")
    lake.write_raw(rows, root, "own")
    lake.write_raw(rows.limit(0), root, "own", source="s", day="2024-01-04")
    lake.write_raw(rows.where("x = 1"), root, "own", source="s", day="2024-01-05")
    found = {r.dt: (r.rows, r.fingerprint) for r in lake.read_manifest(spark, root).collect()}
    assert {k: n for k, (n, _) in found.items()} == {"2024-01-02": 2, "2024-01-03": 1, "2024-01-04": 0, "2024-01-05": 2}
    assert found["2024-01-02"] == found["2024-01-05"] and found["2024-01-04"][1] != found["2024-01-02"][1]
    grid = spark.createDataFrame([("s", day(i)) for i in range(1, 6)], "source string, dt date")
    assert [r.n for r in lake.row_counts(spark, root, "own", grid).orderBy("dt").collect()] == [2, 1, 0, 2, None]


def test_every_bar_counts_in_the_limit_rule(spark):
    """One bad limit among 400 bars of a day fails the day, wherever a sample would have looked."""
    master = spark.createDataFrame([(i, f"600{i:03d}.SH", "main", dt.date(2000, 1, 1)) for i in range(400)], "security_id int, exchange_code string, board string, list_date date")
    for wrong in (0, 123, 399):
        bars = spark.createDataFrame([(i, D, 10.0, 12.0 if i == wrong else 11.0, 9.0, 0, 10.0) for i in range(400)],
                                     "security_id int, trade_date date, pre_close double, up_limit double, down_limit double, is_st int, close double")
        assert [r.passed for r in q.limit_prices(q.Tables(bars, master, None, None, None)).collect()] == [False]


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:1"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="checkpoint"):
        work_dir(Session())
