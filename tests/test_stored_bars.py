"""Market views over bars written once: the same rows, and jobs that do not add up the trades again."""

import datetime as dt

import pytest

from barloom.sources import tables as tb
from barloom.sources.market import Market
from suite import QUERIES

NAMES = [
    "C41_research_acceptance", "C19_experiment_matrix", "C01_bars_with_past_names", "C12_target_weights",
    "C10_refreshed_factors", "L10_cards_of_signal", "W10_indicator_table", "C21_security_cards",
    "C17_portfolio_series",
]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """Three suppliers with a trade on most of 60 days, two on some; one trade without a supplier, one without a day."""
    root, first = str(tmp_path_factory.mktemp("market")), dt.date(1999, 5, 10)
    trades = [
        (s * 1000 + d, s, s, 1 + n, 5.0 + (s + d) % 7, 100.0 + 3 * s + d % 11 + n, 0.05, first + dt.timedelta(days=d))
        for s in (1, 2, 3) for d in range(60) if (s + d) % 5 for n in range(1 + (d % 4 == 0))
    ] + [(9001, 1, None, 1, 2.0, 50.0, 0.0, first), (9002, 1, 2, 1, 2.0, 50.0, 0.0, None)]
    for name, rows, cols in (
        ("lineitem", trades, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_shipdate date"),
        ("supplier", [(s, f"Supplier {s}", s, 10.0) for s in (1, 2, 3)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
        ("part", [(1, "A"), (2, "B"), (3, "A")], "p_partkey long, p_brand string"),
    ):
        spark.createDataFrame(rows, cols).write.parquet(f"{root}/{name}.parquet")
    return root


def _adds_up_trades(df) -> bool:
    """Whether the plan still makes bars of trades: only there the line numbers are read."""
    return "l_linenumber" in df._jdf.queryExecution().optimizedPlan().toString()


def test_stored_views_are_the_same(spark, sf, rows):
    plain, stored = Market(spark, sf), Market(spark, sf).stored("statement_rows", "industries", "calendar")
    for view in ("raw_bars", "bars", "limited_bars", "master", "calendar", "members", "statement_rows", "industries", "execution"):
        assert getattr(stored, view).columns == getattr(plain, view).columns
        assert rows(getattr(stored, view)) == rows(getattr(plain, view)), view


@pytest.mark.parametrize("name", NAMES)
def test_trades_are_added_up_once(spark, sf, name):
    df = QUERIES[name].run(spark, sf)
    assert not _adds_up_trades(df)
    df.collect()


def test_factor_slices_come_from_stored_bars(spark, sf, monkeypatch):
    kept, write = [], tb.write_partitioned
    monkeypatch.setattr(tb, "write_partitioned", lambda df, *a: (kept.append(df), write(df, *a)))
    QUERIES["S13_replace_factor_slice"].run(spark, sf)
    assert kept and not any(map(_adds_up_trades, kept))
