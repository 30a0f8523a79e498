import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from barloom import rules
from barloom.functions import market as mk, scoring as sc, symbols as sy, trading as tr, values as v


def col_values(spark, data, expr, schema="x string"):
    df = spark.createDataFrame([(x,) if not isinstance(x, tuple) else x for x in data], schema)
    return [r[0] for r in df.select(expr).collect()]


def test_codes_round_trip(spark):
    codes = ["600000", "000001", "300750", "688981", "830799", "1"]
    want = ["600000.SH", "000001.SZ", "300750.SZ", "688981.SH", "830799.BJ", "000001.SZ"]
    assert col_values(spark, codes, sy.to_exchange_code(F.col("x"))) == want
    back = sy.from_long_suffix(sy.to_long_suffix(F.col("x")))
    assert col_values(spark, want, back) == want
    assert col_values(spark, want, sy.from_market_first(sy.to_market_first(F.col("x"), "."))) == want
    assert col_values(spark, ["600000.SH"], sy.to_market_first(F.col("x"))) == ["sh600000"]


def test_long_codes_are_not_cut(spark):
    assert col_values(spark, ["1234567"], sy.zero_fill(F.col("x"))) == ["1234567"]


def test_unknown_market_is_an_error(spark):
    with pytest.raises(PySparkException):
        col_values(spark, ["600000.HK"], sy.to_long_suffix(F.col("x")))
    with pytest.raises(PySparkException):
        col_values(spark, ["600000.HK"], sy.board_of(F.col("x")))


def test_boards(spark):
    codes = ["600000.SH", "000001.SZ", "002415.SZ", "300750.SZ", "688111.SH", "830799.BJ"]
    assert col_values(spark, codes, sy.board_of(F.col("x"))) == ["main", "main", "main", "gem", "star", "bse"]


def test_share_predicates(spark):
    codes = ["600000.XSHG", "000300.XSHG", "000001.XSHE", "399001.XSHE", "830799.XBSE", "junk", "600000.NYSE"]
    assert col_values(spark, codes, sy.is_share_long_suffix(F.col("x"))) == [True, False, True, False, True, False, False]
    assert col_values(spark, ["sh.600000", "sh.000300", "junk"], sy.is_share_market_first(F.col("x"))) == [True, False, False]


def test_limit_prices(spark):
    cases = [(10.00, "main", 0), (10.03, "main", 0), (10.00, "main", 1), (10.00, "gem", 1), (50.00, "star", 0), (10.00, "bse", 0)]
    df = spark.createDataFrame(cases, "pre double, board string, st int")
    got = df.select(mk.up_limit(F.col("pre"), F.col("board"), F.col("st")), mk.down_limit(F.col("pre"), F.col("board"), F.col("st"))).collect()
    up, down = [r[0] for r in got], [r[1] for r in got]
    assert up == [11.00, 11.03, 10.50, 12.00, 60.00, 13.00]
    assert (down[0], down[2], down[4]) == (9.00, 9.50, 40.00)


@pytest.mark.parametrize("board,st", [(b, s) for b in rules.BOARDS for s in (0, 1)])
def test_limit_prices_over_all_cents(spark, board, st):
    """Every price from 0.01 to 1000.00 against round-half-up in integer arithmetic."""
    pct = (rules.ST_PRICE_LIMIT if st else rules.PRICE_LIMIT)[board]
    per = round(pct * 100)
    df = spark.range(1, 100_001).select("id", (F.col("id") / 100.0).alias("pre"))
    got = df.select(
        "id", F.round(mk.up_limit(F.col("pre"), F.lit(board), F.lit(st)) * 100).cast("bigint").alias("up"),
        F.round(mk.down_limit(F.col("pre"), F.lit(board), F.lit(st)) * 100).cast("bigint").alias("down"),
    )
    wrong = got.where(
        (F.col("up") != F.floor((F.col("id") * (100 + per) + 50) / 100)) | (F.col("down") != F.floor((F.col("id") * (100 - per) + 50) / 100))
    )
    assert wrong.count() == 0


def test_board_lots(spark):
    cases = [(250, "main"), (99, "main"), (199, "star"), (357, "star"), (357, "bse")]
    got = col_values(spark, cases, mk.board_lot(F.col("q"), F.col("b")), "q int, b string")
    assert got == [200, 0, 0, 357, 357]


def test_no_limit_window(spark):
    listed = dt.date(2026, 7, 1)
    days = [dt.date(2026, 6, 30), listed, dt.date(2026, 7, 5), dt.date(2026, 7, 6)]
    expr = mk.in_no_limit_window(F.col("d"), F.lit(listed), F.lit("gem"))
    assert col_values(spark, days, expr, "d date") == [False, True, True, False]
    assert col_values(spark, days[:1], mk.in_no_limit_window(F.col("d"), F.lit(None).cast("date"), F.lit("gem")), "d date") == [False]


def test_costs(spark):
    ten = tr.Costs(slippage_bps=10.0)
    one = spark.range(1)
    buy, sell = one.select(tr.slipped(F.lit(10.0), F.lit("buy"), ten), tr.slipped(F.lit(10.0), F.lit("sell"), ten)).first()
    assert (buy, sell) == pytest.approx((10.01, 9.99))
    small, big, none = one.select(tr.fee(F.lit(1000.0), F.lit("buy")), tr.fee(F.lit(100_000.0), F.lit("sell")), tr.fee(F.lit(-5.0), F.lit("buy"))).first()
    assert (small, big, none) == pytest.approx((5.0, 100_000 * (rules.COMMISSION_RATE + rules.STAMP_TAX), 0.0))
    with pytest.raises(ValueError):
        tr.Costs(stamp_tax=-1.0)


def test_executability(spark):
    df = spark.createDataFrame([(10.0, 11.0, 11.0, 9.0, False), (10.0, 10.0, 11.0, 9.0, True), (10.0, 9.0, 11.0, 9.0, False), (0.0, 10.0, 11.0, 9.0, False)],
                               "open double, close double, up double, down double, sus boolean")
    got = df.select(tr.buy_block(F.col("open"), F.col("close"), F.col("up"), F.col("sus")),
                    tr.sell_block(F.col("open"), F.col("close"), F.col("down"), F.col("sus"))).collect()
    assert [tuple(r) for r in got] == [("limit_up", None), ("suspended", "suspended"), (None, "limit_down"), ("no_price", "no_price")]


def test_lot_floor(spark):
    assert col_values(spark, [250.0, 99.0, 100.9, -3.0, float("nan")], tr.lot_floor(F.col("x")), "x double") == [200, 0, 100, 0, 0]
    assert col_values(spark, [250.7], tr.lot_floor(F.col("x"), partial=True), "x double") == [250]


def test_target_shares(spark):
    got = col_values(spark, [(0.6, 10.0), (0.4, 20.0), (0.4, 0.0), (None, 5.0)], tr.target_shares(F.col("w"), F.col("p"), 100_000.0), "w double, p double")
    assert got == [6000, 2000, 0, 0]


def test_parsing(spark):
    assert col_values(spark, ["20240131", "2024-01-31", "20241331", "x", None], v.parse_ymd(F.col("x"))) == [dt.date(2024, 1, 31)] * 2 + [None] * 3
    assert col_values(spark, ["22000101"], v.parse_end_date(F.col("x"))) == [None]
    assert col_values(spark, ["2026-07-15", "unpublished"], v.version_date(F.col("x"))) == [dt.date(2026, 7, 15), None]
    assert col_values(spark, ["1.5", "nan", "x", ""], v.to_number(F.col("x"))) == [1.5, None, None, None]


def test_quarter_ends(spark):
    got = col_values(spark, [dt.date(2026, 7, 15), dt.date(2026, 6, 30)], v.recent_quarter_ends(F.col("d"), 4), "d date")
    assert got[0] == [dt.date(2026, 6, 30), dt.date(2026, 3, 31), dt.date(2025, 12, 31), dt.date(2025, 9, 30)]
    assert got[1][0] == dt.date(2026, 6, 30)


def test_item_map_leaves_nulls_out(spark):
    df = spark.createDataFrame([(1.0, None)], "a double, b double")
    assert df.select(v.item_map({"a": F.col("a"), "b": F.col("b")})).first()[0] == {"a": 1.0}


def test_no_nan_survives(spark):
    df = spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "x double, k int")
    assert sorted(r[0] is None for r in v.null_nan(df).select("x").collect()) == [False, True]


def test_industry_labels(spark):
    df = spark.createDataFrame([("801010", "农林牧渔"), ("801010.SI", ""), ("801010.SI", "a|b")], "c string, n string")
    labels = df.select(sy.industry_label(F.col("c"), F.col("n")).alias("l"))
    got = labels.select("l", sy.industry_code(F.col("l")), sy.industry_name(F.col("l")), sy.industry_display(F.col("l"))).collect()
    assert [tuple(r) for r in got] == [("801010.SI|农林牧渔", "801010.SI", "农林牧渔", "农林牧渔"), ("801010.SI", "801010.SI", "", "801010.SI"),
                                       ("801010.SI|a|b", "801010.SI", "a|b", "a|b")]


def test_stance(spark):
    cases = [(60.0, None, "ok"), (50.0, 0.2, "ok"), (50.0, -0.2, "ok"), (50.0, 0.01, "ok"), (90.0, 0.5, "blocked"), (None, None, "ok"), (None, 0.2, "ok")]
    got = col_values(spark, cases, sc.stance(F.col("c"), F.col("r"), F.col("s")), "c double, r double, s string")
    s = rules.STANCE
    assert got == [s["strong"], s["strong"], s["weak"], s["neutral"], s["weak"], s["unknown"], s["strong"]]


def test_short_ids_do_not_depend_on_argument_order(spark):
    one = spark.range(1)
    a = one.select(v.short_id("s", {"b": F.lit(1), "a": F.lit("x")})).first()[0]
    b = one.select(v.short_id("s", {"a": F.lit("x"), "b": F.lit(1)})).first()[0]
    assert a == b and len(a) == len("s_") + 8
