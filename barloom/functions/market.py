"""Price, limit and unit rules of a daily bar."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from barloom import rules


def by_board(table: dict, board: Column) -> Column:
    """Rule value for a board, as a CASE over the fixed table."""
    chain = None
    for name, value in table.items():
        chain = F.when(board == name, F.lit(value)) if chain is None else chain.when(board == name, F.lit(value))
    return chain


def limit_pct(board: Column, is_st: Column) -> Column:
    return F.when(is_st == 1, by_board(rules.ST_PRICE_LIMIT, board)).otherwise(
        by_board(rules.PRICE_LIMIT, board)
    )


def up_limit(pre_close: Column, board: Column, is_st: Column) -> Column:
    return F.round(pre_close * (1 + limit_pct(board, is_st)) + F.lit(1e-9), 2)


def down_limit(pre_close: Column, board: Column, is_st: Column) -> Column:
    return F.round(pre_close * (1 - limit_pct(board, is_st)) + F.lit(1e-9), 2)


def board_lot(shares: Column, board: Column) -> Column:
    """Largest tradable quantity not above `shares` under the board's lot rule."""
    smallest = by_board({b: r[0] for b, r in rules.LOT_RULE.items()}, board)
    step = by_board({b: r[1] for b, r in rules.LOT_RULE.items()}, board)
    lot = smallest + F.floor((shares - smallest) / step) * step
    return F.when(shares < smallest, 0).otherwise(lot).cast("bigint")


def in_no_limit_window(trade_date: Column, list_date: Column, board: Column) -> Column:
    """First N calendar days after listing (N by board); unknown listing date -> False."""
    days = F.coalesce(by_board(rules.NO_LIMIT_DAYS, board), F.lit(1))
    inside = (trade_date >= list_date) & (F.date_diff(trade_date, list_date) < days)
    return F.coalesce(inside, F.lit(False))


def flag(value: Column) -> Column:
    """0/1 flag with null as 0."""
    return F.coalesce(value.cast("int"), F.lit(0))


def adj_ratio(adjusted_close: Column, raw_close: Column) -> Column:
    """Adjustment factor from two landed closes; 1.0 when either one is zero."""
    return F.when(
        (adjusted_close == 0) | (raw_close == 0), F.lit(1.0)
    ).otherwise(F.try_divide(adjusted_close, raw_close))


def derived_pre_close(close: Column, change: Column, pct_change: Column) -> Column:
    """close - change, else close / (1 + pct/100), else close."""
    return F.coalesce(close - change, F.try_divide(close, 1 + pct_change / 100.0), close)


def scaled(value: Column, source: Column, factors: dict[str, float], default: float = 1.0) -> Column:
    """Bring a landed quantity to the common unit: multiplier by source."""
    chain = None
    for name, k in factors.items():
        chain = F.when(source == name, F.lit(k)) if chain is None else chain.when(source == name, F.lit(k))
    return value * (F.lit(default) if chain is None else chain.otherwise(F.lit(default)))


def lots_or_shares(volume: Column, threshold: float = 1e7) -> Column:
    """Sources that do not say whether they report lots: small numbers are lots of 100."""
    return F.when(volume < threshold, volume * 100).otherwise(volume)


def touches(close: Column, limit: Column, tol: float = 1e-6) -> Column:
    """Close sits on the limit price; missing values -> False."""
    return F.coalesce((close > 0) & (F.abs(close - limit) < tol), F.lit(False))
