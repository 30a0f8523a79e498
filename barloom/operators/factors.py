"""Seed factors for every security and day of a range in one pass.

The three price factors and their look-back test share one window
specification, hence one shuffle and one sort of the bars.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom import rules
from barloom.functions import values as v
from barloom.operators import asof
from barloom.operators.prices import by_security, post_close
from barloom.operators.scd2 import current_listing


def lookback_days(n: int) -> int:
    """Calendar days within which the n+1 rows of a look-back must lie."""
    return 3 * n + 10


def _rows(n: int) -> Window:
    return by_security().rowsBetween(-(n - 1), 0)


def _recent_enough(n: int, bound: int) -> Column:
    return F.lag("trade_date", n).over(by_security()) >= F.date_sub("trade_date", bound)


def momentum(n: int, bound: int | None = None) -> Column:
    """px[t] / px[t-n] - 1 over the security's own rows."""
    base = F.lag("px", n).over(by_security())
    ratio = F.try_divide(F.col("px"), F.nullif(base, F.lit(0.0))) - 1
    return F.when(_recent_enough(n, bound or lookback_days(n)), v.finite_or_null(ratio))


def volatility(n: int, bound: int | None = None) -> Column:
    """Sample deviation of the last n returns, all of which must exist."""
    full = F.count("ret").over(_rows(n)) == n
    return F.when(full & _recent_enough(n, bound or lookback_days(n)), F.stddev_samp("ret").over(_rows(n)))


def mean_turnover(n: int, bound: int | None = None) -> Column:
    """Mean of the non-null rates in the last n rows; today's must exist, and 3/4 of n overall."""
    need = max(1, n * 3 // 4)
    limit = bound or lookback_days(n)
    # Where the n-th last row is too old, fewer than n rows lie in the date range,
    # so the date frame alone is the window; otherwise the row frame is.
    full = F.coalesce(F.lag("trade_date", n - 1).over(by_security()) >= F.date_sub("trade_date", limit), F.lit(False))
    rate = F.col("turnover_rate")

    def by_date(aggregate: str) -> Column:
        return F.expr(f"{aggregate}(turnover_rate) over (partition by security_id order by trade_date"
                      f" range between interval {limit} days preceding and current row)")

    present = F.when(full, F.count(rate).over(_rows(n))).otherwise(by_date("count"))
    mean = F.when(full, F.avg(rate).over(_rows(n))).otherwise(by_date("avg"))
    return F.when(rate.isNotNull() & (present >= need), mean)


_PRICE_BUILDERS: dict[str, Callable[[int, int | None], Column]] = {
    "momentum": momentum, "volatility": volatility,
}


def register(name: str, lookback: int, kind: str, builder: Callable[[int, int | None], Column] | None = None) -> None:
    """Add a factor; a new kind brings its column builder over (px, ret)."""
    rules.SEED_FACTORS[name] = (lookback, kind)
    if builder is not None:
        _PRICE_BUILDERS[kind] = builder


def _check(names: list[str]) -> None:
    unknown = [n for n in names if n not in rules.SEED_FACTORS]
    if unknown:
        raise ValueError(f"unknown factors {unknown}; known: {sorted(rules.SEED_FACTORS)}")


def price_factors(bars: DataFrame, names: list[str], *, bound: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Wide (security_id, trade_date, <factor>...) of the price-based factors; columns to `keep` ride along."""
    px = bars.select("security_id", "trade_date", *keep, post_close().alias("px"))
    rets = px.withColumn("ret", v.finite_or_null(F.try_divide(F.col("px"), F.lag("px").over(by_security())) - 1))
    return rets.select("security_id", "trade_date", *keep, *[
        _PRICE_BUILDERS[rules.SEED_FACTORS[n][1]](rules.SEED_FACTORS[n][0], bound).alias(n) for n in names
    ])


def turnover_factors(basic: DataFrame, names: list[str], *, bound: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    return basic.select("security_id", "trade_date", *keep, *[
        mean_turnover(rules.SEED_FACTORS[n][0], bound).alias(n) for n in names
    ])


def valid_market_value(basic: DataFrame) -> DataFrame:
    return basic.where(v.is_finite(F.col("total_mv")) & (F.col("total_mv") > 0))


def value_factors(basic: DataFrame, statements: DataFrame, names: list[str]) -> DataFrame:
    """Visible statement item over market value (converted to yuan)."""
    caps = valid_market_value(basic).select("security_id", "trade_date", "total_mv")
    items = [rules.VALUE_ITEMS[n] for n in names]
    seen = asof.attach_visible(caps, statements, items)
    cap = F.col("total_mv") * rules.MV_UNIT
    return seen.select("security_id", "trade_date", *[
        v.finite_or_null(F.try_divide(F.col(rules.VALUE_ITEMS[n]), cap)).alias(n) for n in names
    ])


def compute(bars: DataFrame, basic: DataFrame, statements: DataFrame, *, names: list[str] | None = None,
            version: str = rules.FACTOR_VERSION, start: dt.date | None = None, end: dt.date | None = None,
            parity_bound: bool = False, bound: int | None = None) -> DataFrame:
    """Long factor table (trade_date, security_id, factor_name, version, value).

    `parity_bound` applies the look-back bound of the longest requested price
    factor to all of them, as a per-day computation of that selection does;
    `bound` sets the calendar days outright. By default each factor has its own.
    """
    names = names or list(rules.SEED_FACTORS)
    _check(names)
    kinds = {n: rules.SEED_FACTORS[n][1] for n in names}
    priced = [n for n in names if kinds[n] in _PRICE_BUILDERS]
    turned = [n for n in names if kinds[n] == "turnover"]
    valued = [n for n in names if kinds[n] == "value"]
    longest = max((rules.SEED_FACTORS[n][0] for n in priced + turned), default=0)
    if parity_bound:
        bound = lookback_days(longest)
    reach = bound or lookback_days(longest)
    parts = []
    if priced:
        parts.append((price_factors(_history(bars, start, reach), priced, bound=bound), priced))
    if turned:
        parts.append((turnover_factors(_history(basic, start, reach), turned, bound=bound), turned))
    if valued:
        parts.append((value_factors(_range(basic, start, end), statements, valued), valued))
    out = None
    for wide, cols in parts:
        long = wide.unpivot(["trade_date", "security_id"], cols, "factor_name", "value").where("value is not null")
        long = _range(long, start, end)
        out = long if out is None else out.unionByName(long)
    return out.select("trade_date", "security_id", "factor_name", F.lit(version).alias("version"), "value")


def _range(df: DataFrame, start: dt.date | None, end: dt.date | None) -> DataFrame:
    if start is not None:
        df = df.where(F.col("trade_date") >= F.lit(start))
    if end is not None:
        df = df.where(F.col("trade_date") <= F.lit(end))
    return df


def _history(df: DataFrame, start: dt.date | None, days: int) -> DataFrame:
    """Input needed for a range: its look-back and nothing earlier."""
    return df if start is None else _range(df, start - dt.timedelta(days=days), None)


def with_codes(factors: DataFrame, master: DataFrame) -> DataFrame:
    """Attach exchange codes; ids without a master row stay, with a null code."""
    return factors.join(current_listing(master, "exchange_code"), "security_id", "left")
