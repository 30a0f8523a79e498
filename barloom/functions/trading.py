"""Costs, executability and order arithmetic per row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from barloom import rules
from barloom.functions.values import is_finite


@dataclass(frozen=True)
class Costs:
    commission_rate: float = rules.COMMISSION_RATE
    commission_min: float = rules.COMMISSION_MIN
    stamp_tax: float = rules.STAMP_TAX
    slippage_bps: float = rules.SLIPPAGE_BPS

    def __post_init__(self) -> None:
        if min(self.commission_rate, self.commission_min, self.stamp_tax, self.slippage_bps) < 0:
            raise ValueError("cost parameters must not be negative")


NO_COSTS = Costs(0.0, 0.0, 0.0, 0.0)


def slipped(price: Column, side: Column, costs: Costs = Costs()) -> Column:
    """Buys pay up, sells receive less."""
    sign = F.when(side == "buy", 1.0).when(side == "sell", -1.0)
    return price * (1.0 + F.lit(costs.slippage_bps / 10_000.0) * sign)


def fee(notional: Column, side: Column, costs: Costs = Costs()) -> Column:
    """Commission with a floor, plus stamp tax on sells; nothing on a non-positive notional."""
    commission = F.greatest(notional * costs.commission_rate, F.lit(costs.commission_min))
    stamp = F.when(side == "sell", notional * costs.stamp_tax).otherwise(0.0)
    return F.when(is_finite(notional) & (notional > 0), commission + stamp).otherwise(0.0)


def fill(price: Column, quantity: Column, side: Column, costs: Costs = Costs()) -> Column:
    """struct(price, notional, fee, cash): cash needed by a buy or received by a sell."""
    px = slipped(price, side, costs)
    notional = px * quantity
    charge = fee(notional, side, costs)
    cash = F.when(side == "buy", notional + charge).otherwise(notional - charge)
    return F.struct(px.alias("price"), notional.alias("notional"), charge.alias("fee"), cash.alias("cash"))


def lot_floor(shares: Column, lot: int = rules.LOT_SIZE, *, partial: bool = False) -> Column:
    unit = 1 if partial else lot
    whole = F.floor(shares / unit) * unit
    return F.when(is_finite(shares) & (shares > 0), whole).otherwise(0).cast("bigint")


def _no_price(open_: Column) -> Column:
    return ~F.coalesce(is_finite(open_) & (open_ > 0), F.lit(False))


def _live(limit: Column) -> Column:
    return F.coalesce(is_finite(limit) & (limit > 0), F.lit(False))


def buy_block(open_: Column, close: Column, limit: Column, suspended: Column, eps: float = rules.LIMIT_EPS) -> Column:
    """Reason a buy cannot execute, null when it can."""
    return (
        F.when(suspended, "suspended")
        .when(_no_price(open_), "no_price")
        .when(_live(limit) & (close >= limit * (1.0 - eps)), "limit_up")
    )


def sell_block(open_: Column, close: Column, limit: Column, suspended: Column, eps: float = rules.LIMIT_EPS) -> Column:
    return (
        F.when(suspended, "suspended")
        .when(_no_price(open_), "no_price")
        .when(_live(limit) & (close <= limit * (1.0 + eps)), "limit_down")
    )


def execution_price(open_: Column, close: Column, side: Column, mode: str = "next_open", costs: Costs = Costs()) -> Column:
    if mode not in ("next_open", "next_close"):
        raise ValueError(f"unknown execution mode {mode!r}")
    return slipped(open_ if mode == "next_open" else close, side, costs)


def target_shares(weight: Column, price: Column, total_asset: Column | float, lot: int = rules.LOT_SIZE) -> Column:
    """Whole lots bought by a weight; whole shares first, then whole lots."""
    total = total_asset if isinstance(total_asset, Column) else F.lit(float(total_asset))
    shares = F.floor(F.try_divide(total * weight, price))
    lots = F.floor(shares / lot) * lot
    ok = F.coalesce((price > 0) & (weight > 0), F.lit(False))
    return F.when(ok, lots).otherwise(0).cast("bigint")
