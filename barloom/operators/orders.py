"""Sizing, order differences and the stateless order screen."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from barloom import rules
from barloom.functions import market as mk, symbols as sy, trading as tr, values as v


@dataclass(frozen=True)
class Limits:
    """Account limits; 0 means unlimited."""

    max_order_value: float = 0.0
    max_position_value: float = 0.0
    reject_limit_up_buy: bool = True
    reject_limit_down_sell: bool = True
    reject_suspended: bool = True


def size_targets(weights: DataFrame, prices: DataFrame, total_asset: float, *, lot: int = rules.LOT_SIZE) -> DataFrame:
    """Target shares per weighted code; a code without a usable price gets 0."""
    px = prices.select("exchange_code", "price")
    return weights.join(px, "exchange_code", "left").withColumn(
        "target", tr.target_shares(F.col("weight"), F.col("price"), total_asset, lot)
    )


def size_targets_capped(weights: DataFrame, execution: DataFrame, *, equity: float, max_participation: float = 0.0,
                        mode: str = "next_open", lot: int = rules.LOT_SIZE, partial: bool = False) -> DataFrame:
    """Holdings a rebalance from cash would ask for, limited by a share of the day's volume.

    weights: exec_date, security_id, weight (already normalised); execution: the
    bar frame. Rejected rows carry a reason and size 0.
    """
    bars = execution.withColumnRenamed("trade_date", "exec_date")
    px = F.col("open") if mode == "next_open" else F.col("close")
    usable = F.coalesce(v.is_finite(px) & (px > 0), F.lit(False))
    want = tr.lot_floor(F.try_divide(F.col("weight") * equity, px), lot, partial=partial)
    cap = tr.lot_floor(F.floor(F.col("volume") * max_participation), lot, partial=partial)
    capped = (F.lit(max_participation) > 0) & (F.coalesce("volume", F.lit(0.0)) > 0)
    blocked = tr.buy_block(F.col("open"), F.col("close"), F.col("up_limit"), F.col("suspended"))
    reason = (
        F.when(F.col("close").isNull(), "no_bar")
        .when(~usable, "no_price")
        .when(F.col("want") <= 0, F.lit(None))
        .when(blocked.isNotNull(), blocked)
        .when(capped & (F.col("cap") <= 0), "adv_limit")
    )
    sized = weights.join(bars, ["security_id", "exec_date"], "left").withColumns({"want": want, "cap": cap}).withColumn(
        "reason", reason
    )
    shares = F.when(F.col("reason").isNotNull(), 0).when(capped, F.least("want", "cap")).otherwise(F.col("want"))
    return sized.select("exec_date", "security_id", "weight", "want", shares.cast("bigint").alias("shares"), "reason")


def reject_counts(sized: DataFrame, *by: str) -> DataFrame:
    return sized.where("reason is not null").groupBy(*by, "reason").agg(F.count("*").alias("n"))


def difference(current: DataFrame, target: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Orders that turn current holdings into target ones: side and quantity, no zero orders."""
    by = by or []
    have = current.groupBy(*by, "exchange_code").agg(F.sum("quantity").alias("have"))
    want = target.groupBy(*by, "exchange_code").agg(F.sum("target").alias("want"))
    delta = F.coalesce("want", F.lit(0)) - F.coalesce("have", F.lit(0))
    return have.join(want, by + ["exchange_code"], "full").withColumn("delta", delta).where("delta <> 0").select(
        *by, "exchange_code",
        F.when(F.col("delta") > 0, "buy").otherwise("sell").alias("side"), F.abs("delta").cast("bigint").alias("quantity"),
    )


def board_rules(spark: SparkSession) -> DataFrame:
    """The fixed rules as a table, one row per board."""
    return spark.createDataFrame(
        [(b, *rules.LOT_RULE[b], rules.PRICE_LIMIT[b], rules.ST_PRICE_LIMIT[b]) for b in rules.BOARDS],
        "board string, smallest int, step int, pct double, st_pct double",
    )


def screen(orders: DataFrame, quotes: DataFrame, positions: DataFrame, *, cash: float, limits: Limits = Limits(),
           costs: tr.Costs | None = None) -> DataFrame:
    """Verdict per order against quotes and holdings as given: ok, reasons, adjusted_qty.

    Each order is judged alone with the full cash; nothing is booked. The first
    failing test decides; a lot adjustment is reported along with it.
    orders: exchange_code, side, quantity[, limit_price].
    """
    code = F.upper(F.trim("exchange_code"))
    quoted = quotes.select("exchange_code", *[
        (F.col(c) if c in quotes.columns else F.lit(None)).alias(f"q_{c}")
        for c in ("price", "ask", "bid", "volume", "pre_close", "up_limit", "down_limit", "is_suspended", "is_st")
    ], F.lit(True).alias("quoted"))
    held = positions.groupBy("exchange_code").agg(
        F.sum("quantity").alias("have"),
        (F.sum("market_value") if "market_value" in positions.columns else F.lit(0.0)).alias("have_value"),
    )
    limit_price = F.col("limit_price") if "limit_price" in orders.columns else F.lit(None).cast("double")
    rows = (
        orders.withColumns({"exchange_code": code, "side": F.lower(F.trim("side")), "limit_price": limit_price})
        .join(quoted, "exchange_code", "left").join(held, "exchange_code", "left")
    )
    known = sy.market_part(F.col("exchange_code")).isin("SH", "SZ", "BJ")
    # The rule columns come from a joined table: as nested CASEs they would be
    # repeated in every test below and outgrow a generated method.
    rows = rows.withColumn("board", F.when(known, sy.board_of(F.col("exchange_code")))).join(
        F.broadcast(board_rules(orders.sparkSession)), "board", "left"
    )
    smallest, step = F.col("smallest"), F.col("step")
    odd = (step > 1) & (F.col("quantity") % step != 0)
    lot = F.when(F.col("quantity") < smallest, 0).otherwise(smallest + F.floor((F.col("quantity") - smallest) / step) * step)
    rows = rows.withColumn("qty", F.when(odd, lot).otherwise(F.col("quantity")))

    def live(c: str):
        return F.when(F.col(c) != 0, F.col(c))

    price = F.coalesce("limit_price", live("q_price"), live("q_ask"), live("q_bid"))
    pre = F.coalesce("q_pre_close", F.lit(0.0))
    pct = F.when(F.col("q_is_st") == 1, F.col("st_pct")).otherwise(F.col("pct"))
    rows = rows.withColumns({
        "px": price,
        "up": F.coalesce("q_up_limit", F.when(pre > 0, F.round(pre * (1 + pct) + 1e-9, 2))),
        "down": F.coalesce("q_down_limit", F.when(pre > 0, F.round(pre * (1 - pct) + 1e-9, 2))),
        "lot_note": F.when(odd, F.lit("lot_adjusted")),
    }).withColumn("notional", F.col("px") * F.col("qty"))
    quoted_row = F.coalesce("quoted", F.lit(False))
    last = F.coalesce("q_price", F.lit(0.0))
    buy, sell = F.col("side") == "buy", F.col("side") == "sell"
    need = F.col("notional") if costs is None else tr.fill(F.col("px"), F.col("qty"), F.lit("buy"), costs)["cash"]
    halted = (mk.flag(F.col("q_is_suspended")) == 1) | ((last <= 0) & (F.coalesce("q_volume", F.lit(0.0)) <= 0))
    position_value = F.coalesce("have_value", F.lit(0.0)) + F.col("notional")

    reason = (
        F.when(~(buy | sell), "bad_side")
        .when(F.col("quantity") <= 0, "bad_quantity")
        .when(F.col("board").isNull(), "unknown_code")
        .when(F.col("quantity") < smallest, "below_min_lot")
        .when(F.col("px").isNull() | (F.col("px") <= 0), "no_price")
        .when(quoted_row & F.lit(limits.reject_suspended) & halted, "suspended")
        .when(quoted_row & F.lit(limits.reject_limit_up_buy) & buy
              & (F.col("px") >= F.col("up") - 1e-6) & (last >= F.col("up") - 1e-6), "limit_up")
        .when(quoted_row & F.lit(limits.reject_limit_down_sell) & sell & (last <= F.col("down") + 1e-6), "limit_down")
        .when(F.lit(limits.max_order_value > 0) & (F.col("notional") > limits.max_order_value + 1e-6), "order_value")
        .when(buy & (need > cash + 1e-6), "cash")
        .when(sell & (F.col("qty") > F.coalesce("have", F.lit(0))), "holding")
        .when(F.lit(limits.max_position_value > 0) & buy & (position_value > limits.max_position_value + 1e-6),
              "position_value")
    )
    out = rows.withColumn("reason", reason)
    return out.select(
        "exchange_code", "side", "quantity",
        F.col("reason").isNull().alias("ok"),
        F.array_compact(F.array("lot_note", "reason")).alias("reasons"),
        F.when(F.col("reason").isNull() & F.col("lot_note").isNotNull(), F.col("qty")).alias("adjusted_qty"),
        F.col("px").alias("price"),
    )


def mark(positions: DataFrame, closes: DataFrame) -> DataFrame:
    """Positions valued at the day's close; a missing quote values at 0 and is flagged.

    positions: session_id, exchange_code, quantity, cost; closes: exchange_code, price.
    """
    px = F.coalesce("price", F.lit(0.0))
    return positions.join(closes.select("exchange_code", "price"), "exchange_code", "left").select(
        "session_id", "exchange_code", "quantity", px.alias("mark_price"), (px * F.col("quantity")).alias("market_value"),
        "cost", F.when(F.col("quantity") != 0, px * F.col("quantity") - F.col("cost")).otherwise(0.0).alias("unrealized_pnl"),
        ((F.col("quantity") > 0) & (px <= 0)).alias("missing_quote"),
    )


def mark_sessions(sessions: DataFrame, positions: DataFrame, closes: DataFrame, mark_date) -> DataFrame:
    """Session totals at a mark date. sessions: session_id, cash, initial_cash, rebalance_total."""
    held = mark(positions, closes).groupBy("session_id").agg(
        F.sum("market_value").alias("market_value"), F.count("*").alias("n_positions"),
        F.count_if("missing_quote").alias("n_missing_quotes"),
    )
    value = F.coalesce("market_value", F.lit(0.0))
    total = F.col("cash") + value
    return sessions.join(held, "session_id", "left").select(
        "session_id", F.lit(mark_date).cast("date").alias("mark_date"), "cash", value.alias("market_value"),
        total.alias("total_asset"), (total - F.col("initial_cash")).alias("pnl_vs_initial"),
        (total - F.coalesce("rebalance_total", total)).alias("pnl_vs_rebalance"),
        (F.try_divide(total, F.nullif("initial_cash", F.lit(0.0))) - 1).alias("return_vs_initial"),
        F.coalesce("n_positions", F.lit(0)).alias("n_positions"),
        F.coalesce("n_missing_quotes", F.lit(0)).alias("n_missing_quotes"),
    )


def with_previous_mark(marks: DataFrame) -> DataFrame:
    """Change of the total against the session's previous mark."""
    w = Window.partitionBy("session_id").orderBy("mark_date")
    return marks.withColumn("pnl_vs_prev_mark", F.col("total_asset") - F.lag("total_asset").over(w))


def named(positions: DataFrame, master: DataFrame) -> DataFrame:
    """Fill missing names from the master's latest row; a blank name or one equal to the code is missing."""
    names = master.groupBy(F.upper("exchange_code").alias("exchange_code")).agg(
        F.max_by(F.trim("name"), "valid_from").alias("__name")
    )
    own = F.nullif(F.trim("name"), F.lit("")) if "name" in positions.columns else F.lit(None).cast("string")
    code = F.upper(F.trim("exchange_code"))
    rows = positions.withColumn("exchange_code", code).withColumn("__own", own)
    return rows.join(names, "exchange_code", "left").withColumn(
        "name",
        F.coalesce(F.when(F.col("__own") != F.col("exchange_code"), F.col("__own")),
                   F.nullif("__name", F.lit("")), F.lit("—")),
    ).drop("__own", "__name")


def compare_sessions(session_ids: DataFrame, sessions: DataFrame, positions: DataFrame, marks: DataFrame) -> DataFrame:
    """Asked sessions side by side; unknown ids stay with error 'not_found'."""
    count = positions.groupBy("session_id").agg(F.count("*").alias("n_positions"))
    latest = marks.groupBy("session_id").agg(F.max_by(
        F.struct("mark_date", F.col("total_asset").alias("mark_total_asset"), "pnl_vs_initial"), "mark_date"
    ).alias("m"))
    known = sessions.withColumn("__known", F.lit(True))
    return (
        session_ids.join(known, "session_id", "left").join(count, "session_id", "left").join(latest, "session_id", "left")
        .select(
            "session_id", *[c for c in sessions.columns if c != "session_id"],
            F.when(F.col("__known"), F.coalesce("n_positions", F.lit(0))).alias("n_positions"),
            F.col("m.mark_date").alias("mark_date"), F.col("m.mark_total_asset").alias("mark_total_asset"),
            F.col("m.pnl_vs_initial").alias("pnl_vs_initial"),
            F.when(F.col("__known").isNull(), "not_found").alias("error"),
        )
    )
