"""Portfolio return series and performance metrics, many runs in one plan.

Run keys (`by`) identify a series, e.g. factor and method. A series has one row
per trading day, so windows per run are bounded by the calendar.
"""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import DataFrame, Window, functions as F

from barloom import rules
from barloom.functions import trading as tr, values as v
from barloom.operators.calendar import open_days, take_effect
from barloom.session import written

YEAR = rules.TRADING_DAYS_YEAR

#: So many (security, day) pairs, of some 40 bytes each, are sent to all tasks at most; more are joined by a shuffle.
FEW = 1_000_000


def _by_day(by: list[str]) -> Window:
    return Window.partitionBy(*by).orderBy("trade_date")


def rebalance_turnover(holdings: DataFrame, steps: DataFrame, by: list[str]) -> DataFrame:
    """bought and sold weight and names traded per rebalance against the previous one of the run.

    Every weight counts +w at its own rebalance and -w at the next one; one
    grouped sum per name replaces a join of neighbouring rebalances.
    """
    linked = holdings.join(steps, by + ["exec_date"])
    moves = linked.select(*by, "security_id", F.explode(F.array(
        F.struct(F.col("exec_date").alias("d"), F.col("weight").alias("x")),
        F.struct(F.col("next_exec").alias("d"), (-F.col("weight")).alias("x")),
    )).alias("m")).where("m.d is not null")
    net = moves.groupBy(*by, F.col("m.d").alias("exec_date"), "security_id").agg(F.sum("m.x").alias("x"))
    return net.groupBy(*by, "exec_date").agg(
        F.sum(F.greatest("x", F.lit(0.0))).alias("bought"), F.sum(F.greatest(-F.col("x"), F.lit(0.0))).alias("sold"),
        F.count_if(F.abs("x") > 1e-12).alias("n_fills"),
    ).withColumn("turnover", F.col("bought") + F.col("sold"))


def rebalances(acting: DataFrame, by: list[str]) -> DataFrame:
    """Every rebalance of a run with the next one, whether or not anything could be bought."""
    return acting.select(*by, "exec_date").distinct().withColumn(
        "next_exec", F.lead("exec_date").over(Window.partitionBy(*by).orderBy("exec_date"))
    )


def held_days(steps: DataFrame, calendar: DataFrame, by: list[str], last_day: dt.date | None = None) -> DataFrame:
    """Open days from each rebalance up to the next one; the last one is held to `last_day`, by default the last open day."""
    opened = open_days(calendar, end=last_day)
    if (last := opened.agg(F.max("trade_date")).first()[0]) is None:
        return steps.select(*by, "exec_date", F.col("exec_date").alias("trade_date")).limit(0)
    past = F.lit(last + dt.timedelta(days=1))
    until = steps.where(F.col("exec_date") < past).select(
        *by, "exec_date", F.least(F.coalesce("next_exec", past), past).alias("until")
    )
    days = until.select(*by, "exec_date", F.explode(F.sequence("exec_date", F.date_sub("until", 1))).alias("trade_date"))
    return days.join(F.broadcast(opened), "trade_date")


def _asked(rows: DataFrame, pairs: DataFrame, day: str) -> DataFrame:
    """Rows on the (security, day) pairs of a stored table, if these are few: what is joined to them is then not shuffled whole."""
    if pairs.count() > FEW:
        return rows
    return rows.join(F.broadcast(pairs.select("security_id", F.col("day").alias(day))), ["security_id", day], "left_semi")


def portfolio_series(weights: DataFrame, returns: DataFrame, execution: DataFrame, calendar: DataFrame, *, by: list[str],
                     costs: tr.Costs = tr.Costs(), last_day: dt.date | None = None, mode: str = "next_open") -> DataFrame:
    """Daily return, turnover and net value per run from close-of-day weights.

    weights: by..., trade_date, security_id, weight. A weight acts on the next open day, at the open (or, with `next_close`, the close).
    That day it earns the move from its price to the close, and the weight it replaces the move from the previous close to that price;
    on later days it earns the whole return, 0 where the name has no bar. Names that cannot be bought stay in cash. `n_rejects` counts those
    and names to be sold that could not be. Costs are commission and slippage on the traded weight and stamp tax on the sold one.
    """
    if mode not in ("next_open", "next_close"):
        raise ValueError(f"unknown execution mode {mode!r}")
    acting = written(take_effect(weights, calendar)[0].select(*by, "security_id", "exec_date", "weight"), "acting")
    mark = F.col("mark") if "mark" in execution.columns else F.col("close")
    inside = F.coalesce(F.try_divide(mark, F.col("open")), F.lit(1.0)) if mode == "next_open" else F.lit(1.0)
    met = execution.select(
        "security_id", F.col("trade_date").alias("exec_date"), inside.alias("inside"),
        tr.buy_block(F.col("open"), F.col("close"), F.col("up_limit"), F.col("suspended")).alias("no_buy"),
        tr.sell_block(F.col("open"), F.col("close"), F.col("down_limit"), F.col("suspended")).alias("no_sell"), F.lit(True).alias("bar"),
    )
    keys = ["security_id", "exec_date"]
    # Turnover, holding spans, earnings and rejects all read the screened weights: compute them once.
    ordered = _asked(met.drop("no_sell"), acting.select("security_id", F.col("exec_date").alias("day")), "exec_date")
    placed = written(acting.join(ordered, keys, "left").select(
        *by, *keys, "weight", "inside", (F.col("bar").isNotNull() & F.col("no_buy").isNull()).alias("bought"),
    ), "placed")
    steps = rebalances(placed, by)
    holdings = placed.where("bought").drop("bought")
    traded = rebalance_turnover(holdings.drop("inside"), steps, by).withColumnRenamed("exec_date", "trade_date")
    days = held_days(steps, calendar, by, last_day)
    whole = F.coalesce("ret", F.lit(0.0))
    positions = days.join(holdings, by + ["exec_date"])
    closed = holdings.drop("inside").join(steps.where("next_exec is not null"), by + ["exec_date"]).drop("exec_date").withColumnRenamed("next_exec", "exec_date")
    pairs = positions.select("security_id", F.col("trade_date").alias("day")).unionByName(closed.select("security_id", F.col("exec_date").alias("day")))
    pairs = written(pairs.distinct(), "held")
    own = _asked(returns.select("security_id", "trade_date", "ret"), pairs, "trade_date")
    met = _asked(met, pairs, "exec_date")
    held = positions.join(own, ["security_id", "trade_date"], "left").select(
        *by, "trade_date", "weight", (F.col("weight") * F.when(F.col("trade_date") == F.col("exec_date"), F.col("inside") - 1).otherwise(whole)).alias("x"), F.lit(1).alias("n"),
    )
    left = closed.join(met.drop("no_buy"), keys, "left").join(own.withColumnRenamed("trade_date", "exec_date"), keys, "left").select(
        *by, F.col("exec_date").alias("trade_date"), F.lit(0.0).alias("weight"),
        (F.col("weight") * (F.coalesce(F.try_divide(1 + whole, F.col("inside")), F.lit(1.0)) - 1)).alias("x"), F.lit(0).alias("n"),
    )
    daily = held.unionByName(left).groupBy(*by, "trade_date").agg(
        F.sum("x").alias("gross"), F.sum("weight").alias("held"), F.sum("n").alias("n_positions"),
    )
    unsold = closed.join(placed.select(*by, *keys), by + keys, "left_anti").join(met, keys, "left").where("bar is null or no_sell is not null")
    rejects = placed.where("not bought").select(*by, "exec_date").unionByName(unsold.select(*by, "exec_date")).groupBy(*by, "exec_date").agg(
        F.count("*").alias("n_rejects")
    ).withColumnRenamed("exec_date", "trade_date")
    series = days.select(*by, "trade_date").join(daily, by + ["trade_date"], "left").join(traded, by + ["trade_date"], "left").join(
        rejects, by + ["trade_date"], "left"
    ).fillna(0.0, ["gross", "held", "turnover", "bought", "sold"]).fillna(0, ["n_positions", "n_fills", "n_rejects"])
    cost = F.col("turnover") * (costs.commission_rate + costs.slippage_bps / 10_000.0) + F.col("sold") * costs.stamp_tax
    return with_nav(series.select(
        *by, "trade_date", "gross", (1.0 - F.col("held")).alias("cash_ratio"), "n_positions", "turnover", cost.alias("cost"),
        (F.col("gross") - cost).alias("ret"), "n_fills", "n_rejects",
    ), by)


def with_nav(series: DataFrame, by: list[str]) -> DataFrame:
    """Compound returns into a net value; a return of -1 or less ends it at 0."""
    w = _by_day(by).rowsBetween(Window.unboundedPreceding, 0)
    alive = F.coalesce(F.min("ret").over(w) > -1, F.lit(True))
    growth = F.exp(F.sum(F.log1p(F.when(F.col("ret") > -1, F.col("ret")))).over(w))
    return series.withColumn("nav", F.when(alive, growth).otherwise(0.0))


def rebased(series: DataFrame, by: list[str]) -> DataFrame:
    """Net value divided by its first value."""
    return series.withColumn("rebased", F.try_divide("nav", F.first("nav").over(_by_day(by))))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two curves side by side on the union of their dates, each starting at 1."""
    left = rebased(a.withColumn("__r", F.lit("a")), ["__r"]).select("trade_date", F.col("rebased").alias("nav_a"))
    right = rebased(b.withColumn("__r", F.lit("b")), ["__r"]).select("trade_date", F.col("rebased").alias("nav_b"))
    return left.join(right, "trade_date", "full")


def drawdowns(series: DataFrame, by: list[str]) -> DataFrame:
    peak = F.max("nav").over(_by_day(by).rowsBetween(Window.unboundedPreceding, 0))
    return series.withColumn("drawdown", F.try_divide("nav", peak) - 1)


def metrics(series: DataFrame, by: list[str]) -> DataFrame:
    """One row of performance figures per run.

    series: by..., trade_date, nav and optionally ret, turnover, cash_ratio. A
    given `ret` counts every day (a first day of 0 included); without it the
    returns come from nav and the first day has none.
    """
    own = "ret" in series.columns
    prev = F.lag("nav").over(_by_day(by))
    ret = v.finite_or_null(F.col("ret") if own else F.try_divide(F.col("nav"), prev) - 1)
    optional = {c: (F.col(c) if c in series.columns else F.lit(None).cast("double")) for c in ("turnover", "cash_ratio", "n_fills", "n_rejects")}
    rows = drawdowns(series, by).select(*by, "trade_date", "nav", ret.alias("__r"), "drawdown",
                                        *[c.alias(k) for k, c in optional.items()])
    g = rows.groupBy(*by).agg(
        F.min_by("nav", "trade_date").alias("nav0"), F.max_by("nav", "trade_date").alias("nav1"),
        F.count("__r").alias("n"), F.stddev_samp("__r").alias("sd"), F.min("drawdown").alias("max_drawdown"),
        F.avg("turnover").alias("turnover"), F.avg("cash_ratio").alias("avg_cash"),
        F.avg(F.when(F.col("__r").isNotNull(), (F.col("__r") > 0).cast("double"))).alias("hit_ratio"),
        F.sum("n_fills").alias("n_fills"), F.sum("n_rejects").alias("n_rejects"),
    )
    total = F.when((F.col("nav0") > 0) & v.is_finite(F.col("nav1")), F.col("nav1") / F.col("nav0") - 1)
    out = g.withColumn("total_return", total).withColumn(
        "ann_return",
        F.when(F.col("n") > 1, v.finite_or_null(F.pow(1.0 + F.col("total_return"), F.lit(YEAR) / F.col("n")) - 1)),
    ).withColumn("ann_vol", F.when(F.col("n") >= 2, F.col("sd") * math.sqrt(YEAR)))
    return out.select(
        *by, "total_return", "ann_return", "ann_vol",
        F.when(F.col("ann_vol") > 0, F.col("ann_return") / F.col("ann_vol")).alias("sharpe"),
        "max_drawdown",
        F.when(F.col("max_drawdown") < 0, F.col("ann_return") / F.abs("max_drawdown")).alias("calmar"),
        "turnover", "avg_cash", "hit_ratio", "n_fills", "n_rejects",
    )


def excess_metrics(series: DataFrame, benchmark: DataFrame, by: list[str]) -> DataFrame:
    """Against a benchmark (trade_date, ret) on common days; runs with fewer than two are left out."""
    prev = F.lag("nav").over(_by_day(by))
    strat = series.select(*by, "trade_date", (F.try_divide(F.col("nav"), prev) - 1).alias("s")).where("s is not null")
    bench = benchmark.select("trade_date", F.col("ret").alias("b")).where("b is not null")
    er = strat.join(bench, "trade_date").select(*by, (F.col("s") - F.col("b")).alias("er"))
    g = er.groupBy(*by).agg(
        F.count("*").alias("days"), (F.product(1.0 + F.col("er")) - 1.0).alias("excess_total"),
        (F.stddev_samp("er") * math.sqrt(YEAR)).alias("excess_ann_vol"), (F.avg("er") * YEAR).alias("excess_ann_return"),
    ).where("days >= 2")
    return g.withColumn(
        "info_ratio", F.when(F.col("excess_ann_vol") > 0, F.col("excess_ann_return") / F.col("excess_ann_vol"))
    ).drop("days")
