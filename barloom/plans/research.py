"""Research reads and jobs: universe, prices, panels, weights, signals, experiments, rebalance plans."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from barloom import rules
from barloom.functions import market as mk, trading as tr, values as v
from barloom.operators import asof, orders as od, performance as pf, prices as pr, weights as wt
from barloom.operators.scd2 import current_listing
from barloom.session import durable

ALL = ("ALL", "*", "all")


def clamp(end: dt.date, version: str | None) -> dt.date:
    """A reader pinned to a published version never sees later days; unreadable versions do not pin."""
    if not version:
        return end
    try:
        return min(end, dt.date.fromisoformat(version.strip()[:10]))
    except ValueError:
        return end


def _in_range(df: DataFrame, start: dt.date | None, end: dt.date | None, version: str | None) -> DataFrame:
    if start is not None:
        df = df.where(F.col("trade_date") >= F.lit(start))
    if end is not None or version:
        df = df.where(F.col("trade_date") <= F.lit(clamp(end or rules.OPEN_END, version)))
    return df


def check_filters(filters: list[str] | tuple[str, ...]) -> None:
    unknown = set(filters) - set(rules.UNIVERSE_FILTERS)
    if unknown:
        raise ValueError(f"unknown filters {sorted(unknown)}; known: {rules.UNIVERSE_FILTERS}")


def filter_test(filters: list[str] | tuple[str, ...]) -> Column:
    """Conjunction of the named universe filters over a bar joined with its listing date."""
    check_filters(filters)
    ok = F.lit(True)
    if "st" in filters:
        ok = ok & (mk.flag(F.col("is_st")) != 1)
    if "suspended" in filters:
        ok = ok & (mk.flag(F.col("is_suspended")) != 1)
    if "listed_days<120" in filters:
        ok = ok & (F.col("list_date") <= F.date_sub("trade_date", 120))
    if "limit_up_open" in filters:
        pinned = (F.col("is_suspended") == 0) & (F.abs(F.col("close") - F.col("up_limit")) < 1e-6)
        ok = ok & ~F.coalesce(pinned, F.lit(False))
    return ok


def universe(bars: DataFrame, master: DataFrame, *, index_code: str = "ALL", members: DataFrame | None = None,
             calendar: DataFrame | None = None, filters: tuple[str, ...] = (), start: dt.date | None = None,
             end: dt.date | None = None, version: str | None = None) -> DataFrame:
    """Selectable codes per day: (trade_date, security_id, exchange_code).

    ALL is everything with a bar; an index is its members at the day, with or
    without a bar. Days after the pinned version are empty.
    """
    check_filters(filters)
    listed = current_listing(master, "exchange_code", "list_date")
    facts = _in_range(bars, start, end, version).select("security_id", "trade_date", *[
        c for c in ("is_st", "is_suspended", "close", "up_limit") if c in bars.columns
    ])
    if index_code in ALL:
        rows = facts
    else:
        days = _in_range(calendar.where("is_open = 1").select(F.col("cal_date").alias("trade_date")), start, end, version)
        last = days.agg(F.max("trade_date")).scalar()
        first = days.agg(F.min("trade_date")).scalar()
        spans = members.where(F.col("index_code") == index_code).where(
            (F.col("in_date") <= last) & (F.col("out_date") > first)
        )
        a, b = F.greatest("in_date", first), F.least(F.date_sub("out_date", 1), last)
        dated = spans.select("security_id", F.explode(F.sequence(a, b)).alias("trade_date")).join(F.broadcast(days), "trade_date")
        rows = dated.join(facts, ["security_id", "trade_date"], "left")
    # A security has one bar per day and one interval per index at a time: the rows are distinct as they are.
    return rows.join(listed, "security_id").where(filter_test(filters)).select("trade_date", "security_id", "exchange_code")


def get_price(bars: DataFrame, master: DataFrame, *, codes: DataFrame | None = None, start: dt.date | None = None,
              end: dt.date | None = None, adjust: str = "post", fields: tuple[str, ...] = ("open", "high", "low", "close", "volume"),
              version: str | None = None) -> DataFrame:
    """Adjusted bars of the asked codes (a frame of exchange_code; None = all) in a range."""
    listed = current_listing(master, "exchange_code")
    if codes is not None:
        listed = listed.join(codes.select("exchange_code").distinct(), "exchange_code", "left_semi")
    rows = pr.adjusted(_in_range(bars, start, end, version), adjust).join(listed, "security_id")
    tail = [c for c in ("up_limit", "down_limit", "is_suspended", "is_st") if c in rows.columns]
    return rows.select("trade_date", "exchange_code", *fields, *tail)


def get_factor(factors: DataFrame, master: DataFrame, name: str, *, start: dt.date | None = None, end: dt.date | None = None,
               factor_version: str = rules.FACTOR_VERSION, version: str | None = None, with_code: bool = True) -> DataFrame:
    rows = _in_range(
        factors.where((F.col("factor_name") == name) & (F.col("version") == factor_version)), start, end, version
    ).select("trade_date", "security_id", "value")
    return rows.join(current_listing(master, "exchange_code"), "security_id", "left") if with_code else rows


def get_industry(industry: DataFrame, master: DataFrame, day: dt.date, level: str = "sw_l1") -> DataFrame:
    if level not in ("sw_l1", "sw_l2"):
        raise ValueError("level must be sw_l1 or sw_l2")
    coded = industry.join(current_listing(master, "exchange_code"), "security_id")
    return asof.attribute_on(coded, level, day)


def get_fundamental(statements: DataFrame, master: DataFrame, item: str, day: dt.date, *, version: str | None = None) -> DataFrame:
    seen = asof.visible_item(statements, item, clamp(day, version))
    return seen.join(current_listing(master, "exchange_code"), "security_id").select("exchange_code", "value")


@dataclass(frozen=True)
class Spec:
    """A rebalance specification."""

    universe: str = "ALL"
    filters: tuple[str, ...] = ("st", "suspended", "listed_days<120")
    factors: tuple[str, ...] = ("mom_20",)
    factor_version: str = rules.FACTOR_VERSION
    adjust: str = "post"
    top_n: int | None = None
    methods: tuple[str, ...] = ("equal",)
    level: str = "sw_l1"


def panel(bars: DataFrame, factors: DataFrame, master: DataFrame, spec: Spec, *, members: DataFrame | None = None,
          industry: DataFrame | None = None, start: dt.date | None = None, end: dt.date | None = None,
          version: str | None = None, selected: bool = False) -> DataFrame:
    """Universe, price, factor value (and industry) per day and factor, all days in one plan.

    The filters sit on the bar rows themselves, and index membership is a sweep,
    so the panel costs one join of bars and factors. With `selected` only the rows are given that
    `weight_series` chooses by the top n of the specification, so only these look for their industry.
    """
    # The limit filter compares raw closes, so the adjusted one rides along under another name.
    rows = _in_range(bars, start, end, version).withColumn("adj_close", F.col("close") * pr.factor_in_range(spec.adjust))
    if spec.universe not in ALL:
        spans = members.where(F.col("index_code") == spec.universe).select("security_id", "in_date", "out_date")
        rows = asof.inside_interval(rows, spans, ["security_id"])
    listed = current_listing(master, "exchange_code", "list_date")
    priced = rows.join(listed.withColumnRenamed("exchange_code", "code"), "security_id").where(
        filter_test(spec.filters)
    ).select("security_id", "trade_date", F.col("code").alias("exchange_code"), F.col("adj_close").alias("close"))
    values = factors.where(
        F.col("factor_name").isin(*spec.factors) & (F.col("version") == spec.factor_version) & F.col("value").isNotNull()
    ).select("security_id", "trade_date", "factor_name", "value")
    out = priced.join(values, ["security_id", "trade_date"])
    if selected:
        out = wt.select_names(out, ["factor_name", "trade_date"], spec.top_n)
    if industry is not None:
        out = asof.attach_interval(out, industry.where(F.col("level") == spec.level), ["security_id"], ["industry"])
        out = out.withColumn("industry", F.coalesce("industry", F.lit(wt.UNKNOWN)))
    return out


def weight_series(panel_rows: DataFrame, spec: Spec) -> DataFrame:
    """Target weights per factor, method and day."""
    return wt.target_weights(panel_rows, list(spec.methods), spec.top_n, by=["factor_name", "trade_date"], keep=["security_id"])


def tradability_preview(weights: DataFrame, bars: DataFrame) -> DataFrame:
    """Weighted names on their day: suspension and limit flags, tradable or not."""
    up = (F.col("close") >= F.col("up_limit") * (1 - rules.LIMIT_EPS)).cast("int")
    down = (F.col("close") <= F.col("down_limit") * (1 + rules.LIMIT_EPS)).cast("int")
    facts = bars.select("security_id", "trade_date", "is_suspended", F.coalesce(up, F.lit(0)).alias("at_up_limit"),
                        F.coalesce(down, F.lit(0)).alias("at_down_limit"))
    open_ = (mk.flag(F.col("is_suspended")) == 0) & (F.col("at_up_limit") == 0) & (F.col("at_down_limit") == 0)
    return weights.join(facts, ["security_id", "trade_date"]).withColumn("tradable", open_.cast("int"))


def signal_exposure(weights: DataFrame, index_rows: DataFrame, industry: DataFrame, level: str = "sw_l1") -> DataFrame:
    """Industry weights of a signal against the equal-weight index, per day."""
    spans = industry.where(F.col("level") == level)
    sig = asof.attach_interval(weights, spans, ["security_id"], ["industry"])
    idx = asof.attach_interval(index_rows, spans, ["security_id"], ["industry"])
    return wt.exposure(sig, idx)


def signal_meta(weights: DataFrame, preview: DataFrame, spec: Spec, *, dataset_version: str) -> DataFrame:
    """One row per signal (day, factor, method): id, names, weight sum, non-tradable count."""
    keys = ["trade_date", "factor_name", "weight_method"]
    stuck = preview.where("tradable = 0").groupBy(*keys).agg(F.count("*").alias("non_tradable_count"))
    head = weights.groupBy(*keys).agg(F.count("*").alias("n_names"), F.sum("weight").alias("weight_sum"))
    ident = v.short_id("signal", {
        "asof": F.col("trade_date"), "universe": F.lit(spec.universe), "factor": F.col("factor_name"),
        "top_n": F.lit(spec.top_n or 0), "weight_method": F.col("weight_method"), "version": F.lit(dataset_version),
        "industry_level": F.lit(spec.level), "factor_version": F.lit(spec.factor_version),
    })
    return head.join(stuck, keys, "left").fillna(0, ["non_tradable_count"]).withColumn(
        "signal_id", F.concat_ws("_", "factor_name", "weight_method", F.right(ident, F.lit(8)))
    )


def cells(factors: list[str], methods: list[str], spark) -> DataFrame:
    """Parameter grid factor x method."""
    rows = spark.createDataFrame([(f,) for f in factors], "factor_name string")
    return rows.select("factor_name", F.explode(F.array(*[F.lit(m) for m in methods])).alias("weight_method"))


def experiment(weights: DataFrame, bars: DataFrame, execution: DataFrame, calendar: DataFrame, *,
               benchmark: DataFrame | None = None, costs: tr.Costs = tr.Costs()) -> DataFrame:
    """Metrics of every (factor, method) cell in one plan."""
    by = ["factor_name", "weight_method"]
    returns = pr.daily_returns(bars).select("security_id", "trade_date", "ret")
    series = pf.portfolio_series(weights, returns, execution, calendar, by=by, costs=costs)
    if benchmark is not None:
        series = durable(series)  # a row per cell and day, read for either kind of figures
    out = pf.metrics(series, by)
    if benchmark is not None:
        out = out.join(pf.excess_metrics(series, benchmark, by), by, "left")
    return out.withColumn("status", F.lit("ok"))


def with_failed_cells(grid: DataFrame, results: DataFrame) -> DataFrame:
    """Cells of the grid without a result are marked as failed."""
    return grid.join(results, ["factor_name", "weight_method"], "left").withColumn(
        "status", F.coalesce("status", F.lit("fail"))
    )


def best_cell(summary: DataFrame, rank_by: str = "sharpe", *, ascending: bool = False) -> DataFrame:
    """Best successful cell; missing figures rank last."""
    if rank_by not in summary.columns:
        raise ValueError(f"no metric {rank_by!r}; columns: {summary.columns}")
    order = F.asc_nulls_last(rank_by) if ascending else F.desc_nulls_last(rank_by)
    tie = [c for c in ("factor_name", "factor", "weight_method") if c in summary.columns]
    return summary.where("status = 'ok'").orderBy(order, *tie).limit(1)


def matrix(summary: DataFrame, methods: list[str], metric: str = "sharpe") -> DataFrame:
    """Factor by method table of a metric."""
    return summary.groupBy("factor_name").pivot("weight_method", methods).agg(F.first(metric))


def quotes_of(bars: DataFrame, master: DataFrame, day: dt.date | None = None) -> DataFrame:
    """Daily bars as quotes: of a day, or the latest bar per code."""
    rows = bars.where(F.col("trade_date") == F.lit(day)) if day is not None else bars.groupBy("security_id").agg(
        F.max_by(F.struct(*[c for c in bars.columns if c != "security_id"]), "trade_date").alias("r")
    ).select("security_id", "r.*")
    coded = rows if "exchange_code" in rows.columns else rows.join(current_listing(master, "exchange_code"), "security_id")
    return coded.select(
        "exchange_code", F.col("close").alias("price"), "pre_close", "open", "high", "low", "volume", "amount",
        "up_limit", "down_limit", "is_suspended", "is_st", F.col("close").alias("bid"), F.col("close").alias("ask"),
    )


def rebalance_plan(weights: DataFrame, quotes: DataFrame, positions: DataFrame, *, total_asset: float, cash: float,
                   limits: od.Limits = od.Limits(), costs: tr.Costs = tr.Costs()) -> tuple[DataFrame, DataFrame]:
    """Signal weights -> sized targets -> order differences -> screened (orders, rejects)."""
    targets = od.size_targets(weights, quotes, total_asset)
    verdicts = od.screen(od.difference(positions, targets), quotes, positions, cash=cash, limits=limits, costs=costs)
    return verdicts.where("ok"), verdicts.where("not ok")


def first_codes(codes: DataFrame, n: int) -> DataFrame:
    """The first n distinct codes in order (used with a semi-join to restrict a universe)."""
    return codes.select("exchange_code").distinct().orderBy("exchange_code").limit(n)


def latest_basic(basic: DataFrame, *, upto: dt.date | None = None) -> DataFrame:
    rows = basic if upto is None else basic.where(F.col("trade_date") <= F.lit(upto))
    rest = [c for c in basic.columns if c != "security_id"]
    return rows.groupBy("security_id").agg(F.max_by(F.struct(*rest), "trade_date").alias("r")).select("security_id", "r.*")


def default_range(bars: DataFrame, days: int = 90) -> DataFrame:
    """[max(first, last - days), last] of the bars."""
    return bars.agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("b")).select(
        F.greatest("a", F.date_sub("b", days)).alias("start"), F.col("b").alias("end")
    )


