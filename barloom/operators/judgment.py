"""Security cards: percentile scores, relative strength, tradability and tags for all codes at a date."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from barloom import rules
from barloom.functions import market as mk, scoring as sc, values as v
from barloom.operators import asof, ranking
from barloom.operators.prices import post_close
from barloom.session import durable


def percentiles(factors: DataFrame, by: list[str], *, counted: str | None = None, stored: DataFrame | None = None) -> DataFrame:
    """Share of the cross-section at or below each value (`pct`) and its size (`n`); `stored` are the factors before anything was attached."""
    rows, sampled = (None if x is None else x.where(v.is_finite(F.col("value"))) for x in (factors, stored))
    ranked = ranking.with_tie_ranks(rows, by, "value", ["security_id"], counted=counted, sampled=sampled)
    return ranked.withColumn("pct", ranking.share_at_or_below()).drop("rn", "rank_low", "rank_high")


def market_percentiles(factors: DataFrame) -> DataFrame:
    return percentiles(factors, ["trade_date", "factor_name"])


def index_percentiles(factors: DataFrame, members: DataFrame, index_code: str) -> DataFrame:
    """Every value against the index members' values of the day (the row itself need not be a member)."""
    spans = members.where(F.col("index_code") == index_code).select("security_id", "in_date", "out_date",
                                                                    F.lit(True).alias("member"))
    marked = asof.attach_in_place(factors, spans, ["security_id"], ["member"])
    marked = marked.withColumn("member", F.coalesce("member", F.lit(False)))
    return percentiles(marked, ["trade_date", "factor_name"], counted="member", stored=factors)


def industry_percentiles(factors: DataFrame, industry: DataFrame, level: str) -> DataFrame:
    placed = asof.attach_in_place(factors, industry.where(F.col("level") == level), ["security_id"], ["industry"])
    return percentiles(placed.where("industry is not null"), ["trade_date", "factor_name", "industry"], stored=factors)


def factor_profile(factors: DataFrame, industry: DataFrame, level: str = "sw_l1") -> DataFrame:
    """Value, market share and in-industry share per security, day and factor."""
    keys = ["trade_date", "security_id", "factor_name"]
    market = market_percentiles(factors).select(
        *keys, "value", F.col("pct").alias("pct_market"), F.col("n").alias("n_market")
    )
    peers = industry_percentiles(factors, industry, level).select(
        *keys, "industry", F.col("pct").alias("pct_industry"), F.col("n").alias("n_industry")
    )
    return market.join(peers, keys, "left")


def wide(profile: DataFrame, column: str, names: list[str], suffix: str = "") -> DataFrame:
    """Long per-factor rows -> one row per security with a column per factor."""
    return profile.groupBy("security_id").agg(*[
        F.max(F.when(F.col("factor_name") == n, F.col(column))).alias(n + suffix) for n in names
    ])


def scores(percentile_of: dict[str, Column]) -> dict[str, Column]:
    """Dimension scores 0-100 from factor percentiles, plus their mean as `composite`."""
    out = {dim: sc.dimension_score(percentile_of[f], inv) for dim, (f, inv) in rules.DIMENSIONS.items()}
    return out | {"composite": sc.mean_present(list(out.values()))}


def market_window(bars: DataFrame, day: dt.date, n: int) -> DataFrame:
    """The latest n market days up to a date (bounded by n)."""
    return bars.where(F.col("trade_date") <= F.lit(day)).select("trade_date").distinct().orderBy(
        F.desc("trade_date")
    ).limit(n)


def relative_strength(bars: DataFrame, members: DataFrame, index_code: str, day: dt.date, window: int = 20) -> DataFrame:
    """Return over the last window+1 market days minus the mean member return, per security.

    A security needs two bars in the window. A member counts when it has a bar on
    the first and on the last day of the members' window.
    """
    days = market_window(bars, day, window + 1)
    own = bars.join(F.broadcast(days), "trade_date", "left_semi").withColumn("px", post_close()).groupBy("security_id").agg(
        F.count("*").alias("n"), F.min("trade_date").alias("d0"), F.max("trade_date").alias("d1"),
        F.min_by("px", "trade_date").alias("c0"), F.max_by("px", "trade_date").alias("c1"),
    )
    inside = asof.valid_on(members.where(F.col("index_code") == index_code), day).select("security_id").distinct()
    change = F.try_divide("c1", F.nullif("c0", F.lit(0.0))) - 1
    # Grouped by first and last day: at most (window + 1) squared rows are left to choose from.
    spans = own.join(inside, "security_id", "left_semi").groupBy("d0", "d1").agg(F.avg(change).alias("mean"))
    first, last = F.min("d0"), F.max("d1")
    bench = spans.agg(
        first.alias("first"), last.alias("last"), F.collect_list(F.struct("d0", "d1", "mean")).alias("s")
    ).select(F.expr("get(filter(s, e -> e.d0 = first and e.d1 = last and first < last), 0).mean").alias("mean")).scalar()
    usable = own.where("n >= 2 and c0 > 0").select("security_id", (F.col("c1") / F.col("c0") - 1).alias("stock_return"))
    return usable.withColumn("bench_return", bench).withColumn(
        "relative_strength", F.col("stock_return") - F.col("bench_return")
    )


def tradability(bars: DataFrame, suspensions: DataFrame, statements: DataFrame, day: dt.date, lookback: int = 20) -> DataFrame:
    """Limit, suspension and ST events in a security's last bars, filing lag and a status."""
    d = F.lit(day)
    upto = bars.where(F.col("trade_date") <= d)
    recent = ranking.top_n(upto, ["security_id"], [F.desc("trade_date")], lookback, rank="back")
    up, down = mk.touches(F.col("close"), F.col("up_limit")), mk.touches(F.col("close"), F.col("down_limit"))
    sus, st = mk.flag(F.col("is_suspended")) == 1, mk.flag(F.col("is_st")) == 1
    event = F.array_compact(F.array(F.when(sus, "suspended"), F.when(up, "limit_up"), F.when(down, "limit_down")))
    latest = F.col("back") == 1
    g = recent.groupBy("security_id").agg(
        F.count_if(up).alias("n_limit_up"), F.count_if(down).alias("n_limit_down"), F.count_if(sus).alias("n_suspended"),
        F.bool_or(st).alias("any_st"), F.bool_or(latest & sus).alias("now_suspended"),
        F.bool_or(latest & up).alias("now_up"), F.bool_or(latest & down).alias("now_down"),
        F.collect_list(F.when(F.size(event) > 0, F.struct("trade_date", event.alias("events")))).alias("__events"),
    )
    halted = suspensions.where(F.col("suspend_date") <= d).groupBy("security_id").agg(
        F.max("suspend_date").alias("last_suspend_date")
    )
    filed = statements.where(F.col("ann_date") <= d).groupBy("security_id").agg(
        F.max("ann_date").alias("finance_ann_date")
    ).withColumn("finance_ann_lag_days", F.date_diff(d, "finance_ann_date"))
    care = (
        F.col("now_up") | F.col("now_down") | F.col("any_st") | (F.col("n_suspended") >= 3)
        | (F.col("n_limit_up") + F.col("n_limit_down") >= 3) | F.coalesce(F.col("finance_ann_lag_days") > 90, F.lit(False))
    )
    joined = g.join(halted, "security_id", "left").join(filed, "security_id", "left")
    return joined.select(
        "security_id",
        F.when(F.col("now_suspended"), "blocked").when(care, "caution").otherwise("ok").alias("status"),
        (~F.col("now_suspended")).alias("tradeable"),
        "n_limit_up", "n_limit_down", "n_suspended", F.col("any_st").alias("is_st"),
        "last_suspend_date", "finance_ann_date", "finance_ann_lag_days",
        # At most `lookback` events per security.
        F.sort_array("__events", asc=False).alias("events"),
    )


def cards(master: DataFrame, bars: DataFrame, factors: DataFrame, members: DataFrame, industry: DataFrame,
          statements: DataFrame, suspensions: DataFrame, day: dt.date, *, benchmark: str, window: int = 20,
          universe: str = "ALL", level: str = "sw_l1", lookback: int = 20) -> DataFrame:
    """One card per security of the master, as one wide join."""
    names = list(rules.SEED_FACTORS)
    # One day's values, read by several cross-sections below.
    today = durable(factors.where((F.col("trade_date") == F.lit(day)) & F.col("factor_name").isin(*names)))
    # Three wide tables are made of the profile, so it is stored too.
    profile = durable(factor_profile(today, industry, level))
    if universe in ("ALL", "*", "all", ""):
        shares = wide(profile, "pct_market", names, "_pct")
    else:
        ranked = index_percentiles(today, members, universe)
        shares = wide(ranked, "pct", names, "_pct")
    raw = wide(profile, "value", names)
    peers = wide(profile, "pct_industry", names, "_in_industry")
    strength = relative_strength(bars, members, benchmark, day, window)
    trade = tradability(bars, suspensions, statements, day, lookback).withColumnRenamed("is_st", "recent_st")
    place = asof.valid_on(industry.where(F.col("level") == level), day).groupBy("security_id").agg(
        F.min_by("industry", F.struct("in_date", "industry")).alias("industry")
    )
    now = bars.where(F.col("trade_date") == F.lit(day)).select(
        "security_id", mk.flag(F.col("is_suspended")).alias("is_suspended"), mk.flag(F.col("is_st")).alias("is_st"),
        mk.touches(F.col("close"), F.col("up_limit")).alias("at_up"),
        mk.touches(F.col("close"), F.col("down_limit")).alias("at_down"),
    )
    stale = statements.agg(F.date_diff(F.lit(day), F.max("ann_date")) > 30).scalar()
    out = master.select("security_id", "exchange_code", "name")
    for part in (raw, shares, peers, strength, trade, place, now):
        out = out.join(part, "security_id", "left")
    out = out.withColumns(scores({f: F.col(f"{f}_pct") for f in names}))
    out = out.withColumn("status", F.coalesce("status", F.lit("blocked")))
    cols = {c: F.col(c) for c in (
        "is_suspended", "is_st", "at_up", "at_down", "momentum", "volatility", "valuation", "turnover", "status",
        "mom_20_in_industry", "ep_in_industry", "bp_in_industry", *names,
    )} | {"strength": F.col("relative_strength"), "finance_stale": stale}
    return out.select(
        "exchange_code", "security_id", "name", F.lit(day).alias("asof"),
        *rules.DIMENSIONS, "composite",
        sc.stance(F.col("composite"), F.col("relative_strength"), F.col("status")).alias("stance"),
        "relative_strength", "stock_return", "bench_return", sc.card_tags(cols).alias("tags"), "industry",
        F.col("status").alias("tradability"), "n_limit_up", "n_limit_down", "n_suspended",
        "finance_ann_date", "finance_ann_lag_days", *names,
    )


def cards_of_signal(card_rows: DataFrame, weights: DataFrame, top_n: int) -> DataFrame:
    """Cards of the n largest weights of a signal."""
    head = weights.orderBy(F.desc("weight"), "exchange_code").limit(top_n).select("exchange_code", "weight")
    return card_rows.join(head, "exchange_code")


def last_rows(df: DataFrame, key: str, n: int, *, day: str = "trade_date") -> DataFrame:
    """Latest n rows per key."""
    return ranking.top_n(df, [key], [F.desc(day)], n)


def latest_row(df: DataFrame, key: str, *, day: str = "trade_date", upto: dt.date | None = None) -> DataFrame:
    """Latest row per key (on or before a date) as a partial aggregate."""
    rows = df if upto is None else df.where(F.col(day) <= F.lit(upto))
    rest = [c for c in df.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), day).alias("r")).select(key, "r.*")


