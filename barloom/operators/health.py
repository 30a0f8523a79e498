"""Watermarks, lags, distributions and table-backed alerts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions import scoring as sc, symbols as sy
from barloom.operators import asof

LAG_TABLES = ("daily_basic", "suspend", "fin_statement", "factor_value")


def watermarks(tables: dict[str, tuple[DataFrame, str | None]]) -> DataFrame:
    """Range, rows and days per table; tables without a date column only count rows."""
    out = None
    for name, (df, day) in tables.items():
        d = F.col(day) if day else F.lit(None).cast("date")
        part = df.agg(
            F.min(d).alias("min_date"), F.max(d).alias("max_date"), F.count("*").alias("rows"), F.countDistinct(d).alias("days"),
        ).select(F.lit(name).alias("table"), "*", (F.col("rows") > 0).alias("ok"))
        out = part if out is None else out.unionByName(part)
    return out


def bar_series(bars: DataFrame, limit_days: int = 30) -> DataFrame:
    """Rows per day for the latest days and the drift against the day before in that list."""
    latest = bars.groupBy("trade_date").agg(F.count("*").alias("row_count")).orderBy(F.desc("trade_date")).limit(limit_days)
    prev = F.lag("row_count").over(Window.orderBy("trade_date"))  # limit_days rows
    return latest.withColumn("prev_count", prev).withColumn(
        "drift_pct", F.try_divide(F.col("row_count") - F.col("prev_count"), F.nullif("prev_count", F.lit(0)))
    )


def extras_lag(marks: DataFrame) -> DataFrame:
    """Calendar-day lag of the extra tables behind the bars: ok, lag (<= 3), stale, missing."""
    bar_max = marks.where(F.col("table") == "daily_bar").agg(F.max("max_date")).scalar()
    lag = F.date_diff(bar_max, F.col("max_date"))
    return marks.where(F.col("table").isin(*LAG_TABLES)).select(
        "table", "max_date", lag.alias("lag_days"), sc.lag_bucket(lag, 0, 3).alias("status")
    )


def summary(marks: DataFrame, series: DataFrame, versions: DataFrame) -> DataFrame:
    """One row of headline figures."""
    bar = marks.where(F.col("table") == "daily_bar")
    masters = marks.where(F.col("table") == "security_master").agg(F.max("rows")).scalar()
    published = versions.where(F.col("dataset") == "daily_bar").agg(F.max("version")).scalar()
    drift = series.agg(F.max_by("drift_pct", "trade_date")).scalar()
    stale = extras_lag(marks).agg(F.count_if(F.col("status") == "stale")).scalar()
    return bar.select(
        masters.alias("security_master"), F.col("max_date").alias("daily_bar_max"), F.col("days").alias("daily_bar_days"),
        F.col("rows").alias("daily_bar_rows"), published.alias("latest_published"), drift.alias("last_drift_pct"),
        stale.alias("extras_stale"),
    )


def bar_watermark(bars: DataFrame) -> DataFrame:
    return bars.agg(
        F.min("trade_date").alias("min_date"), F.max("trade_date").alias("max_date"), F.count("*").alias("rows"),
        F.countDistinct("trade_date").alias("days"), F.countDistinct("security_id").alias("n_codes"),
    )


def finance_summary(statements: DataFrame, bars: DataFrame) -> DataFrame:
    """Row counts by kind and rule, date ranges and the lag behind the bars."""
    bar_max = bars.agg(F.max("trade_date")).scalar()
    g = statements.agg(
        F.count("*").alias("rows"), F.countDistinct("security_id").alias("securities"),
        F.countDistinct("ann_date").alias("ann_days"), F.min("ann_date").alias("min_ann"), F.max("ann_date").alias("max_ann"),
        F.min("report_date").alias("min_report"), F.max("report_date").alias("max_report"),
        F.count_if(F.col("ann_date") < F.col("report_date")).alias("bad_ann_lt_report"),
        F.count_if(F.col("stmt_type") == "income").alias("n_income"),
        F.count_if(F.col("stmt_type") == "balance").alias("n_balance"),
        F.count_if(F.col("stmt_type") == "cashflow").alias("n_cashflow"),
    )
    return g.withColumn("daily_bar_max", bar_max).withColumn("lag_days", F.date_diff("daily_bar_max", "max_ann"))


def finance_lag(statements: DataFrame, bars: DataFrame) -> DataFrame:
    """ok within 7 days, lag within 30, else stale (no statements: stale)."""
    s = finance_summary(statements, bars)
    bucket = sc.lag_bucket(F.col("lag_days"), 7, 30)
    return s.select("max_ann", "daily_bar_max", "lag_days",
                    F.when(bucket == "missing", "stale").otherwise(bucket).alias("status"))


def announcement_months(statements: DataFrame, limit_months: int = 24) -> DataFrame:
    return statements.groupBy(F.trunc("ann_date", "month").alias("month")).agg(
        F.count("*").alias("rows"), F.countDistinct("security_id").alias("securities")
    ).orderBy(F.desc("month")).limit(limit_months)


def item_coverage(statements: DataFrame, bars: DataFrame, day: dt.date | Column, names: tuple[str, ...]) -> DataFrame:
    """Share of the day's securities with a visible value, per item, in one pass."""
    d = day if isinstance(day, Column) else F.lit(day)
    universe = bars.where(F.col("trade_date") == d).select("security_id").distinct()
    size = universe.agg(F.count("*")).scalar()
    wanted = F.array(*[F.lit(n) for n in names])
    hits = statements.where(F.col("ann_date") <= d).join(universe, "security_id", "left_semi").select(
        "security_id", F.explode(F.array_intersect(F.map_keys("fields"), wanted)).alias("item")
    ).groupBy("item").agg(F.countDistinct("security_id").alias("n_hit"))
    asked = statements.sparkSession.createDataFrame([(n,) for n in names], "item string")
    return asked.join(hits, "item", "left").fillna(0, ["n_hit"]).withColumn("sample", size).withColumn(
        "coverage", F.coalesce(F.try_divide("n_hit", "sample"), F.lit(0.0))
    )


def universe_sizes(members: DataFrame, bars: DataFrame, days: DataFrame) -> DataFrame:
    """Members per index and day plus the ALL row (securities with a bar)."""
    per = asof.active_counts(members, ["index_code"], days)
    every = bars.join(F.broadcast(days.select("trade_date").distinct()), "trade_date", "left_semi").groupBy("trade_date").agg(
        F.count("*").alias("members")
    )
    return per.unionByName(every.select(F.lit("ALL").alias("index_code"), "trade_date", "members"))


def industry_distribution(industry: DataFrame, days: DataFrame, level: str, *, members: DataFrame | None = None,
                          index_code: str | None = None) -> DataFrame:
    """Head count and share per industry and day, optionally within an index."""
    spans = industry.where(F.col("level") == level)
    if index_code is not None:
        inside = members.where(F.col("index_code") == index_code).select("security_id", "in_date", "out_date")
        spans = asof.intersect(spans, inside, ["security_id"], [])
    counts = asof.active_counts(spans, ["industry"], days)
    total = F.sum("members").over(Window.partitionBy("trade_date"))  # one row per industry and day
    return counts.select("trade_date", "industry", sy.industry_display(F.col("industry")).alias("industry_name"), "members",
                         (F.col("members") / total).alias("weight"))


def industry_coverage(industry: DataFrame, bars: DataFrame, level: str) -> DataFrame:
    """Mapped share of the day's bars, and the number of industries with a mapped bar."""
    placed = asof.attach_interval(bars.select("security_id", "trade_date"), industry.where(F.col("level") == level),
                                  ["security_id"], ["industry"])
    return placed.groupBy("trade_date").agg(
        F.count("*").alias("universe"), F.count("industry").alias("mapped"), F.countDistinct("industry").alias("n_industries")
    ).withColumn("coverage", F.try_divide("mapped", "universe"))


def lag_alerts(lag: DataFrame) -> DataFrame:
    """One alert per stale table, plus one for having any."""
    stale = lag.where("status = 'stale'")
    each = stale.select(
        F.concat(F.lit("health:lag:"), "table").alias("id"), F.lit("warn").alias("level"), F.lit("data_health").alias("source"),
        F.concat(F.lit("max="), F.col("max_date").cast("string"), F.lit(" lag_days="), F.col("lag_days").cast("string")).alias("message"),
    )
    head = stale.agg(F.count("*").alias("n")).where("n > 0").select(
        F.lit("health:extras_stale").alias("id"), F.lit("warn").alias("level"), F.lit("data_health").alias("source"),
        F.concat(F.col("n").cast("string"), F.lit(" tables are stale")).alias("message"),
    )
    return head.unionByName(each)


def monitor_alerts(report: DataFrame) -> DataFrame:
    """Alert of the newest monitored day, if it has any."""
    latest = report.agg(F.max_by(F.struct("trade_date", "n_alerts"), "trade_date").alias("r")).select("r.*").where("n_alerts > 0")
    return latest.select(
        F.concat(F.lit("monitor:"), F.col("trade_date").cast("string")).alias("id"), F.lit("warn").alias("level"),
        F.lit("factor_monitor").alias("source"), F.concat(F.col("n_alerts").cast("string"), F.lit(" coverage alerts")).alias("message"),
    )


def collect_alerts(*parts: DataFrame) -> DataFrame:
    """Union of alert frames, one row per id."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(["id"])


def alert_counts(alerts: DataFrame) -> DataFrame:
    return alerts.agg(
        F.count("*").alias("count"), F.count_if(F.col("level") == "error").alias("n_error"),
        F.count_if(F.col("level") == "warn").alias("n_warn"),
    )


def overview(versions: DataFrame, bars: DataFrame, monitor: DataFrame, sessions: DataFrame, marks: DataFrame) -> DataFrame:
    """One row: newest version, bar watermark, newest monitor report, newest session and its mark."""
    report = monitor.agg(F.max_by(F.struct("trade_date", "n_alerts", "universe_size"), "trade_date")).scalar()
    newest = sessions.agg(F.max_by(F.struct("session_id", "total_asset", "cash"), "created_at").alias("s"))
    last_mark = marks.groupBy("session_id").agg(F.max_by(F.struct("mark_date", "pnl_vs_initial"), "mark_date").alias("m"))
    session = newest.select("s.*").join(last_mark, "session_id", "left").select(
        F.struct("session_id", "total_asset", "cash", F.col("m.mark_date").alias("mark_date"),
                 F.col("m.pnl_vs_initial").alias("pnl_vs_initial")).alias("paper")
    ).scalar()
    version = versions.where(F.col("dataset") == "daily_bar").agg(F.max("version")).scalar()
    return bar_watermark(bars).select(
        version.alias("version"), F.struct("*").alias("daily_bar"), report.alias("factor_monitor"), session.alias("paper")
    )
