"""Adjusted prices, returns and the execution view of a bar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions import market as mk, values as v
from barloom.operators import asof
from barloom.operators.calendar import link

PRICES = ("open", "high", "low", "close")
ADJUST = ("none", "pre", "post")


def by_security(*extra: str) -> Window:
    """The library's one time-series window: a security's own rows by date."""
    return Window.partitionBy("security_id", *extra).orderBy("trade_date")


def factor_in_range(adjust: str) -> Column:
    """Multiplier that brings a raw price to the asked adjustment.

    `pre` divides by the last factor inside the requested range, not by the
    latest one known.
    """
    if adjust not in ADJUST:
        raise ValueError(f"adjust must be one of {ADJUST}")
    if adjust == "none":
        return F.lit(1.0)
    if adjust == "post":
        return F.col("adj_factor")
    whole = by_security().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.try_divide("adj_factor", F.nullif(F.last("adj_factor").over(whole), F.lit(0.0)))


def adjusted(bars: DataFrame, adjust: str = "post", columns: tuple[str, ...] = PRICES) -> DataFrame:
    """Replace price columns by their adjusted values."""
    factor = factor_in_range(adjust)
    if adjust == "none":
        return bars
    work = bars.withColumn("__f", factor)
    return work.withColumns({c: F.col(c) * F.col("__f") for c in columns if c in bars.columns}).drop("__f")


def post_close() -> Column:
    """Adjusted close for factors; a zero adjustment factor gives null."""
    return v.finite_or_null(F.col("close") * F.nullif(F.col("adj_factor"), F.lit(0.0)))


def daily_returns(bars: DataFrame, *, name: str = "ret", price: Column | None = None) -> DataFrame:
    """Return over the security's previous row."""
    px = post_close() if price is None else price
    return bars.withColumn("__px", px).withColumn(
        name, F.try_divide(F.col("__px"), F.lag("__px").over(by_security())) - 1
    ).drop("__px")


def execution_frame(bars: DataFrame, suspensions: DataFrame, adjust: str = "post") -> DataFrame:
    """What an order meets: adjusted open, raw close and limits, either kind of suspension, volume.

    Here a factor that is missing, not finite or not positive counts as 1.
    """
    usable = v.is_finite(F.col("adj_factor")) & (F.col("adj_factor") > 0)
    if adjust not in ADJUST:
        raise ValueError(f"adjust must be one of {ADJUST}")
    whole = by_security().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.last("adj_factor").over(whole)
    factor = {
        "none": F.lit(1.0),
        "post": F.when(usable, F.col("adj_factor")).otherwise(1.0),
        "pre": F.when(usable & (last > 0), F.col("adj_factor") / last).otherwise(1.0),
    }[adjust]
    # A security's suspended days are a short list; joined by the security alone they leave bars that lie in buckets where they are.
    halted = suspensions.groupBy("security_id").agg(F.collect_set("suspend_date").alias("__halts"))
    return bars.withColumn("__f", factor).join(halted, "security_id", "left").select(
        *[c for c in ("security_id", "exchange_code", "trade_date") if c in bars.columns],
        (F.col("open") * F.col("__f")).alias("open"),
        "close", "up_limit", "down_limit",
        ((mk.flag(F.col("is_suspended")) == 1) | F.coalesce(F.array_contains("__halts", F.col("trade_date")), F.lit(False))).alias("suspended"),
        F.col("volume").cast("double").alias("volume"),
        v.finite_or_null(F.col("close") * F.col("__f")).alias("mark"),
    )


def _member_means(rets: DataFrame, members: DataFrame) -> DataFrame:
    """Mean return per index and day over the members of the day.

    A return is met once per index its security was ever in, however often it came and went; a sweep then keeps the days inside.
    """
    key = ["index_code", "security_id"]
    ever = members.select(*key).distinct()
    hit = asof.inside_interval(rets.join(ever, "security_id"), members.select(*key, "in_date", "out_date"), key)
    return hit.groupBy("index_code", "trade_date").agg(F.avg("ret").alias("ret"), F.count("*").alias("members"))


def member_equal_returns(bars: DataFrame, members: DataFrame, calendar: DataFrame) -> DataFrame:
    """Equal-weight return per index and day over the members valid that day.

    A member's return is taken against the previous open day; members without a
    bar on either day are left out of the mean.
    """
    px = bars.select("security_id", "trade_date", post_close().alias("px"))
    w = by_security()
    rets = link(
        px.withColumns({"__p": F.lag("px").over(w), "__pd": F.lag("trade_date").over(w)}), calendar, "prev_open", "__open"
    ).where(F.col("__pd") == F.col("__open")).select(
        "security_id", "trade_date", (F.try_divide("px", "__p") - 1).alias("ret")
    ).where("ret is not null")
    return _member_means(rets, members)


def member_equal_returns_filled(bars: DataFrame, members: DataFrame) -> DataFrame:
    """The same over rows of the security's own history: the last known price stands in for gaps."""
    rets = daily_returns(bars.select("security_id", "trade_date", "close", "adj_factor")).where("ret is not null")
    return _member_means(rets, members)


def benchmark_returns(own: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Benchmark series: its own price where it has any, else the equal-weight members.

    Both inputs are (index_code, trade_date, ret); the choice is per benchmark.
    """
    priced = own.where("ret is not null")
    has_own = priced.select("index_code").distinct()
    rest = synthetic.select("index_code", "trade_date", "ret").join(has_own, "index_code", "left_anti")
    return priced.select("index_code", "trade_date", "ret", F.lit("security_price").alias("mode")).unionByName(
        rest.select("index_code", "trade_date", "ret", F.lit("index_members_equal").alias("mode"))
    )


def suspended_either(bars: DataFrame, suspensions: DataFrame) -> DataFrame:
    """0/1 suspension per bar from the bar flag or the suspension table."""
    halted = suspensions.select("security_id", F.col("suspend_date").alias("trade_date"),
                                F.lit(1).alias("__halt")).distinct()
    return bars.join(halted, ["security_id", "trade_date"], "left").withColumn(
        "suspended", F.greatest(mk.flag(F.col("is_suspended")), F.coalesce("__halt", F.lit(0)))
    ).drop("__halt")


def with_resume_date(suspensions: DataFrame, bars: DataFrame) -> DataFrame:
    """Resume date of a suspension = the security's next bar with volume."""
    traded = bars.where("volume > 0").select("security_id", F.col("trade_date").alias("__d"))
    stream = suspensions.select("security_id", F.col("suspend_date").alias("__d"), F.lit(0).alias("k")).unionByName(
        traded.select("security_id", "__d", F.lit(1).alias("k"))
    )
    w = Window.partitionBy("security_id").orderBy("__d", F.col("k").desc()).rowsBetween(1, Window.unboundedFollowing)
    nxt = F.first(F.when(F.col("k") == 1, F.col("__d")), ignorenulls=True).over(w)
    return stream.withColumn("resume_date", nxt).where("k = 0").select(
        "security_id", F.col("__d").alias("suspend_date"), "resume_date"
    )


def industry_of_bars(bars: DataFrame, industry: DataFrame, level: str) -> DataFrame:
    return asof.attach_interval(bars, industry.where(F.col("level") == level), ["security_id"], ["industry"])
