"""Factor coverage, distribution and forward-return buckets, all days at once."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barloom import rules
from barloom.functions import values as v
from barloom.operators import asof, ranking, scd2
from barloom.operators.calendar import link
from barloom.operators.prices import by_security

POINTS = {"p1": 0.01, "p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def _valid() -> Column:
    return v.is_finite(F.col("value"))


def watermarks(factors: DataFrame) -> DataFrame:
    """Range, rows, days and securities per factor."""
    return factors.groupBy("factor_name").agg(
        F.min("trade_date").alias("min_date"), F.max("trade_date").alias("max_date"), F.count("*").alias("rows"),
        F.countDistinct("trade_date").alias("days"), F.countDistinct("security_id").alias("securities"),
    )


def dates(factors: DataFrame, factor: str | None = None, limit: int = 60) -> DataFrame:
    """Latest dates that have factor values, newest first."""
    rows = factors if factor is None else factors.where(F.col("factor_name") == factor)
    return rows.select("trade_date").distinct().orderBy(F.desc("trade_date")).limit(limit)


def coverage(factors: DataFrame, bars: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Per day and factor: rows, securities, tradable universe and their ratio; absent factors count 0."""
    names = names or list(rules.SEED_FACTORS)
    got = factors.where(F.col("factor_name").isin(*names)).groupBy("trade_date", "factor_name").agg(
        F.count("*").alias("n_rows"), F.countDistinct("security_id").alias("n_securities")
    )
    universe = bars.groupBy("trade_date").agg(F.count_if(F.col("is_suspended") == 0).alias("universe_size"))
    grid = universe.select("*", F.explode(F.array(*[F.lit(n) for n in names])).alias("factor_name"))
    ratio = F.try_divide("n_securities", F.col("universe_size"))
    return grid.join(got, ["trade_date", "factor_name"], "left").fillna(0, ["n_rows", "n_securities"]).withColumn(
        "coverage", F.coalesce(ratio, F.lit(0.0))
    )


def distribution(factors: DataFrame, bars: DataFrame) -> DataFrame:
    """Per day and factor: valid values, mean, sample deviation, quantiles and coverage."""
    by = ["trade_date", "factor_name"]
    rows = factors.where(_valid()).select(*by, "security_id", "value")
    moments = [F.count("*").alias("n_valid"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")]
    out = ranking.quantiles(rows, by, "value", ["security_id"], POINTS, extra=moments)
    universe = bars.groupBy("trade_date").agg(F.count("*").alias("universe"))
    return out.join(universe, "trade_date", "left").withColumn(
        "coverage", F.coalesce(F.try_divide("n_valid", "universe"), F.lit(0.0))
    )


def coverage_series(factors: DataFrame, bars: DataFrame, factor: str, limit_days: int = 30) -> DataFrame:
    """Coverage of one factor over its latest days."""
    per_day = factors.where(F.col("factor_name") == factor).groupBy("trade_date").agg(
        F.count("*").alias("n_factor"), F.count_if(_valid()).alias("n_valid")
    ).orderBy(F.desc("trade_date")).limit(limit_days)
    universe = bars.groupBy("trade_date").agg(F.count("*").alias("universe"))
    return per_day.join(universe, "trade_date", "left").fillna(0, ["universe"]).withColumn(
        "coverage", F.coalesce(F.try_divide("n_valid", "universe"), F.lit(0.0))
    )


def matrix(factors: DataFrame, bars: DataFrame, day: dt.date | None = None) -> DataFrame:
    """All factors of a day (default: the latest one): coverage, median, mean."""
    d = F.lit(day).cast("date") if day else factors.agg(F.max("trade_date")).scalar()
    rows = factors.where(F.col("trade_date") == d)
    out = distribution(rows, bars.where(F.col("trade_date") == d))
    return out.select("trade_date", "factor_name", "n_valid", "universe", "coverage", "p50", "mean")


def histogram(factors: DataFrame, by: list[str], bins: int = 30) -> DataFrame:
    """Equal-width bins between the group's minimum and maximum; the top edge belongs to the last bin."""
    rows = factors.where(_valid())
    edges = rows.groupBy(*by).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    slot = F.floor(F.coalesce(F.try_divide(F.col("value") - F.col("lo"), F.nullif(width, F.lit(0.0))), F.lit(0.0)))
    # The group's edges are a per-group constant, so bins are counted before anything is joined back.
    # They travel to the rows, so no task gets all rows of a factor.
    return ranking.null_safe_join(rows, F.broadcast(edges), by).groupBy(*by, F.least(slot, F.lit(bins - 1)).cast("int").alias("bin")).agg(
        F.count("*").alias("n")
    )


def forward_buckets(factors: DataFrame, bars: DataFrame, calendar: DataFrame, *, min_names: int = 50,
                    buckets: int = 5, adjust: str = "post") -> DataFrame:
    """Mean return to the next open day per factor bucket, one row per day, factor and bucket.

    Days with fewer than `min_names` names are left out. `adjust='none'` uses raw closes.
    """
    price = F.col("close") * (F.col("adj_factor") if adjust == "post" else F.lit(1.0))
    px = bars.select("security_id", "trade_date", price.alias("px"))
    # The security's next row counts only when it lies on the next open day.
    ahead = px.withColumns({"c1": F.lead("px").over(by_security()), "__d": F.lead("trade_date").over(by_security())})
    fwd = link(ahead, calendar, "next_open", "fwd_date").where("__d = fwd_date and px > 0 and c1 > 0").select(
        "security_id", "trade_date", "fwd_date", (F.col("c1") / F.col("px") - 1).alias("fwd_ret")
    )
    by = ["trade_date", "factor_name"]
    valid = factors.where(_valid()).select(*by, "security_id", "value")
    rows = valid.join(fwd, ["security_id", "trade_date"])
    ranked = ranking.order_rank(rows, by, ["value", "security_id"], total="n", sampled=valid)
    cut = ranked.where(F.col("n") >= min_names).withColumn("quintile", ranking.quantile_bucket(buckets))
    return cut.groupBy(*by, "fwd_date", "quintile").agg(
        F.avg("fwd_ret").alias("mean_fwd_ret"), F.count("*").alias("names"), F.max("n").alias("n_names")
    )


def cube(factors: DataFrame, bars: DataFrame, master: DataFrame, industry: DataFrame, level: str = "sw_l1") -> DataFrame:
    """Valid values and securities with one, over factor, industry and board at once: `grouping` is grouping_id (4 factor, 2 industry, 1 board).

    Sets: all three, factor with either, each factor, each industry, and everything. Values are first counted per security, so one
    scan feeds a single Expand over counts, and securities are counted exactly in every set.
    """
    placed = asof.attach_interval(bars.select("security_id", "trade_date"), industry.where(F.col("level") == level), ["security_id"], ["industry"])
    listed = placed.join(scd2.current_listing(master, "board"), "security_id")
    rows = factors.where(_valid()).select("security_id", "trade_date", "factor_name").join(listed, ["security_id", "trade_date"])
    counts = rows.groupBy("factor_name", "industry", "board", "security_id").agg(F.count("*").alias("k"))
    f, i, b = (F.col(c) for c in ("factor_name", "industry", "board"))
    sets = [[f, i, b], [f, i], [f, b], [f], [i], []]
    return counts.groupingSets(sets, f, i, b).agg(
        F.grouping_id().alias("grouping"), F.sum("k").alias("n_values"), F.countDistinct("security_id").alias("n_securities"))


def spreads(bucket_returns: DataFrame, buckets: int = 5) -> DataFrame:
    """Top minus bottom bucket per day and factor."""
    top = F.max(F.when(F.col("quintile") == buckets, F.col("mean_fwd_ret")))
    low = F.max(F.when(F.col("quintile") == 1, F.col("mean_fwd_ret")))
    return bucket_returns.groupBy("trade_date", "factor_name").agg(
        F.max("n_names").alias("n_names"),
        (F.coalesce(top, F.lit(0.0)) - F.coalesce(low, F.lit(0.0))).alias("spread_q5_q1"),
    )


def alerts(covered: DataFrame, min_coverage: float = 0.9) -> DataFrame:
    """warn below the threshold, error where a factor has no values; one row per alert."""
    found = F.array_compact(F.array(
        F.when(F.col("coverage") < min_coverage, F.struct(F.lit("warn").alias("level"), F.col("coverage").alias("at"))),
        F.when(F.col("n_securities") == 0, F.struct(F.lit("error").alias("level"), F.lit(0.0).alias("at"))),
    ))
    return covered.select("trade_date", "factor_name", F.explode(found).alias("a")).select(
        "trade_date", "factor_name", F.col("a.level").alias("level"), F.col("a.at").alias("coverage")
    )


def report(covered: DataFrame, min_coverage: float = 0.9) -> DataFrame:
    """One row per day: universe, number of alerts and whether the coverage gate passes."""
    low = F.count_if(F.col("coverage") < min_coverage) + F.count_if(F.col("n_securities") == 0)
    return covered.groupBy("trade_date").agg(
        F.max("universe_size").alias("universe_size"), low.alias("n_alerts")
    ).withColumn("passed", F.col("n_alerts") == 0)


def missing_days(factors: DataFrame, published: DataFrame, names: list[str]) -> DataFrame:
    """Published days without values, per factor."""
    want = published.select("trade_date").distinct().select(
        "trade_date", F.explode(F.array(*[F.lit(n) for n in names])).alias("factor_name")
    )
    have = factors.select("trade_date", "factor_name").distinct()
    return want.join(have, ["trade_date", "factor_name"], "left_anti")


def alignment(factors: DataFrame, published: DataFrame, names: list[str]) -> DataFrame:
    """Per factor: published days covered and missing, and what is stored at all."""
    days = published.select("trade_date").distinct().withColumn("pub", F.lit(True))
    stored = factors.where(F.col("factor_name").isin(*names)).groupBy("factor_name", "trade_date").agg(
        F.count("*").alias("n")
    )
    joined = stored.join(F.broadcast(days), "trade_date", "left")
    per = joined.groupBy("factor_name").agg(
        F.count_if("pub").alias("published_overlap"), F.count("*").alias("stored_days"), F.sum("n").alias("rows"),
        F.min("trade_date").alias("min_date"), F.max("trade_date").alias("max_date"),
    )
    total = days.agg(F.count("*")).scalar()
    spark: SparkSession = factors.sparkSession
    wanted = spark.createDataFrame([(n,) for n in names], "factor_name string")
    return wanted.join(per, "factor_name", "left").fillna(0, ["published_overlap", "stored_days", "rows"]).withColumn(
        "missing_on_published", total - F.col("published_overlap")
    )


