"""Published versions: publication rows, continuity, incremental ranges, reuse of landed data."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from barloom import rules
from barloom.functions import values as v

DATE_COLUMN = {"daily_bar": "trade_date", "daily_basic": "trade_date", "fin_statement": "ann_date"}


def publication_rows(tables: dict[str, DataFrame], days: DataFrame, *, note: str = "") -> DataFrame:
    """One version row per dataset and day with its row count (0 when the day is empty)."""
    out = None
    for name, df in tables.items():
        counts = df.groupBy(F.col(DATE_COLUMN[name]).alias("trade_date")).agg(F.count("*").alias("row_count"))
        part = days.select("trade_date").join(counts, "trade_date", "left").select(
            F.lit(name).alias("dataset"), F.date_format("trade_date", "yyyy-MM-dd").alias("version"),
            F.coalesce("row_count", F.lit(0)).cast("bigint").alias("row_count"),
            F.current_timestamp().alias("published"), F.lit(note).alias("note"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def replace_versions(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Publishing a version again replaces its row."""
    return existing.join(incoming.select("dataset", "version"), ["dataset", "version"], "left_anti").unionByName(incoming)


def version_counts(versions: DataFrame, dataset: str = "daily_bar") -> DataFrame:
    """Row count per readable version date; repeated versions count by their largest."""
    rows = versions.where(F.col("dataset") == dataset).withColumn("trade_date", v.version_date(F.col("version")))
    return rows.where("trade_date is not null").groupBy("trade_date").agg(F.max("row_count").alias("row_count"))


def latest_version(versions: DataFrame, dataset: str = "daily_bar") -> DataFrame:
    return versions.where(F.col("dataset") == dataset).agg(F.max("version").alias("version"))


def recent(versions: DataFrame, dataset: str = "daily_bar", limit: int = 20) -> DataFrame:
    return versions.where(F.col("dataset") == dataset).orderBy(F.desc("version")).limit(limit)


def published_days(versions: DataFrame, dataset: str = "daily_bar", *, min_rows: int = 1) -> DataFrame:
    return version_counts(versions, dataset).where(F.col("row_count") >= min_rows).select("trade_date")


def unpublished(days: DataFrame, versions: DataFrame, dataset: str = "daily_bar", *, min_rows: int = 1) -> DataFrame:
    """Days still to build when published ones are skipped."""
    return days.join(published_days(versions, dataset, min_rows=min_rows), "trade_date", "left_anti")


def continuity(expected: DataFrame, versions: DataFrame, dataset: str = "daily_bar", *, min_rows: int = 1) -> DataFrame:
    """Expected days with their state: published, thin or missing."""
    counts = version_counts(versions, dataset)
    state = (
        F.when(F.col("row_count").isNull(), "missing").when(F.col("row_count") < min_rows, "thin").otherwise("published")
    )
    return expected.select("trade_date").join(counts, "trade_date", "left").withColumn("state", state)


def continuity_summary(states: DataFrame) -> DataFrame:
    """Counts per state; ok needs at least one expected day, none missing and none thin."""
    return states.agg(
        F.count("*").alias("expected"), F.count_if(F.col("state") != "missing").alias("published"),
        F.count_if(F.col("state") == "missing").alias("missing"), F.count_if(F.col("state") == "thin").alias("thin"),
    ).withColumn("ok", (F.col("expected") > 0) & (F.col("missing") == 0) & (F.col("thin") == 0))


def segments(states: DataFrame, label: Column) -> DataFrame:
    """Continuity per segment of the range (e.g. quarter)."""
    return states.groupBy(label.alias("segment")).agg(
        F.min("trade_date").alias("start"), F.max("trade_date").alias("end"), F.count("*").alias("expected"),
        F.count_if(F.col("state") != "missing").alias("published"), F.count_if(F.col("state") == "missing").alias("missing"),
        F.count_if(F.col("state") == "thin").alias("thin"),
    ).withColumn("ok", (F.col("missing") == 0) & (F.col("thin") == 0))


def first_gap(segment_rows: DataFrame) -> DataFrame:
    """First segment that is not complete (no row when all are)."""
    return segment_rows.where("not ok").agg(F.min_by("segment", "start").alias("segment")).where("segment is not null")


def quarter_label(day: Column) -> Column:
    return F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string"))


def incremental_range(watermarks: dict[str, tuple[DataFrame, str]], end: Column, *, fallback_days: int = 30) -> DataFrame:
    """start = smallest of the tables' last dates + 1, else end - 30 days; `fresh` is False when nothing is new."""
    out = None
    for name, (df, column) in watermarks.items():
        part = df.agg(F.max(column).alias("last")).select(F.lit(name).alias("table"), "last")
        out = part if out is None else out.unionByName(part)
    first = out.agg(F.min("last").alias("last"))
    start = F.coalesce(F.date_add("last", 1), F.date_sub(end, fallback_days))
    return first.select(start.alias("start"), end.alias("end")).withColumn("fresh", F.col("start") <= F.col("end"))


def reusable(counts: DataFrame, min_rows: int) -> DataFrame:
    """Landed partitions complete enough to skip: counts has source, dataset, dt, n (n null = absent).

    The adjustment factors also need nine tenths of the day's bars of the source
    where those are complete; suspensions only have to be present.
    """
    bars = counts.where(F.col("dataset") == "daily_bar").select("source", "dt", F.col("n").alias("bar_n"))
    n, bar_n = F.col("n"), F.col("bar_n")
    enough = n >= min_rows
    with_bars = bar_n.isNull() | (bar_n < min_rows) | (n >= F.floor(bar_n * 0.9))
    ok = (
        F.when(F.col("dataset").isin(*rules.REUSE_IF_PRESENT), n.isNotNull())
        .when(F.col("dataset") == "adj_factor", enough & with_bars)
        .otherwise(enough)
    )
    return counts.join(bars, ["source", "dt"], "left").withColumn("reusable", F.coalesce(ok, F.lit(False))).drop("bar_n")


def reconcile(landed: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows that one side holds more often than the other, as multisets over the columns both have: `side` and how many times `n`.

    One signed count per distinct row: +1 landed, -1 stored, added up before and after the shuffle. Equal rows, repeated ones
    too, cancel; a row that is there twice on one side and once on the other comes out once. Nulls are equal to each other.
    """
    columns = [c for c in landed.columns if c in stored.columns]
    both = landed.select(*columns, F.lit(1).alias("__n")).unionByName(stored.select(*columns, F.lit(-1).alias("__n")))
    left = both.groupBy(*columns).agg(F.sum("__n").alias("__n")).where("__n <> 0")
    return left.select(*columns, F.when(F.col("__n") > 0, "landed").otherwise("stored").alias("side"), F.abs("__n").alias("n"))


def in_both(landed: DataFrame, stored: DataFrame) -> DataFrame:
    """The rows both sides hold, as often as both do (`n`)."""
    columns = [c for c in landed.columns if c in stored.columns]
    sides = landed.select(*columns, F.lit(1).alias("__l"), F.lit(0).alias("__s")).unionByName(stored.select(*columns, F.lit(0).alias("__l"), F.lit(1).alias("__s")))
    return sides.groupBy(*columns).agg(F.least(F.sum("__l"), F.sum("__s")).alias("n")).where("n > 0")


def alignment(published: DataFrame, present: DataFrame) -> DataFrame:
    """Published days with and without the extra table's rows."""
    have = present.select("trade_date").distinct().withColumn("present", F.lit(True))
    return published.select("trade_date").distinct().join(have, "trade_date", "left").withColumn(
        "present", F.coalesce("present", F.lit(False))
    )


def alignment_summary(aligned: DataFrame) -> DataFrame:
    """Counts, the first and last missing days, and whether every published day is covered."""
    lost = F.when(~F.col("present"), F.col("trade_date"))
    return aligned.agg(
        F.count("*").alias("published_days"), F.count_if("present").alias("covered"),
        F.count_if(~F.col("present")).alias("missing"), F.min(lost).alias("first_missing"), F.max(lost).alias("last_missing"),
    ).withColumn("ok", (F.col("published_days") > 0) & (F.col("missing") == 0))


def calendar_coverage(counts: DataFrame, start: dt.date | Column, end: dt.date | Column) -> DataFrame:
    """Calendar days of a range against landed partitions; a partition with 0 rows is present."""
    a = start if isinstance(start, Column) else F.lit(start)
    b = end if isinstance(end, Column) else F.lit(end)
    spark = counts.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(a, b)).alias("dt"))
    have = counts.where("n is not null").select("dt").distinct().withColumn("present", F.lit(True))
    return days.join(have, "dt", "left").agg(
        F.count("*").alias("expected_days"), F.count_if("present").alias("present_days"),
        F.count_if(F.col("present").isNull()).alias("missing_days"),
    ).withColumn("complete", (F.col("expected_days") > 0) & (F.col("missing_days") == 0))
