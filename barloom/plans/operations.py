"""Operational jobs over day ranges: build-check-publish, incremental extras, monitoring, acceptance."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from barloom import rules
from barloom.operators import coverage as cv, publish as pb, quality as q
from barloom.operators.calendar import previous_trading_day


@dataclass(frozen=True)
class Backfill:
    """Result frames of a backfill: rows to store, rule results, days to publish and their version rows."""

    rows: DataFrame
    checks: DataFrame
    published: DataFrame


def backfill(bars: DataFrame, tables: q.Tables, versions: DataFrame, expected: DataFrame, *, skip_published: bool = True,
             min_rows: int = 1, gate: bool = True, note: str = "", **options: dict) -> Backfill:
    """Build the days still unpublished, run the rules on them and publish those a hard rule does not block."""
    todo = pb.unpublished(expected, versions, min_rows=min_rows) if skip_published else expected.select("trade_date")
    days = F.broadcast(todo)  # one row per day
    rows = bars.join(days, "trade_date", "left_semi")
    # The rules look at a day and the open day before it, so they get the bars of those days only.
    near = todo.union(previous_trading_day(tables.calendar, todo).where("prev_day is not null").select("prev_day")).distinct()
    some = replace(
        tables, bars=tables.bars.join(F.broadcast(near), "trade_date", "left_semi"), factors=tables.factors.join(days, "trade_date", "left_semi"),
        statements=tables.statements.join(days, F.col("ann_date") == F.col("trade_date"), "left_semi"),
    )
    checks = q.run_all(some, **options).join(days, "trade_date", "left_semi")
    ready = rows.select("trade_date").distinct()
    if gate:
        ready = ready.join(q.blocked_days(checks).where("blocked"), "trade_date", "left_anti")
    return Backfill(rows, checks, pb.publication_rows({"daily_bar": rows}, ready, note=note))


def extras_sync(tables: dict[str, tuple[DataFrame, str]], landed: dict[str, DataFrame], end: Column) -> tuple[DataFrame, DataFrame]:
    """Incremental sync: the range from the watermarks, and rows of that range per table and day.

    Returns (range row, day counts). The rows themselves are `landed` filtered by `in_range`.
    """
    span = pb.incremental_range(tables, end)
    counts = None
    for name, df in landed.items():
        day = tables[name][1]
        part = in_range(df, span, day).groupBy(F.col(day).alias("trade_date")).agg(F.count("*").alias("rows")).select(
            F.lit(name).alias("table"), "trade_date", "rows"
        )
        counts = part if counts is None else counts.unionByName(part)
    return span, counts


def in_range(df: DataFrame, span: DataFrame, day: str) -> DataFrame:
    """Rows of the one-row range; both bounds are scalar subqueries, so they reach the scan as filters."""
    start, end = span.select("start").scalar(), span.select("end").scalar()
    return df.where((F.col(day) >= start) & (F.col(day) <= end))


def monitor(factors: DataFrame, bars: DataFrame, calendar: DataFrame, *, version: str = rules.FACTOR_VERSION,
            names: list[str] | None = None, min_coverage: float = 0.9, min_names: int = 50,
            adjust: str = "post") -> dict[str, DataFrame]:
    """Coverage, alerts, day report, bucket returns and spreads for every day of the inputs."""
    rows = factors.where(F.col("version") == version)
    covered = cv.coverage(rows, bars, names)
    buckets = cv.forward_buckets(rows, bars, calendar, min_names=min_names, adjust=adjust)
    return {
        "coverage": covered, "alerts": cv.alerts(covered, min_coverage), "report": cv.report(covered, min_coverage),
        "quintiles": buckets, "spreads": cv.spreads(buckets),
    }


def coverage_gate(report: DataFrame) -> DataFrame:
    """Newest monitored day: passes only without alerts."""
    return report.agg(F.max_by(F.struct("trade_date", "n_alerts", "passed"), "trade_date").alias("r")).select("r.*")


def smoke(bars: DataFrame, master: DataFrame, versions: DataFrame, universe: DataFrame, weights: DataFrame, *,
          min_universe: int = 1, require_published: bool = False) -> DataFrame:
    """One row per day and check: bars exist, published, universe large enough, weights sum to 1."""
    listed = master.agg(F.count("*")).scalar()
    counts = bars.groupBy("trade_date").agg(F.count("*").alias("bars"))
    published = pb.version_counts(versions).select("trade_date", F.lit(True).alias("published"))
    sizes = universe.groupBy("trade_date").agg(F.countDistinct("exchange_code").alias("universe"))
    sums = weights.groupBy("trade_date").agg(F.sum("weight").alias("weight_sum"))
    rows = counts.join(published, "trade_date", "left").join(sizes, "trade_date", "left").join(sums, "trade_date", "left")
    size = F.coalesce("universe", F.lit(0))
    # No weights is no failure: a day without factor values has none.
    checks = F.array(
        F.struct(F.lit("master").alias("check"), (listed > 0).alias("passed")),
        F.struct(F.lit("bars").alias("check"), (F.col("bars") > 0).alias("passed")),
        F.struct(F.lit("published").alias("check"), (F.coalesce("published", F.lit(False)) | ~F.lit(require_published)).alias("passed")),
        F.struct(F.lit("universe").alias("check"), (size >= min_universe).alias("passed")),
        F.struct(F.lit("weight_sum").alias("check"), F.coalesce(F.abs(F.col("weight_sum") - 1.0) < 1e-6, F.lit(True)).alias("passed")),
    )
    return rows.select("trade_date", F.explode(checks).alias("c")).select("trade_date", "c.*")


def release(states: DataFrame, smoke_rows: DataFrame) -> DataFrame:
    """Acceptance of a range: continuity plus every smoke check."""
    failed = smoke_rows.agg(F.count_if(~F.col("passed"))).scalar()
    return pb.continuity_summary(states).withColumn("smoke_failed", failed).withColumn(
        "accepted", F.col("ok") & (F.col("smoke_failed") == 0)
    )


def extras_status(published: DataFrame, basic: DataFrame, statements: DataFrame, landed_days: DataFrame, *,
                  min_rows: int = 10_000, min_codes: int = 1_000) -> DataFrame:
    """Overlap of published days with valuation rows, and whether the statements count as complete."""
    overlap = pb.alignment_summary(pb.alignment(published, basic))
    fin = statements.agg(
        F.min("ann_date").alias("min_ann"), F.max("ann_date").alias("max_ann"), F.count("*").alias("finance_rows"),
        F.countDistinct("security_id").alias("finance_codes"),
    )
    done = fin.select(F.struct("*").alias("f")).scalar()
    raw = landed_days.select(F.struct("expected_days", "present_days", "complete").alias("r")).scalar()
    return overlap.withColumns({"f": done, "r": raw}).select(
        "published_days", "covered", "missing", "first_missing", "last_missing", F.col("ok").alias("overlap_ok"), "f.*",
        F.col("r.complete").alias("raw_complete"),
    ).withColumn(
        "finance_ok", F.col("raw_complete") & (F.col("finance_rows") >= min_rows) & (F.col("finance_codes") >= min_codes)
    )


def acceptance(published: DataFrame, matrix: DataFrame, signal: DataFrame, cards: DataFrame, *, min_cards: int = 2) -> DataFrame:
    """Research acceptance in one row: passes when no matrix cell failed and enough cards came out."""
    cells = matrix.agg(
        F.count_if(F.col("status") == "ok").alias("n_ok"), F.count_if(F.col("status") != "ok").alias("n_fail")
    )
    days = published.select("trade_date").distinct().agg(F.count("*")).scalar()
    names = signal.agg(F.count("*")).scalar()
    judged = cards.agg(F.count_if(F.col("composite").isNotNull())).scalar()
    return cells.withColumns({"published_days": days, "signal_names": names, "judgment_ok": judged}).withColumn(
        "passed", (F.col("n_ok") > 0) & (F.col("n_fail") == 0) & (F.col("judgment_ok") >= min_cards)
    )
