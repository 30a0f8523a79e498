"""Snapshots -> half-open validity intervals [in_date, out_date)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from barloom import rules
from barloom.schemas import require



def _open_end():
    return F.lit(rules.OPEN_END)


def snapshots_from_weights(weights: DataFrame, index_code: str, *, code: str = "con_code") -> DataFrame:
    """Monthly weight panel -> membership snapshots."""
    column = "exchange_code" if "exchange_code" in weights.columns else code
    require(weights, {column, "trade_date"}, "weight panel")
    return weights.select(
        F.lit(index_code).alias("index_code"),
        F.col(column).cast("string").alias("exchange_code"),
        F.to_date("trade_date").alias("as_of_date"),
        F.lit("tushare_weight").alias("confidence"),
    ).dropna(subset=["as_of_date", "exchange_code"]).distinct()


def member_intervals(snaps: DataFrame, *, hint_every_entry: bool = False) -> DataFrame:
    """Membership snapshots -> intervals.

    Absence from the next snapshot of the index closes an interval, coming back
    opens a new one, members of the last snapshot stay open. An `in_date` column is
    an entry-date hint: its earliest value per member replaces the start when it is not
    later. By default only the first interval uses it; `hint_every_entry` applies
    it to re-entries too (which then merge with the earlier stay).
    """
    require(snaps, {"index_code", "exchange_code", "as_of_date"}, "membership snapshots")
    key = ["index_code", "exchange_code"]
    hint = F.min("in_date") if "in_date" in snaps.columns else F.min(F.lit(None).cast("date"))
    rows = snaps.dropna(subset=key + ["as_of_date"])
    hints = rows.groupBy(*key).agg(hint.alias("hint"))
    # Snapshot dates per index: as many rows as an index has snapshots.
    by_index = Window.partitionBy("index_code").orderBy("as_of_date")
    dates = rows.select("index_code", "as_of_date").distinct().select(
        "index_code", "as_of_date",
        F.row_number().over(by_index).alias("ord"),
        F.lead("as_of_date").over(by_index).alias("next_snap"),
    )
    by_member = Window.partitionBy(*key).orderBy("as_of_date")
    islands = (
        rows.select(*key, "as_of_date").distinct().join(dates, ["index_code", "as_of_date"])
        .withColumn("island", F.col("ord") - F.row_number().over(by_member))
        .groupBy(*key, "island")
        .agg(F.min("as_of_date").alias("start"), F.max_by("next_snap", "as_of_date").alias("next_snap"))
    )
    first = F.row_number().over(Window.partitionBy(*key).orderBy("start")) == 1
    use_hint = (F.col("hint") <= F.col("start")) & (F.lit(hint_every_entry) | F.col("first"))
    spans = islands.withColumn("first", first).join(hints, key).select(
        *key,
        F.when(use_hint, F.col("hint")).otherwise(F.col("start")).alias("in_date"),
        F.coalesce("next_snap", _open_end()).alias("out_date"),
    )
    return merge_intervals(spans, key)


def attribute_intervals(snaps: DataFrame) -> DataFrame:
    """Attribute snapshots (industry) -> intervals.

    A change of value closes an interval; a missing snapshot does not. Several
    values on one date: the last one by `load_order` (or by value) wins.
    """
    require(snaps, {"exchange_code", "level", "industry", "as_of_date"}, "attribute snapshots")
    key = ["exchange_code", "level"]
    rows = snaps.dropna(subset=key + ["industry", "as_of_date"])
    last = F.col("load_order") if "load_order" in rows.columns else F.col("industry")
    hint = F.min("in_date") if "in_date" in rows.columns else F.min(F.lit(None).cast("date"))
    daily = rows.groupBy(*key, "as_of_date").agg(F.max_by("industry", last).alias("industry"), hint.alias("hint"))
    w = Window.partitionBy(*key).orderBy("as_of_date")
    before = F.lag("industry").over(w)
    changes = daily.select(
        *key, "as_of_date", "industry",
        F.min("hint").over(Window.partitionBy(*key)).alias("hint"),
        before.isNull().alias("first"),
        (before.isNull() | (before != F.col("industry"))).alias("changed"),
    ).where("changed")
    spans = changes.select(
        *key, "industry",
        F.when(F.col("first") & (F.col("hint") <= F.col("as_of_date")), F.col("hint"))
        .otherwise(F.col("as_of_date")).alias("in_date"),
        F.coalesce(F.lead("as_of_date").over(w), _open_end()).alias("out_date"),
    )
    return merge_intervals(spans, key + ["industry"])


def merge_intervals(spans: DataFrame, key: list[str]) -> DataFrame:
    """Join overlapping or touching intervals of one key."""
    w = Window.partitionBy(*key).orderBy("in_date", "out_date")
    reach = F.max("out_date").over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = spans.withColumn("fresh", (reach.isNull() | (F.col("in_date") > reach)).cast("int"))
    grouped = starts.withColumn("grp", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*key, "grp").agg(
        F.min("in_date").alias("in_date"), F.max("out_date").alias("out_date")
    ).drop("grp")


def spans_of_days(rows: DataFrame, key: list[str], day: str) -> DataFrame:
    """Dated rows -> [in_date, out_date) over runs of consecutive calendar days."""
    days = rows.where(F.col(day).isNotNull()).select(*key, F.col(day).cast("date").alias("in_date")).distinct()
    return merge_intervals(days.withColumn("out_date", F.date_add("in_date", 1)), key)


def current_listing(master: DataFrame, *columns: str) -> DataFrame:
    """One row per security with the columns of its newest master row, whatever history the master holds."""
    if "valid_from" not in master.columns:
        return master.select("security_id", *columns).dropDuplicates(["security_id"])
    newest = master.groupBy("security_id").agg(F.max_by(F.struct(*columns), "valid_from").alias("r"))
    return newest.select("security_id", *[F.col("r")[c].alias(c) for c in columns])
