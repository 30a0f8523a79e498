"""Landed data -> service tables, for any range of days in one plan."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom import rules
from barloom.functions import market as mk, symbols as sy, values as v
from barloom.operators import asof, ranking, scd2
from barloom.schemas import conform, require, table


def st_names(master: DataFrame) -> DataFrame:
    """Validity intervals during which the name says ST."""
    return master.where(F.contains(F.col("name"), F.lit("ST"))).select(
        "exchange_code", F.col("valid_from").alias("in_date"), F.col("valid_to").alias("out_date"), F.lit(1).alias("is_st")
    )


def known_names(names: DataFrame, version: dt.date | str | Column | None = None) -> DataFrame:
    """Name snapshots as they stood at a version: one row per code and `as_of_date`, the one learnt last.

    `known_on` is the day a snapshot arrived (its own date where the column or the value is missing); a later arrival for the same
    `as_of_date` corrects the earlier one.
    """
    learnt = F.coalesce("known_on", "as_of_date") if "known_on" in names.columns else F.col("as_of_date")
    rows = names.dropna(subset=["exchange_code", "name", "as_of_date"]).withColumn("known_on", learnt)
    if version is not None:
        rows = rows.where(F.col("known_on") <= (version if isinstance(version, Column) else F.lit(version).cast("date")))
    return rows.groupBy("exchange_code", "as_of_date").agg(F.max_by("name", F.struct("known_on", "name")).alias("name"))


def master_history(names: DataFrame, version: dt.date | str | Column | None = None) -> DataFrame:
    """Name snapshots -> validity rows as known at `version` (by default all that is known), so past days keep past names."""
    spans = scd2.attribute_intervals(known_names(names, version).select(
        "exchange_code", F.lit("name").alias("level"), F.col("name").alias("industry"), "as_of_date"
    ))
    return spans.select("exchange_code", F.col("industry").alias("name"), F.col("in_date").alias("valid_from"),
                        F.col("out_date").alias("valid_to"))


def st_known_then(facts: DataFrame, names: DataFrame, *, day: str = "trade_date") -> DataFrame:
    """`is_st` of each row by the name valid on its day as it was known on that day: no look-ahead on either axis."""
    learnt = F.coalesce("known_on", "as_of_date") if "known_on" in names.columns else F.col("as_of_date")
    points = names.dropna(subset=["exchange_code", "name", "as_of_date"]).select(
        "exchange_code", "as_of_date", learnt.alias("known_on"), F.contains("name", F.lit("ST")).cast("int").alias("is_st"))
    return asof.attach_known(facts, points, ["exchange_code"], "is_st", day=day).fillna({"is_st": 0})


def daily_bars(bars: DataFrame, factors: DataFrame, suspensions: DataFrame, master: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bars with factor, flags, limits and ids; returns (rows, rejected codes).

    A missing factor is 1.0; limits use the unadjusted previous close.
    """
    require(bars, {"exchange_code", "trade_date", "pre_close"}, "landed bars")
    adj = factors.groupBy("exchange_code", "trade_date").agg(F.max("adj_factor").alias("adj_factor"))
    halted = suspensions.select("exchange_code", F.col("suspend_date").alias("trade_date"), F.lit(1).alias("is_suspended")).distinct()
    rows = (
        bars.join(adj, ["exchange_code", "trade_date"], "left").join(halted, ["exchange_code", "trade_date"], "left")
        .fillna({"adj_factor": 1.0, "is_suspended": 0})
    )
    flagged = asof.attach_interval(rows, st_names(master), ["exchange_code"], ["is_st"]).fillna({"is_st": 0})
    board = sy.board_of(F.col("exchange_code"))
    limited = flagged.withColumns({
        "up_limit": mk.up_limit(F.col("pre_close"), board, F.col("is_st")),
        "down_limit": mk.down_limit(F.col("pre_close"), board, F.col("is_st")),
    })
    kept, rejected = asof.map_ids(limited, master)
    return conform(kept, table("daily_bar")), rejected.select("exchange_code", "trade_date")


def daily_basics(landed: DataFrame, master: DataFrame) -> DataFrame:
    """Valuation rows; absent columns are null, an unknown code fails the job."""
    return conform(asof.map_ids_strict(landed, master), table("daily_basic"))


def security_master(listing: DataFrame, existing: DataFrame, *, names: DataFrame | None = None,
                    version: dt.date | str | None = None) -> DataFrame:
    """Master rows; known codes keep their id, new codes get the next ids in code order.

    With name snapshots a code has one row per name and stretch of days, as known at `version`; the first stretch reaches back to the
    listing. Without, or for codes without snapshots, it has one row. Numbering is a distributed rank, not a window over all codes.
    """
    known = existing.groupBy("exchange_code").agg(F.min("security_id").alias("security_id"))
    top = F.coalesce(known.agg(F.max("security_id")).scalar(), F.lit(0))
    fresh = listing.select("exchange_code").distinct().join(known, "exchange_code", "left_anti")
    numbered = ranking.order_rank(fresh, [], ["exchange_code"]).select(
        "exchange_code", (top + F.col("rn")).cast("int").alias("security_id")
    )
    listed = F.coalesce("list_date", F.lit(rules.DEFAULT_LIST_DATE)) if "list_date" in listing.columns else F.lit(rules.DEFAULT_LIST_DATE)
    name = F.col("name") if "name" in listing.columns else F.col("symbol")
    gone = F.col("delist_date") if "delist_date" in listing.columns else F.lit(None).cast("date")
    rows = listing.join(known.unionByName(numbered), "exchange_code").select(
        "security_id", "exchange_code", name.alias("name"), listed.alias("list_date"), gone.alias("delist_date"),
        sy.board_of(F.col("exchange_code")).alias("board"), listed.alias("valid_from"), F.lit(rules.OPEN_END).alias("valid_to"),
    )
    if names is None:
        return rows
    spans = master_history(names, version).withColumnsRenamed({"name": "__name", "valid_from": "__from", "valid_to": "__to"})
    spans = spans.withColumn("__first", F.min("__from").over(Window.partitionBy("exchange_code")) == F.col("__from"))
    start = F.when(F.col("__first"), F.least("__from", "valid_from")).otherwise(F.col("__from"))
    return rows.join(spans, "exchange_code", "left").withColumns({
        "name": F.coalesce("__name", "name"), "valid_from": F.coalesce(start, "valid_from"), "valid_to": F.coalesce("__to", "valid_to"),
    }).drop("__name", "__from", "__to", "__first")


def merged_listing(listed: DataFrame, delisted: DataFrame, paused: DataFrame) -> DataFrame:
    """Listings by status, one row per code: listed before delisted before paused."""
    parts = [df.withColumn("status_order", F.lit(i)) for i, df in enumerate((listed, delisted, paused))]
    rows = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    rest = [c for c in rows.columns if c not in ("exchange_code", "status_order")]
    return rows.groupBy("exchange_code").agg(F.min_by(F.struct(*rest), "status_order").alias("r")).select("exchange_code", "r.*")


def listing_for_universe(universe: DataFrame, basics: DataFrame) -> DataFrame:
    """A day's universe with listing data; codes without a record get placeholder names and null dates."""
    facts = basics.select("exchange_code", "name", "list_date", "delist_date")
    return universe.select("exchange_code").distinct().join(facts, "exchange_code", "left").select(
        "exchange_code", sy.number_part(F.col("exchange_code")).alias("symbol"),
        F.coalesce("name", F.col("exchange_code")).alias("name"), "list_date", "delist_date",
    )


def statement_part(landed: DataFrame, dataset: str, master: DataFrame) -> DataFrame:
    """One landed statement dataset -> map rows; an announcement before its report date fails the job."""
    kind, items = rules.STATEMENT_ITEMS[dataset]
    require(landed, {"exchange_code", "ann_date", "report_date"}, dataset)
    early = F.when(
        F.col("ann_date") < F.col("report_date"),
        F.raise_error(F.concat(F.lit("announced before its report date: "), F.col("exchange_code"))).cast("date"),
    ).otherwise(F.col("ann_date"))
    flag = v.to_number(F.col("update_flag")).cast("int") if "update_flag" in landed.columns else F.lit(0)
    present = {name: F.col(c) for c, name in items.items() if c in landed.columns}
    rows = asof.map_ids_strict(landed, master)
    return rows.select(
        "security_id", early.alias("ann_date"), "report_date", F.lit(kind).alias("stmt_type"),
        F.coalesce(flag, F.lit(0)).alias("update_flag"), v.item_map(present).alias("fields"),
    )


def statements(parts: dict[str, DataFrame], master: DataFrame) -> DataFrame:
    """Income, balance and cash-flow rows in one table."""
    out = None
    for dataset, df in parts.items():
        rows = statement_part(df, dataset, master)
        out = rows if out is None else out.unionByName(rows)
    return out


def announced_on_day(landed: DataFrame, items: dict[str, str], *, code: Column, ann: str, report: str) -> DataFrame:
    """Vendor statement rows -> landed columns; kept when announced on the partition's day and not before the report."""
    rows = landed.withColumns({"__ann": v.parse_ymd(F.col(ann)), "__rep": v.parse_ymd(F.col(report))})
    keep = (F.col("__ann") == F.col("dt")) & (F.col("__ann") >= F.col("__rep"))
    return rows.where(keep).select(
        code.alias("exchange_code"), F.col("__ann").alias("ann_date"), F.col("__rep").alias("report_date"),
        F.lit(0).alias("update_flag"),
        *[v.to_number(v.first_alias(rows, [src], any_case=True)).alias(std) for src, std in items.items()],
    )


def suspensions(landed: DataFrame, master: DataFrame) -> DataFrame:
    """Distinct suspensions; the resume date is derived later from the bars."""
    rows = asof.map_ids_strict(landed, master).select("security_id", "suspend_date", F.lit(None).cast("date").alias("resume_date"))
    return rows.dropDuplicates(["security_id", "suspend_date"])


def suspended_from_status(status_rows: DataFrame, *, status: str | None = None, paused: str | None = None) -> DataFrame:
    """Suspension rows from a status column ('0' = halted) or a paused flag (> 0)."""
    hit = (F.col(status).cast("string") == "0") if status else (v.to_number(F.col(paused)) > 0)
    return status_rows.where(hit).select("exchange_code", F.col("trade_date").alias("suspend_date")).dropDuplicates()


def index_members(snaps: DataFrame, master: DataFrame, *, hint_every_entry: bool = False) -> DataFrame:
    kept, _ = asof.map_ids(scd2.member_intervals(snaps, hint_every_entry=hint_every_entry), master)
    return conform(kept, table("index_member"))


def industry_members(snaps: DataFrame, master: DataFrame) -> DataFrame:
    kept, _ = asof.map_ids(scd2.attribute_intervals(snaps), master)
    return conform(kept, table("industry_member"))


def provenance(snaps: DataFrame) -> DataFrame:
    """Rows and snapshot days per provenance label."""
    return snaps.groupBy("confidence").agg(F.count("*").alias("rows"), F.countDistinct("as_of_date").alias("days"))


def constituents(landed: DataFrame, index_code: str, *, number: str, exchange: str | None, entry: str | None,
                 label: str, day: str = "dt") -> DataFrame:
    """Vendor constituent rows -> membership snapshot rows; a missing entry date is the snapshot date."""
    named = F.col(exchange) if exchange else F.lit(None).cast("string")
    first = F.coalesce(v.parse_ymd(F.col(entry)), F.col(day)) if entry else F.col(day)
    return landed.select(
        F.lit(index_code).alias("index_code"), sy.code_on_named_exchange(F.col(number), named).alias("exchange_code"),
        first.alias("in_date"), F.col(day).alias("as_of_date"), F.lit(label).alias("confidence"),
    )


def adj_factors(raw: DataFrame, adjusted: DataFrame) -> DataFrame:
    """Adjustment factors from two landed bar sets of a source; rows without a positive raw close are dropped."""
    a = raw.select("exchange_code", "trade_date", F.col("close").alias("c0"))
    b = adjusted.select("exchange_code", "trade_date", F.col("close").alias("c1"))
    return a.join(b, ["exchange_code", "trade_date"]).where("c0 > 0 and c1 is not null").select(
        "exchange_code", "trade_date", mk.adj_ratio(F.col("c1"), F.col("c0")).alias("adj_factor")
    )


