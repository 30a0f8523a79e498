"""Factor refresh after late or corrected input: only rows that can have changed are computed again.

What landed is met with what was used before as multisets; each changed (security, day) makes the factor rows dirty from that day to
as many days on as the factor looks back, ranges of a security are merged, and the input of just these ranges, widened backwards by
the look-back, is computed again. Everything is a plan over tables: nothing lists days or securities on the driver. The ranges are
written, as input, fresh rows and the rows to keep are all told by them. Where the factor table lies in buckets of securities, the rows to
keep are not shuffled.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window, functions as F

from barloom import rules
from barloom.operators import asof, factors as fct, publish as pb, scd2
from barloom.session import written


class Inputs(NamedTuple):
    """The tables factors are made of."""

    bars: DataFrame
    basic: DataFrame
    statements: DataFrame


class Refresh(NamedTuple):
    """`ranges` (factor_name, security_id, in_date, out_date), the `fresh` rows inside them, and the whole `table` after it."""

    ranges: DataFrame
    fresh: DataFrame
    table: DataFrame


def changed_days(before: DataFrame, after: DataFrame, columns: list[str], *, day: str = "trade_date") -> DataFrame:
    """Securities and days with a row that is new, gone or other than before in `columns`."""
    return _days_of(_differences(before, after, columns, day=day), columns, day=day)


def _differences(before: DataFrame, after: DataFrame, columns: list[str], *, day: str = "trade_date") -> DataFrame:
    """Rows of one side only with how many there are, those gone as a negative number `n`."""
    keys = ["security_id", day]
    found = pb.reconcile(after.select(*keys, *columns), before.select(*keys, *columns))
    return found.withColumn("n", F.when(F.col("side") == "landed", F.col("n")).otherwise(-F.col("n"))).drop("side")


def _days_of(differences: DataFrame, columns: list[str], *, day: str = "trade_date") -> DataFrame:
    """Securities and days with differences in some of their columns: those in the others cancel."""
    keys = ["security_id", day]
    rows = differences.where(f"{day} is not null")
    if set(columns) != set(differences.columns) - {*keys, "n"}:
        rows = rows.groupBy(*keys, *columns).agg(F.sum("n").alias("n")).where("n <> 0")
    return rows.select(*keys).distinct()


def dirty_ranges(days: DataFrame, reach: int, *, day: str = "trade_date") -> DataFrame:
    """[in_date, out_date) per security: from each changed day to `reach` days after it, merged."""
    spans = days.select("security_id", F.col(day).alias("in_date"), F.date_add(day, reach + 1).alias("out_date"))
    return scd2.merge_intervals(spans, ["security_id"])


def statement_ranges(before: DataFrame, after: DataFrame) -> DataFrame:
    """From the first changed announcement of a security on: a statement is seen until a later one hides it, so there is no end."""
    shown = lambda df: df.withColumn("__fields", F.to_json(F.array_sort(F.map_entries("fields"))))
    columns = ["report_date", "update_flag", "stmt_type", "__fields"]
    first = changed_days(shown(before), shown(after), columns, day="ann_date").groupBy("security_id").agg(F.min("ann_date").alias("in_date"))
    return first.withColumn("out_date", F.lit(rules.OPEN_END))


def _input_of(rows: DataFrame, ranges: DataFrame, reach: int) -> DataFrame:
    """Rows of the ranges and of the look-back before them, told apart by `__dirty`."""
    before = F.lag("out_date").over(Window.partitionBy("security_id").orderBy("in_date"))
    lead = ranges.select("security_id", F.greatest(F.date_sub("in_date", reach), before).alias("__from"), F.col("in_date").alias("out_date"))
    lead = lead.withColumnRenamed("__from", "in_date").where("in_date < out_date").withColumn("__dirty", F.lit(False))
    spans = ranges.withColumn("__dirty", F.lit(True)).unionByName(lead)
    return asof.attach_interval(rows, spans, ["security_id"], ["__dirty"]).where("__dirty is not null")


def _kept(stored: DataFrame, ranges: list[tuple[list[str], DataFrame]], version: str) -> DataFrame:
    """Rows of the table outside the ranges of their factor. Only the security is a key of the join, by which the table may be bucketed."""
    spans = None
    for names, dirty in ranges:
        part = dirty.select("security_id", "in_date", "out_date", F.array(*[F.lit(n) for n in names]).alias("__names"))
        spans = part if spans is None else spans.unionByName(part)
    inside = (F.col("trade_date") >= F.col("in_date")) & (F.col("trade_date") < F.col("out_date"))
    hit = F.expr("array_contains(__names, factor_name)") & (F.col("version") == version) & inside
    spans = spans.withColumnRenamed("security_id", "__id")
    known = stored.where("security_id is not null").join(spans.hint("shuffle_hash"), (F.col("security_id") == F.col("__id")) & hit, "left_anti")
    # Rows without a security are few, and so are their ranges: null is a security like others here.
    rest = stored.where("security_id is null").join(spans.where("__id is null"), F.col("security_id").eqNullSafe(F.col("__id")) & hit, "left_anti")
    return known.unionByName(rest)


def refresh(stored: DataFrame, before: Inputs, after: Inputs, *, names: list[str] | None = None, bound: int | None = None,
            version: str = rules.FACTOR_VERSION) -> Refresh:
    """`stored`, the factor table made from `before`, brought to what a full computation from `after` gives.

    `names` and `bound` must be those the table was made with. Rows of other factors or versions stay as they are.
    """
    names = names or list(rules.SEED_FACTORS)
    kind_of = lambda n: {"turnover": "turnover", "value": "value"}.get(rules.SEED_FACTORS[n][1], "price")
    families = {k: [n for n in names if kind_of(n) == k] for k in ("price", "turnover", "value")}
    valued = [c for c, kind in (("turnover_rate", "turnover"), ("total_mv", "value")) if families[kind]]
    ratios = written(_differences(before.basic, after.basic, valued), "changed-ratios") if valued else None
    found, ranges, fresh = [], None, None
    for kind, own in families.items():
        if not own:
            continue
        reach = 0 if kind == "value" else bound or fct.lookback_days(max(rules.SEED_FACTORS[n][0] for n in own))
        if kind == "price":
            dirty = written(dirty_ranges(changed_days(before.bars, after.bars, ["close", "adj_factor"]), reach), "dirty")
            wide = fct.price_factors(_input_of(after.bars, dirty, reach), own, bound=bound, keep=("__dirty",)).where("__dirty")
        elif kind == "turnover":
            dirty = written(dirty_ranges(_days_of(ratios, ["turnover_rate"]), reach), "dirty")
            wide = fct.turnover_factors(_input_of(after.basic, dirty, reach), own, bound=bound, keep=("__dirty",)).where("__dirty")
        else:
            dirty = dirty_ranges(_days_of(ratios, ["total_mv"]), 0)
            told = statement_ranges(before.statements, after.statements)
            dirty = written(scd2.merge_intervals(dirty.unionByName(told), ["security_id"]), "dirty")
            wide = fct.value_factors(asof.inside_interval(after.basic, dirty, ["security_id"]), after.statements, own)
        long = wide.unpivot(["trade_date", "security_id"], own, "factor_name", "value").where("value is not null")
        rows = long.select("trade_date", "security_id", "factor_name", F.lit(version).alias("version"), "value")
        part = dirty.select(F.explode(F.array(*[F.lit(n) for n in own])).alias("factor_name"), "security_id", "in_date", "out_date")
        found.append((own, dirty))
        ranges, fresh = (part, rows) if ranges is None else (ranges.unionByName(part), fresh.unionByName(rows))
    kept = _kept(stored, found, version).select(*stored.columns)
    return Refresh(ranges, fresh, kept.unionByName(fresh.select(*stored.columns)))
