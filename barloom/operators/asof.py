"""Point-in-time joins.

One date is a filter. Many dates use a sweep: facts and dated changes of the
same security are put in one stream ordered by date and the latest change is
carried forward. That is one shuffle on the security and no date-range
explosion; a security's stream is bounded by its trading days plus its changes.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom import rules


def valid_on(df: DataFrame, day: dt.date | str | Column, *, start: str = "in_date", end: str = "out_date") -> DataFrame:
    """Rows whose [start, end) contains the date."""
    d = day if isinstance(day, Column) else F.lit(day).cast("date")
    return df.where((F.col(start) <= d) & (F.col(end) > d))


def members_on(intervals: DataFrame, index_code: str, day: dt.date) -> DataFrame:
    """Sorted distinct member codes of an index at a date."""
    return valid_on(intervals.where(F.col("index_code") == index_code), day).select(
        "exchange_code"
    ).distinct().orderBy("exchange_code")


def attribute_on(intervals: DataFrame, level: str, day: dt.date) -> DataFrame:
    """One attribute value per code at a date (earliest interval wins)."""
    hit = valid_on(intervals.where(F.col("level") == level), day)
    return hit.groupBy("exchange_code").agg(F.min_by("industry", F.struct("in_date", "industry")).alias("industry"))


def _sweep(facts: DataFrame, changes: DataFrame, key: list[str], day: str, change_day: str,
           payload: list[str], keep: Column) -> DataFrame:
    """Carry `keep` (an aggregate over the changes so far) onto each fact as `__hit`."""
    fact_cols = [c for c in facts.columns if c not in key + [day]]
    left = facts.select(*key, F.col(day).alias("__d"), F.lit(1).alias("__kind"), *fact_cols)
    right = changes.select(*key, F.col(change_day).alias("__d"), F.lit(0).alias("__kind"), F.struct(*payload).alias("__chg"))
    stream = left.unionByName(right, allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy("__d", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = stream.withColumn("__hit", keep.over(w)).where("__kind = 1")
    return swept.select(*key, F.col("__d").alias(day), *fact_cols, "__hit")


def attach_interval(facts: DataFrame, intervals: DataFrame, key: list[str], columns: list[str], *,
                    day: str = "trade_date") -> DataFrame:
    """Left as-of join of every fact row to the interval of its key containing its date.

    Intervals of one key must not overlap (the scd2 builders guarantee it).
    Several keys can share a security by adding e.g. the level to `key`.
    """
    payload = [F.col(c) for c in columns] + [F.col("out_date").alias("__out")]
    swept = _sweep(facts, intervals, key, day, "in_date", payload, F.last("__chg", ignorenulls=True))
    live = F.col("__hit.__out") > F.col(day)
    return swept.select(
        *[c for c in swept.columns if c != "__hit"],
        *[F.when(live, F.col(f"__hit.{c}")).alias(c) for c in columns],
    )


def attach_in_place(facts: DataFrame, intervals: DataFrame, key: list[str], columns: list[str], *,
                    day: str = "trade_date") -> DataFrame:
    """As `attach_interval`, by a join on the key: facts that lie in buckets of the key stay where they are.

    Every interval ends where the next one of its key starts, so a fact meets one of them at most; those of a key are gone through for
    each of its facts, which suits securities with some dozens of changes. A null key meets nothing.
    """
    ends = F.lead("in_date").over(Window.partitionBy(*key).orderBy("in_date"))
    spans = intervals.select(*[F.col(k).alias(f"__{k}") for k in key], F.col("in_date").alias("__in"), F.col("out_date").alias("__out"),
                             ends.alias("__next"), *[F.col(c).alias(f"__c_{c}") for c in columns])
    d = F.col(day)
    hit = (F.col("__in").isNull() | (F.col("__in") <= d)) & (F.col("__out") > d) & (F.col("__next").isNull() | (F.col("__next") > d))
    for k in key:
        hit = hit & (F.col(k) == F.col(f"__{k}"))
    return facts.join(spans.hint("shuffle_hash"), hit, "left").select(*facts.columns, *[F.col(f"__c_{c}").alias(c) for c in columns])


def attach_known(facts: DataFrame, points: DataFrame, key: list[str], column: str, *, day: str = "trade_date") -> DataFrame:
    """Left join of each fact to the value in force on its day as far as it was known that day.

    `points` hold the value from `as_of_date` on, learnt on `known_on`. Among the points with both dates at or before the fact's the one
    with the latest `as_of_date` counts, and of these the one learnt last. A point counts from the later of its two dates on, so one
    sweep with a running maximum does it.
    """
    best = points.withColumn("__since", F.greatest("as_of_date", "known_on"))
    payload = [F.col("as_of_date"), F.col("known_on"), F.col(column).alias("__value")]
    swept = _sweep(facts, best, key, day, "__since", payload, F.max("__chg"))
    return swept.withColumn(column, F.col("__hit.__value")).drop("__hit")


def inside_interval(facts: DataFrame, intervals: DataFrame, key: list[str], *, day: str = "trade_date") -> DataFrame:
    """Fact rows whose date lies in an interval of their key."""
    marked = attach_interval(facts, intervals.withColumn("__in", F.lit(True)), key, ["__in"], day=day)
    return marked.where("__in").drop("__in")


def _order_key() -> Column:
    """Statement order (report, announcement, correction, type) as one number.

    A number keeps the aggregates below in a hash aggregate, which a struct would not.
    """
    kinds = F.create_map(*[F.lit(x) for i, k in enumerate(sorted(rules.STATEMENT_KINDS), 1) for x in (k, i)])
    kind = F.coalesce(F.try_element_at(kinds, F.col("stmt_type")), F.lit(0))

    def date(c: str) -> Column:
        return F.unix_date(c).cast("bigint") + (1 << 20)

    return ((date("report_date") * (1 << 22) + date("ann_date")) * 16 + F.col("update_flag")) * 16 + kind


def visible_item(statements: DataFrame, name: str, day: dt.date | str) -> DataFrame:
    """Item value per security visible at a date: latest report, then latest announcement."""
    d = F.lit(day).cast("date")
    seen = statements.where((F.col("ann_date") <= d) & F.map_contains_key("fields", F.lit(name)))
    return seen.groupBy("security_id").agg(
        F.max_by(F.try_element_at("fields", F.lit(name)), _order_key()).alias("value")
    )


def visible_items(statements: DataFrame, names: list[str], day: dt.date | str) -> DataFrame:
    """Several items at once: (security_id, item, value)."""
    d = F.lit(day).cast("date")
    rows = statements.where(F.col("ann_date") <= d).select(
        "security_id", _order_key().alias("__k"), F.explode("fields").alias("item", "value")
    ).where(F.col("item").isin(*names))
    return rows.groupBy("security_id", "item").agg(
        F.max_by("value", "__k").alias("value")
    )


def attach_visible(facts: DataFrame, statements: DataFrame, names: list[str], *, day: str = "trade_date") -> DataFrame:
    """The items visible at each fact row's date, one column per item.

    All items travel in one sweep: the statements of a day are reduced to the
    best one per item, and the running best so far is carried onto the facts.
    """
    keyed = statements.select("security_id", "ann_date", "fields", _order_key().alias("__k"))
    has = {n: F.map_contains_key("fields", F.lit(n)) for n in names}
    best = keyed.groupBy("security_id", "ann_date").agg(*[a for n in names for a in (
        F.max(F.when(has[n], F.col("__k"))).alias(f"__k_{n}"),
        F.max_by(F.try_element_at("fields", F.lit(n)), F.when(has[n], F.col("__k"))).alias(f"__v_{n}"),
    )])
    fact_cols = [c for c in facts.columns if c not in ("security_id", day)]
    left = facts.select("security_id", F.col(day).alias("__d"), F.lit(1).alias("__kind"), *fact_cols)
    right = best.withColumnRenamed("ann_date", "__d").withColumn("__kind", F.lit(0))
    stream = left.unionByName(right, allowMissingColumns=True)
    w = Window.partitionBy("security_id").orderBy("__d", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = stream.select("*", *[F.max_by(f"__v_{n}", f"__k_{n}").over(w).alias(f"__best_{n}") for n in names])
    return swept.where("__kind = 1").select(
        "security_id", F.col("__d").alias(day), *fact_cols, *[F.col(f"__best_{n}").alias(n) for n in names]
    )


def active_counts(intervals: DataFrame, by: list[str], days: DataFrame, *, day: str = "trade_date") -> DataFrame:
    """Number of intervals containing each day, per group; days with none are left out.

    +1 at the start and -1 at the end, summed along the dates: the work grows
    with intervals plus days, not with their product.
    """
    steps = intervals.select(*by, F.explode(F.array(
        F.struct(F.col("in_date").alias("d"), F.lit(1).alias("step")),
        F.struct(F.col("out_date").alias("d"), F.lit(-1).alias("step")),
    )).alias("s")).groupBy(*by, F.col("s.d").alias("d")).agg(F.sum("s.step").alias("step"))
    w = Window.partitionBy(*by).orderBy("d")
    spans = steps.select(
        *by, "d",
        F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("members"),
        F.date_sub(F.lead("d").over(w), 1).alias("until"),
    ).where("members > 0")
    asked = days.select(F.col(day).cast("date").alias(day)).distinct()
    last = F.least("until", asked.agg(F.max(day)).scalar())
    dated = spans.where(F.col("d") <= last).select(*by, "members", F.explode(F.sequence("d", last)).alias(day))
    return dated.join(F.broadcast(asked), day).select(*by, day, "members")


def intersect(left: DataFrame, right: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Common validity of two interval tables: [max(in), min(out)) where it is not empty."""
    return overlaps(left, right, on=key, columns=columns)


def overlaps(left: DataFrame, right: DataFrame, *, on: list[str] | None = None, columns: list[str], bin_days: int = 64) -> DataFrame:
    """Every pair of a left and a right interval that share a day (and the `on` columns), with the days they share.

    The result has the left columns, the right `columns` and [in_date, out_date) of the common stretch. Intervals are placed in the
    bins of `bin_days` they touch and joined by bin and `on` alone, so no range join and no product of a key's intervals is
    made; a pair is taken in the first bin it shares only, which is the bin where the later of the two starts. Bins after the
    last start of the other side hold no first bins, so an open interval is not spread to the end of time. Empty intervals and
    those with a missing date share nothing.
    """
    on, far = list(on or []), rules.OPEN_END
    held = lambda df: df.where(F.col("in_date") < F.col("out_date"))
    bin_of = lambda d: F.floor(F.unix_date(d) / bin_days)

    def placed(df: DataFrame, other: DataFrame) -> DataFrame:
        last = F.coalesce(other.agg(F.max("in_date")).scalar(), F.lit(far))
        end = F.greatest(F.least(F.date_sub("out_date", 1), last), "in_date")
        return df.withColumn("__bin", F.explode(F.sequence(bin_of(F.col("in_date")), bin_of(end))))

    left = held(left)
    right = held(right).select(*on, *columns, "in_date", "out_date")
    spans = placed(right, left).withColumnsRenamed({"in_date": "__in", "out_date": "__out"})
    both = placed(left, right).join(spans, [*on, "__bin"])
    from_, to = F.greatest("in_date", "__in"), F.least("out_date", "__out")
    shared = both.where((from_ < to) & (F.col("__bin") == bin_of(from_)))
    return shared.withColumns({"in_date": from_, "out_date": to}).drop("__in", "__out", "__bin")


def map_ids(df: DataFrame, ids: DataFrame, *, on: str = "exchange_code") -> tuple[DataFrame, DataFrame]:
    """Code -> security_id; returns (mapped rows, rejected rows)."""
    codes = ids.select(F.col("exchange_code").alias(on), "security_id").distinct()
    joined = df.join(codes, on, "left")
    return joined.where("security_id is not null"), joined.where("security_id is null").drop("security_id")


def map_ids_strict(df: DataFrame, ids: DataFrame, *, on: str = "exchange_code") -> DataFrame:
    """Code -> security_id where an unknown code fails the job at run time."""
    codes = ids.select(F.col("exchange_code").alias(on), "security_id").distinct()
    fail = F.raise_error(F.concat(F.lit("unknown security code "), F.col(on))).cast("int")
    return df.join(codes, on, "left").withColumn("security_id", F.coalesce("security_id", fail))
