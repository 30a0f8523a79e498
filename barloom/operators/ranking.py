"""Cross-section ranks whose work is spread by rows, not by groups.

Groups of more than some `SPARSE * PER_RANGE` rows are dealt to ranges of their order (value, tie), so a day with a third of all
rows is many ranges; all other groups are one range each, and their rows carry no cuts. The ranges are cut at keys that a hash
picks from the rows: they depend on the rows alone, and are `RANGES` at most. A rank is the place inside the range plus the rows
of the group in lower ranges, so all numbers that cross ranges fit in a table of a few rows per cut, whatever the input; without
cuts the plan is one window. Nothing is stored and nothing comes back to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: One key in so many is sampled, every so-manieth sampled key of a group is a cut, and there are so many ranges at most.
SPARSE, PER_RANGE, RANGES = 131_072, 32, 1_024


def _running(by: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def _whole(by: list[str], order: list[str]) -> Window:
    """All rows of `by`; the order has no effect but that one pass serves this and a running window."""
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    renamed = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        hit = F.col(k).eqNullSafe(F.col(f"__{k}"))
        cond = hit if cond is None else cond & hit
    return left.join(renamed, cond, how).drop(*[f"__{k}" for k in keys])


def _cuts(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The groups that are cut, each with its cut keys in order, as an array of structs of `order`."""
    picked = F.xxhash64(*by, *order).alias("h")
    sample = df.select(*by, F.struct(*order).alias("__key"), picked).where(F.pmod("h", F.lit(SPARSE)) == 0)
    fewest = sample.orderBy("h").limit(RANGES * PER_RANGE)
    kept = F.filter(F.sort_array(F.collect_list("__key")), lambda _, i: i % PER_RANGE == PER_RANGE - 1)
    return fewest.groupBy(*by).agg(kept.alias("__cuts")).where(F.size("__cuts") > 0)


def _range_of(cuts: Column, key: Column) -> Column:
    """How many cuts lie below the key, by halving."""
    steps = F.filter(F.array(*[F.lit(1 << b) for b in reversed(range(RANGES.bit_length()))]), lambda s: s <= F.size(cuts))
    below = lambda at, s: F.coalesce(F.try_element_at(cuts, at + s) < key, F.lit(False))
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(below(at, s), at + s).otherwise(at))


def _placed(
    df: DataFrame, by: list[str], order: list[str], counted: str | None, source: DataFrame | None, sampled: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows with their range and 0/1 weight, those of `source` in cut groups likewise, and the cut groups with their cuts."""
    weight = F.lit(1) if counted is None else F.coalesce(F.col(counted).cast("int"), F.lit(0))
    same = df if source is None else source
    seen = same if sampled is None else sampled
    group = [c for c in by if c in seen.columns]
    cuts = _cuts(seen, group, order)

    def dealt(rows: DataFrame, how: str) -> DataFrame:
        rows = null_safe_join(rows.withColumn("__w", weight.cast("bigint")), F.broadcast(cuts), group, how)
        return rows.withColumn("__range", _range_of(F.col("__cuts"), F.struct(*order))).drop("__cuts")

    return dealt(df, "left"), dealt(same, "inner"), cuts


def order_rank(
    df: DataFrame, by: list[str], order: list[str], *, rank: str = "rn", total: str | None = None, counted: str | None = None,
    source: DataFrame | None = None, sampled: DataFrame | None = None,
) -> DataFrame:
    """row_number() within `by`, ascending by `order` (which must be unique per group).

    `total` names an extra column with the group's row count. With `counted` (a
    boolean column) only marked rows count, so an unmarked row gets the number
    of marked rows at or before it. The rows are read up to three times; where that is dear, store them first.
    `source` may name the same rows before further columns were made, which do not matter to where ranges are cut.
    `sampled` may name cheaper rows to take the cuts from: with `order` and some columns of `by`, and no fewer rows than `df`.
    """
    if not by:
        one, whole, some = (None if x is None else x.withColumn("__all", F.lit(1)) for x in (df, source, sampled))
        return order_rank(one, ["__all"], order, rank=rank, total=total, counted=counted, source=whole, sampled=some).drop("__all")
    rows, base, _ = _placed(df, by, order, counted, source, sampled)
    cell = by + ["__range"]
    own = rows.withColumn(rank, F.sum("__w").over(_running(cell, order)))
    if total is not None:
        own = own.withColumn(total, F.sum("__w").over(_whole(cell, order)))
    cells = base.groupBy(*cell).agg(F.sum("__w").alias("__n"))
    up = Window.partitionBy(*by).orderBy("__range")
    lower = cells.select(
        *cell, (F.sum("__n").over(up.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__below"),
        F.sum("__n").over(Window.partitionBy(*by)).alias("__whole"),
    )
    out = null_safe_join(own, F.broadcast(lower), cell, "left").withColumn(rank, F.col(rank) + F.coalesce("__below", F.lit(0)))
    if total is not None:
        out = out.withColumn(total, F.coalesce("__whole", total))
    return out.drop("__w", "__range", "__below", "__whole")


def with_tie_ranks(
    df: DataFrame, by: list[str], value: str, tie: list[str], *, counted: str | None = None, source: DataFrame | None = None,
    sampled: DataFrame | None = None,
) -> DataFrame:
    """Adds rn (first rank), rank_low / rank_high (of the tied values) and n per group; `source`, `sampled` as in `order_rank`.

    Ties inside a range are a window over the same sort; a value that lies on both sides of a cut (at most one per cut) has
    its first and last rank put together from the counts of its ranges.
    """
    rows, base, cuts = _placed(df, by, [value] + tie, counted, source, sampled)
    cell = by + ["__range"]
    upto = Window.partitionBy(*cell).orderBy(value)  # with all rows tied with the row
    first = F.rank().over(upto).cast("bigint") if counted is None else F.min("rn").over(Window.partitionBy(*cell, value))
    own = rows.withColumn("rn", F.sum("__w").over(_running(cell, [value] + tie))).withColumns({
        "rank_low": first, "rank_high": F.sum("__w").over(upto), "n": F.sum("__w").over(_whole(cell, [value])),
    })
    # per cell of a group with a cut inside: its weight, and for values at a cut their weight and that of their first row
    group = [c for c in cuts.columns if c != "__cuts"]
    at_cut = cuts.select(*group, F.array_distinct(F.transform("__cuts", lambda c: F.struct(c[value].alias("__v")))).alias("__vs"))
    known = null_safe_join(base, F.broadcast(at_cut), group)
    held = F.when(F.array_contains("__vs", F.struct(F.col(value).alias("__v"))), F.struct(F.col(value).alias("__v")))
    cells = known.groupBy(*cell, held.alias("__held")).agg(
        F.sum("__w").alias("__n"), F.min_by("__w", F.struct(*[F.col(c) for c in tie])).alias("__first")
    )
    all_held = cells.groupBy(*cell).agg(F.sum("__n").alias("__n"))
    up = Window.partitionBy(*by).orderBy("__range")
    lower = all_held.select(
        *cell, F.col("__n").alias("__inside"), (F.sum("__n").over(up.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__below"),
        F.sum("__n").over(Window.partitionBy(*by)).alias("__whole"),
    )
    parts = null_safe_join(cells.where("__held is not null"), lower, cell)
    before = F.col("__below") + F.col("__inside") - F.col("__n") + F.col("__first")  # in its first range a crossing value comes last
    ends = parts.groupBy(*by, "__held").agg(
        F.count("*").alias("ranges"), F.min_by(before, "__range").alias("__low"), F.max_by(F.col("__below") + F.col("__n"), "__range").alias("__high")
    ).where("ranges > 1").select(*by, F.col("__held.__v").alias(value), "__low", "__high")
    out = null_safe_join(own, F.broadcast(lower.drop("__inside")), cell, "left")
    out = null_safe_join(out, F.broadcast(ends), by + [value], "left")
    below = F.coalesce("__below", F.lit(0))
    return out.withColumns({
        "rn": F.col("rn") + below, "rank_low": F.coalesce("__low", F.col("rank_low") + below),
        "rank_high": F.coalesce("__high", F.col("rank_high") + below), "n": F.coalesce("__whole", "n"),
    }).drop("__w", "__range", "__below", "__whole", "__low", "__high")


def share_at_or_below() -> Column:
    """Share of the (counted) cross-section at or below the row's value."""
    return F.try_divide("rank_high", "n")


def average_rank() -> Column:
    return (F.col("rank_low") + F.col("rank_high")) / 2.0


def quantile_bucket(n_buckets: int) -> Column:
    """Bucket of a first-rank cut into equal-width rank intervals (1-based)."""
    width = F.ceil(F.try_divide(F.lit(n_buckets) * (F.col("rn") - 1), F.col("n") - 1))
    return F.greatest(F.lit(1), F.coalesce(width, F.lit(1))).cast("int")


def quantiles(df: DataFrame, by: list[str], value: str, tie: list[str], points: dict[str, float], *,
              extra: list[Column] | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group; `extra` aggregates ride along.

    Only the two neighbours of each position are aggregated, so no task holds a
    group's values (the built-in exact percentile keeps them all in memory).
    """
    ranked = order_rank(df, by, [value] + tie, total="n")
    aggs = list(extra or [])
    for name, q in points.items():
        pos = F.lit(q) * (F.col("n") - 1)
        low = F.max(F.when(F.col("rn") - 1 == F.floor(pos), F.col(value)))
        high = F.max(F.when(F.col("rn") - 1 == F.ceil(pos), F.col(value)))
        frac = F.max(pos - F.floor(pos))
        aggs.append((low + (high - low) * frac).alias(name))
    return ranked.groupBy(*by).agg(*aggs)


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int, *, rank: str | None = None) -> DataFrame:
    """First n rows per group. Spark limits each map task to n rows per group before the shuffle."""
    name = rank or "__rn"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def page_after(df: DataFrame, keys: list[str], size: int, last: Column | None = None) -> DataFrame:
    """The next page of a listing in ascending order of `keys`, which must be unique together.

    `last` is the key of the row before (a struct of the keys, see `last_key`); without it the first page is given. Every page
    costs one filtered scan and a top `size` per task, however deep it lies.
    """
    if size < 1:
        raise ValueError("page size starts at 1")
    rows = df if last is None else df.where(F.struct(*keys) > last)
    return rows.orderBy(*keys).limit(size)


def last_key(page: DataFrame, keys: list[str]) -> Column:
    """The key a page ends with, for the page after it."""
    return page.agg(F.max(F.struct(*keys))).scalar()
