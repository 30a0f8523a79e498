"""Coercion, parsing and small map/number helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barloom import rules


def is_finite(value: Column) -> Column:
    """Not null, not NaN, not infinite."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def finite_or_null(value: Column) -> Column:
    return F.when(is_finite(value), value)


def null_nan(df: DataFrame) -> DataFrame:
    """Turn NaN into null in every floating column; applied at every reader."""
    floating = {c for c, t in df.dtypes if t in ("double", "float")}
    if not floating:
        return df
    return df.select(*[
        F.when(~F.isnan(c), F.col(c)).alias(c) if c in floating else F.col(c) for c in df.columns
    ])


def to_number(value: Column) -> Column:
    """Text or number -> double, anything unreadable (and NaN) -> null."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number), number)


def to_count(value: Column) -> Column:
    """Unreadable or missing counts are 0."""
    return F.coalesce(to_number(value), F.lit(0.0)).cast("bigint")


def parse_ymd(value: Column) -> Column:
    """`yyyyMMdd` or ISO text -> date, anything else -> null."""
    text = F.trim(value.cast("string"))
    return F.coalesce(
        F.to_date(F.try_to_timestamp(F.when(text.rlike(r"^\d{8}$"), text), F.lit("yyyyMMdd"))),
        F.to_date(F.try_to_timestamp(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(text, 1, 10)),
                                     F.lit("yyyy-MM-dd"))),
    )


def parse_end_date(value: Column) -> Column:
    """Delisting date; far-future placeholders mean "still listed"."""
    day = parse_ymd(value)
    return F.when(day < F.lit(rules.FAR_FUTURE), day)


def version_date(version: Column) -> Column:
    """Version text -> as-of date, unparsable -> null."""
    return F.to_date(F.try_to_timestamp(F.substring(F.trim(version), 1, 10), F.lit("yyyy-MM-dd")))


def first_number(record: Column, *keys: str) -> Column:
    """First readable number under the given keys of a map<string,string>, else 0."""
    found = [record.getItem(k).try_cast("double") for k in keys]
    return F.coalesce(*found, F.lit(0.0))


def first_alias(df: DataFrame, names: list[str], *, any_case: bool = False) -> Column:
    """Coalesce the landed spellings of one column; null when none is present."""
    if any_case:
        present = {c.lower(): c for c in df.columns}
        hits = [present[n.lower()] for n in names if n.lower() in present]
    else:
        hits = [n for n in names if n in df.columns]
    if not hits:
        return F.lit(None)
    return F.coalesce(*[F.col(f"`{c}`") for c in hits])


def recent_quarter_ends(day: Column, n: int = 4) -> Column:
    """The n latest quarter ends on or before `day`, newest first."""
    first = F.date_sub(F.add_months(F.trunc(day, "quarter"), 3), 1)
    latest = F.when(first <= day, first).otherwise(F.date_sub(F.trunc(day, "quarter"), 1))
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: F.last_day(F.add_months(latest, -3 * i)),
    )


def item_map(items: dict[str, Column]) -> Column:
    """Statement items as map<string,double>; null items are left out."""
    names = F.array(*[F.lit(k) for k in items])
    values = F.array(*[v.cast("double") for v in items.values()])
    return F.map_filter(F.map_from_arrays(names, values), lambda k, v: v.isNotNull())


def item(fields: Column, name: str) -> Column:
    return F.try_element_at(fields, F.lit(name))


def has_item(fields: Column, name: str) -> Column:
    return F.map_contains_key(fields, name)


def content_print(df: DataFrame) -> Column:
    """Order-independent fingerprint of the rows (aggregate): their number and the sum of their hashes, so equal rows don't cancel."""
    return print_of(*[c for c in df.columns])


def print_of(*columns: str) -> Column:
    return F.xxhash64(F.count("*"), F.coalesce(F.sum(F.xxhash64(F.struct(*columns)).cast("decimal(20,0)")), F.lit(0)))


def short_id(prefix: str, parts: dict[str, Column], length: int = 8) -> Column:
    """Stable id: prefix plus the head of a sha1 over the sorted, named parts."""
    payload = F.to_json(F.struct(*[parts[k].cast("string").alias(k) for k in sorted(parts)]))
    return F.concat(F.lit(prefix), F.lit("_"), F.substring(F.sha1(payload), 1, length))
