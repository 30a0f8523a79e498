"""Recursive averages of long series as composed affine maps.

y[t] = y[t - 1] + alpha * (x[t] - y[t - 1]), with y[1] = x[1], takes the value before a stretch of rows to the value after it by
y -> c + a * (y - c) + b, where c is the stretch's first value. Rows are cut by date into chunks, each chunk is reduced to its map, and
the maps of a series, one for every `DAYS` calendar days, are applied one after the other to find the value that enters each
chunk. Inside a chunk every row's value follows from the entering one by a running sum. All of it runs in the JVM, and a series
is as many groups as it has chunks.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Calendar days of a chunk; (1 - alpha) ** -DAYS must be a double.
DAYS = 366


class Step(NamedTuple):
    """`name`: column `of` smoothed with weight `alpha` for the newest row."""

    name: str
    of: str
    alpha: float


def _entering(maps: DataFrame, key: list[str], n: int) -> DataFrame:
    """`key, __chunk, __y*, __n*`: the value that enters each chunk (its own first one if none does) and the values before it."""
    fields = [f"{f}{i}" for i in range(n) for f in ("m", "a", "b", "c")]
    state = [f"{f}{i}" for i in range(n) for f in ("y", "n")]
    kind = f"array<struct<at:bigint,{','.join(f'{s}:{t}' for s, t in zip(state, ('double', 'bigint') * n))}>>"
    nothing = [F.lit(None).cast("double") if s[0] == "y" else F.lit(0).cast("bigint") for s in state]

    def step(s: Column, m: Column) -> Column:
        enters = [F.coalesce(s[f"y{i}"], m[f"c{i}"]) for i in range(n)]
        leaves = [F.when(m[f"m{i}"] == 0, s[f"y{i}"]).otherwise(m[f"c{i}"] + m[f"a{i}"] * (enters[i] - m[f"c{i}"]) + m[f"b{i}"]) for i in range(n)]
        own = F.struct(m["__chunk"].alias("at"), *[c for i in range(n) for c in (enters[i].alias(f"y{i}"), s[f"n{i}"].alias(f"n{i}"))])
        new = [c for i in range(n) for c in (leaves[i].alias(f"y{i}"), (s[f"n{i}"] + m[f"m{i}"]).alias(f"n{i}"))]
        return F.struct(*new, F.concat(s["out"], F.array(own)).alias("out"))

    start = F.struct(*[c.alias(s) for c, s in zip(nothing, state)], F.array().cast(kind).alias("out"))
    whole = maps.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("__chunk", *fields))).alias("maps"))
    each = whole.select(*key, F.explode(F.aggregate("maps", start, step, lambda s: s["out"])).alias("e"))
    return each.select(*key, F.col("e.at").alias("__chunk"), *[F.col(f"e.{s}").alias(f"__{s}") for s in state])


def smoothed(rows: DataFrame, steps: list[Step], *, key: list[str], day: str = "trade_date", seen: bool = False) -> DataFrame:
    """The rows with one column per step; with `seen` also `__seen_<name>`, the step's values up to the row.

    Rows of a key must have different days. A missing value leaves the average as it is and does not weigh; before the first
    value the average is null. The chunk stays in `__chunk`, so that a further pass over the result deals its rows alike.
    The rows are read twice.
    """
    n = len(steps)
    cell = Window.partitionBy(*key, "__chunk").orderBy(day)
    upto = cell.rowsBetween(Window.unboundedPreceding, 0)
    chunk = F.floor(F.unix_date(F.col(day)) / DAYS).cast("bigint")
    base = rows if "__chunk" in rows.columns else rows.withColumn("__chunk", chunk)
    x = [F.col(s.of).cast("double") for s in steps]
    base = base.withColumns({c: v for i in range(n) for c, v in (
        (f"__k{i}", F.count(x[i]).over(upto)), (f"__c{i}", F.first(x[i], ignorenulls=True).over(upto)))})
    power = lambda i, k: F.pow(F.lit(1.0 - steps[i].alpha), k)
    grown = [s.alpha * (x[i] - F.col(f"__c{i}")) * power(i, -F.col(f"__k{i}")) for i, s in enumerate(steps)]
    base = base.withColumns({f"__s{i}": F.coalesce(F.sum(grown[i]).over(upto), F.lit(0.0)) for i in range(n)})
    last = [a for i in range(n) for a in (F.max(f"__k{i}").alias(f"m{i}"), F.max_by(f"__s{i}", day).alias(f"__b{i}"), F.max_by(f"__c{i}", day).alias(f"c{i}"))]
    maps = base.groupBy(*key, "__chunk").agg(*last).select(*key, "__chunk", *[c for i in range(n) for c in (
        F.col(f"m{i}"), power(i, F.col(f"m{i}")).alias(f"a{i}"), (power(i, F.col(f"m{i}")) * F.col(f"__b{i}")).alias(f"b{i}"), F.col(f"c{i}"))])
    out = base.join(_entering(maps, key, n), [*key, "__chunk"])
    held = [F.col(f"__n{i}") + F.col(f"__k{i}") for i in range(n)]
    # without a value of its own yet, a chunk passes on what enters
    value = [F.when(F.col(f"__k{i}") == 0, F.col(f"__y{i}")).otherwise(
        F.col(f"__c{i}") + power(i, F.col(f"__k{i}")) * (F.col(f"__y{i}") - F.col(f"__c{i}") + F.col(f"__s{i}"))) for i in range(n)]
    made = {s.name: F.when(held[i] > 0, value[i]) for i, s in enumerate(steps)}
    if seen:
        made |= {f"__seen_{s.name}": held[i] for i, s in enumerate(steps)}
    return out.withColumns(made).drop(*[f"__{f}{i}" for i in range(n) for f in "kcsyn"])
