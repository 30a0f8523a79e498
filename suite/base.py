"""Query registry.

A query returns a DataFrame; `cols` names its output columns and their
presentation, applied alike to the DataFrame and to the checking SQL:
d = date as ISO text, i = whole number, s = text, b = boolean as 0/1,
f = double as computed, fN = double rounded to N digits, rN = N significant digits as mantissa and exponent, l = text list joined by
commas. Sums and means differ in the last bits with the order of addition, hence
the rounding; a small nudge keeps values off exact halves, where the two engines'
round functions disagree.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barloom.sources.market import Market
from suite.views import with_views


@dataclass(frozen=True)
class Query:
    name: str
    fn: Callable[[Market], DataFrame]
    cols: tuple[tuple[str, str], ...]
    sql: str | None
    needs: tuple[str, ...]

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.fn(Market(spark, sf_dir))
        return df.select(*[_spark_out(c, t).alias(c) for c, t in self.cols])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        out = ", ".join(f"{_sql_out(c, t)} as {c}" for c, t in self.cols)
        return with_views(self.needs, self.sql, out)


QUERIES: dict[str, Query] = {}
NUDGE = "3.14159e-{}"


def _nudge(digits: int) -> str:
    return NUDGE.format(digits + 3)


def _finite(x: Column) -> Column:
    """Infinite and undefined figures count as missing."""
    return F.when(F.abs(x) < float("inf"), x)


def _spark_out(c: str, t: str) -> Column:
    col = F.col(c)
    if t == "d":
        return F.date_format(col, "yyyy-MM-dd")
    if t == "i":
        return col.cast("bigint")
    if t == "b":
        return col.cast("int").cast("bigint")
    if t == "l":
        return F.array_join(col, ",")
    if t.startswith("r"):
        x, n = _finite(col.cast("double")), int(t[1:])
        e = F.floor(F.log10(F.abs(x)))
        mantissa = F.round(x / F.pow(F.lit(10.0), e.cast("double")) + F.lit(float(_nudge(n))), n - 1)
        return F.when(x == 0, "0").otherwise(F.concat(mantissa.cast("string"), F.lit("e"), e.cast("string")))
    if t.startswith("f"):
        x = _finite(col.cast("double")) if t[1:] else col.cast("double")
        return F.round(x + F.lit(float(_nudge(int(t[1:])))), int(t[1:])) if t[1:] else x
    return col.cast("string")


def _sql_out(c: str, t: str) -> str:
    if t == "d":
        return f"strftime({c}, '%Y-%m-%d')"
    if t == "i":
        return f"cast({c} as bigint)"
    if t == "b":
        return f"cast(cast({c} as integer) as bigint)"
    if t.startswith("r"):
        n, x = int(t[1:]), f"(case when isfinite(cast({c} as double)) then cast({c} as double) end)"
        e = f"cast(floor(log10(abs(nullif({x}, 0)))) as bigint)"
        return f"case when {x} = 0 then '0' else cast(round({x} / pow(10.0::double, {e}) + cast({_nudge(n)} as double), {n - 1}) as varchar) || 'e' || cast({e} as varchar) end"
    if t.startswith("f"):
        n = t[1:]
        return f"round((case when isfinite(cast({c} as double)) then cast({c} as double) end) + cast({_nudge(int(n))} as double), {n})" if n else f"cast({c} as double)"
    return f"cast({c} as varchar)"


def query(name: str, cols: str, sql: str | None = None, needs: str = ""):
    """Register `fn(market) -> DataFrame` under `name`; `needs` lists the SQL views used."""
    parsed = tuple(tuple(c.rsplit(":", 1)) for c in cols.split())

    def add(fn: Callable[[Market], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(name, fn, parsed, sql, tuple(needs.split()))
        return fn

    return add
