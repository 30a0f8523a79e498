"""Target weights from a panel, and their arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom import rules
from barloom.operators import ranking

UNKNOWN = "UNKNOWN"


def _check(method: str) -> None:
    if method not in rules.WEIGHT_METHODS:
        raise ValueError(f"unknown weight method {method!r}; known: {rules.WEIGHT_METHODS}")


def select_names(panel: DataFrame, by: list[str], top_n: int | None, *, code: str = "exchange_code") -> DataFrame:
    """Rows with a value; the top n by value where n is given (ties by code)."""
    rows = panel.where("value is not null")
    if top_n is None or top_n <= 0:
        return rows
    return ranking.top_n(rows, by, [F.col("value").desc(), F.col(code)], int(top_n))


def _triangle(n: Column) -> Column:
    """Sum of the ranks 1..n, which average ranks preserve."""
    return n * (n + 1) / 2.0


def _ranked(rows: DataFrame, source: DataFrame, by: list[str], code: str, bounded: bool, prefix: str) -> DataFrame:
    """Average rank and group size as <prefix>rank, <prefix>n; `source` holds the same rows with fewer columns."""
    if bounded:
        # At most top_n rows per group: plain windows.
        group, tied = Window.partitionBy(*by), Window.partitionBy(*by, "value")
        low = F.rank().over(group.orderBy("value"))
        return rows.withColumns({
            f"{prefix}rank": low + (F.count("*").over(tied) - 1) / 2.0, f"{prefix}n": F.count("*").over(group),
        })
    return ranking.with_tie_ranks(rows, by, "value", [code], source=source).withColumns({
        f"{prefix}rank": ranking.average_rank(), f"{prefix}n": F.col("n"),
    }).drop("rn", "n", "rank_low", "rank_high")


def target_weights(panel: DataFrame, methods: list[str] | str = "equal", top_n: int | None = None, *,
                   by: list[str] | None = None, code: str = "exchange_code", keep: list[str] | None = None) -> DataFrame:
    """Weights summing to 1 per group, all asked methods in one pass.

    `by` defaults to the day; add e.g. the factor name to weigh many panels at
    once. The output is long: by..., code, keep..., weight_method, weight. Without
    `top_n` the panel is ranked over ranges and read several times: store it first.
    """
    methods = [methods] if isinstance(methods, str) else list(methods)
    for m in methods:
        _check(m)
    by = by or ["trade_date"]
    bounded = bool(top_n and top_n > 0)
    rows = select_names(panel, by, top_n, code=code)
    if "industry_neutral" in methods:
        if "industry" not in panel.columns:
            raise ValueError("industry_neutral needs an industry column")
        rows = rows.withColumn("industry", F.coalesce("industry", F.lit(UNKNOWN)))
    out, weights = rows, {}
    if {"equal", "factor_rank"} & set(methods):
        out = _ranked(out, rows, by, code, bounded, "__d_")
        weights["equal"] = 1.0 / F.col("__d_n")
        weights["factor_rank"] = F.col("__d_rank") / _triangle(F.col("__d_n"))
    if "industry_neutral" in methods:
        out = _ranked(out, rows, by + ["industry"], code, bounded, "__i_")
        if bounded:
            out = out.withColumn("__k", F.size(F.collect_set("industry").over(Window.partitionBy(*by))))
        else:
            kinds = rows.groupBy(*by).agg(F.countDistinct("industry").alias("__k"))
            out = ranking.null_safe_join(out, kinds, by)
        weights["industry_neutral"] = F.col("__i_rank") / _triangle(F.col("__i_n")) / F.col("__k")
    ids = by + [code] + (keep or [])
    return out.select(*ids, *[weights[m].alias(m) for m in methods]).unpivot(ids, methods, "weight_method", "weight")


def normalized(weights: DataFrame, by: list[str], *, tol: float = 1e-6, renormalize: bool = True) -> DataFrame:
    """Drop missing and non-positive weights; rescale groups whose sum is off by more than `tol`.

    With `renormalize=False` such a group fails the job at run time.
    """
    rows = weights.where(F.col("weight").isNotNull() & ~F.isnan("weight") & (F.col("weight") > 0))
    sums = rows.groupBy(*by).agg(F.sum("weight").alias("__s"))
    off = F.abs(F.col("__s") - 1.0) > tol
    fixed = F.col("weight") / F.col("__s") if renormalize else F.raise_error(
        F.concat(F.lit("weights do not sum to 1: "), F.col("__s").cast("string"))
    ).cast("double")
    return ranking.null_safe_join(rows, sums, by).withColumn(
        "weight", F.when(off, fixed).otherwise(F.col("weight"))
    ).drop("__s")


def exposure(signal: DataFrame, index: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Industry weight of a signal against the equal share of the index members.

    `signal` has industry and weight, `index` has industry, one row per member.
    """
    by = by or ["trade_date"]
    sig = signal.groupBy(*by, F.coalesce("industry", F.lit(UNKNOWN)).alias("industry")).agg(
        F.sum("weight").alias("signal_weight")
    )
    idx = index.groupBy(*by, F.coalesce("industry", F.lit(UNKNOWN)).alias("industry")).agg(F.count("*").alias("n"))
    total = Window.partitionBy(*by)  # over industries of a group, a short list
    idx = idx.withColumn("index_weight", F.col("n") / F.sum("n").over(total)).drop("n")
    both = sig.join(idx, by + ["industry"], "full").fillna(0.0, ["signal_weight", "index_weight"])
    return both.withColumn("diff", F.col("signal_weight") - F.col("index_weight"))
