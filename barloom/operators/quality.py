"""Data-quality rules over a range of days and the publication gate.

A rule takes the tables it names and returns (trade_date, passed, message); the
registry adds its name and severity. A failed hard rule blocks the day.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom import rules
from barloom.functions import market as mk, symbols as sy, values as v
from barloom.operators import asof, ranking
from barloom.operators.calendar import link, open_days
from barloom.operators.scd2 import current_listing
from barloom.operators.prices import by_security, post_close

HARD, SOFT = "hard", "soft"
MAX_MOVE = 0.21
LIMIT_TOLERANCE = 0.011


@dataclass(frozen=True)
class Tables:
    """What the rules read. `second_source` holds landed bars of another source, if any."""

    bars: DataFrame
    master: DataFrame
    calendar: DataFrame
    statements: DataFrame
    factors: DataFrame
    second_source: DataFrame | None = None


_RULES: dict[str, tuple[str, Callable[..., DataFrame]]] = {}


def rule(name: str, severity: str):
    """Register a rule function under a name and severity."""
    if severity not in (HARD, SOFT):
        raise ValueError(f"severity must be {HARD!r} or {SOFT!r}")

    def add(fn: Callable[..., DataFrame]):
        _RULES[name] = (severity, fn)
        return fn

    return add


def registered() -> dict[str, str]:
    return {name: severity for name, (severity, _) in _RULES.items()}


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("-")) for p in parts])


def bar_counts(bars: DataFrame) -> DataFrame:
    return bars.groupBy("trade_date").agg(F.count("*").alias("got"))


def listed_counts(master: DataFrame, days: DataFrame) -> DataFrame:
    """Securities listed per day: listing to delisting as an interval."""
    spans = master.where("list_date is not null").select(
        F.lit("listed").alias("k"), F.col("list_date").alias("in_date"),
        F.coalesce("delist_date", F.lit(rules.OPEN_END)).alias("out_date"),
    )
    return asof.active_counts(spans, ["k"], days).select("trade_date", F.col("members").alias("listed"))


def _with_listed(rows: DataFrame, t: Tables) -> DataFrame:
    """Day rows with the count of the previous open day (0 without bars) and the number of listed securities."""
    w = Window.orderBy("trade_date")  # one row per day
    before = F.when(F.lag("trade_date").over(w) == F.col("prev_day"), F.lag("got").over(w))
    days = link(rows, t.calendar, "prev_open", "prev_day").withColumn("prev", F.coalesce(before, F.lit(0)))
    return days.join(listed_counts(t.master, open_days(t.calendar)), "trade_date", "left").fillna(0, ["listed"])


def _row_count(min_universe: int = rules.MIN_UNIVERSE, max_drift: float = 0.05, min_share: float = 0.9) -> tuple[Column, Column]:
    drift = F.try_divide(F.abs(F.col("got") - F.col("prev")), F.col("prev"))
    ok = (
        F.when(F.col("got") < min_universe, False)
        .when(F.col("prev") >= min_universe, drift <= max_drift)
        .otherwise((F.col("listed") > 0) & (F.col("got") >= F.col("listed") * min_share))
    )
    return ok, _text("got=", F.col("got"), " listed=", F.col("listed"), " prev=", F.col("prev"))


@rule("row_count", HARD)
def row_count(t: Tables, **options) -> DataFrame:
    """Floor, then drift against the previous open day, else share of the listed securities."""
    ok, message = _row_count(**options)
    return _with_listed(bar_counts(t.bars), t).select("trade_date", ok.alias("passed"), message.alias("message"))


def adjusted_moves(t: Tables) -> DataFrame:
    """Adjusted move against the previous open day, with the listing columns of the security."""
    px = t.bars.select("security_id", "trade_date", post_close().alias("px"))
    w = by_security()
    # The security's previous row counts only when it lies on the previous open day.
    before = px.withColumns({"p0": F.lag("px").over(w), "__d": F.lag("trade_date").over(w)})
    return (
        link(before, t.calendar, "prev_open", "prev_day").where("__d = prev_day")
        .join(current_listing(t.master, "exchange_code", "board", "list_date"), "security_id")
        .withColumn("adj_ret", F.try_divide("px", F.nullif("p0", F.lit(0.0))) - 1)
    )


def _outlier(max_move: float = MAX_MOVE) -> Column:
    board = sy.board_or_inferred(F.col("board"), F.col("exchange_code"))
    new = mk.in_no_limit_window(F.col("trade_date"), F.col("list_date"), board)
    return (F.abs("adj_ret") > max_move) & ~new & ~F.coalesce(F.col("list_date") == F.col("trade_date"), F.lit(False))


def _no_bad(label: str, bad: str) -> tuple[Column, Column]:
    return F.coalesce(bad, F.lit(0)) == 0, _text(label, F.coalesce(bad, F.lit(0)))


@rule("adj_continuity", HARD)
def adj_continuity(t: Tables, *, max_move: float = MAX_MOVE) -> DataFrame:
    """Adjusted one-day moves beyond the limit outside the no-limit window of a new listing."""
    found = adjusted_moves(t).where(_outlier(max_move)).groupBy("trade_date").agg(F.count("*").alias("bad"))
    days, (ok, message) = bar_counts(t.bars).select("trade_date"), _no_bad("outliers=", "bad")
    return days.join(found, "trade_date", "left").select("trade_date", ok.alias("passed"), message.alias("message"))


def limit_mismatches(t: Tables, *, sample: int | None = None) -> DataFrame:
    """Bars with recomputed limits beside the stored ones; `sample` takes a fixed hash sample per day."""
    rows = t.bars.where("pre_close > 0").select(
        "security_id", "trade_date", "pre_close", "up_limit", "down_limit", "is_st"
    )
    if sample:
        rows = ranking.top_n(rows, ["trade_date"], [F.xxhash64("security_id", "trade_date"), F.col("security_id")], sample)
    listed = current_listing(t.master, "exchange_code", "board", "list_date")
    return _with_mismatch(rows.join(listed, "security_id"))


def _with_mismatch(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("board", sy.board_or_inferred(F.col("board"), F.col("exchange_code")))
    new = mk.in_no_limit_window(F.col("trade_date"), F.col("list_date"), F.col("board"))
    st = mk.flag(F.col("is_st"))
    off = (F.abs(F.col("up_limit") - mk.up_limit(F.col("pre_close"), F.col("board"), st)) > LIMIT_TOLERANCE) | (
        F.abs(F.col("down_limit") - mk.down_limit(F.col("pre_close"), F.col("board"), st)) > LIMIT_TOLERANCE
    )
    return rows.withColumns({"exempt": new, "mismatch": F.coalesce(off, F.lit(True)) & ~new})


def _limits() -> tuple[Column, Column]:
    return (F.col("seen") > 0) & (F.col("bad") == 0), _text("checked=", F.col("checked"), " mismatches=", F.col("bad"))


@rule("limit_prices", HARD)
def limit_prices(t: Tables, *, sample: int | None = None) -> DataFrame:
    """Stored limits against recomputed ones, of every bar of a day (`sample` checks so many a day)."""
    rows = limit_mismatches(t, sample=sample)
    found = rows.groupBy("trade_date").agg(
        F.count("*").alias("seen"), F.count_if(~F.col("exempt")).alias("checked"), F.count_if("mismatch").alias("bad")
    )
    days = bar_counts(t.bars).select("trade_date")
    joined, (ok, message) = days.join(found, "trade_date", "left").fillna(0, ["seen", "checked", "bad"]), _limits()
    return joined.select("trade_date", ok.alias("passed"), message.alias("message"))


@rule("pit_sanity", HARD)
def pit_sanity(t: Tables) -> DataFrame:
    """Statements announced before their report date."""
    bad = t.statements.where("ann_date < report_date").groupBy(F.col("ann_date").alias("trade_date")).agg(
        F.count("*").alias("bad")
    )
    days = bar_counts(t.bars).select("trade_date")
    return days.join(bad, "trade_date", "left").select(
        "trade_date", (F.coalesce("bad", F.lit(0)) == 0).alias("passed"), _text("violations=", F.coalesce("bad", F.lit(0))).alias("message")
    )


def source_differences(first: DataFrame, second: DataFrame, *, tol: float = 0.01) -> DataFrame:
    """Two sources on (code, day): relative differences of close and volume, one-sided rows kept."""
    a = first.select("exchange_code", "trade_date", F.col("close").alias("close_a"), F.col("volume").cast("double").alias("volume_a"))
    b = second.select("exchange_code", "trade_date", F.col("close").alias("close_b"), F.col("volume").cast("double").alias("volume_b"))

    def apart(x: str) -> Column:
        return F.abs(F.try_divide(F.col(f"{x}_b") - F.col(f"{x}_a"), F.nullif(f"{x}_a", F.lit(0.0))))

    side = F.when(F.col("close_a").isNull(), "second_only").when(F.col("close_b").isNull(), "first_only").otherwise("both")
    return a.join(b, ["exchange_code", "trade_date"], "full").withColumns({
        "side": side, "close_diff": apart("close"), "volume_diff": apart("volume"),
    }).withColumn("differs", (F.col("side") != "both") | (F.col("close_diff") > tol) | (F.col("volume_diff") > tol))


@rule("cross_source", SOFT)
def cross_source(t: Tables, *, tol: float = 0.01) -> DataFrame:
    days = bar_counts(t.bars).select("trade_date")
    if t.second_source is None:
        return days.select("trade_date", F.lit(True).alias("passed"), F.lit("no second source").alias("message"))
    coded = t.bars.join(current_listing(t.master, "exchange_code"), "security_id") if (
        "exchange_code" not in t.bars.columns) else t.bars
    found = source_differences(coded, t.second_source, tol=tol).where("side = 'both'").groupBy("trade_date").agg(
        F.count("*").alias("seen"), F.count_if("differs").alias("bad")
    )
    return days.join(found, "trade_date", "left").fillna(0, ["seen", "bad"]).select(
        "trade_date", (F.col("bad") == 0).alias("passed"), _text("compared=", F.col("seen"), " differing=", F.col("bad")).alias("message")
    )


@rule("factor_coverage", SOFT)
def factor_coverage(t: Tables, *, floor: float = 0.5, version: str = rules.FACTOR_VERSION) -> DataFrame:
    """A seed factor that has values on a day covers at least half of its bars."""
    valid = t.factors.where((F.col("version") == version) & F.col("factor_name").isin(*rules.SEED_FACTORS)
                            & v.is_finite(F.col("value")))
    per = valid.groupBy("trade_date", "factor_name").agg(F.count("*").alias("nn"))
    low = per.join(bar_counts(t.bars), "trade_date").groupBy("trade_date").agg(
        F.count_if(F.col("nn") / F.col("got") < floor).alias("bad"), F.count("*").alias("factors")
    )
    days = bar_counts(t.bars).select("trade_date")
    return days.join(low, "trade_date", "left").fillna(0, ["bad", "factors"]).select(
        "trade_date", (F.col("bad") == 0).alias("passed"), _text("factors=", F.col("factors"), " below=", F.col("bad")).alias("message")
    )


def bar_days(t: Tables, max_move: float = MAX_MOVE) -> DataFrame:
    """What the rules on bars ask of a day, from one pass: bars, outliers, limits seen, checked and wrong."""
    w = by_security()
    px = t.bars.select("security_id", "trade_date", "pre_close", "up_limit", "down_limit", "is_st", post_close().alias("px"))
    before = px.withColumns({"p0": F.lag("px").over(w), "__d": F.lag("trade_date").over(w)})
    linked = link(before, t.calendar, "prev_open", "prev_day")
    listed = current_listing(t.master, "exchange_code", "board", "list_date").withColumn("known", F.lit(True))
    move = F.try_divide("px", F.nullif("p0", F.lit(0.0))) - 1
    rows = linked.join(listed, "security_id", "left").withColumn("adj_ret", F.when(F.col("known") & (F.col("__d") == F.col("prev_day")), move))
    outlier = F.coalesce(_outlier(max_move), F.lit(False))
    rows = _with_mismatch(rows.withColumn("outlier", outlier)).withColumn("priced", F.coalesce(F.col("known") & (F.col("pre_close") > 0), F.lit(False)))
    return rows.groupBy("trade_date").agg(
        F.count("*").alias("got"), F.count_if("outlier").alias("outliers"), F.count_if("priced").alias("seen"),
        F.count_if(F.col("priced") & ~F.col("exempt")).alias("checked"), F.count_if(F.col("priced") & F.col("mismatch")).alias("bad"),
    )


_OF_BARS = ("row_count", "adj_continuity", "limit_prices")


def run_all(t: Tables, **options: dict) -> DataFrame:
    """Every rule over every day: (trade_date, rule, severity, passed, message).

    The rules on bars share one pass over them, unless an option asks for a sample.
    """
    if options.get("limit_prices", {}).get("sample"):
        out, rest = None, list(_RULES)
    else:
        days = _with_listed(bar_days(t, **options.get("adj_continuity", {})), t)
        verdicts = (_row_count(**options.get("row_count", {})), _no_bad("outliers=", "outliers"), _limits())
        each = F.array(*[
            F.struct(F.lit(name).alias("rule"), F.lit(_RULES[name][0]).alias("severity"), ok.alias("passed"), message.alias("message"))
            for name, (ok, message) in zip(_OF_BARS, verdicts)
        ])
        out, rest = days.select("trade_date", F.inline(each)), [name for name in _RULES if name not in _OF_BARS]
    for name in rest:
        severity, fn = _RULES[name]
        part = fn(t, **options.get(name, {})).select(
            "trade_date", F.lit(name).alias("rule"), F.lit(severity).alias("severity"), "passed", "message"
        )
        out = part if out is None else out.unionByName(part)
    return out


def blocked_days(results: DataFrame) -> DataFrame:
    """Per day: does a hard rule fail?"""
    return results.groupBy("trade_date").agg(
        F.bool_or((F.col("severity") == HARD) & ~F.col("passed")).alias("blocked"), F.count_if(~F.col("passed")).alias("failed")
    )
