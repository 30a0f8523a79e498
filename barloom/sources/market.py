"""Market-shaped views over the driver's tables.

security = supplier, bar = supplier-day of `lineitem` (every date with a trade is an open day), statements =
supplier-quarter sums, index membership = monthly activity, industry = leading
brand of the quarter, quotes = `events`. Bars come from one map-side-combined
aggregation, so whatever the skew of `lineitem`, a security has at most one row
per trading day afterwards; every per-security window in the library relies on
that bound.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from barloom.functions import market as mk, values as v
from barloom.operators import calendar as cal, factors as fct, prices as pr
from barloom.plans import build
from barloom.session import bucketed, written

INDEX_CODE = "IDX_A"


def _trade_order() -> Column:
    """Total order of the trades of a day packed in one decimal.

    A decimal buffer keeps min_by/max_by in a hash aggregate; a struct would
    force sorting the trades before and after the shuffle.
    """
    return F.expr(
        "cast(cast(l_orderkey as decimal(20,0)) * 1000000000000000bd"
        " + cast(l_linenumber as decimal(3,0)) * 100000000000000bd"
        " + cast(round(l_extendedprice * 100) as decimal(12,0)) * 100bd"
        " + cast(l_quantity as decimal(3,0)) as decimal(38,0))"
    )


class Market:
    """Lazy views of one scale-factor directory; each property is a DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def stored(self, *views: str, columns: tuple[str, ...] | None = None) -> Market:
        """The same views over service bars written once and read back, and over the named views likewise.

        For jobs that read the bars several times: the trades are then added up once, and readers take the columns they need. The bars
        lie in buckets of securities, so what joins or windows them by security does not shuffle them again.
        `columns` names those of the bars that the job reads at all (all by default); others are neither made nor kept.
        """
        out = Market(self.spark, self.sf_dir)
        bars = self._dated_bars if columns is None else self._dated_bars.select("security_id", "trade_date", *columns)
        if "pre_close" not in bars.columns:  # whose window deals them to securities as it is
            bars = bars.repartition("security_id")
        out._dated_bars = bucketed(bars, "bars", "security_id", ["security_id", "trade_date"])
        out.raw_bars = out._dated_bars.select(*[c for c in self.raw_bars.columns if c in bars.columns])
        out._traded = out.raw_bars.select("security_id", "trade_date")
        for name in views:
            setattr(out, name, written(getattr(out, name), name))
        return out

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def trades(self) -> DataFrame:
        day = F.to_date("l_shipdate")
        return (
            self.table("lineitem")
            .select(
                F.col("l_suppkey").cast("int").alias("security_id"), day.alias("trade_date"),
                "l_partkey", "l_quantity", "l_extendedprice", "l_discount",
                _trade_order().alias("seq"),
                F.try_divide("l_extendedprice", "l_quantity").alias("p"),
            )
        )

    @cached_property
    def _traded(self) -> DataFrame:
        """Every security and day with a trade, once or more often."""
        return self.trades.select("security_id", "trade_date")

    @cached_property
    def raw_bars(self) -> DataFrame:
        """open/high/low/close/volume/amount per security and day."""
        return self.trades.groupBy("security_id", "trade_date").agg(
            F.min_by("p", "seq").alias("open"),
            F.max("p").alias("high"),
            F.min("p").alias("low"),
            F.max_by("p", "seq").alias("close"),
            (F.sum("l_quantity") * 100).cast("bigint").alias("volume"),
            F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("amount"),
        )

    @cached_property
    def listing(self) -> DataFrame:
        """Supplier-derived identity columns, one row per security."""
        slot = F.col("s_nationkey") % 4
        number = F.concat(
            F.when(slot == 0, "600").when(slot == 1, "300").when(slot == 2, "688").otherwise("830"),
            F.when(F.length(F.col("s_suppkey").cast("string")) < 3,
                   F.lpad(F.col("s_suppkey").cast("string"), 3, "0")).otherwise(F.col("s_suppkey").cast("string")),
        )
        suffix = F.when(slot == 1, ".SZ").when(slot == 3, ".BJ").otherwise(".SH")
        st = F.col("s_acctbal") < 0
        return self.table("supplier").select(
            F.col("s_suppkey").cast("int").alias("security_id"),
            F.concat(number, suffix).alias("exchange_code"),
            F.concat(F.when(st, "ST ").otherwise(""), F.col("s_name")).alias("name"),
            F.when(slot == 0, "main").when(slot == 1, "gem").when(slot == 2, "star").otherwise("bse").alias("board"),
            st.cast("int").alias("is_st"),
        )

    @cached_property
    def master(self) -> DataFrame:
        first = self._traded.groupBy("security_id").agg(F.min("trade_date").alias("list_date"))
        return self.listing.join(first, "security_id", "left").select(
            "*",
            F.lit(None).cast("date").alias("delist_date"),
            F.col("list_date").alias("valid_from"),
            F.lit("2099-12-31").cast("date").alias("valid_to"),
        )

    @cached_property
    def _dated_bars(self) -> DataFrame:
        w = Window.partitionBy("security_id").orderBy("trade_date")
        return self.raw_bars.select(
            "*",
            F.coalesce(F.lag("close").over(w), F.col("close")).alias("pre_close"),
            (1.0 + 0.05 * (F.year("trade_date") - 1995)).alias("adj_factor"),
            ((F.col("security_id") + F.dayofmonth("trade_date")) % 29 == 0).cast("int").alias("is_suspended"),
        )

    @cached_property
    def bars(self) -> DataFrame:
        return self._dated_bars.join(self.listing.select("security_id", "is_st"), "security_id")

    @cached_property
    def limited_bars(self) -> DataFrame:
        """Bars with their limit prices, as the service table has them."""
        named = self.listing.select("security_id", "is_st", "board", "exchange_code")
        return self._dated_bars.join(named, "security_id").withColumns({
            "up_limit": mk.up_limit(F.col("pre_close"), F.col("board"), F.col("is_st")),
            "down_limit": mk.down_limit(F.col("pre_close"), F.col("board"), F.col("is_st")),
        })

    @cached_property
    def basic(self) -> DataFrame:
        odd = (F.col("security_id") + F.dayofmonth("trade_date")) % 17 == 0
        return self.raw_bars.select(
            "security_id", "trade_date",
            (F.col("close") * (1000 + F.col("security_id")) / 10.0).alias("total_mv"),
            # A power of two keeps the sums exact, so equal means tie in every engine.
            F.when(~odd, F.col("volume") / 1024.0).alias("turnover_rate"),
        )

    @cached_property
    def calendar_days(self) -> DataFrame:
        """Every date of the span with an open flag (open = somebody traded)."""
        open_days = self._traded.select("trade_date").distinct()
        span = open_days.agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("b"))
        every = span.select(F.explode(F.sequence("a", "b")).alias("cal_date"))
        return every.join(open_days, every.cal_date == open_days.trade_date, "left").select(
            "cal_date", F.col("trade_date").isNotNull().cast("int").alias("is_open")
        )

    @cached_property
    def index_snapshots(self) -> DataFrame:
        month = F.trunc("trade_date", "month")
        return (
            self.raw_bars.groupBy("security_id", month.alias("as_of_date")).count().where("count >= 6")
            .join(self.listing.select("security_id", "exchange_code"), "security_id")
            .select(F.lit(INDEX_CODE).alias("index_code"), "exchange_code", "as_of_date")
        )

    @cached_property
    def industry_snapshots(self) -> DataFrame:
        """Leading brand per security and quarter: most trades, then the smaller name."""
        quarter = F.trunc("trade_date", "quarter").alias("as_of_date")
        brand = self.table("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("industry"))
        # Counted per part first: a part traded in a third of all rows is then a few rows per security.
        parts = self.trades.groupBy("security_id", quarter, "l_partkey").count()
        counts = parts.join(brand, "l_partkey").groupBy("security_id", "as_of_date", "industry").agg(F.sum("count").alias("count"))
        lead = counts.groupBy("security_id", "as_of_date").agg(
            F.min(F.struct((-F.col("count")).alias("n"), "industry")).alias("best")
        )
        return lead.join(self.listing.select("security_id", "exchange_code"), "security_id").select(
            "exchange_code", F.lit("sw_l1").alias("level"), F.col("best.industry").alias("industry"), "as_of_date"
        )

    @cached_property
    def statement_rows(self) -> DataFrame:
        """First disclosures plus corrections, plain item columns."""
        money = F.col("l_extendedprice").cast("decimal(18,2)")
        net = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")
        quarter_end = F.date_sub(F.add_months(F.trunc("trade_date", "quarter"), 3), 1)
        q = self.trades.groupBy("security_id", quarter_end.alias("report_date")).agg(
            F.sum(money).cast("double").alias("revenue"),
            (F.sum(net).cast("double") * 0.1).alias("net_profit"),
        )
        kinds = F.when(
            (F.col("security_id") + F.quarter("report_date")) % 5 == 0, F.array(F.lit(0), F.lit(1))
        ).otherwise(F.array(F.lit(0)))
        shrink = F.when(F.col("update_flag") == 1, 0.9).otherwise(1.0)
        return q.withColumn("update_flag", F.explode(kinds)).select(
            "security_id", "report_date",
            F.expr(
                "date_add(report_date, (case when update_flag = 1 then 65 else 20 end)"
                " + (security_id * 7 + month(report_date)) % 60)"
            ).alias("ann_date"),
            "update_flag",
            (F.col("revenue") * shrink).alias("revenue"),
            (F.col("net_profit") * shrink).alias("net_profit"),
            (F.col("revenue") * 3 * shrink).alias("equity"),
        )

    @cached_property
    def statements(self) -> DataFrame:
        return self.statement_rows.select(
            "security_id", "ann_date", "report_date", F.lit("income").alias("stmt_type"), "update_flag",
            v.item_map({c: F.col(c) for c in ("revenue", "net_profit", "equity")}).alias("fields"),
        )

    @cached_property
    def name_snapshots(self) -> DataFrame:
        """Monthly names, learnt 35 days on: ST after few trading days; every fifth is corrected to the plain name 120 days on."""
        month = F.trunc("trade_date", "month").alias("as_of_date")
        seen = self.raw_bars.groupBy("security_id", month).agg(F.count("*").alias("n")).join(
            self.listing.select("security_id", "exchange_code"), "security_id")
        first = seen.select("security_id", "exchange_code", "as_of_date", F.date_add("as_of_date", 35).alias("known_on"),
                            F.concat(F.when(F.col("n") <= 5, "ST ").otherwise(""), F.col("exchange_code")).alias("name"))
        fixed = seen.where((F.col("security_id") + F.month("as_of_date")) % 5 == 0).select(
            "security_id", "exchange_code", "as_of_date", F.date_add("as_of_date", 120).alias("known_on"), F.col("exchange_code").alias("name"))
        return first.unionByName(fixed)

    @cached_property
    def suspensions(self) -> DataFrame:
        """Landed suspension rows, on other days than the bar flag."""
        return self.raw_bars.where(
            (F.col("security_id") + F.dayofmonth("trade_date")) % 31 == 0
        ).select("security_id", F.col("trade_date").alias("suspend_date"))

    # ---- derived service tables -------------------------------------------------

    @cached_property
    def calendar(self) -> DataFrame:
        return cal.build(self.calendar_days)

    @cached_property
    def days(self) -> DataFrame:
        return cal.open_days(self.calendar)

    @cached_property
    def members(self) -> DataFrame:
        return build.index_members(self.index_snapshots, self.listing)

    @cached_property
    def industries(self) -> DataFrame:
        return build.industry_members(self.industry_snapshots, self.listing)

    def factors(self, *names: str) -> DataFrame:
        """Factor table with the look-back bound of the longest factor (bars are sparse here)."""
        wanted = list(names) or None
        wide_bound = fct.lookback_days(60)
        parts = fct.compute(self.bars, self.basic, self.statements, names=wanted, bound=wide_bound)
        return parts

    def stored_factors(self, *names: str) -> DataFrame:
        """The factor table written once and read back, as a job finds it that ranks it: in buckets of securities."""
        return bucketed(self.factors(*names), "factors", "security_id", ["factor_name", "trade_date"])

    @cached_property
    def execution(self) -> DataFrame:
        return pr.execution_frame(self.limited_bars, self.suspensions)

    @cached_property
    def versions(self) -> DataFrame:
        """Published versions: every trading day but the 13th and 26th, with the day's bar count."""
        counts = self.raw_bars.groupBy("trade_date").agg(F.count("*").alias("row_count"))
        return counts.where(F.dayofmonth("trade_date") % 13 != 0).select(
            F.lit("daily_bar").alias("dataset"), F.date_format("trade_date", "yyyy-MM-dd").alias("version"), "row_count",
            F.lit(None).cast("timestamp").alias("published"), F.lit("").alias("note"),
        )
