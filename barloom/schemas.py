"""Column types of landed datasets and service tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# dataset -> "name type, ..." (fixed column lists of the landed datasets)
LANDED = {
    "daily_bar": "exchange_code string, trade_date date, open double, high double, low double, "
                 "close double, pre_close double, volume bigint, amount double",
    "adj_factor": "exchange_code string, trade_date date, adj_factor double",
    "daily_basic": "exchange_code string, trade_date date, turnover_rate double, total_share double, "
                   "float_share double, total_mv double, circ_mv double, pe_ttm double, pb double",
    "suspend": "exchange_code string, suspend_date date",
    "stock_basic": "exchange_code string, symbol string, name string, list_date date, delist_date date",
    "income": "exchange_code string, ann_date date, report_date date, update_flag int, revenue double, "
              "n_income_attr_p double, basic_eps double, operate_profit double",
    "balancesheet": "exchange_code string, ann_date date, report_date date, update_flag int, "
                    "total_assets double, total_liab double, total_hldr_eqy_exc_min_int double",
    "cashflow": "exchange_code string, ann_date date, report_date date, update_flag int, "
                "n_cashflow_act double, n_cashflow_inv_act double, n_cash_flows_fnc_act double",
    "realtime_quote": "exchange_code string, name string, price double, open double, high double, "
                      "low double, pre_close double, volume double, amount double, bid double, "
                      "ask double, time string, snapshot_ts timestamp",
    "index_member": "index_code string, exchange_code string, in_date date, as_of_date date, "
                    "confidence string",
    "industry_member": "exchange_code string, level string, industry string, as_of_date date, "
                       "confidence string",
}

TABLES = {
    "security_master": "security_id int, exchange_code string, name string, list_date date, "
                       "delist_date date, board string, valid_from date, valid_to date",
    "trade_calendar": "cal_date date, is_open int, prev_open date, next_open date",
    "daily_bar": "trade_date date, security_id int, open double, high double, low double, close double, "
                 "pre_close double, volume bigint, amount double, adj_factor double, up_limit double, "
                 "down_limit double, is_suspended int, is_st int",
    "daily_basic": "trade_date date, security_id int, total_share double, float_share double, "
                   "total_mv double, circ_mv double, turnover_rate double, pe_ttm double, pb double",
    "fin_statement": "security_id int, ann_date date, report_date date, stmt_type string, "
                     "update_flag int, fields map<string,double>",
    "suspend": "security_id int, suspend_date date, resume_date date",
    "index_member": "index_code string, security_id int, in_date date, out_date date",
    "industry_member": "security_id int, level string, industry string, in_date date, out_date date",
    "factor_value": "trade_date date, security_id int, factor_name string, version string, value double",
    "dataset_version": "dataset string, version string, row_count bigint, published timestamp, note string",
}

# table -> (day column, partition column, unit). The unit is a size choice: replacing a
# day rewrites its partition, so a table with very large days takes the unit "day".
LAYOUT = {
    "daily_bar": ("trade_date", "month", "month"),
    "daily_basic": ("trade_date", "month", "month"),
    "fin_statement": ("ann_date", "ann_year", "year"),
    "suspend": ("suspend_date", "month", "month"),
    "factor_value": ("trade_date", "month", "month"),
}
# leading partition columns before the date unit
LEADING = {"factor_value": ["factor_name", "version"]}
SORT_KEYS = {
    "daily_bar": ["security_id", "trade_date"],
    "daily_basic": ["security_id", "trade_date"],
    "fin_statement": ["security_id", "ann_date", "report_date"],
    "factor_value": ["trade_date", "security_id"],
}


def landed(dataset: str) -> T.StructType:
    return T.StructType.fromDDL(LANDED[dataset])


def table(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select exactly the schema's columns; absent ones become null."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema
    ])


def require(df: DataFrame, names: set[str], what: str) -> DataFrame:
    missing = names - set(df.columns)
    if missing:
        raise ValueError(f"{what}: missing columns {sorted(missing)}")
    return df
