"""Point-in-time reads as SQL table functions over the service tables.

After `register` a session's SQL can say `SELECT * FROM members_on('IDX_A', DATE '1997-06-30')`. Each function is one SQL body that Spark
inlines, so its filters reach the scans and it joins like any other relation; no Python runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name -> (parameters, result columns, body); tables are the views of `register`.
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "members_on": (
        "idx STRING, d DATE", "security_id INT, exchange_code STRING",
        "SELECT DISTINCT m.security_id, m.exchange_code FROM pit_members m WHERE m.index_code = idx AND m.in_date <= d AND m.out_date > d",
    ),
    "industry_on": (
        "lvl STRING, d DATE", "security_id INT, industry STRING",
        """SELECT i.security_id, min_by(i.industry, struct(i.in_date, i.industry)) AS industry FROM pit_industries i
           WHERE i.level = lvl AND i.in_date <= d AND i.out_date > d GROUP BY i.security_id""",
    ),
    "price_on": (
        "d DATE", "security_id INT, close DOUBLE, post_close DOUBLE, tradable BOOLEAN",
        """SELECT b.security_id, b.close, b.close * b.adj_factor AS post_close, coalesce(b.is_suspended, 0) = 0 AS tradable
           FROM pit_bars b WHERE b.trade_date = d""",
    ),
    "last_price_by": (
        "d DATE", "security_id INT, trade_date DATE, close DOUBLE",
        """SELECT b.security_id, max(b.trade_date) AS trade_date, max_by(b.close, b.trade_date) AS close FROM pit_bars b
           WHERE b.trade_date <= d GROUP BY b.security_id""",
    ),
    "visible_item": (
        "item STRING, d DATE", "security_id INT, value DOUBLE",
        """SELECT e.security_id, max_by(e.v, struct(e.report_date, e.ann_date, e.update_flag)) AS value
           FROM (SELECT s.security_id, s.report_date, s.ann_date, s.update_flag, explode(s.fields) AS (k, v) FROM pit_statements s) e
           WHERE e.k = item AND e.ann_date <= d GROUP BY e.security_id""",
    ),
    "universe_on": (
        "idx STRING, d DATE, min_listed_days INT", "security_id INT, exchange_code STRING",
        """SELECT m.security_id, m.exchange_code FROM members_on(idx, d) m JOIN pit_bars b ON b.security_id = m.security_id AND b.trade_date = d
           JOIN pit_master s ON s.security_id = m.security_id
           WHERE coalesce(b.is_suspended, 0) <> 1 AND coalesce(b.is_st, 0) <> 1 AND s.list_date <= date_sub(d, min_listed_days)""",
    ),
}


def register(spark: SparkSession, *, bars: DataFrame, master: DataFrame, members: DataFrame, industries: DataFrame, statements: DataFrame) -> None:
    """Names the tables (bars, master: one row per security, members, industries, statements) and defines the functions on them."""
    for name, table in (("bars", bars), ("master", master), ("members", members), ("industries", industries), ("statements", statements)):
        table.createOrReplaceTempView(f"pit_{name}")
    for name, (parameters, columns, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({columns}) RETURN {body}")
