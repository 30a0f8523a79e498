"""Service tables on Parquet: partitioned appends, day replacement, artefact listings."""

from __future__ import annotations

import datetime as dt

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession, Window, functions as F

from barloom.functions import values as v
from barloom.schemas import LAYOUT, LEADING, SORT_KEYS, table as table_schema
from barloom.sources.lake import delete_path, list_paths, path_exists

# artefact kind -> keys (its partition columns)
ARTEFACT_KEYS = {
    "run": ["run_id"], "equity": ["run_id"], "experiment_run": ["experiment_id"], "signal": ["asof", "signal_id"],
    "signal_meta": ["asof", "signal_id"], "monitor": ["trade_date"], "session": ["session_id"],
    "session_position": ["session_id"], "session_order": ["session_id"], "mark": ["session_id", "mark_date"],
}


def table_path(root: str, name: str) -> str:
    return f"{root}/tables/{name}"


def read(spark: SparkSession, root: str, name: str, *, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """A service table; a date range also prunes its partitions."""
    df = spark.read.parquet(table_path(root, name))
    if name in LAYOUT:
        day, part, unit = LAYOUT[name]
        if start is not None:
            df = df.where((F.col(day) >= F.lit(start)) & (F.col(part) >= F.lit(_unit_start(start, unit))))
        if end is not None:
            df = df.where((F.col(day) <= F.lit(end)) & (F.col(part) <= F.lit(_unit_start(end, unit))))
        df = df.drop(part)
    return v.null_nan(df)


def query(spark: SparkSession, sql: str, **params) -> DataFrame:
    """Parameterised SQL; values are bound, never spliced into the text."""
    return spark.sql(sql, args=params)


def partition_columns(name: str) -> list[str]:
    """Partition levels of a table."""
    if name in LAYOUT:
        return LEADING.get(name, []) + [LAYOUT[name][1]]
    return {"index_member": ["index_code"], "industry_member": ["level"]}.get(name, ARTEFACT_KEYS.get(name, []))


def _laid_out(df: DataFrame, name: str, by: list[str]) -> DataFrame:
    """Cluster rows by partition and sort inside for row-group pruning.

    The rebalance hint lets AQE split a partition that is too large for one
    task (a hot day) and merge small ones, instead of one file per task and partition.
    """
    if name in LAYOUT:
        day, part, unit = LAYOUT[name]
        df = df.withColumn(part, F.to_date(F.date_trunc(unit, day)))
    if not by:
        return df
    sort = [c for c in SORT_KEYS.get(name, []) if c not in by]
    return df.hint("rebalance", *by).sortWithinPartitions(*by, *sort)


def _writer(df: DataFrame, name: str, by: list[str], mode: str):
    out = _laid_out(df, name, by).write.mode(mode)
    return out.partitionBy(*by) if by else out


def _observed(seen: Observation, name: str, default):
    """Observed metric of a finished write; a plan known to be empty is dropped along with its observation."""
    try:
        return seen.get[name]
    except Py4JJavaError:
        return default


def append(df: DataFrame, root: str, name: str) -> int:
    """Append rows and return their number; nothing to append is 0."""
    seen = Observation("append")
    rows = df.observe(seen, F.count(F.lit(1)).alias("n"))
    _writer(rows, name, partition_columns(name), "append").parquet(table_path(root, name))
    return int(_observed(seen, "n", 0))


def write_partitioned(df: DataFrame, root: str, name: str, by: list[str] | None = None) -> None:
    """Replace exactly the partitions present in `df` (dynamic overwrite)."""
    by = by or partition_columns(name)
    _writer(df, name, by, "overwrite").option("partitionOverwriteMode", "dynamic").parquet(table_path(root, name))


def _unit_start(d: dt.date, unit: str) -> dt.date:
    return {"day": d, "month": d.replace(day=1), "year": d.replace(month=1, day=1)}[unit]


def _replace(df: DataFrame, root: str, name: str, days: list[dt.date], leading: dict[str, list[str]], keep_when_empty: bool) -> None:
    """Rewrite the partitions the days fall in: their other days stay, the named ones become `df`'s rows.

    Dynamic overwrite swaps partitions at commit, so the old rows can be read by
    the same job. Partitions left without any row are dropped afterwards.
    """
    spark = df.sparkSession
    day, part, unit = LAYOUT[name]
    parts = sorted({_unit_start(d, unit) for d in days})
    rows = df.where(F.col(day).isin(*days))
    for column, values in leading.items():
        rows = rows.where(F.col(column).isin(*values))
    if keep_when_empty:
        # A day without new rows keeps its old ones. The caller names the days, so this list is as short as theirs.
        days = [r[0] for r in rows.select(day).distinct().collect()]
        parts = sorted({_unit_start(d, unit) for d in days})
        if not days:
            return
    if unit != "day" and path_exists(spark, table_path(root, name)):
        old = spark.read.parquet(table_path(root, name)).where(F.col(part).isin(*parts) & ~F.col(day).isin(*days))
        for column, values in leading.items():
            old = old.where(F.col(column).isin(*values))
        rows = rows.unionByName(old.select(*rows.columns))
    seen = Observation("replaced")
    keys = partition_columns(name)
    marked = rows.withColumn(part, F.to_date(F.date_trunc(unit, day)))
    write_partitioned(marked.observe(seen, F.collect_set(F.struct(*keys)).alias("filled")).drop(part), root, name)
    # One entry per rewritten partition; the caller's days and keys bound them.
    filled = {tuple(str(x) for x in r) for r in _observed(seen, "filled", [])}
    for d in parts:
        levels = [f"{k}={{{','.join(leading[k])}}}" if k in leading else f"{k}=*" for k in keys[:-1]] + [f"{part}={d}"]
        for path in list_paths(spark, "/".join([table_path(root, name), *levels])):
            have = tuple(level.split("=", 1)[1] for level in path.split("/")[-len(keys):])
            if have not in filled:
                delete_path(spark, path)


def replace_days(df: DataFrame, root: str, name: str, days: list[dt.date], *, keep_when_empty: bool = False) -> None:
    """Idempotent replacement of whole days.

    A day without rows is cleared, unless `keep_when_empty`, the rule for statements.
    """
    _replace(df, root, name, days, {}, keep_when_empty)


def replace_factor_days(df: DataFrame, root: str, names: list[str], version: str, days: list[dt.date]) -> None:
    """Replace (factor, version, day) slices; other factors, versions and days stay."""
    _replace(df, root, "factor_value", days, {"factor_name": names, "version": [version]}, False)


def replace_intervals(df: DataFrame, root: str, name: str, key: str) -> None:
    """Replace all interval rows of the index codes (or levels) present in `df`."""
    write_partitioned(df, root, name, [key])


def overwrite(df: DataFrame, root: str, name: str) -> None:
    """Truncate and insert (security master)."""
    df.write.mode("overwrite").parquet(table_path(root, name))


def latest_rows(df: DataFrame, key: list[str], load_order: str = "load_ts") -> DataFrame:
    """Replacing-table read: the last write per key wins (one aggregate; the rows of a key are reduced before the shuffle)."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), load_order).alias("__r")).select(*key, "__r.*")


def keep_last(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Keep the last row per key under an explicit order (few rows per key)."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


# ---- artefacts: runs, experiments, signals, monitor reports, sessions, marks

def save_artefact(df: DataFrame, root: str, kind: str) -> None:
    """Store an artefact; the same id (and mark day) again replaces the earlier one."""
    write_partitioned(df, root, kind)


def load_artefact(spark: SparkSession, root: str, kind: str, **where) -> DataFrame:
    df = spark.read.parquet(table_path(root, kind))
    for column, value in where.items():
        df = df.where(F.col(column) == F.lit(value))
    return df


def list_artefacts(spark: SparkSession, root: str, kind: str, limit: int = 50, **where) -> DataFrame:
    """Newest first by created_at where there is one, else by the artefact's keys."""
    df = load_artefact(spark, root, kind, **where)
    order = ["created_at"] if "created_at" in df.columns else ARTEFACT_KEYS[kind]
    return df.orderBy(*[F.desc(c) for c in order]).limit(limit)


def pack_run(metrics: DataFrame, meta: DataFrame, keys: list[str]) -> DataFrame:
    """Run row: keys, created_at and the metrics and meta data as JSON text."""
    figures = [c for c in metrics.columns if c not in keys]
    info = [c for c in meta.columns if c not in keys + ["created_at"]]
    m = metrics.select(*keys, F.to_json(F.struct(*figures)).alias("metrics_json"))
    i = meta.select(*keys, "created_at", F.to_json(F.struct(*info)).alias("meta_json"), *info)
    return i.join(m, keys, "left")


METRIC_KEYS = (
    "total_return", "ann_return", "sharpe", "max_drawdown", "turnover", "excess_total", "info_ratio", "n_fills", "n_rejects",
)


def metric_matrix(runs: DataFrame, limit: int = 20, factor: str | None = None) -> DataFrame:
    """Latest runs with a fixed list of metrics unpacked from their JSON."""
    rows = runs if factor is None else runs.where(F.col("factor") == factor)
    schema = ", ".join(f"{k} double" for k in METRIC_KEYS)
    head = rows.orderBy(F.desc("created_at")).limit(limit)
    return head.select(
        "run_id", "created_at", *[c for c in ("factor", "universe") if c in runs.columns],
        F.from_json("metrics_json", schema).alias("m"),
    ).select("*", "m.*").drop("m")


def prefer(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Rows of the first listing, plus those of the second whose key the first lacks."""
    return first.unionByName(second.join(first.select(key), key, "left_anti"), allowMissingColumns=True)


def read_summary_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Legacy experiment summaries."""
    return spark.read.schema(schema).option("header", "true").csv(path)


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], table_schema(name))
