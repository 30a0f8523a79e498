"""Landed (raw) partitions: source / dataset / dt, replaced as a whole, never edited."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F, types as T

from barloom import rules
from barloom.functions import values as v
from barloom.schemas import LANDED, conform, landed


def dataset_path(root: str, dataset: str) -> str:
    """One directory per dataset, so a reader sees one schema."""
    return f"{root}/raw/dataset={dataset}"


def manifest_path(root: str) -> str:
    return f"{root}/meta/manifest"


def delete_path(spark: SparkSession, path: str) -> bool:
    """Remove a directory through the Hadoop file system of the path."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def list_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Paths matching a glob (used on partition directories named by the caller)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return [s.getPath().toString() for s in found or []]


def write_raw(df: DataFrame, root: str, dataset: str, *, source: str | None = None, day: str | None = None) -> None:
    """Write the partitions present in `df` (columns source, dt) or one named partition.

    A named partition is replaced even by an empty frame, which records "no rows
    that day"; a frame without columns is refused.
    """
    if not df.columns:
        raise ValueError(f"refusing to land a frame without columns: {dataset}")
    spark = df.sparkSession
    if day is not None:
        rows = df.drop("source", "dt")
        if not rows.columns:
            raise ValueError(f"refusing to land a frame without columns: {dataset}")
        path = f"{dataset_path(root, dataset)}/source={source}/dt={day}"
        rows.write.mode("overwrite").parquet(path)
        rows = spark.read.schema(rows.schema).parquet(path)  # what the manifest says is about what was written
        written = spark.createDataFrame([(source, day)], "source string, dt string")
        counts = rows.agg(F.count("*").alias("rows"), v.content_print(rows).alias("fingerprint"))
        entry = written.select("*", counts.select(F.struct("*")).scalar().alias("c")).select("source", "dt", "c.*")
    else:
        named = df.withColumn("source", F.lit(source)) if source is not None else df
        key = F.struct(F.col("source").cast("string").alias("source"), F.col("dt").cast("string").alias("dt"))
        seen = Observation()  # the partitions met while writing: one computation of the rows, and what is counted is what was written
        (
            named.observe(seen, F.collect_set(key).alias("parts")).hint("rebalance", "source", "dt")
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source", "dt").parquet(dataset_path(root, dataset))
        )
        parts = [(p["source"], p["dt"]) for p in seen.get["parts"]]
        if not parts:
            return
        body = [c for c in named.columns if c not in ("source", "dt")]
        shape = T.StructType([f for f in named.schema.fields if f.name in body] + [T.StructField(c, T.StringType()) for c in ("source", "dt")])
        back = spark.read.schema(shape).parquet(dataset_path(root, dataset))
        near = F.col("source").isin(*{p[0] for p in parts}) & F.col("dt").isin(*{p[1] for p in parts})  # prunes folders
        back = back.where(near).join(spark.createDataFrame(parts, "source string, dt string"), ["source", "dt"], "left_semi")
        entry = back.groupBy("source", F.col("dt").cast("string").alias("dt")).agg(
            F.count("*").alias("rows"), v.print_of(*body).alias("fingerprint")
        )
    append_manifest(entry.withColumn("dataset", F.lit(dataset)), root)


def append_manifest(entries: DataFrame, root: str) -> None:
    entries.select(
        F.current_timestamp().alias("ts"), "source", "dataset", "dt", "rows", "fingerprint"
    ).write.mode("append").parquet(manifest_path(root))


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(manifest_path(root))


def _landed_schema(dataset: str) -> T.StructType:
    return T.StructType(landed(dataset).fields + [T.StructField("source", T.StringType()), T.StructField("dt", T.DateType())])


def scan(spark: SparkSession, root: str, dataset: str) -> DataFrame:
    """All sources and days of a dataset; NaN becomes null, absent columns are null."""
    path = dataset_path(root, dataset)
    if dataset in LANDED:
        return v.null_nan(spark.read.schema(_landed_schema(dataset)).parquet(path))
    return v.null_nan(spark.read.option("mergeSchema", "true").parquet(path))


def read_raw(spark: SparkSession, root: str, dataset: str, source: str, day: str) -> DataFrame:
    """One partition; an absent one is an error (an empty one is not)."""
    if not path_exists(spark, f"{dataset_path(root, dataset)}/source={source}/dt={day}"):
        raise FileNotFoundError(f"no landed partition {source}/{dataset}/dt={day}")
    return scan(spark, root, dataset).where((F.col("source") == source) & (F.col("dt") == F.lit(day).cast("date")))


def row_counts(spark: SparkSession, root: str, dataset: str, grid: DataFrame) -> DataFrame:
    """Rows per (source, dt) of the grid: null = never landed, 0 = landed empty.

    Presence comes from the manifest, rows from the partitions: counting reads no column, only file footers.
    """
    landed_days = read_manifest(spark, root).where(F.col("dataset") == dataset).select("source", F.to_date("dt").alias("dt")).distinct()
    rows = scan(spark, root, dataset).groupBy("source", F.to_date("dt").alias("dt")).agg(F.count("*").alias("n"))
    have = landed_days.join(rows, ["source", "dt"], "left").select("source", "dt", F.coalesce("n", F.lit(0)).alias("n"))
    return grid.select("source", "dt").join(have, ["source", "dt"], "left").withColumn("dataset", F.lit(dataset))


def priorities(spark: SparkSession, sources: list[str]) -> DataFrame:
    return spark.createDataFrame([(s, i) for i, s in enumerate(sources)], "source string, priority int")


def candidate_order(preferred: list[str], known: list[str]) -> list[str]:
    """Preferred sources first, then every other known one, each once."""
    return list(dict.fromkeys(preferred + known))


def pick_source(rows: DataFrame, order: DataFrame, *, by: list[str] | None = None) -> DataFrame:
    """First source in the candidate order that has the partition wins.

    The winner is found on the partition list (one row per source and day), so
    the rows themselves are neither sorted nor windowed.
    """
    by = by or ["dt"]
    ranked = rows.select(*by, "source").distinct().join(F.broadcast(order), "source")
    best = ranked.groupBy(*by).agg(F.min_by("source", "priority").alias("source"))
    return rows.join(best, by + ["source"], "left_semi")


def fallback_plan(counts: DataFrame, order: DataFrame, datasets: list[str]) -> DataFrame:
    """Source to read per day and dataset under the fallback policy.

    An empty partition falls to the next source except where empty is legal.
    Once a dataset of the day fell back, later datasets stay on that source.
    counts: source, dataset, dt, n (null = absent).
    """
    spark = counts.sparkSession
    seq = spark.createDataFrame([(d, i) for i, d in enumerate(datasets)], "dataset string, ordinal int")
    usable = F.coalesce((F.col("n") > 0) | (F.col("n").isNotNull() & F.col("dataset").isin(*rules.EMPTY_IS_LEGAL)), F.lit(False))
    free = (
        counts.where(usable).join(F.broadcast(order), "source").groupBy("dt", "dataset")
        .agg(F.min("priority").alias("priority"))
        .join(F.broadcast(seq), "dataset")
    )
    # The first fallback (priority > 0) by ordinal pins the rest of the day; a day has few datasets.
    w = Window.partitionBy("dt").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    pinned = F.first(F.when(F.col("priority") > 0, F.col("priority")), ignorenulls=True).over(w)
    chosen = free.withColumn("priority", F.coalesce(pinned, F.col("priority")))
    return chosen.join(F.broadcast(order), "priority").select("dt", "dataset", "source")


def snapshots(spark: SparkSession, root: str, dataset: str, source: str | None = None) -> DataFrame:
    """All landed snapshots of a membership dataset; a missing as_of_date is the partition's day."""
    rows = scan(spark, root, dataset)
    if source is not None:
        rows = rows.where(F.col("source") == source)
    day = F.coalesce("as_of_date", "dt") if "as_of_date" in rows.columns else F.col("dt")
    return rows.withColumn("as_of_date", day)


def by_day(df: DataFrame, day: str = "trade_date") -> DataFrame:
    """Range data of many symbols -> one partition per day (days without rows do not appear)."""
    return df.withColumn("dt", F.col(day))


def _wall_clock(ts: dt.datetime) -> Column:
    """A naive time is wall-clock time in the session's zone, whatever the driver's own zone is."""
    return F.lit(ts) if ts.tzinfo else F.lit(ts.isoformat(sep=" ")).cast("timestamp")


def aligned_quotes(df: DataFrame, snapshot_ts: dt.datetime) -> DataFrame:
    """Quote columns in the registry's order; an existing snapshot time is kept."""
    out = df if "snapshot_ts" in df.columns else df.withColumn("snapshot_ts", _wall_clock(snapshot_ts))
    return conform(out, landed("realtime_quote"))


def quotes_path(root: str, source: str) -> str:
    return f"{root}/realtime/{source}/realtime_quote"


def write_snapshot(df: DataFrame, root: str, source: str, snapshot_ts: dt.datetime) -> None:
    """Land one quote snapshot under dt= / ts=."""
    out = aligned_quotes(df, snapshot_ts)
    ts = _wall_clock(snapshot_ts)
    out.withColumns({"dt": F.to_date(ts), "ts": F.date_format(ts, "HHmmss")}).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("dt", "ts").parquet(quotes_path(root, source))


def _quotes(spark: SparkSession, root: str, source: str) -> DataFrame:
    fields = landed("realtime_quote").fields + [T.StructField("dt", T.DateType()), T.StructField("ts", T.StringType())]
    return spark.read.schema(T.StructType(fields)).parquet(quotes_path(root, source))


def list_snapshots(spark: SparkSession, root: str, source: str, day: str) -> DataFrame:
    return _quotes(spark, root, source).where(F.col("dt") == F.lit(day).cast("date")).select("dt", "ts").distinct().orderBy("ts")


def latest_snapshot(spark: SparkSession, root: str, source: str, day: str) -> DataFrame:
    """Rows of the newest snapshot of a day."""
    rows = _quotes(spark, root, source).where(F.col("dt") == F.lit(day).cast("date"))
    return rows.where(F.col("ts") == rows.agg(F.max("ts")).scalar()).drop("dt", "ts")
