"""Quote streams: latest quote per code, bars per window, incremental landing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from barloom.schemas import landed


def read_quotes(spark: SparkSession, path: str, *, schema: T.StructType | None = None,
                files_per_trigger: int | None = None, file_glob: str | None = None) -> DataFrame:
    """File stream over a folder of landed snapshots (dt= / ts= partitions or plain files)."""
    reader = spark.readStream.schema(schema or landed("realtime_quote"))
    if file_glob:
        reader = reader.option("pathGlobFilter", file_glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


ONCE = {"availableNow": True}


def latest_per_code(quotes: DataFrame, *, code: str = "exchange_code", ts: str = "snapshot_ts") -> DataFrame:
    """Newest quote per code; a snapshot that arrives late but is older changes nothing.

    The state is one row per code, so it needs no watermark.
    """
    rest = [c for c in quotes.columns if c not in (code, ts)]
    # The remaining columns break ties between snapshots of the same instant.
    return quotes.groupBy(code).agg(F.max(F.struct(ts, *rest)).alias("q")).select(code, "q.*")


#: Buckets of the latest-quote folder; a batch rewrites those in which a quote changes.
BUCKETS = 64


def start_latest(quotes: DataFrame, table: str, checkpoint: str, *, code: str = "exchange_code",
                 ts: str = "snapshot_ts", trigger: dict | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """Keep the latest quote per code in a folder `table/v=<batch>/bucket=<hash of the code>`.

    The folder is the state: each batch is reduced to its newest quote per code, met with the newest version of the buckets it
    touches, and the buckets in which a quote really changed are written anew under the batch's number; a late, older snapshot
    changes nothing and writes nothing. A replayed batch rewrites its own version, so the sink is idempotent. Of each bucket the two
    newest versions stay, for readers under way. `trigger` as for a stream writer, e.g. {"processingTime": "1 minute"}; by
    default it takes what is there and stops. `buckets` must not change over the life of a folder.
    """
    columns = quotes.columns
    place = F.pmod(F.xxhash64(code), F.lit(buckets)).cast("int")

    def upsert(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = latest_per_code(batch.select(*columns), code=code, ts=ts).withColumn("bucket", place).persist()
        try:
            kept = bucket_versions(spark, table, before=batch_id)
            touched = [r.bucket for r in fresh.select("bucket").distinct().collect()]  # numbers of buckets
            held = _read(spark, table, {b: kept[b][:1] for b in touched if b in kept}, fresh.schema)
            old = held.select(code, F.struct(ts, *[c for c in columns if c not in (code, ts)]).alias("__old"))
            new = F.struct(ts, *[c for c in columns if c not in (code, ts)])
            moved = fresh.join(old, code, "left").where(F.col("__old").isNull() | (new > F.col("__old"))).drop("__old")
            changed = [r.bucket for r in moved.select("bucket").distinct().collect()]
            if not changed:
                return
            stay = held.where(F.col("bucket").isin(*changed)).join(moved.select(code), code, "left_anti")
            out = moved.select(*columns, "bucket").unionByName(stay.select(*columns, "bucket"))
            out.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/v={batch_id}")
            for b in changed:
                for v in kept.get(b, [])[1:]:
                    _delete(spark, f"{table}/v={v}/bucket={b}")
        finally:
            fresh.unpersist()

    return quotes.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(**(trigger or ONCE)).start()


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def _numbered(spark: SparkSession, path: str, prefix: str) -> list[int]:
    fs, p = _fs(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted((int(n.removeprefix(prefix)) for n in names if n.startswith(prefix)), reverse=True)


def bucket_versions(spark: SparkSession, table: str, *, before: int | None = None) -> dict[int, list[int]]:
    """Complete versions (those with a success marker) of each bucket, newest first."""
    out: dict[int, list[int]] = {}
    for v in _numbered(spark, table, "v="):
        fs, done = _fs(spark, f"{table}/v={v}/_SUCCESS")
        if (before is None or v < before) and fs.exists(done):
            for b in _numbered(spark, f"{table}/v={v}", "bucket="):
                out.setdefault(b, []).append(v)
    return out


def _read(spark: SparkSession, table: str, chosen: dict[int, list[int]], schema: T.StructType) -> DataFrame:
    paths = [f"{table}/v={v[0]}/bucket={b}" for b, v in chosen.items()]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.option("basePath", table).schema(schema).parquet(*paths).select(*schema.names)


def read_latest(spark: SparkSession, table: str) -> DataFrame:
    """The newest quote of every code."""
    newest = bucket_versions(spark, table)
    paths = [f"{table}/v={v[0]}/bucket={b}" for b, v in newest.items()]
    return spark.read.option("basePath", table).parquet(*paths).drop("v", "bucket")


def quote_view(latest: DataFrame, codes: list[str] | None = None, limit: int = 500, *, code: str = "exchange_code") -> DataFrame:
    """The served view: asked codes, at most `limit` rows."""
    rows = latest
    if codes:
        rows = rows.where(F.upper(F.col(code)).isin(*[c.strip().upper() for c in codes if c.strip()]))
    return rows.orderBy(code).limit(limit)


def window_bars(quotes: DataFrame, *, code: str, price: str, ts: str, size: str = "5 minutes", slide: str | None = None,
                delay: str = "10 minutes", volume: Column | None = None, tie: list[str] | None = None) -> DataFrame:
    """open/high/low/close/volume per code and event-time window, tumbling or sliding.

    In append mode a window is emitted once the watermark passes its end; later
    rows for it are dropped.
    """
    order = F.struct(ts, *(tie or [price]))
    bucket = F.window(ts, size, slide) if slide else F.window(ts, size)
    return quotes.withWatermark(ts, delay).groupBy(bucket.alias("w"), code).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.max_by(price, order).alias("close"), F.sum(volume if volume is not None else F.lit(1)).alias("volume"),
    ).select(code, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "open", "high", "low", "close", "volume")


def sessions(quotes: DataFrame, *, code: str, price: str, ts: str, gap: str = "30 minutes", delay: str = "10 minutes",
             tie: list[str] | None = None) -> DataFrame:
    """open/high/low/close/ticks per code and session: quotes less than `gap` apart belong together.

    A session ends `gap` after its last quote. On a stream in append mode a late quote may still join two sessions; they are emitted once
    the watermark passes the end, and quotes behind it are dropped. On a table the same rows come out at once.
    """
    order = F.struct(ts, *(tie or [price]))
    rows = quotes.withWatermark(ts, delay) if quotes.isStreaming else quotes
    return rows.groupBy(F.session_window(ts, gap).alias("w"), code).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.max_by(price, order).alias("close"), F.count("*").alias("ticks"),
    ).select(code, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "open", "high", "low", "close", "ticks")


def start_to_parquet(df: DataFrame, path: str, checkpoint: str, *, partition_by: list[str] | None = None,
                     trigger: dict | None = None) -> StreamingQuery:
    """Append a stream to Parquet, by default everything available now, then stop; the checkpoint is the watermark."""
    writer = df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.trigger(**(trigger or ONCE)).start()


def incremental(spark: SparkSession, source: str, target: str, checkpoint: str, schema: T.StructType, *,
                file_glob: str | None = None) -> StreamingQuery:
    """Incremental sync of a landed dataset: only files not seen before are appended to the target."""
    return start_to_parquet(read_quotes(spark, source, schema=schema, file_glob=file_glob), target, checkpoint)
