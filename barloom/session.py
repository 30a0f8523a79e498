"""Session and durable-intermediate helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(name: str = "barloom", cores: str = "*", **conf: str) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession) -> str:
    """Shared folder for intermediates: the cluster's `spark.checkpoint.dir`.

    Only where that is unset on one machine (tests) a temporary folder is made, once per Spark context; on a cluster,
    whose executors don't share such a folder, its lack is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="barloom-"))
    return folder or context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives lost executors and is computed once."""
    work_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query run inside are deleted when it ends, not when the driver next collects garbage."""
    before = spark.conf.get(_CLEANUP)
    try:
        spark.conf.set(_CLEANUP, "true")
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: computed once, lineage cut, and readers take the columns they need."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, order: list[str]) -> DataFrame:
    """As `written`, with the rows of a `key` in one bucket: joins and aggregates on it take the table as it lies, without a shuffle.

    Rows lie in `order` in each file, so what is shuffled of them later has like rows side by side, which compress well.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with shuffles_removed(spark):
        df.write.format("parquet").bucketBy(buckets, key).sortBy(*order).option("path", f"{work_dir(spark)}/{table}").saveAsTable(table)
    return spark.table(table)
