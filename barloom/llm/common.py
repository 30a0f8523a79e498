"""What several operators share: tables, words, hashes, counting sketches, written intermediates."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barloom.session import shuffles_removed, work_dir  # noqa: F401  the former for operators

#: Words a worker remembers with their hashes; further ones are hashed at each occurrence.
REMEMBERED = 200_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_CHUNK = 4096
#: Whole texts that a Python worker gets at a time while a sketch is made.
_TEXTS = 512
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """At most so many rows at a time go to a Python worker in jobs run inside; 0 leaves the session's number."""
    before = spark.conf.get(_BATCH)
    try:
        if rows:
            spark.conf.set(_BATCH, rows)
        yield
    finally:
        spark.conf.set(_BATCH, before)


def written(df: DataFrame, name: str, batch: int = 0, codec: str = "snappy") -> DataFrame:
    """The rows as a Parquet table in the shared folder: computed once, lineage cut, columns read as needed.

    `batch` rows at most go to a Python worker at a time, where rows are long (by default as the session says).
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    with batches_of(spark, batch):
        df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes `written` tables that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def remainder(doc_id: str | Column, of: int) -> Column:
    """crc32 of the id as text, modulo `of`; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")) % of


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a url: what follows the first :// up to / ? #, and from there up to ? #; else empty."""
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return ascii_lower(part(1)), part(2)


def texts(batch: pa.RecordBatch, column: int = 1) -> list[bytes]:
    """The column's texts as UTF-8 bytes; null counts as empty."""
    return [b"" if t is None else t for t in batch.column(column).cast(pa.binary()).to_pylist()]


def in_blocks(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batch's rows in order, with some `size` bytes in the column at a time."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    block = (np.cumsum(sizes) - sizes) // size
    edges = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True]).tolist() if len(sizes) else []
    for i, j in zip(edges, edges[1:]):
        yield batch.slice(i, j - i)


class WordHashes(dict):
    """64-bit hash of each word, remembered for the first `REMEMBERED` words met."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < REMEMBERED:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingles(h: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; with fewer words, of the whole sequence."""
    n = len(h)
    if not n:
        return h
    width = min(k, n)
    s = h[: n - width + 1] + np.uint64(width)
    for j in range(1, width):
        s = s * _ODD + h[j : n - width + 1 + j]
    return np.unique(mixed(s))


class Sketch:
    """Occurrences per slot of a table of 2**bits slots, added up within a task."""

    def __init__(self, bits: int):
        self.mask, self.size, self.waiting, self.held = np.uint64((1 << bits) - 1), 1 << bits, [], 0
        self.counts = np.zeros(self.size, np.int32)

    def add(self, hashes: np.ndarray) -> None:
        self.waiting.append(hashes)
        self.held += len(hashes)
        if self.held > self.size // 4:
            self.flush()

    def flush(self) -> None:
        if self.waiting:
            self.counts += np.bincount((np.concatenate(self.waiting) & self.mask).astype(np.int64), minlength=self.size).astype(np.int32)
            self.waiting, self.held = [], 0

    def rows(self) -> Iterator[pa.RecordBatch]:
        """Pieces of the table that hold anything, in the narrowest type that fits."""
        self.flush()
        pieces = self.counts.reshape(-1, min(_CHUNK, self.size))
        some = np.flatnonzero(pieces.any(axis=1))
        data = [p.astype(next(t for t in (np.uint8, np.uint32, np.int64) if p.max() <= np.iinfo(t).max)).tobytes() for p in pieces[some]]
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(data, pa.binary())], ["piece", "data"])


def _widened(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, {1: np.uint8, 4: np.uint32, 8: np.int64}[len(data) // width]).astype(np.int64)


def summed_sketch(pieces: DataFrame, bits: int, finish: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The tasks' tables added up in Spark, piece by piece, each made bytes by `finish`: 2**bits bytes, whatever the input."""
    width = min(_CHUNK, 1 << bits)

    def add(key: tuple[pa.Scalar, ...], rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for batch in rows:
            for data in batch.column("data").to_pylist():
                total += _widened(data, width)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([finish(total).astype(np.uint8).tobytes()], pa.binary())], ["piece", "data"])

    out = np.tile(finish(np.zeros(width, np.int64)).astype(np.uint8), ((1 << bits) // width, 1))
    with batches_of(pieces.sparkSession, _TEXTS):
        rows = pieces.groupBy("piece").applyInArrow(add, "piece int, data binary").collect()
    for row in rows:
        out[row.piece] = np.frombuffer(row.data, np.uint8)
    return out.reshape(-1)
