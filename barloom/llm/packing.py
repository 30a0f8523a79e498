"""Packing by powers of two: a document's tokens are cut into pieces of binary length, each a sequence of its own.

No sequence crosses documents and none needs padding, since every length is a power of two; batches are made of
sequences of one length, so the length is the bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barloom.llm.bpe import encode, of_tokenizer_file
from barloom.llm.common import in_blocks, texts

#: Bytes of text packed in one go.
BLOCK = 1 << 22
#: Place of the bucket's power in a sequence id: below it are the numbers of the sequences.
_BUCKET = 58


def lengths(n: int, most: int = 2048) -> list[int]:
    """`n` as pieces: as many of `most` as fit, then the binary digits of the rest, largest first."""
    return [most] * (n // most) + [1 << b for b in reversed(range(most.bit_length() - 1)) if n % most >> b & 1]


def pack(
    docs: DataFrame, path: str, most: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: `doc_id, start, length, ids` (binary, little-endian u32), `doc_tokens, sequence_id, offset`.

    Each document is its ids, as the tokenizers library gives them for the file without added special tokens (a special token's string
    in a text is that token), and then `end_id`; a null text is an empty one and gives the single id. `most` must be a power of two.
    Every piece fills a sequence, so `offset` is 0 and `length` is the bucket; sequences of one bucket have ids in one range. Rows of
    one id are packed one by one, null ids too; other columns are not looked at; an empty table gives an empty one.
    """
    if most & (most - 1):
        raise ValueError("most must be a power of two")
    names = ["doc_id", "start", "length", "ids", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = of_tokenizer_file(path)[0], np.asarray([end_id], "<u4")
        for whole in batches:
            for batch in in_blocks(whole, 1, BLOCK):
                ids = [x for t in texts(batch) for x in (encode(own, t.decode(), special=True), end)]
                n = np.array([len(x) + 1 for x in ids[::2]])
                cut = [lengths(k, most) for k in n.tolist()]
                row = np.repeat(np.arange(len(n)), [len(c) for c in cut])
                length = np.array([k for c in cut for k in c])
                at = np.r_[0, np.cumsum(length)]  # pieces lie end to end, as their documents do
                start = at[:-1] - (np.cumsum(n) - n)[row]
                held = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer((4 * at).astype(np.int32)), pa.py_buffer(np.concatenate(ids))])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(start), pa.array(length), held, pa.array(n[row])], names)

    source = docs.select(F.col(id_col).alias("doc_id"), text_col)
    kind = source.schema[0].dataType.simpleString()
    pieces = source.mapInArrow(run, f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint")
    bucket = F.shiftleft(F.round(F.log2("length")).cast("bigint"), _BUCKET)
    return pieces.withColumns({"sequence_id": bucket + F.monotonically_increasing_id(), "offset": F.lit(0).cast("bigint")})


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Writes the sequences under one folder per length."""
    pieces.withColumn("bucket", F.col("length")).write.partitionBy("bucket").parquet(path)
