"""Byte-level BPE by a local rank file, with long texts cut where no match of the pattern can cross."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import re
import tiktoken
from pyspark.sql import DataFrame

from barloom.llm.common import texts

#: Characters after which the next safe boundary is taken as a cut.
BLOCK = 1 << 16
#: A word character and then one space before another: every match ends before that space.
_SAFE = re.compile(r"(?<=[0-9A-Za-z.,;:!?]) (?=[0-9A-Za-z])")


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file (`base64 rank` lines), without special tokens."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _letters() -> dict[str, int]:
    """Letter of a byte-level vocabulary -> byte: printable Latin-1 letters stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}


@lru_cache(maxsize=4)
def of_tokenizer_file(path: str, pattern: str = public_tokenizers.PATTERN) -> tuple[tiktoken.Encoding, list[bytes]]:
    """The encoding of a byte-level BPE file of the tokenizers library, and the bytes of each id; special tokens are their own text.

    The file must merge in the order of ids and split by the byte-level pattern alone, else it is a ValueError.
    """
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    model, split, letters = found["model"], found["pre_tokenizer"] or {}, _letters()
    special = {t["content"]: t["id"] for t in found.get("added_tokens") or ()}
    ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if merged != sorted(merged) or found["normalizer"] or split.get("type") != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
        raise ValueError(f"{path} is no plain byte-level BPE")
    shown = [b""] * (1 + max([*ranks.values(), *special.values()]))
    for token, i in [*ranks.items(), *((t.encode(), i) for t, i in special.items())]:
        shown[i] = token
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens=special), shown


def blocks(text: str, size: int = BLOCK) -> Iterator[str]:
    """The text in order, cut at the first safe boundary after every `size` characters; a stretch without one stays whole."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode(enc: tiktoken.Encoding, text: str, size: int = BLOCK, special: bool = False) -> np.ndarray:
    """The ids as little-endian unsigned 32-bit integers; with `special` the strings of special tokens, which hold no space, are these."""
    own = (lambda t: enc.encode(t, allowed_special="all")) if special and any(s in text for s in enc.special_tokens_set) else enc.encode_ordinary
    if len(text) <= size:
        return np.asarray(own(text), "<u4")
    return np.concatenate([np.asarray(own(part), "<u4") for part in blocks(text, size)])


def decode(enc: tiktoken.Encoding, ids: Iterable[int]) -> bytes:
    """The bytes behind the ids; they need not be UTF-8, as any slice of ids may be decoded."""
    return enc.decode_bytes(ids)


def encode_column(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col, ids` (binary, little-endian u32) for every row.

    A null text counts as empty and gives no ids; ids of rows are passed on as they are, null and repeated ones
    included. Other columns are not looked at. An empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in batches:
            for part in _parts(batch):
                ids = [encode(enc, t.decode()).tobytes() for t in texts(part)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], [id_col, "ids"])

    source = docs.select(id_col, text_col)
    return source.mapInArrow(run, f"{id_col} {source.schema[0].dataType.simpleString()}, ids binary")


def decode_column(encoded: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """The table with the bytes behind `ids_col` in a column `decoded`; null ids give null."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name != "decoded")
    columns = [f.name for f in encoded.schema if f.name != "decoded"]
    at = columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in batches:
            for part in _parts(batch):
                out = [None if x is None else decode(enc, np.frombuffer(x, "<u4").tolist()) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], [*columns, "decoded"])

    return encoded.select(*columns).mapInArrow(run, f"{schema}, decoded binary")


def _parts(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Few rows at a time, so that what a worker holds is bounded by a few hundred texts."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)
