"""Alignment of two tokenizers' tokens on the bytes of a text, as Arrow tables.

Token lists are flattened with their parent indices, token lengths summed up within each text, and the ends of both sides joined
by Acero on (text, end): where both end, a group closes. Tokens whose bytes overlap are links; the pairs of ids they join are counted with
`Table.group_by` in the tasks and added up by Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from barloom.llm.bpe import encode, of_tokenizer_file
from barloom.llm.common import in_blocks, texts, written

#: Bytes of text aligned in one go, and different id pairs that a task holds before it passes them on.
BLOCK, HELD = 1 << 19, 1_000_000
#: Id pairs up to which their counts are sent to all tasks (13 bytes each); joined by a shuffle beyond.
BROADCAST_PAIRS = 4_000_000


@lru_cache(maxsize=2)
def pieces(path: str) -> tuple[sentencepiece.SentencePieceProcessor, list[bytes]]:
    """A piece tokenizer and the bytes of each id: U+2581 is a space, <0xHH> the byte HH."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    return sp, [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]


def _joined(tokens: pa.Array, side: pa.Array) -> pa.Array:
    """The bytes of each text's tokens, end to end."""
    own = side.take(pc.list_flatten(tokens))
    ends = np.frombuffer(own.buffers()[1], np.int32, len(own) + 1, own.offset * 4) if len(own) else np.zeros(1, np.int32)
    offsets = pa.py_buffer(np.ascontiguousarray(ends[tokens.offsets.to_numpy()]))
    return pa.Array.from_buffers(pa.binary(), len(tokens), [None, offsets, own.buffers()[2] or pa.py_buffer(b"")])


class Aligner:
    """Both tokenizers with the lengths of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.bytes_a = of_tokenizer_file(path_a)
        self.b, self.bytes_b = pieces(path_b)
        self.bytes = [pa.array(side, pa.binary()) for side in (self.bytes_a, self.bytes_b)]
        self.lengths = [pc.binary_length(side).cast(pa.int64()) for side in self.bytes]
        self.kind = "<u4" if len(self.bytes_a) * len(self.bytes_b) < 1 << 32 else "<i8"
        # a token's number as text, once for each mark that can follow it
        self.names = [pa.array([f"{i}{mark}" for mark in (",", "|", ";", "") for i in range(len(side))]) for side in (self.bytes_a, self.bytes_b)]

    def encoded(self, own: list[bytes]) -> list[pa.Array]:
        """Ids of both sides per text, as lists; empty where a side's bytes are not a space and the text."""
        shown = [t.decode() for t in own]
        ids = [[encode(self.a, " " + t) if t else [] for t in shown], [self.b.encode(t, num_threads=1) if t else [] for t in shown]]
        lists = [self._lists(side) for side in ids]
        want = pa.array([b" " + t if t else b"" for t in own], pa.binary())
        if not all(_joined(tokens, side).equals(want) for tokens, side in zip(lists, self.bytes)):
            same = [_joined(tokens, side) for tokens, side in zip(lists, self.bytes)]
            same = pc.and_(pc.equal(same[0], want), pc.equal(same[1], want)).to_pylist()
            lists = [self._lists([x if ok else [] for x, ok in zip(side, same)]) for side in ids]
        return lists

    @staticmethod
    def _lists(side: list) -> pa.Array:
        flat = np.concatenate([np.zeros(0, np.int32), *(np.asarray(x, np.int32) for x in side)])
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, side)], dtype=np.int32)), pa.array(flat))

    def aligned(self, lists: list[pa.Array]) -> dict[str, pa.Array]:
        """Per text: tokens, groups and links, the groups as text, and the links' id pairs (a times B's size plus b) as bytes."""
        n = len(lists[0])
        ids, text, end = [], [], []
        for tokens, lengths in zip(lists, self.lengths):
            ids.append(pc.list_flatten(tokens))
            text.append(pc.list_parent_indices(tokens))
            total = pc.cumulative_sum(pc.take(lengths, ids[-1])).to_numpy(zero_copy_only=False)
            starts = tokens.offsets.to_numpy()[:-1]  # ends count from the start of each text
            before = np.r_[0, total][starts]
            end.append(total - before[text[-1].to_numpy()])
        sides = [pa.table({"text": t, "end": e, f"at_{k}": np.arange(len(e))}) for k, t, e in zip("ab", text, end)]
        shared = sides[0].join(sides[1], ["text", "end"], join_type="inner", use_threads=False)
        closes = [np.zeros(len(e), bool) for e in end]
        for k, side in enumerate(closes):
            side[shared.column(f"at_{'ab'[k]}").to_numpy()] = True
        at_text = [t.to_numpy() for t in text]
        ids = [i.to_numpy() for i in ids]
        # every end of either side cuts the bytes; between two cuts one token of each side overlaps
        own = np.flatnonzero(~closes[1])
        cut_text, cut_end = np.r_[at_text[0], at_text[1][own]], np.r_[end[0], end[1][own]]
        order = np.argsort((cut_text.astype(np.int64) << 40) + cut_end, kind="stable")  # two sorted runs, so a merge
        from_a = order < len(end[0])
        from_b = ~from_a
        from_b[from_a] = closes[0][order[from_a]]
        link = ids[0][np.cumsum(from_a) - from_a].astype(np.int64) * len(self.bytes_b) + ids[1][np.cumsum(from_b) - from_b]
        count = lambda t: np.bincount(t, minlength=n)
        n_links = count(cut_text)
        edges = np.r_[0, np.cumsum(n_links)]
        blobs = [link[i:j].astype(self.kind).tobytes() for i, j in zip(edges[:-1].tolist(), edges[1:].tolist())]
        return {
            "n_a": pa.array(count(at_text[0])), "n_b": pa.array(count(at_text[1])), "n_groups": pa.array(count(at_text[0][closes[0]])),
            "n_links": pa.array(n_links), "groups": self._shown(ids, at_text, closes, n), "links": pa.array(blobs, pa.binary()),
        }

    def _shown(self, ids: list[np.ndarray], at_text: list[np.ndarray], closes: list[np.ndarray], n: int) -> pa.Array:
        """`a1,a2|b1;a3|b2,b3` per text: each token's place follows from the tokens of the other side in the groups before it."""
        group = [np.cumsum(c) - c for c in closes]
        per = [np.bincount(g, minlength=1) for g in group]
        place_a = np.arange(len(ids[0])) + np.r_[0, np.cumsum(per[1])][group[0]]
        place_b = np.arange(len(ids[1])) + np.cumsum(per[0])[group[1]] if len(ids[1]) else np.zeros(0, np.int64)
        last = np.r_[at_text[1][1:] != at_text[1][:-1], True] if len(ids[1]) else np.zeros(0, bool)
        mark_b = np.where(closes[1], np.where(last, 3, 2), 0)
        names = pa.concat_arrays([self.names[0].take(pa.array(np.where(closes[0], 1, 0) * len(self.bytes_a) + ids[0])), self.names[1].take(pa.array(mark_b * len(self.bytes_b) + ids[1]))])
        order = np.empty(len(names), np.int64)
        order[np.r_[place_a, place_b]] = np.arange(len(names))
        edges = np.r_[0, np.cumsum(np.bincount(at_text[0], minlength=n) + np.bincount(at_text[1], minlength=n))]
        return _joined(pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(order)), names).cast(pa.string())


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def align(
    docs: DataFrame, path_a: str, path_b: str, digest: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """`id_col, n_a, n_b, n_groups, n_links, groups, links` per row.

    A encodes a space and the text, B the text, which it puts a space before; strings of special tokens are plain text. `groups` is
    `a1,a2|b1;a3|b2,b3` in ids (with `digest` its SHA-256 in hex), `links` the id pairs of overlapping tokens in order (a times the size
    of B plus b, little-endian, unsigned 32 bits if all pairs fit, else 64). Rows whose text is null or empty, or not the bytes of both sides' tokens, have no tokens: zeros and empty values. Ids
    are passed on as they are, null and repeated ones too; other columns are not looked at; an empty table gives an empty one.
    """
    names = [id_col, "n_a", "n_b", "n_groups", "n_links", "groups", "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)
        for whole in batches:
            for batch in in_blocks(whole, 1, BLOCK):
                found = own.aligned(own.encoded(texts(batch)))
                if digest:
                    found["groups"] = pa.array([hashlib.sha256(g.as_buffer()).hexdigest() if g.as_py() else "" for g in found["groups"]], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), *(found[n].cast(pa.int64()) for n in names[1:5]), found["groups"], found["links"]], names)

    source = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, links binary")


def _pairs(blobs: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of the rows' links, and each one's row."""
    data = [np.frombuffer(b, kind) for b in blobs.to_pylist()]
    return np.concatenate([np.zeros(0, kind), *data]).astype(np.int64), np.repeat(np.arange(len(data)), [len(d) for d in data])


def pair_counts(aligned: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """`pair, n, best` over the whole corpus: links that hold the pair, and if no pair of its B id is held by more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = aligner(path_a, path_b).kind
        held = pa.table({"pair": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                pair = _pairs(whole.column(0).slice(at, 512), kind)[0]
                held = pa.concat_tables([held, pa.table({"pair": pair, "n": np.ones(len(pair), np.int64)})])
                if held.num_rows > HELD:
                    held = held.group_by("pair", use_threads=False).aggregate([("n", "sum")]).rename_columns(["pair", "n"])
                    if held.num_rows > HELD:
                        yield from held.to_batches(1 << 16)
                        held = held.slice(0, 0)
        if held.num_rows:
            yield from held.group_by("pair", use_threads=False).aggregate([("n", "sum")]).rename_columns(["pair", "n"]).to_batches(1 << 16)

    size = len(pieces(path_b)[1])
    counts = aligned.select("links").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = written(counts.withColumn("b", (F.col("pair") % size).cast("int")), "alignment-pairs")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))  # one row per B id


def with_counts(aligned: DataFrame, counts: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """`aligned` with `n_best` (links whose pair is the most frequent of its B id) and `count_sum` (their pairs' counts added up)."""
    spark, columns = aligned.sparkSession, [c for c in aligned.columns if c not in ("n_best", "count_sum")]
    aligned = aligned.select(*columns)
    if counts.count() > BROADCAST_PAIRS:
        return _joined_counts(aligned, counts, path_a, path_b)
    rows = counts.orderBy("pair").toArrow()
    table = spark.sparkContext.broadcast(tuple(rows.column(c).to_numpy() for c in ("pair", "n", "best")))
    at = columns.index("links")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = table.value
        kind = aligner(path_a, path_b).kind
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                links, row = _pairs(batch.column(at), kind)
                k = np.searchsorted(pair, links)
                sums = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
                for total, values in zip(sums, (best[k], n[k]) if len(k) else ()):
                    np.add.at(total, row, values)
                yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, sums)], [*columns, "n_best", "count_sum"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in aligned.schema)
    return aligned.mapInArrow(run, f"{schema}, n_best bigint, count_sum bigint")


def _joined_counts(aligned: DataFrame, counts: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """As `with_counts`, the counts joined by a shuffle of each row's different pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = aligner(path_a, path_b).kind
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                pair, row = _pairs(whole.column(1).slice(at, 512), kind)
                order = np.lexsort((pair, row))
                pair, row = pair[order], row[order]
                first = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (row[1:] != row[:-1])]) if len(pair) else np.zeros(0, np.int64)
                times = np.diff(np.r_[first, len(pair)])
                yield pa.RecordBatch.from_arrays([whole.column(0).take(pa.array(row[first] + at)), pa.array(pair[first]), pa.array(times)], ["row_id", "pair", "times"])

    numbered = written(aligned.withColumn("row_id", F.monotonically_increasing_id()), "alignment-rows", codec="zstd")
    held = numbered.select("row_id", "links").mapInArrow(run, "row_id bigint, pair bigint, times bigint")
    sums = held.join(counts, "pair").groupBy("row_id").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return numbered.join(sums, "row_id", "left").select(*aligned.columns, zero("n_best"), zero("count_sum"))
