"""Hard negatives by exact integer scores from residue matrices.

Components become integers; a score is their inner product. Matrices of residues modulo a few small primes are multiplied in float32,
where every partial sum is an exact integer, and the signed score is put together from its residues by mixed-radix Chinese
remaindering. The primes are as many as the data's largest possible score needs.

Anchors meet all rows in blocks: rows are packed into matrices of some hundred rows, dealt over strips, and each block of anchors
visits every strip once. A strip gives at most the asked number of rows per anchor, and a window over the strips chooses among them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.llm.common import written

POSITIVES, NEGATIVES, SCALE = 5, 10, 256
#: A negative's score lies between these hundredths of the positive's.
LOWEST, HIGHEST = 30, 90
#: Rows in a packed matrix, residues in a strip of rows (64 MB), and anchors in a block.
PACK, STRIP, BLOCK = 512, 1 << 24, 4_096
#: Primes in descending order: with residues of at most 125 in size, 1,024 products add up exactly in float32.
PRIMES = (251, 241, 239, 233, 229, 227, 223, 211, 199, 197)
_RUN = 1_024
_LOST = np.iinfo(np.int64).min


def primes_for(bound: int) -> tuple[int, ...]:
    """The first primes whose product tells all scores from -bound to bound apart."""
    product, chosen = 1, []
    for p in PRIMES:
        if product > 2 * bound and chosen:
            break
        product *= p
        chosen.append(p)
    if product <= 2 * bound or bound >= 1 << 62:
        raise OverflowError("scores of these vectors may not fit in 64 bits")
    return tuple(chosen)


def residues(q: np.ndarray, primes: tuple[int, ...]) -> list[np.ndarray]:
    """For each prime the rows' residues, from -(p - 1) / 2 to (p - 1) / 2, as float32."""
    return [((q + p // 2) % p - p // 2).astype(np.float32) for p in primes]


def product(a: list[np.ndarray], b: list[np.ndarray], primes: tuple[int, ...]) -> np.ndarray:
    """Exact inner products (int64) of the rows of `a` with those of `b` from their residues."""
    digits: list[np.ndarray] = []
    for k, p in enumerate(primes):
        r = np.zeros((len(a[k]), len(b[k])), np.int32)
        for at in range(0, a[k].shape[1], _RUN):
            r += (a[k][:, at : at + _RUN] @ b[k][:, at : at + _RUN].T).astype(np.int32) % p
        for q, d in zip(primes, digits):  # mixed-radix digit: what is left after the earlier digits, divided by their primes
            r = (r - d) * pow(q, -1, p) % p
        r %= p
        digits.append(np.where(r > p // 2, r - p, r))
    score = digits[-1].astype(np.int64)
    for p, d in zip(primes[-2::-1], digits[-2::-1]):
        score = score * p + d
    return score


def best(group: np.ndarray, score: np.ndarray, vec_id: np.ndarray, row: np.ndarray, most: int) -> np.ndarray:
    """Indices of the first `most` of each group by score downwards, then id, then row."""
    order = np.lexsort((row, vec_id, -score, group))
    g = group[order]
    start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(start, np.diff(np.r_[start, len(g)]))
    return order[rank < most]


class Found:
    """The best rows so far of each of `n` groups, added block by block."""

    def __init__(self, n: int, most: int):
        self.most = most
        self.group, self.score, self.vec_id, self.row = (np.zeros(0, np.int64) for _ in range(4))
        self.floor = np.full(n, _LOST, np.int64)  # scores below can't come in

    def add(self, group: np.ndarray, score: np.ndarray, vec_id: np.ndarray, row: np.ndarray) -> None:
        if not len(group):
            return
        parts = [np.concatenate(x) for x in zip((self.group, self.score, self.vec_id, self.row), (group, score, vec_id, row))]
        keep = best(*parts, self.most)
        self.group, self.score, self.vec_id, self.row = (x[keep] for x in parts)
        held = np.bincount(self.group, minlength=len(self.floor))
        last = np.cumsum(held) - 1
        self.floor = np.where(held >= self.most, self.score[np.maximum(last, 0)], _LOST)


def _blocks(rows: pa.Table, primes: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
    for r in rows.to_pylist():
        ids, q = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["q"], r["kind"]).astype(np.int64)
        yield ids, np.frombuffer(r["row_ids"], "<i8"), np.frombuffer(r["labels"], "<i8"), residues(q.reshape(len(ids), -1), primes)


def _positives(left: pa.Table, right: pa.Table, primes: tuple[int, ...]) -> pa.Table:
    """Per anchor of the left blocks its first rows of the same label among the right ones."""
    out = {k: [] for k in ("anchor", "vec_id", "row_id", "score")}
    others = list(_blocks(right, primes))
    for _, rows, labels, a in _blocks(left, primes):
        found = Found(len(rows), POSITIVES)
        for ids, own, kinds, b in others:
            for label in np.intersect1d(labels, kinds):
                x, y = np.flatnonzero(labels == label), np.flatnonzero(kinds == label)
                s = product([m[x] for m in a], [m[y] for m in b], primes)
                i, j = np.nonzero((s >= found.floor[x][:, None]) & (rows[x][:, None] != own[y][None]))
                found.add(x[i], s[i, j], ids[y[j]], own[y[j]])
        for k, v in zip(out, (rows[found.group], found.vec_id, found.row, found.score)):
            out[k].append(v)
    return pa.table({k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()})


def _negatives(left: pa.Table, right: pa.Table, primes: tuple[int, ...]) -> pa.Table:
    """Per anchor and positive of the left blocks the first rows of other labels in the score's band among the right ones."""
    out = {k: [] for k in ("anchor", "rank", "vec_id", "row_id", "score")}
    others = list(_blocks(right, primes))
    for (_, rows, labels, a), r in zip(_blocks(left, primes), left.column("positives").to_pylist()):
        low, high = _band(np.frombuffer(r, "<i8").reshape(len(rows), POSITIVES))
        found = [Found(len(rows), NEGATIVES) for _ in range(POSITIVES)]
        for ids, own, kinds, b in others:
            s = product(a, b, primes)
            s[labels[:, None] == kinds[None]] = _LOST
            for k, f in enumerate(found):
                i, j = np.nonzero((s >= np.maximum(low[:, k], f.floor)[:, None]) & (s <= high[:, k][:, None]))
                f.add(i, s[i, j], ids[j], own[j])
        for k, f in enumerate(found):
            for name, v in zip(out, (rows[f.group], np.full(len(f.group), k, np.int64), f.vec_id, f.row, f.score)):
                out[name].append(v)
    return pa.table({k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()})


def _band(positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest negative score for positive scores; none where there is no positive or it is below zero."""
    none = positive < 0
    p = np.where(none, 0, positive)
    whole, rest = p // 100, p % 100  # p = 100 whole + rest, so that no product leaves 64 bits
    low, high = LOWEST * whole - (-LOWEST * rest) // 100, HIGHEST * whole + HIGHEST * rest // 100
    return np.where(none, 1, low), np.where(none, 0, high)


def _packed(rows: DataFrame, kind: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Matrices of up to `PACK` rows: ids, row ids, labels and integer vectors as bytes."""
    names = ["ids", "row_ids", "labels", "q", *extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PACK):
                batch = whole.slice(at, PACK)
                blobs = [c.to_numpy(zero_copy_only=False).astype("<i8").tobytes() for c in batch.columns[:3]]
                blobs += [b"".join(c.to_pylist()) for c in batch.columns[3:]]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in blobs], names)

    packed = rows.select("vec_id", "row_id", "label", "q", *extra).mapInArrow(run, ", ".join(f"{n} binary" for n in names))
    return packed.withColumn("kind", F.lit(kind))


def _met(anchors: DataFrame, rows: DataFrame, blocks: int, strips: int, with_strip, schema: str) -> DataFrame:
    """Every block of anchors with every strip of rows, each pair a group of bounded size."""
    deal = lambda df, n: F.pmod(F.xxhash64("row_ids"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.withColumn("block", deal(anchors, blocks)).withColumn("strip", every(strips))
    right = rows.withColumn("strip", deal(rows, strips)).withColumn("block", every(blocks))
    return left.groupBy("block", "strip").cogroup(right.groupBy("block", "strip")).applyInArrow(with_strip, schema)


def _rows(vectors: DataFrame, vector_col: str, id_col: str, label: Column) -> tuple[DataFrame, str, int, int, int]:
    """Rows that take part, numbered, with integer vectors as bytes; the integers' type, the rows, the width and the scores' bound."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    own = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), x.alias("x"))
    odd = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    own = own.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & ~odd)
    width, size, n = own.agg(F.max(F.size("x")), F.max(F.array_max(F.transform("x", F.abs))), F.count("*")).first()
    width, largest = max(width or 0, 1), int((size or 0.0) * SCALE) + 1
    bound = largest * largest * width
    primes_for(bound)
    kind = next(f"<i{k}" for k in (2, 4, 8) if largest < 1 << (8 * k - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(3)
            q = np.zeros((batch.num_rows, width), kind)
            q[np.arange(width)[None] < x.value_lengths().to_numpy(zero_copy_only=False)[:, None]] = np.floor(SCALE * x.flatten().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([r.tobytes() for r in q], pa.binary())], ["vec_id", "row_id", "label", "q"])

    numbered = own.select("vec_id", F.monotonically_increasing_id().alias("row_id"), "label", "x")
    return written(numbered.mapInArrow(run, "vec_id bigint, row_id bigint, label bigint, q binary"), "rns-rows", codec="zstd"), kind, n, width, bound


def mine(
    vectors: DataFrame, anchor: Column, label: Column | str = "label", vector_col: str = "embedding", id_col: str = "vec_id"
) -> DataFrame:
    """`anchor_id, positive_id, rank, negative_id, positive_score, negative_score` for the rows where `anchor` (over vec_id) holds.

    Scores are inner products of floor(256 x). An anchor's positives are its first `POSITIVES` other rows of its label, by score
    downwards and then by id; a positive's negatives are the first `NEGATIVES` rows of other labels whose score lies from 30 to 90
    hundredths of the positive's, both included. A positive below zero has none; fewer rows are returned where there are fewer.

    Rows with a null id or label, a null vector or a null or non-finite component take no part. Missing components of a shorter
    vector are zero; an empty vector scores 0 with everything. Rows that share an id are rows of their own: each is a candidate,
    and each that is an anchor has its own positives. Vectors whose scores might not fit in 62 bits are an OverflowError.
    Other columns are not looked at. An empty table gives an empty one.
    """
    rows, kind, n, width, bound = _rows(vectors, vector_col, id_col, F.col(label) if isinstance(label, str) else label)
    primes = primes_for(bound)
    anchors = rows.where(anchor)
    blocks = max(1, -(-anchors.count() // BLOCK))
    strips = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * width * len(primes) // STRIP))
    packed = written(_packed(rows, kind), "rns-packed", codec="zstd")
    order = (F.desc("score"), "vec_id", "row_id")
    near = _met(_packed(anchors, kind), packed, blocks, strips, lambda a, b: _positives(a, b, primes), "anchor bigint, vec_id bigint, row_id bigint, score bigint")
    own = Window.partitionBy("anchor").orderBy(*order)
    positives = written(near.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= POSITIVES), "rns-positives")
    # the positives' scores of an anchor, in order, as bytes; -1 where there is no further one
    scores = positives.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("s"))
    asked = anchors.join(scores.withColumnRenamed("anchor", "row_id"), "row_id").withColumn("s", F.transform("s", lambda s: s["score"]))

    def with_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [np.array(x + [-1] * (POSITIVES - len(x)), "<i8").tobytes() for x in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(s, pa.binary())], ["vec_id", "row_id", "label", "q", "positives"])

    asked = asked.select("vec_id", "row_id", "label", "q", "s").mapInArrow(with_scores, "vec_id bigint, row_id bigint, label bigint, q binary, positives binary")
    far = _met(
        _packed(asked, kind, ("positives",)), packed, blocks, strips, lambda a, b: _negatives(a, b, primes),
        "anchor bigint, rank bigint, vec_id bigint, row_id bigint, score bigint",
    )
    own = Window.partitionBy("anchor", "at").orderBy(*order)
    chosen = far.withColumnRenamed("rank", "at").withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= NEGATIVES)
    pairs = positives.select("anchor", (F.col("rank") - 1).alias("at"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    names = anchors.select(F.col("row_id").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    joined = chosen.join(pairs, ["anchor", "at"]).join(names, "anchor")
    return joined.select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
