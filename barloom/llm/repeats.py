"""Substring dedup by repeated-phrase automata.

Every window of `WINDOW` words is filed under the word run of `SEED` words with the smallest hash inside it. Equal windows have
equal seeds, so a window whose seed turns up once in the corpus is unique, and only stretches around recurring seeds (a few words for
every window that may recur) leave their documents. Stretches meet by seed; there the recurring windows are confirmed and compiled into
Aho-Corasick automata of bounded size, and every stretch of every document is streamed through the automaton of its seeds, which
finds each occurrence word by word.

Nothing depends on how often a seed occurs: equal texts and equal stretches are one with a weight, and a seed with more than `HOT`
different stretches has them dealt over many groups, with their windows counted by a Spark aggregate first.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from barloom.llm.common import WordHashes, discard, mixed, texts, written

WINDOW, SEED = 35, 5
#: Stretches in one group, and windows compiled into one automaton.
GROUP, PATTERNS = 16_384, 16_384
#: Different stretches of a seed from which they are dealt over several groups.
HOT = 16_384
#: Texts with removed words up to which their spans are sent to all tasks (some 100 bytes each); a shuffle beyond.
BROADCAST_TEXTS = 300_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD2 = np.uint64(0xC2B2AE3D27D4EB4F)


def words(text: bytes) -> list[bytes]:
    """Runs of bytes outside \\x20 and \\x09-\\x0D."""
    return text.split()


def rolled(h: np.ndarray, k: int, factor: np.uint64 = _ODD) -> np.ndarray:
    """Hashes of all runs of `k` words from the words' hashes."""
    n = len(h) - k + 1
    s = h[:n].copy()
    for j in range(1, k):
        s = s * factor + h[j : n + j]
    return mixed(s)


def seeds(h: np.ndarray, window: int = WINDOW, k: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of neighbouring windows that share their seed: seed, first window, number of windows, places of the seed.

    A window's seed is the smallest hash of its `k`-word runs, so equal windows have equal seeds, at equal places inside them: a
    window can only come twice where its seed has two places.
    """
    if len(h) < window:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3
    runs = v = rolled(h, k)
    width, span = 1, window - k + 1
    while width < span:
        step = min(width, span - width)
        v = np.minimum(v[step:], v[:-step])
        width += step
    first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    n = np.diff(np.r_[first, len(v)])
    # places of each stretch's seed among the runs its windows hold: its first window, and those entering with later windows
    later = np.r_[0, np.cumsum(runs[span:] == v[1:])] if len(v) > 1 else np.zeros(1, np.int64)
    once = np.array([np.count_nonzero(runs[f : f + span] == x) for f, x in zip(first.tolist(), v[first])])
    return v[first], first, n, once + later[first + n - 1] - later[first]


def _digest(text: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary"))))


def _stretches(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """`d, seed, first, n, times` of every stretch of every text."""
    known = WordHashes()
    for batch in batches:
        rows, parts = [], []
        for i, text in enumerate(texts(batch)):
            part = seeds(known.of(words(text)), window)
            if len(part[0]):
                parts.append(part)
                rows.append(np.full(len(part[0]), i))
        if parts:
            seed, *rest = (np.concatenate(x) for x in zip(*parts))
            d = batch.column(0).take(pa.array(np.concatenate(rows)))
            yield pa.RecordBatch.from_arrays([d, pa.array(seed.view(np.int64)), *(pa.array(x.astype(np.int32)) for x in rest)], ["d", "seed", "first", "n", "times"])


def _pieces(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The words of each stretch that may recur, from rows `d, text, copies, cands`."""
    names = ["d", "seed", "first", "copies", "piece"]
    for whole in batches:
        for at in range(0, whole.num_rows, 64):
            batch = whole.slice(at, 64)
            cands = batch.column(3)
            rows = np.repeat(np.arange(batch.num_rows), cands.value_lengths().to_numpy(zero_copy_only=False))
            flat = cands.flatten()
            first, n = flat.field("first"), flat.field("n").to_pylist()
            own, pieces = [words(t) for t in texts(batch)], []
            for r, a, k in zip(rows.tolist(), first.to_pylist(), n):
                pieces.append(b" ".join(own[r][a : a + k + window - 1]))
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), flat.field("seed"), first, batch.column(2).take(take), pa.array(pieces, pa.binary())], names
            )


class Phrases:
    """Word numbers and automata over the stretches of one group."""

    def __init__(self, pieces: Iterable[bytes], window: int):
        self.window, number = window, {}
        self.ids = [tuple([number.setdefault(w, len(number)) for w in words(p)]) for p in pieces]

    def recurring(self, copies: list[int], rows: list[int]) -> dict[int, list[int]]:
        """Stretch -> windows that start there first and twice or more among `rows`: found by 64-bit hash, counted again by the automaton."""
        flat = np.concatenate([np.array(self.ids[r], np.uint64) for r in rows])
        n = np.array([len(self.ids[r]) for r in rows])
        starts = np.cumsum(n) - n
        own = np.repeat(np.arange(len(rows)), n)
        off = np.arange(len(flat)) - starts[own]
        h = rolled(mixed((flat + np.uint64(1)) * _ODD), self.window)
        inside = np.flatnonzero((off + self.window <= n[own])[: len(h)])
        _, at, back = np.unique(h[inside], return_index=True, return_inverse=True)
        weight = np.bincount(back, weights=np.array(copies, np.float64)[np.array(rows)[own[inside]]])
        again = np.sort(inside[at[weight >= 2]])
        out: dict[int, list[int]] = {}
        for r, o in zip(np.array(rows)[own[again]].tolist(), off[again].tolist()):
            out.setdefault(r, []).append(o)
        return out

    def occurrences(self, patterns: dict[int, list[int]], rows: list[int], copies: list[int] | None) -> Iterator[tuple[int, int]]:
        """(stretch, window) for every occurrence of a pattern in `rows`; with weights, only of patterns that occur twice."""
        machine, number = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE), 0
        for r, offsets in patterns.items():
            ids = self.ids[r]
            for o in offsets:
                number += machine.add_word(ids[o : o + self.window], number)
        if not number:
            return
        machine.make_automaton()
        found, weight = [], [0] * (number + 1)
        for r in rows:
            c = 2 if copies is None else copies[r]
            for end, p in machine.iter(self.ids[r]):
                weight[p] += c
                found.append((p, r, end - self.window + 1))
        yield from ((r, o) for p, r, o in found if weight[p] >= 2)


def covered(phrases: Phrases, seed: list[int], copies: list[int], known: list[list[int]] | None) -> Iterator[tuple[int, int, int]]:
    """(stretch, first word, word after) of every run of recurring windows, a bounded number of patterns at a time.

    Seeds are taken whole, as all stretches of a seed must meet the patterns of all others; `known` gives the recurring windows
    where they have been counted before.
    """
    order = sorted(range(len(seed)), key=seed.__getitem__)
    blocks, rows, size = [], [], 0
    for i, r in enumerate(order):
        rows.append(r)
        size += len(phrases.ids[r]) - phrases.window + 1
        if size >= PATTERNS and (i + 1 == len(order) or seed[order[i + 1]] != seed[r]):
            blocks, rows, size = [*blocks, rows], [], 0
    for rows in [*blocks, rows] if rows else blocks:
        patterns = phrases.recurring(copies, rows) if known is None else {r: known[r] for r in rows if known[r]}
        last: list[int] = []
        for r, o in phrases.occurrences(patterns, rows, copies if known is None else None):
            if last and last[0] == r and o <= last[2]:
                last[2] = max(last[2], o + phrases.window)
            else:
                if last:
                    yield tuple(last)
                last = [r, o, o + phrases.window]
        if last:
            yield tuple(last)


def _located(table: pa.Table, window: int) -> pa.Table:
    """Runs `piece_id, a, b` of recurring words in the stretches of one group."""
    known = table.column("known").to_pylist() if "known" in table.column_names else None
    phrases = Phrases(table.column("piece").to_pylist(), window)
    rows = list(covered(phrases, table.column("seed").to_pylist(), table.column("copies").to_pylist(), known))
    r, a, b = (np.array(x, np.int64) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 3
    return pa.table({"piece_id": table.column("piece_id").take(pa.array(r)), "a": pa.array(a.astype(np.int32)), "b": pa.array(b.astype(np.int32))})


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Two hashes, weight and place of every window of stretches `piece_id, copies, piece`."""
    known = WordHashes()
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            batch = whole.slice(at, 1024)
            hashes = [known.of(words(t)) for t in texts(batch, 2)]
            hi, lo = (np.concatenate([rolled(h, window, f) for h in hashes]).view(np.int64) for f in (_ODD, _ODD2))
            n = np.array([len(h) - window + 1 for h in hashes])
            own = np.repeat(np.arange(len(n)), n)
            off = np.arange(len(own)) - (np.cumsum(n) - n)[own]
            take = pa.array(own)
            yield pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo), batch.column(1).take(take), batch.column(0).take(take), pa.array(off.astype(np.int32))], ["hi", "lo", "copies", "piece_id", "off"])


def _hot(pieces: DataFrame, groups: int, window: int) -> DataFrame:
    """As `_located`, for seeds with many stretches: windows counted by an aggregate, stretches dealt evenly over groups."""
    schema = "hi bigint, lo bigint, copies bigint, piece_id binary, off int"
    windows = written(pieces.select("piece_id", "copies", "piece").mapInArrow(lambda b: _windows(b, window), schema), "repeats-windows", codec="zstd")
    again = windows.groupBy("hi", "lo").agg(F.sum("copies").alias("n")).where("n >= 2").select("hi", "lo")
    known = windows.join(again, ["hi", "lo"]).groupBy("piece_id").agg(F.collect_list("off").alias("known"))
    dealt = pieces.join(known, "piece_id").withColumn("part", F.pmod(F.xxhash64("piece_id"), F.lit(groups)))
    return dealt.groupBy("part").applyInArrow(lambda t: _located(t, window), "piece_id binary, a int, b int")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs of each text joined where they touch."""
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    for batch in batches:
        out = []
        for runs in batch.column(1).to_pylist():
            done = runs[:1]
            for s in runs[1:]:
                if s["a"] <= done[-1]["b"]:
                    done[-1]["b"] = max(done[-1]["b"], s["b"])
                else:
                    done.append(s)
            out.append(done)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["d", "spans"])


def spans(docs: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """Words covered by recurring windows: `d` (digest of the text), `spans` (sorted, disjoint runs of words from `a` up to, not with, `b`).

    Texts without such words have no row. Rows count as they are, copies too, so a text that is there twice and has `window` words is
    covered whole; null texts hold no words; other columns are not looked at; an empty table gives an empty one.
    """
    docs = docs.select(F.col(text_col).alias("text")).where("text is not null").select(_digest("text").alias("d"), "text")
    schema = "d binary, seed bigint, first int, n int, times int"
    every = written(docs.mapInArrow(lambda b: _stretches(b, window), schema), "repeats-seeds", codec="zstd")
    often = every.groupBy("seed").agg(F.sum("times").alias("places")).where("places >= 2").select("seed")
    cands = every.join(often, "seed").groupBy("d").agg(F.collect_set(F.struct("first", "n", "seed")).alias("cands"))
    once = docs.groupBy("d").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    schema = "d binary, seed bigint, first int, copies bigint, piece binary"
    pieces = once.join(cands, "d").select("d", "text", "copies", "cands").mapInArrow(lambda b: _pieces(b, window), schema)
    placed = written(pieces.withColumn("piece_id", _digest("piece")), "repeats-placed", codec="zstd")
    discard(every)
    # one row per different stretch; seeds that still have many are counted apart
    stretches = written(placed.groupBy("seed", "piece", "piece_id").agg(F.sum("copies").alias("copies")), "repeats-stretches", codec="zstd")
    hot = stretches.groupBy("seed").count().where(F.col("count") > HOT).select("seed")
    n, crowded = stretches.count(), hot.count()
    groups = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // GROUP))
    rest = stretches.join(hot, "seed", "left_anti") if crowded else stretches
    dealt = rest.withColumn("part", F.pmod(F.xxhash64("seed"), F.lit(groups)))
    found = dealt.groupBy("part").applyInArrow(lambda t: _located(t, window), "piece_id binary, a int, b int")
    if crowded:
        found = found.unionByName(_hot(stretches.join(hot, "seed", "left_semi"), groups, window))
    found = placed.select("d", "first", "piece_id").join(found, "piece_id").select("d", (F.col("first") + F.col("a")).alias("a"), (F.col("first") + F.col("b")).alias("b"))
    runs = found.groupBy("d").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("runs"))
    merged = runs.mapInArrow(_merged, "d binary, spans array<struct<a:int,b:int>>")
    out = written(merged, "repeats-spans", codec="zstd")
    discard(placed, stretches)
    return out


def _cut(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 64):
            batch = whole.slice(at, 64)
            n, removed, kept = [], [], []
            for text, spans in zip(texts(batch), batch.column(2).to_pylist()):
                own, gone = words(text), 0
                n.append(len(own))
                for s in reversed(spans or ()):
                    gone += s["b"] - s["a"]
                    del own[s["a"] : s["b"]]
                removed.append(gone)
                kept.append(b" ".join(own))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names)


def cut(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row `id_col, n_words, n_removed, kept`: the words outside every recurring window, joined by one space.

    A window recurs if its word sequence starts anywhere else, in the same text too; windows are judged on the input. Null and empty
    texts have no words and keep ''; ids are passed on as they are, null and repeated ones too; other columns are not looked at;
    an empty table gives an empty one.
    """
    found = spans(docs, window, text_col)
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text")).withColumn("d", _digest("text"))
    if found.count() <= BROADCAST_TEXTS:
        found = F.broadcast(found)
    joined = rows.join(found, "d", "left").select(id_col, "text", "spans")
    names = [id_col, "n_words", "n_removed", "kept"]
    kind = joined.schema[0].dataType.simpleString()
    return joined.mapInArrow(lambda b: _cut(b, names), f"`{id_col}` {kind}, n_words bigint, n_removed bigint, kept string")
