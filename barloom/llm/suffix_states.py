"""States of a probabilistic suffix tree, found and used in groups of equal contexts.

Every word is a symbol. A context of k words is a candidate when it occurs `LEAST` times; level by level, those whose next symbols diverge
from what their suffix predicts stay as states. Nothing is bounded by a share of the corpus: states and what follows them grow with it. A
token's probability over its word frequency is q(k) = f + b * q(k - 1) for each state k words back, from q(0) = 1, where b belongs to the
state and f to the state and the token.

Texts become chunks of word numbers (`encoded`, `numbered`, `coded`). Each token then goes, with the three words before it and the place of
its text, to the group of its last word (`dealt`): all longer contexts that end in that word, their suffixes and the tokens to be scored
by them meet there, so one shuffle of packed columns counts, tests and scores all levels (`gains`). A context that occurs more than
`BROADCAST_STATES` times is dealt to several groups by the word before it; its followers are counted by themselves, in slices, and sent to
these groups (`Often`). Texts' sums go back to their chunks (`scored`).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import count
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from barloom.llm.common import mixed, texts, written

#: Longest context in words.
DEPTH = 3
#: The least occurrences of a context, and of a symbol kept with a state.
LEAST, FOLLOW_LEAST = 16, 2
#: Occurrences that the suffix's distribution counts as in each state.
PRIOR = 20.0
#: A context that occurs more often than this is dealt to several groups, and what follows it is sent to each of them.
BROADCAST_STATES = 500_000
#: Tokens of a chunk of texts, and those that a group of contexts holds on average.
CHUNK, GROUP = 1_000_000, 500_000
#: So many sets of groups are shuffled (unless tokens would be more than `SET` in each), so that a chunk's share of a set is no few tokens.
SETS, SET = 64, 4_000_000
#: Sums of texts that a set holds before it hands them on.
HELD = 2_000_000
#: Words are numbered in so many parts.
PARTS = 512
_NONE, _END, _FIRST = 0, 1, 2  # numbers: no word of a context, the end of a text, the first word


def pack(x: np.ndarray) -> bytes:
    """Numbers below 2**32, compressed byte by byte of their width."""
    planes = np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return len(x).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 4 * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").reshape(-1)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys in order, a place of each, and for each place which key it has."""
    found, which = np.unique(keys, return_inverse=True)
    at = np.empty(len(found), np.int64)
    at[which] = np.arange(len(keys))
    return found, at, which


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema)], schema=schema)


def _ddl(schema: pa.Schema, id_type: str = "") -> str:
    names = {pa.int64(): "bigint", pa.int32(): "int", pa.binary(): "binary", pa.bool_(): "boolean", pa.float64(): "double"}
    return ", ".join(f"{f.name} {id_type if f.name == 'doc_id' else names[f.type]}" for f in schema)


@dataclass(frozen=True)
class Ids:
    """The type of the texts' ids, for Arrow and for Spark."""

    arrow: pa.DataType
    spark: str


def encoded(rows: DataFrame, words: Callable[[bytes], list[bytes]], ids: Ids) -> DataFrame:
    """Chunks of `rows(doc_id, held, text)`.

    Part -2 is a text (its id and place), -1 the chunk's tokens as places in the chunk's words, the texts' sizes (and whether they are
    trained on) and the words' parts; the others are the chunk's words of a part, and how often each is in training texts and in all.
    """
    schema = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("doc_id", ids.arrow), ("held", pa.bool_()), ("place", pa.int32()),
                        ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("train", pa.int64()), ("tokens", pa.int64())])

    def flush(chunk: int, place: dict, tokens: list, sizes: list, train: list) -> pa.RecordBatch:
        flat, size, learnt = np.concatenate(tokens), np.array(sizes, np.int64), np.array(train, bool)
        every = np.bincount(flat, minlength=len(place))
        known = np.bincount(flat[np.repeat(learnt, size)], minlength=len(place))
        names = list(place)[1:]
        part = np.fromiter(map(crc32, names), np.int64, len(names)) % PARTS
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange(PARTS + 1)).tolist()
        rest = (None, None, None)
        out = [(chunk, -1, *rest, pack(flat), pack(size * 2 + learnt), pack(part), int(size[learnt].sum()), len(flat))]
        for p in range(PARTS):
            if edges[p] < edges[p + 1]:
                own = order[edges[p] : edges[p + 1]]
                counts = np.concatenate([known[own + 1], every[own + 1]])
                out.append((chunk, p, *rest, pa.compress(joined := b" ".join([names[i] for i in own]), "zstd", asbytes=True), pack(counts), len(joined).to_bytes(8, "little"), None, None))
        return _batch(schema, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, left = (TaskContext.get().partitionId() << 32) - 1, 0
        tokens, sizes, train = [], [], []
        for batch in batches:
            out = []
            for doc, held, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch, 2)):
                if not sizes:
                    chunk, left, place = chunk + 1, CHUNK, defaultdict(count().__next__)
                    place[b""]  # the end is the first word
                w = words(t)
                s = np.zeros(len(w) + 1, np.uint32)
                s[:-1] = np.fromiter(map(place.__getitem__, w), np.uint32, len(w))
                out.append((chunk, -2, doc, held, len(sizes), None, None, None, None, None))
                tokens.append(s)
                sizes.append(len(s))
                train.append(held is False)
                left -= len(s)
                if left <= 0:
                    yield flush(chunk, place, tokens, sizes, train)
                    tokens, sizes, train = [], [], []
            yield _batch(schema, out)
        if sizes:
            yield flush(chunk, place, tokens, sizes, train)

    return rows.mapInArrow(run, _ddl(schema, ids.spark))


def numbered(chunks: DataFrame) -> DataFrame:
    """Numbers of each chunk's words of each part, in the order given; words of a part are numbered by falling training counts.

    Chunk -1 has the counts of a part (from which number in the part on a count holds) and how many words have one; -2 the words that occur often.
    """
    schema = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("n", pa.int64())])
    often = BROADCAST_STATES

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        part, place, found = key[0].as_py(), defaultdict(count().__next__), []
        for words, counts, size in zip(*(table[c].to_pylist() for c in "abc")):
            w = pa.decompress(words, int.from_bytes(size, "little"), "zstd", asbytes=True).split(b" ")
            found.append((np.fromiter(map(place.__getitem__, w), np.int64, len(w)), unpack(counts).reshape(2, -1)))
        at, counts = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found], axis=1)
        train, every = (np.bincount(at, c, len(place)).astype(np.int64) for c in counts)
        order = np.argsort(-train, kind="stable")
        rank = np.empty(len(place), np.int64)
        rank[order] = np.arange(len(place))
        number, falling = _FIRST + rank * PARTS + part, train[order]
        steps = np.flatnonzero(np.r_[True, falling[1:] != falling[:-1]])
        many = np.flatnonzero(every > often)
        rows = [(chunk, part, pack(number[x]), None, None) for chunk, (x, _) in zip(table["chunk"].to_pylist(), found)]
        rows += [(-1, part, pack(steps), pack(falling[steps]), int((train > 0).sum())), (-2, part, pack(number[many]), pack(every[many]), None)]
        return pa.Table.from_batches([_batch(schema, rows)])

    return chunks.where("part >= 0").select("chunk", "part", "a", "b", "c").groupBy("part").applyInArrow(run, _ddl(schema))


@dataclass(frozen=True)
class Counts:
    """Training counts of numbered words: a table of steps, as numbers follow the counts."""

    starts: np.ndarray  # part << 32 | first number in the part
    counts: np.ndarray
    ends: int  # of texts
    tokens: int  # N
    distinct: int  # V, the end included

    @property
    def mass(self) -> float:
        return self.tokens + 0.5 * (self.distinct + 1)

    def of(self, numbers: np.ndarray) -> np.ndarray:
        out = np.zeros(len(numbers), np.int64)
        out[numbers == _END] = self.ends
        word = np.flatnonzero(numbers >= _FIRST)
        x = numbers[word].astype(np.int64) - _FIRST
        if len(word):
            out[word] = self.counts[np.searchsorted(self.starts, x % PARTS << 32 | x // PARTS, "right") - 1]
        return out

    def root(self, numbers: np.ndarray) -> np.ndarray:
        return (self.of(numbers) + 0.5) / self.mass


def counted(chunks: DataFrame, numbers: DataFrame) -> tuple[Counts, int]:
    """The counts, and how many tokens there are in all."""
    train, tokens, ends = (x or 0 for x in chunks.agg(F.sum("train"), F.sum("tokens"), F.count_if(F.expr("part = -2 and not held"))).first())
    found = sorted(numbers.where("chunk = -1").select("part", "a", "b", "n").collect())
    starts = [unpack(bytes(r.a)).astype(np.int64) | r.part << 32 for r in found]
    counts = [unpack(bytes(r.b)).astype(np.int64) for r in found]
    whole = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return Counts(whole(starts), whole(counts), ends, train, sum(r.n for r in found) + (ends > 0)), tokens


def coded(chunks: DataFrame, numbers: DataFrame, counts, ids: Ids) -> DataFrame:
    """A row per chunk (part -1): tokens, sizes, the words' numbers, and per text how many tokens are known and the logarithms of their counts; the texts as before."""
    schema = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("tokens", pa.binary()), ("sizes", pa.binary()), ("numbers", pa.binary()), ("known", pa.binary()), ("logs", pa.binary())])

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table[c].to_pylist() for c in ("part", "a", "b", "c"))), key=lambda r: r[0])
        _, tokens, sizes, parts = rows[0]
        number = np.full(len(part := unpack(parts)) + 1, _END, np.uint32)
        if len(part):
            number[1 + np.argsort(part, kind="stable")] = np.concatenate([unpack(r[1]) for r in rows[1:]])
        c, size = counts.value.of(number), unpack(sizes) >> 1
        first, flat = np.cumsum(size, dtype=np.int64) - size, unpack(tokens)
        known = np.add.reduceat((c > 0)[flat].astype(np.int64), first)
        logs = np.add.reduceat(np.log10(c + 0.5)[flat], first)
        return pa.Table.from_batches([_batch(schema, [(key[0].as_py(), -1, tokens, sizes, pack(number), pack(known), logs.tobytes())])])

    columns = ["chunk", "part", "a", "b", "c"]
    replies = numbers.where("chunk >= 0").select("chunk", "part", "a", F.lit(None).cast("binary").alias("b"), F.lit(None).cast("binary").alias("c"))
    whole = chunks.where("part = -1").select(columns).unionByName(replies).groupBy("chunk").applyInArrow(run, _ddl(schema))
    return whole.unionByName(chunks.where("part = -2").select("chunk", "part", "doc_id", "held", "place"), allowMissingColumns=True)


def _hash(x: np.ndarray) -> np.ndarray:
    return mixed(x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@dataclass(frozen=True)
class Groups:
    """How many groups of contexts there are; a set of some of them is shuffled to one place, where they are worked through one by one."""

    groups: int
    sets: int

    @classmethod
    def of(cls, tokens: int) -> Groups:
        groups = max(1, tokens // GROUP)
        return cls(groups, min(groups, max(SETS, tokens // SET)))


@dataclass
class Often:
    """Contexts dealt to several groups, level by level: sorted keys (place of the suffix in the level before << 32 | word)."""

    keys: list[np.ndarray] = field(default_factory=list)
    words: list[np.ndarray] = field(default_factory=list)  # per context its words, the last first
    spread: list[np.ndarray] = field(default_factory=list)  # to how many groups
    slices: list[np.ndarray] = field(default_factory=list)  # of followers, as many as its last word is spread to

    def add(self, keys: np.ndarray, every: np.ndarray) -> None:
        order = np.argsort(keys)
        keys = keys[order]
        own = (keys & 0xFFFFFFFF).reshape(-1, 1)
        self.words.append(np.hstack([self.words[-1][keys >> 32], own]) if self.keys else own)
        self.spread.append(-(-every[order] // max(BROADCAST_STATES, 1)))
        self.slices.append(self.slices[-1][keys >> 32] if self.keys else self.spread[-1])
        self.keys.append(keys)

    def found(self, level: int, suffix: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of contexts in the level, and which are there at all."""
        key = suffix.astype(np.int64) << 32 | word.astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys[level], key), len(self.keys[level]) - 1)
        return at, self.keys[level][at] == key

    def first(self, level: int, at: np.ndarray) -> np.ndarray:
        return _hash(self.keys[level][at] + (level << 60))

    def groups(self, groups: int) -> list[list[set[int]]]:
        """Per level and context the groups its occurrences are dealt to, with those of longer ones."""
        out: list[list[set[int]]] = []
        for level, keys in enumerate(self.keys):
            first = self.first(level, np.arange(len(keys)))
            out.append([{(int(f) % groups + i) % groups for i in range(n)} for f, n in zip(first, self.spread[level])])
        for level in range(len(out) - 1, 0, -1):
            for i, key in enumerate(self.keys[level]):
                out[level - 1][key >> 32] |= out[level][i]
        return out


class Tokens:
    """Tokens of a chunk: numbers, the three words before (none if too rare for a context, and before such), their texts."""

    def __init__(self, row: dict, counts: Counts):
        number, flat, sizes = unpack(row["numbers"]), unpack(row["tokens"]), unpack(row["sizes"])
        train, size = (sizes & 1).astype(np.uint8), sizes >> 1
        context = np.where((number != _END) & (counts.of(number) >= LEAST), number, _NONE).astype(np.uint32)[flat]
        self.text = np.repeat(np.arange(len(size), dtype=np.int32), size)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(size, dtype=np.int64) - size, size)
        self.next = number[flat]
        self.train, self.before, ok = train[self.text], [], np.ones(len(flat), bool)
        for k in range(1, DEPTH + 1):
            w = np.zeros(len(flat), np.uint32)
            w[k:] = context[:-k]
            ok = ok & (place >= k) & (w != _NONE)
            self.before.append(np.where(ok, w, np.uint32(_NONE)))

    def often(self, often: Often) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Level by level: the tokens after contexts that occur often, and the contexts' places."""
        at, code = np.flatnonzero(self.before[0]), None
        for level in range(len(often.keys)):
            if not len(often.keys[level]):
                return
            code, hit = often.found(level, np.zeros(len(at), np.int64) if code is None else code, self.before[level][at])
            at, code = at[hit], code[hit]
            yield level, at, code


_FOLLOWERS = pa.schema([("key", pa.int64()), ("slice", pa.int64()), ("code", pa.int64()), ("next", pa.binary()), ("c", pa.binary()), ("every", pa.binary()), ("below", pa.binary())])
_TESTED = pa.schema([("code", pa.int64()), ("slice", pa.int64()), ("next", pa.binary()), ("c", pa.binary()), ("below", pa.binary()), ("often", pa.binary()), ("times", pa.binary()),
                     ("total", pa.int64()), ("kinds", pa.int64()), ("kept", pa.int64()), ("gain", pa.float64())])
_DEALT = pa.schema([("set", pa.int32()), ("chunk", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])


def _followers(whole: DataFrame, counts, often, level: int) -> DataFrame:
    """What follows the contexts of a level that occur often, per chunk, context and slice; the key is the suffix's place, or the context's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                t, out = Tokens(batch.slice(i, 1).to_pylist()[0], counts.value), []
                for k, at, code in t.often(often.value):
                    if k == level and len(at):
                        keys, which = np.unique(code << 32 | t.next[at], return_inverse=True)
                        c, every = np.bincount(which, t.train[at], len(keys)), np.bincount(which, minlength=len(keys))
                        code, nxt = keys >> 32, keys & 0xFFFFFFFF
                        piece = (_hash(nxt) % often.value.slices[k][code].astype(np.uint64)).astype(np.int64)
                        order = np.lexsort((piece, code))
                        code, piece = code[order], piece[order]
                        edges = np.flatnonzero(np.r_[True, (np.diff(code) != 0) | (np.diff(piece) != 0), True])
                        for i, j in zip(edges, edges[1:]):
                            own, key = order[i:j], int(often.value.keys[k][code[i]] >> 32) if k else int(code[i])
                            out.append((key, int(piece[i]), int(code[i]), pack(nxt[own]), pack(c[own]), pack(every[own]), None))
                yield _batch(_FOLLOWERS, out)

    return whole.mapInArrow(run, _ddl(_FOLLOWERS))


def _tested(followers: DataFrame, counts, states, limit: int) -> DataFrame:
    """Per context and slice its followers, what their suffix predicts of them, those that occur often, and the sums for the test.

    Rows with code -1 are the suffix's followers; `states` are occurrences of suffixes and whether they stay.
    """

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        parts, out, suffix = defaultdict(list), [], None
        for code, *columns in zip(*(table[c].to_pylist() for c in ("code", "next", "c", "every", "below"))):
            parts[code].append(columns)
        if states is not None:
            total, _, stays = states.value[key[0].as_py()]
            ((nxt, c, _, below),) = parts.pop(-1)
            suffix = unpack(nxt).astype(np.int64), unpack(c) / total if stays else np.frombuffer(below)
        for code, found in sorted(parts.items()):
            nxt, which = np.unique(np.concatenate([unpack(x[0]) for x in found]).astype(np.int64), return_inverse=True)
            c, every = (np.bincount(which, np.concatenate([unpack(x[i]) for x in found]), len(nxt)).astype(np.int64) for i in (1, 2))
            below = counts.value.root(nxt) if suffix is None else suffix[1][np.searchsorted(suffix[0], nxt)]
            n, low = c[c > 0], below[c > 0]
            many = np.flatnonzero((every > limit) & (nxt != _END))
            out.append((code, key[1].as_py(), pack(nxt), pack(c), below.tobytes(), pack(nxt[many]), pack(every[many]), int(n.sum()), len(n), int(n[n >= FOLLOW_LEAST].sum()), float((n * np.log(n / low)).sum())))
        return pa.Table.from_batches([_batch(_TESTED, out)])

    return followers.groupBy("key", "slice").applyInArrow(run, _ddl(_TESTED))


def sent(whole: DataFrame, numbers: DataFrame, counts, groups: Groups) -> tuple[Often, DataFrame | None]:
    """The contexts that occur often, and per group their followers, as in `dealt` (numbers, counts, and the state)."""
    share, often, limit = whole.sparkSession.sparkContext.broadcast, Often(), BROADCAST_STATES
    found = numbers.where("chunk = -2").select("a", "b").collect()
    keys, every = (np.concatenate([unpack(bytes(r[i])) for r in found] or [np.zeros(0, np.int64)]).astype(np.int64) for i in (0, 1))
    keys, every = keys[(fits := counts.value.of(keys) >= LEAST)], every[fits]
    states, tables = [], []
    while len(keys):
        level = len(often.keys)
        often.add(keys, every)
        rows = _followers(whole, counts, share(often), level)
        if tables:
            rows = rows.unionByName(tables[-1].select(F.col("code").alias("key"), "slice", F.lit(-1).cast("bigint").alias("code"), "next", "c", "below"), allowMissingColumns=True)
        tables.append(written(_tested(rows, counts, share(states[-1]) if states else None, limit), f"followers-{level}"))
        state = np.zeros((len(often.keys[level]), 3), np.int64)  # occurrences, those of kept followers, whether it stays
        for r in tables[-1].groupBy("code").agg(*(F.sum(x).alias(x) for x in ("total", "kinds", "kept", "gain"))).collect():
            stays = r.total >= LEAST and r.gain - r.total * np.log(r.total) > 0.5 * r.kinds * np.log(r.total)
            state[r.code] = r.total, r.kept, stays
        states.append(state)
        if level + 1 == DEPTH:
            break
        # a longer context is as frequent as its last word after the rest, which then is in this level
        place = {tuple(w): i for i, w in enumerate(often.words[level].tolist())}
        longer = []
        for r in tables[-1].select("code", "often", "times").collect():
            for word, times in zip(unpack(bytes(r.often)).tolist(), unpack(bytes(r.times)).tolist()):
                *suffix, first = word, *often.words[level][r.code].tolist()
                if tuple(suffix) in place:
                    longer.append((place[tuple(suffix)] << 32 | first, times))
        keys, every = np.array([k for k, _ in longer], np.int64), np.array([n for _, n in longer], np.int64)

    where, out = often.groups(groups.groups), None
    for level, rows in enumerate(tables):
        heads = [pack(np.array([level, *w, *([0] * (DEPTH - 1 - level)), *s])) for w, s in zip(often.words[level].tolist(), states[level].tolist())]
        each = _addressed(rows, share((heads, [[(g % groups.sets, g // groups.sets) for g in sorted(x)] for x in where[level]])))
        out = each if out is None else out.unionByName(each)
    return often, out


def _addressed(rows: DataFrame, info) -> DataFrame:
    """Followers of a level, once for each group that gets them; `info` has the contexts' states and groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, to = info.value
        for batch in batches:
            for code, nxt, c in zip(*(x.to_pylist() for x in batch.columns)):
                yield _batch(_DEALT, [(s, -1, nxt, c, heads[code], pack(np.array([g]))) for s, g in to[code]])

    return rows.select("code", "next", "c").mapInArrow(run, _ddl(_DEALT))


def dealt(whole: DataFrame, counts, often, groups: Groups) -> DataFrame:
    """Tokens after a context, by set of groups: `set, chunk, a, b, c, d` (the three words before; the token; its text and whether it is
    trained on; how many tokens of each group of the set, in order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sets = groups.groups, groups.sets
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                t = Tokens(row, counts.value)
                group = (_hash(t.before[0]) % np.uint64(n)).astype(np.int64)
                for level, at, code in t.often(often.value):
                    by = t.before[level + 1][at] if level + 1 < DEPTH else t.next[at]
                    start = (often.value.first(level, code) % np.uint64(n)).astype(np.int64)
                    group[at] = (start + (_hash(by) % often.value.spread[level][code].astype(np.uint64)).astype(np.int64)) % n
                some = np.flatnonzero(t.before[0])
                where, own = group[some] % sets, group[some] // sets
                order = np.argsort(where * (n // sets + 1) + own, kind="stable")
                where, own, some = where[order], own[order], some[order]
                edges = np.flatnonzero(np.diff(where, prepend=-1, append=-1)) if len(some) else []
                text, out = t.text * 2 + t.train.astype(np.int32), []
                for i, j in zip(edges, edges[1:]):
                    x = some[i:j]
                    out.append((int(where[i]), row["chunk"], pack(np.concatenate([w[x] for w in t.before])), pack(t.next[x]), pack(np.diff(text[x], prepend=0)), pack(np.bincount(own[i:j]))))
                yield _batch(_DEALT, out)

    return whole.mapInArrow(run, _ddl(_DEALT))


class Group:
    """Tokens of a group with their contexts; `q` is a token's probability over that without a context, `met` whether it had a state."""

    def __init__(self, before: list[np.ndarray], nxt: np.ndarray, train: np.ndarray, counts: Counts, sent: dict[tuple, list]):
        self.before, self.train, self.sent = before, train, sent
        self.kinds, self.next = np.unique(nxt, return_inverse=True)
        self.root = counts.root(self.kinds)[self.next]
        self.below, self.q, self.met = self.root.copy(), np.ones(len(nxt)), np.zeros(len(nxt), bool)
        at, suffix = np.arange(len(nxt)), np.zeros(len(nxt), np.int64)
        for level in range(DEPTH):
            some = before[level][at] != _NONE
            at, suffix = at[some], suffix[some]
            if not len(at):
                return
            _, one, context = _distinct(suffix << 32 | before[level][at])
            total = self._level(level, at, one, context)
            more = total[context] >= LEAST
            at, suffix = at[more], context[more]

    def _level(self, level: int, at: np.ndarray, first: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Tests the contexts of a level and lets those that stay predict their tokens; their occurrences."""
        total = np.bincount(context, self.train[at], len(first))
        often = total >= LEAST
        split = self._split(level, at[first])
        for i in split:
            often[i] = True
        rows = often[context]
        at, context = at[rows], context[rows]
        if not len(at):
            return total
        _, one, pair = _distinct(context * len(self.kinds) + self.next[at])
        c = np.bincount(pair, self.train[at], len(one))
        seen = c > 0
        of, n, below = context[one][seen], c[seen], self.below[at[one]][seen]
        gain = np.bincount(of, n * np.log(n / total[of] / below), len(first))
        kinds, kept = np.bincount(of, minlength=len(first)), np.bincount(of, np.where(n >= FOLLOW_LEAST, n, 0), len(first))
        stays = often & (gain > 0.5 * kinds * np.log(np.maximum(total, 1)))
        c = c[pair]
        for i, (state, numbers, counts) in split.items():
            total[i], kept[i], stays[i] = state
            own = np.flatnonzero(context == i)
            c[own] = self._looked_up(numbers, counts, self.kinds[self.next[at[own]]])
        hit = stays[context]
        at, context, c = at[hit], context[hit], c[hit]
        n = total[context]
        f = np.where(c >= FOLLOW_LEAST, c, 0) / self.root[at] / (n + PRIOR)
        self.q[at] = f + (n - kept[context] + PRIOR) / (n + PRIOR) * self.q[at]
        self.below[at] = c / n
        self.met[at] = True
        return total

    def _split(self, level: int, first: np.ndarray) -> dict[int, tuple]:
        """Contexts, by their place, of which the group has only a part of the occurrences."""
        if not any(len(k) == level + 1 for k in self.sent):
            return {}
        words = zip(*(w[first].tolist() for w in self.before[: level + 1]))
        return {i: self.sent[w] for i, w in enumerate(words) if w in self.sent}

    @staticmethod
    def _looked_up(numbers: np.ndarray, counts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(numbers, wanted), len(numbers) - 1)
        return np.where(numbers[at] == wanted, counts[at], 0)


def _received(rows: list[tuple], group: int) -> dict[tuple, tuple]:
    """Followers sent to a group, by context: the state, the followers' numbers in order and their counts."""
    parts = defaultdict(list)
    for _, a, b, head, to in rows:
        if unpack(to)[0] == group:
            parts[tuple(unpack(head).tolist())].append((unpack(a), unpack(b)))
    out = {}
    for (level, *rest), found in parts.items():
        numbers, counts = (np.concatenate(x).astype(np.int64) for x in zip(*found))
        order = np.argsort(numbers)
        out[tuple(rest[: level + 1])] = (rest[DEPTH:], numbers[order], counts[order])
    return out


def gains(tokens: DataFrame, counts) -> DataFrame:
    """`chunk, a, b, c` per group and chunk: texts, the logarithms of their gains by context in the group, and how many tokens had a state."""
    schema = pa.schema([("chunk", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])

    def some(data: bytes, at: slice, rows: int = 1) -> np.ndarray:
        return np.ascontiguousarray(unpack(data).reshape(rows, -1)[:, at])

    def added(sums: dict[int, list]) -> pa.RecordBatch:
        out = []
        for chunk, parts in sums.items():
            docs, gain, states = (np.concatenate(x) for x in zip(*parts))
            docs, which = np.unique(docs, return_inverse=True)
            out.append((chunk, pack(np.diff(docs, prepend=0)), np.bincount(which, gain).tobytes(), pack(np.bincount(which, states))))
        return _batch(schema, out)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        rows = sorted(zip(*(table[c].to_pylist() for c in ("chunk", "a", "b", "c", "d"))), key=lambda r: r[0])
        sent, own = [r for r in rows if r[0] < 0], [r for r in rows if r[0] >= 0]
        edges, held, sums = [np.cumsum([0, *unpack(r[4])]) for r in own], 0, defaultdict(list)
        for group in range(max((len(e) - 1 for e in edges), default=0)):
            here = [(r, slice(e[group], e[group + 1])) for r, e in zip(own, edges) if group + 1 < len(e) and e[group] < e[group + 1]]
            if not here:
                continue
            before = list(np.concatenate([some(r[1], at, DEPTH) for r, at in here], axis=1))
            nxt = np.concatenate([unpack(r[2])[at] for r, at in here])
            text = [np.cumsum(unpack(r[3]), dtype=np.uint32)[at].astype(np.int64) for r, at in here]
            g = Group(before, nxt, (np.concatenate(text) & 1).astype(np.uint8), counts.value, _received(sent, group))
            end = 0
            for (r, _), t in zip(here, text):
                start, end = end, end + len(t)
                hit = g.met[start:end]
                if hit.any():
                    docs = t[hit] >> 1
                    first = np.flatnonzero(np.diff(docs, prepend=-1))
                    sums[r[0]].append((docs[first], np.add.reduceat(np.log10(g.q[start:end][hit]), first), np.diff(first, append=len(docs))))
                    held += len(first)
            if held > HELD:
                yield added(sums)
                held, sums = 0, defaultdict(list)
        yield added(sums)

    return tokens.groupBy("set").applyInArrow(run, _ddl(schema))


def scored(whole: DataFrame, found: DataFrame, ids: Ids) -> DataFrame:
    """`doc_id, held, n_tokens, n_known, logs, gain, n_states` per text: a chunk's texts, what is known of them and their sums in all groups."""
    schema = pa.schema([("doc_id", ids.arrow), ("held", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("logs", pa.float64()), ("gain", pa.float64()), ("n_states", pa.int64())])

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        kind = table["part"].to_numpy()
        docs, (base,) = table.filter(pa.array(kind == -2)), table.filter(pa.array(kind == -1)).to_pylist()
        n = docs.num_rows
        gain, states = np.zeros(n), np.zeros(n, np.int64)
        sums = table.filter(pa.array(kind == 0)).select(["a", "b", "c"])
        for a, b, c in sorted(zip(*(x.to_pylist() for x in sums.columns))):  # in one order, so that sums repeat
            at = np.cumsum(unpack(a), dtype=np.int64)
            gain[at] += np.frombuffer(b)
            states[at] += unpack(c)
        at = docs["place"].to_numpy()
        of = lambda x: pa.array(np.asarray(x)[at])
        columns = [of((unpack(base["a"]) >> 1).astype(np.int64)), of(unpack(base["b"]).astype(np.int64)), of(np.frombuffer(base["c"])), of(gain), of(states)]
        return pa.Table.from_arrays([docs["doc_id"], docs["held"], *columns], schema=schema)

    texts_of = whole.where("part = -2").select("chunk", "part", "doc_id", "held", "place")
    base = whole.where("part = -1").select("chunk", "part", F.col("sizes").alias("a"), F.col("known").alias("b"), F.col("logs").alias("c"))
    rows = texts_of.unionByName(base, allowMissingColumns=True).unionByName(found.withColumn("part", F.lit(0)), allowMissingColumns=True)
    return rows.groupBy("chunk").applyInArrow(run, _ddl(schema, ids.spark))
