"""Language-model scores from a probabilistic suffix tree over words.

States are contexts of the last words, as many as the corpus has, found where their tokens meet (`suffix_states`). A context stays if what follows it
diverges from what follows its suffix by more than its own size pays for. A state keeps the words that follow it more than once; the
rest of its probability goes to its suffix's distribution, down to smoothed word frequencies. A token is scored by the longest
suffix of its history that is a state.

`grow`, `Tree` and `vocabulary` hold a small tree of one or two frequent words in memory; `score` doesn't use them.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from barloom.llm import suffix_states
from barloom.llm.common import discard, remainder, shuffles_removed, texts, written

#: Share of the training tokens from which a word is a symbol of its own in contexts; rarer ones are one symbol there.
WORD_SHARE = 1e-5
#: Share from which a context is a candidate, and the least occurrences of one.
STATE_SHARE, LEAST = 2e-5, 16
#: Share of a state's occurrences from which a following symbol is kept, so at most 1 / FOLLOW_SHARE a state; and the least count.
FOLLOW_SHARE, FOLLOW_LEAST = 0.002, 2
#: Occurrences that the suffix's distribution counts as in each state.
PRIOR = 20.0
#: Words (or keys) a task counts before it hands on what it has.
HELD = 500_000
#: Whole texts that a Python worker gets at a time.
BATCH = 512
_RARE, _END = 0, 1
_SHIFT = 21  # symbols fit in 21 bits, as 1 / WORD_SHARE < 2**21


def words(text: bytes) -> list[bytes]:
    """Runs without ASCII white space, A-Z lowered."""
    return text.lower().split()


def _pairs(counts: Counter | dict, names: list[str], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), kind), pa.array(list(counts.values()), pa.int64())], names)


def word_counts(texts_of: DataFrame) -> DataFrame:
    """`word, c` over all texts, added up in each task before the shuffle; the null word counts the ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, ends = Counter(), 0
        for batch in batches:
            for t in texts(batch, 0):
                counts.update(words(t))
                ends += 1
                if len(counts) > HELD:
                    yield _pairs(counts, ["word", "c"], pa.binary())
                    counts = Counter()
        yield _pairs({**counts, None: ends}, ["word", "c"], pa.binary())

    return texts_of.select("text").mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c")).where("c > 0")


@dataclass(frozen=True)
class Vocabulary:
    """Frequent words as symbols from 2 on, with their counts; 0 is any other word, 1 the end of a text."""

    symbol: dict[bytes, int]
    counts: np.ndarray  # per symbol; at 0 of all rare words together
    tokens: int  # N
    distinct: int  # V, the end included
    rare: int  # distinct rare words

    @property
    def mass(self) -> float:
        return self.tokens + 0.5 * (self.distinct + 1)

    def root(self) -> np.ndarray:
        """Probability of each symbol without a context; the rare symbol also stands for words never met."""
        more = np.full(len(self.counts), 0.5)
        more[_RARE] = 0.5 * (self.rare + 1)
        if not self.counts[_END]:
            more[_END] = 0.0
        return (self.counts + more) / self.mass

    def encode(self, w: list[bytes]) -> np.ndarray:
        get = self.symbol.get
        out = np.fromiter((get(x, _RARE) for x in w), np.int64, len(w)) if w else np.zeros(0, np.int64)
        return np.append(out, _END)


def vocabulary(counts: DataFrame, share: float = WORD_SHARE) -> Vocabulary:
    """The frequent words of a table of counts; their number is at most 1 / share, only they are collected."""
    total, distinct, ends = counts.agg(F.sum("c"), F.count("*"), F.sum(F.when(F.col("word").isNull(), F.col("c")))).first()
    total, ends = total or 0, ends or 0
    top = counts.where(F.col("word").isNotNull() & (F.col("c") >= max(share * total, 1))).orderBy(F.desc("c"), "word").toArrow()
    found = np.asarray(top["c"].to_numpy(), np.int64)
    rare = distinct - len(found) - (1 if ends else 0)
    return Vocabulary({w: i + 2 for i, w in enumerate(top["word"].to_pylist())}, np.concatenate([[total - ends - found.sum(), ends], found]), total, distinct, rare)


def _followed(texts_of: DataFrame, voc, contexts) -> DataFrame:
    """`context, next, c`: how often each symbol follows each wanted context (packed; rare words and ends are in none)."""

    def flush(waiting: list[np.ndarray]) -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(waiting), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array((keys >> _SHIFT)), pa.array((keys & ((1 << _SHIFT) - 1))), pa.array(n.astype(np.int64))], ["context", "next", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0
        for batch in batches:
            for t in texts(batch, 0):
                s = voc.value.encode(words(t))
                if contexts is None:
                    keys = (s[:-1] << _SHIFT | s[1:])[s[:-1] > _END]
                else:  # two words back; their place among the wanted contexts stands for them
                    two = s[:-2] << _SHIFT | s[1:-1]
                    at = np.minimum(np.searchsorted(contexts.value, two), len(contexts.value) - 1)
                    hit = contexts.value[at] == two
                    keys = at[hit] << _SHIFT | s[2:][hit]
                waiting.append(keys)
                held += len(keys)
                if held > 4 * HELD:
                    yield flush(waiting)
                    waiting, held = [], 0
        if held:
            yield flush(waiting)

    return texts_of.select("text").mapInArrow(run, "context bigint, next bigint, c bigint").groupBy("context", "next").agg(F.sum("c").alias("c"))


@dataclass(frozen=True)
class Tree:
    """States sorted by context; per state the occurrences, and per kept (state, next) the probability, sorted by key."""

    voc: Vocabulary
    one: np.ndarray  # contexts of one symbol
    two: np.ndarray  # contexts of two symbols, packed
    total: tuple[np.ndarray, np.ndarray]
    kept: tuple[np.ndarray, np.ndarray]  # counts of the symbols kept
    keys: tuple[np.ndarray, np.ndarray]  # place of the state << SHIFT | next
    count: tuple[np.ndarray, np.ndarray]

    def _level(self, d: int, place: np.ndarray, nxt: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """P(next | state): kept counts, and the rest of the state's occurrences with the prior spread like the suffix's distribution."""
        key = place << _SHIFT | nxt
        at = np.minimum(np.searchsorted(self.keys[d], key), len(self.keys[d]) - 1)
        own = np.where(self.keys[d][at] == key, self.count[d][at], 0)
        total, kept = self.total[d][place], self.kept[d][place]
        return (own + (total - kept + PRIOR) * lower) / (total + PRIOR)

    def probabilities(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each symbol of a text its probability after the longest state that fits, and without a context."""
        root = self.voc.root()[s]
        p = root.copy()
        for d, states in enumerate((self.one, self.two)):
            if len(states) and len(s) > d + 1:
                history = s[:-1] if d == 0 else s[:-2] << _SHIFT | s[1:-1]
                at = np.minimum(np.searchsorted(states, history), len(states) - 1)
                hit = np.flatnonzero(states[at] == history)
                p[hit + d + 1] = self._level(d, at[hit], s[hit + d + 1], p[hit + d + 1])
        return p, root


def grow(train: DataFrame, voc: Vocabulary, share: float = STATE_SHARE, least: int = LEAST) -> Tree:
    """The tree from training texts.

    A context of one or two words stays when the information gained by its next symbols over its suffix's, in nats, exceeds half its
    distinct next symbols times the logarithm of its count: what describing its distribution costs. The suffix of a state of
    two words need not be a state; it then stands for the root.
    """
    spark = train.sparkSession
    shared, need = spark.sparkContext.broadcast(voc), max(share * voc.tokens, least)
    root = voc.root()
    pairs = written(_followed(train, shared, None), "pairs")
    sums = pairs.groupBy("context").agg(F.sum("c").alias("total"), F.count("*").alias("kinds")).where(F.col("total") >= need)

    def tested(counted: DataFrame, totals: DataFrame, lower: DataFrame) -> DataFrame:
        """`context, total, next, c` of the contexts that stay; `lower(context, next, below)`: the suffix's probability of what follows."""
        rows = counted.join(totals, "context").join(lower, ["context", "next"])
        gain = F.sum(F.col("c") * F.ln(F.col("c") / F.col("total") / F.col("below")))
        stays = rows.groupBy("context").agg(gain.alias("gain"), F.max("kinds").alias("kinds"), F.max("total").alias("total")).where(F.col("gain") > 0.5 * F.col("kinds") * F.ln("total"))
        return counted.join(stays.select("context", "total"), "context").where((F.col("c") >= FOLLOW_LEAST) & (F.col("c") >= FOLLOW_SHARE * F.col("total")) | F.col("c").isNull())

    symbols = F.broadcast(spark.createDataFrame([(i, float(p)) for i, p in enumerate(root)], "next long, below double"))
    first = written(tested(pairs, sums, pairs.select("context", "next").join(symbols, "next")), "states-1")
    # contexts of two words: a pair that is frequent itself
    two = np.sort(np.array([r.a << _SHIFT | r.b for r in pairs.where((F.col("c") >= need) & (F.col("next") > _END)).select(F.col("context").alias("a"), F.col("next").alias("b")).collect()], np.int64))
    parts = [_state_arrays(first, None)]
    if len(two):
        triples = written(_followed(train, shared, spark.sparkContext.broadcast(two)), "triples")
        # the suffix's probabilities: of the last word's state if it stayed, else of the root
        suffix = F.broadcast(spark.createDataFrame([(i, int(c & ((1 << _SHIFT) - 1))) for i, c in enumerate(two)], "context long, last long"))
        of_last = pairs.join(first.select("context").distinct(), "context").join(sums.select("context", "total"), "context").select(F.col("context").alias("last"), "next", (F.col("c") / F.col("total")).alias("p"))
        lower = triples.select("context", "next").join(suffix, "context").join(of_last, ["last", "next"], "left").join(symbols, "next")
        sums2 = triples.groupBy("context").agg(F.sum("c").alias("total"), F.count("*").alias("kinds")).where(F.col("total") >= need)
        second = written(tested(triples, sums2, lower.select("context", "next", F.coalesce("p", "below").alias("below"))), "states-2")
        parts.append(_state_arrays(second, two))
    else:
        parts.append(tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.int64)))
    (one, t1, k1, y1, c1), (pairs2, t2, k2, y2, c2) = parts
    return Tree(voc, one, pairs2, (t1, t2), (k1, k2), (y1, y2), (c1, c2))


def _state_arrays(states: DataFrame, names: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """Contexts, totals, kept counts, keys and counts of `context, total, next, c`; bounded by the shares above."""
    t = states.select("context", "total", "next", "c").toArrow()
    context, total, nxt, c = (np.asarray(t[n].to_numpy(), np.int64) for n in ("context", "total", "next", "c"))
    if names is not None:
        context = names[context] if len(context) else context
    found, place = np.unique(context, return_inverse=True)
    totals, kept = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
    totals[place] = total
    np.add.at(kept, place, c)
    keys = place.astype(np.int64) << _SHIFT | nxt
    order = np.argsort(keys)
    return found, totals, kept, keys[order], c[order]


def score(docs: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_states` for every row of `docs(doc_id, text)`.

    Trained on the rows where `held_out` is false (by default: crc32 of the id as text, modulo 5, is not 1; rows with a null id are
    neither trained on nor held out). Null counts as the empty text, which is one end token. `score` is `base_score` plus, for each
    token, the logarithm of its gain by context; `n_states` is how many tokens had one. Repeated rows are scored one by one. Other columns are not
    looked at; an empty table gives an empty one; without training rows every token is unknown.
    """
    held = remainder(id_col, 5) == 1 if held_out is None else held_out
    spark, share = docs.sparkSession, docs.sparkSession.sparkContext.broadcast
    rows = docs.select(F.col(id_col).alias("doc_id"), held.alias("held"), F.col(text_col).alias("text"))
    ids = suffix_states.Ids(rows.limit(0).toArrow().schema.field("doc_id").type, rows.schema["doc_id"].dataType.simpleString())
    with shuffles_removed(spark):
        chunks = written(suffix_states.encoded(rows, words, ids), "encoded", batch=BATCH)
        numbers = written(suffix_states.numbered(chunks), "numbers")
        counts, tokens = suffix_states.counted(chunks, numbers)
        shared, groups = share(counts), suffix_states.Groups.of(tokens)
        whole = written(suffix_states.coded(chunks, numbers, shared, ids), "coded")
        every = whole.where("part = -1")
        often, followers = suffix_states.sent(every, numbers, shared, groups)
    discard(chunks, numbers)
    rows_of = suffix_states.dealt(every, shared, share(often), groups)
    found = suffix_states.gains(rows_of if followers is None else rows_of.unionByName(followers), shared)
    base = F.col("logs") - F.col("n_tokens") * F.lit(math.log10(counts.mass))
    return suffix_states.scored(whole, found, ids).select(
        "doc_id", F.coalesce("held", F.lit(False)).alias("held_out"), "n_tokens", "n_known", F.lit(int(counts.tokens)).cast("bigint").alias("train_tokens"),
        base.alias("base_score"), (base + F.col("gain")).alias("score"), "n_states",
    )
