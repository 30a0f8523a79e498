"""States as Spark tables against plain dictionaries, and both ways of scoring against each other."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import suffix_states as ss, suffix_tree as st
from barloom.llm.common import table


def brute(train, docs):
    """Gain and tokens with a state per doc, with contexts as tuples."""
    seqs = [[*text.encode().lower().split(), None] for text in train]
    n = Counter(t for s in seqs for t in s)
    mass = sum(n.values()) + 0.5 * (len(n) + 1)
    root = lambda t: (n[t] + 0.5) / mass
    states, seen = {}, {}
    for k in range(1, ss.DEPTH + 1):
        for s in seqs:
            for j in range(k, len(s)):
                seen.setdefault(tuple(s[j - k : j]), Counter())[s[j]] += 1

    def low(ctx, t):
        while ctx:
            ctx = ctx[1:]
            if ctx in states:
                return seen[ctx][t] / sum(seen[ctx].values())
        return root(t)

    for ctx in sorted(seen, key=len):
        total, nxt = sum(seen[ctx].values()), seen[ctx]
        if total >= ss.LEAST and sum(c * math.log(c / total / low(ctx, t)) for t, c in nxt.items()) > 0.5 * len(nxt) * math.log(total):
            states[ctx] = (total, {t: c for t, c in nxt.items() if c >= ss.FOLLOW_LEAST})
    out = {}
    for i, text in docs:
        s, gain, met = [*text.encode().lower().split(), None], 0.0, 0
        for j, t in enumerate(s):
            p, found = root(t), False
            for k in range(1, min(j, ss.DEPTH) + 1):
                if (ctx := tuple(s[j - k : j])) in states:
                    total, kept = states[ctx]
                    p, found = (kept.get(t, 0) + (total - sum(kept.values()) + ss.PRIOR) * p) / (total + ss.PRIOR), True
            gain, met = gain + math.log10(p / root(t)), met + found
        out[i] = (gain, met)
    return states, out


@pytest.fixture
def docs():
    """Chains of three words that only the third word back decides, among many words that are rare each."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(300):
        parts = []
        for _ in range(25):
            parts += [["p", "a", "b", "c"], ["q", "a", "b", "d"], [f"w{rng.integers(400)}", "after"], [f"w{rng.integers(400)}"]][rng.integers(4)]
        rows.append((i, " ".join(parts)))
    return [*rows, (7, rows[7][1]), (900, rows[8][1])]


@pytest.mark.parametrize("limit", [10**9, 0])
def test_against_dictionaries(spark, docs, monkeypatch, limit):
    """Held in memory or joined by a shuffle, every gain is the one by definition; there are states of three words."""
    monkeypatch.setattr(ss, "BROADCAST_STATES", limit)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    states, want = brute([t for i, t in docs if i % 5], docs)
    assert {(b"p", b"a", b"b"), (b"q", b"a", b"b")} <= set(states)
    got = st.score(frame, F.col("doc_id") % 5 == 0).collect()
    assert len(got) == len(docs)
    for r in got:
        gain, met = want[r.doc_id]
        assert abs(r.score - r.base_score - gain) < 1e-6 and r.n_states == met


def test_states_grow_with_the_corpus(spark):
    """A word is a state from an absolute count on, however small its share: here 40 of 4 million tokens."""
    rare = [(i, "seldom met again") for i in range(40)]
    many = rare + [(i, " ".join(["x"] * 5000)) for i in range(40, 840)]
    frame = spark.createDataFrame(many, "doc_id long, text string")
    got = st.score(frame, F.lit(False)).where("doc_id = 3").first()
    assert got.n_states >= 2 and got.score > got.base_score + 2


def test_shuffle_files_go_when_their_query_ends(spark):
    import pytest

    from barloom.llm import common

    before = spark.conf.get(common._CLEANUP)
    with pytest.raises(ValueError), common.shuffles_removed(spark):
        assert spark.conf.get(common._CLEANUP) == "true"
        raise ValueError
    assert spark.conf.get(common._CLEANUP) == before


def test_the_tree_is_grown_with_shuffles_removed(spark, monkeypatch):
    from barloom.llm import common, suffix_tree

    seen, write = [], common.written
    monkeypatch.setattr(suffix_tree, "written", lambda df, *a, **k: (seen.append(df.sparkSession.conf.get(common._CLEANUP)), write(df, *a, **k))[1])
    docs = spark.createDataFrame([(i, "a b c " * 20) for i in range(40)], "doc_id long, text string")
    assert suffix_tree.score(docs).count() == 40
    assert seen == ["true"] * 3


@pytest.mark.parametrize("often", [60, 10**9])
def test_against_dictionaries_over_many_groups(spark, docs, monkeypatch, often):
    """Several chunks, sets of several groups, and contexts of every level that are split over groups or not: the same gains."""
    for name, value in {"BROADCAST_STATES": often, "CHUNK": 3000, "GROUP": 500, "SETS": 3, "SET": 10**9, "HELD": 50}.items():
        monkeypatch.setattr(ss, name, value)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    _, want = brute([t for i, t in docs if i % 5], docs)
    got = st.score(frame, F.col("doc_id") % 5 == 0).collect()
    assert len(got) == len(docs)
    for r in got:
        gain, met = want[r.doc_id]
        assert abs(r.score - r.base_score - gain) < 1e-6 and r.n_states == met


def test_contexts_that_occur_often_are_split_at_every_level(spark, docs, monkeypatch):
    """Words, pairs and triples over the limit, no others; each has several groups, which hold those of longer ones."""
    seen, sent = [], ss.sent
    monkeypatch.setattr(ss, "BROADCAST_STATES", 60)
    monkeypatch.setattr(ss, "sent", lambda *a: seen.append(sent(*a)) or seen[-1])
    st.score(spark.createDataFrame(docs, "doc_id long, text string"), F.col("doc_id") % 5 == 0)
    often, _ = seen[0]
    seqs = [t.encode().split() for _, t in docs]
    ends = [Counter(tuple(s[j : j + k]) for s in seqs for j in range(len(s) - k + 1)) for k in range(1, ss.DEPTH + 1)]
    assert [len(k) for k in often.keys] == [sum(n > 60 for n in c.values()) for c in ends]
    groups = often.groups(16)
    for level in range(1, ss.DEPTH):
        assert all(own <= groups[level - 1][key >> 32] for own, key in zip(groups[level], often.keys[level].tolist()))
    assert max(map(len, groups[0])) > 4


def test_intermediates_are_smaller_than_the_texts(spark):
    """What a query leaves in the shared folder takes fewer bytes than the texts have, and its rows are packed by chunk."""
    from pathlib import Path

    from barloom.session import work_dir

    rng = np.random.default_rng(2)
    many = [(i, " ".join(f"word{x}" for x in rng.zipf(1.3, 400) % 5000)) for i in range(1000)]
    folder = Path(work_dir(spark).removeprefix("file:"))
    before = set(folder.glob("llm-*"))
    assert st.score(spark.createDataFrame(many, "doc_id long, text string")).count() == len(many)
    left = sum(f.stat().st_size for d in set(folder.glob("llm-*")) - before for f in d.rglob("*.parquet"))
    assert left < 0.6 * sum(len(t) for _, t in many)
    rows = sum(spark.read.parquet(str(d)).count() for d in set(folder.glob("llm-*")) - before)
    assert rows < 2 * len(many)


def test_numbers_survive_packing():
    for x in (np.zeros(0, np.int64), np.array([0, 1, 255, 256, 2**32 - 1]), np.arange(100_000) * 40_000):
        assert (ss.unpack(ss.pack(x)) == x).all() and ss.unpack(ss.pack(x)).dtype == np.uint32
