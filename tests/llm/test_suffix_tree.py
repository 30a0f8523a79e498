"""The suffix tree against plain dictionaries, and its scores against the definition of the base score."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from barloom.llm import suffix_tree as st
from barloom.llm.common import table
from barloom.llm.queries import QUERIES


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def check_base(rows, docs):
    """Every count and base score by the formula; docs are (id, text)."""
    counts = Counter(t for i, text in docs if i is not None and not held(i) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, text in docs:
        ts = tokens(text)
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts)
        want[i, held(i), len(ts), sum(counts[t] > 0 for t in ts), n, round(base, 6)] += 1
    got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows)
    assert {k[:5]: c for k, c in got.items()} == {k[:5]: c for k, c in want.items()}
    by = {k[:5]: k[5] for k in want}
    assert all(abs(k[5] - by[k[:5]]) < 1e-5 for k in got)


def test_query_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op4_probabilistic_suffix_tree"](spark, sf).collect()
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    assert len(rows) == len(docs)
    check_base(rows, docs)
    out = [r for r in rows if r.held_out]
    assert len(out) > 100 and sum(r.score for r in out) > sum(r.base_score for r in out) and sum(r.n_states for r in out) > 1000


@pytest.fixture
def docs(monkeypatch):
    """Text in which `b` after `a` is followed by `c`, after `x` by `d`; and words too rare for a symbol of their own."""
    monkeypatch.setattr(st, "WORD_SHARE", 0.01)
    rng = np.random.default_rng(0)
    rows = []
    for i in range(200):
        parts = []
        for _ in range(30):
            parts += [["a", "b", "c"], ["x", "b", "d"], ["e"], [f"rare{rng.integers(500)}"]][rng.integers(4)]
        rows.append((i, " ".join(parts).upper() if i % 2 else " ".join(parts)))
    return rows


def test_tree_against_dictionaries(spark, docs):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    counts = st.word_counts(frame)
    voc = st.vocabulary(counts, 0.01)
    names = [b"?", None, *voc.symbol]
    n = Counter(t for _, text in docs for t in tokens(text))
    assert set(voc.symbol) == {w for w, c in n.items() if w is not None and c >= 0.01 * sum(n.values())}
    seqs = [[t if t is None or t in voc.symbol else b"?" for t in tokens(text)] for _, text in docs]
    root = {t: (sum(c for w, c in n.items() if (w if w is None or w in voc.symbol else b"?") == t) + (0.5 * (voc.rare + 1) if t == b"?" else 0.5)) / voc.mass for t in names}
    assert abs(sum(root.values()) - 1) < 1e-12

    def follow(k):
        out = {}
        for s in seqs:
            for j in range(k, len(s)):
                ctx = tuple(s[j - k : j])
                if b"?" not in ctx:
                    out.setdefault(ctx, Counter())[s[j]] += 1
        return out

    need, states = max(0.02 * sum(n.values()), st.LEAST), {}
    one, two = follow(1), follow(2)
    for level in (one, two):
        for ctx, nxt in level.items():
            total = sum(nxt.values())
            if total < need or len(ctx) == 2 and one[ctx[:1]][ctx[1]] < need:
                continue
            low = lambda t: one[ctx[1:]][t] / sum(one[ctx[1:]].values()) if len(ctx) == 2 and ctx[1:] in states else root[t]  # noqa: B023, E731
            gain = sum(c * math.log(c / total / low(t)) for t, c in nxt.items())
            if gain > 0.5 * len(nxt) * math.log(total):
                states[ctx] = (total, {t: c for t, c in nxt.items() if c >= st.FOLLOW_LEAST and c >= st.FOLLOW_SHARE * total})
    assert (b"a", b"b") in states and (b"x", b"b") in states
    tree = st.grow(frame, voc, 0.02)
    got = {(names[c],) for c in tree.one} | {(names[c >> st._SHIFT], names[c & ((1 << st._SHIFT) - 1)]) for c in tree.two}
    assert got == set(states)

    def p(history, t):
        out = root[t]
        for k in (1, 2):
            ctx = tuple(history[len(history) - k :]) if len(history) >= k else None
            if ctx in states:
                total, kept = states[ctx]
                out = (kept.get(t, 0) + (total - sum(kept.values()) + st.PRIOR) * out) / (total + st.PRIOR)
        return out

    for text in ("a b c x b d e a b new words b", "b", "", "E X B D"):
        s = voc.encode(st.words(text.encode()))
        seq = [names[i] for i in s]
        assert np.allclose(tree.probabilities(s)[0], [p(seq[:j], seq[j]) for j in range(len(seq))])
    for history in ([b"a", b"b"], [b"b"], [b"?"], [], [b"e", b"a"]):
        assert abs(sum(p(history, t) for t in names) - 1) < 1e-9
    assert p([b"a", b"b"], b"c") > 0.9 > 0.6 > p([b"b"], b"c")


def test_awkward_rows(spark, docs):
    odd = [(None, "a b c"), (300, None), (301, ""), (302, " \n"), (303, "never met"), (303, "never met"), (304, "a\x0bB\x1ca"), (305, "é É a")]
    rows = [*docs[:40], *odd]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, c int, word string")
    check_base(st.score(frame).collect(), rows)


def test_without_training_rows(spark):
    ids = [i for i in range(60) if held(i)]
    rows = [(i, "some words") for i in ids]
    got = st.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check_base(got, rows)
    assert all(r.score == r.base_score == 0 for r in got)
    assert st.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
