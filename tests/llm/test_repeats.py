"""Repeated phrases against brute force over all windows: every word covered by a window that starts anywhere else, and no other."""

import hashlib
import random
from collections import Counter

import pytest

from barloom.llm import repeats
from barloom.llm.common import table
from barloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def brute(rows, window=35):
    """[(id, words, words removed, kept text)] by counting whole word sequences."""
    split = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[a : a + window]) for _, w in split for a in range(len(w) - window + 1))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for a in range(len(w) - window + 1):
            if seen[tuple(w[a : a + window])] > 1:
                gone[a : a + window] = [True] * window
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out, key=repr)


def run(spark, rows, window=35):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, d string, spans int")
    return sorted((tuple(r) for r in repeats.cut(df, window).collect()), key=repr)


def corpus(seed, n=60, vocabulary=4000):
    r = random.Random(seed)
    new = lambda k: [f"w{r.randrange(vocabulary)}" for _ in range(k)]
    passages = [new(k) for k in (34, 35, 36, 50, 90, 200)]
    rows = []
    for i in range(n):
        parts = [w for _ in range(r.randrange(4)) for w in (new(r.randrange(60)) + (r.choice(passages) if r.random() < 0.7 else []))]
        rows.append((i, " ".join(parts)))
    near = rows[0][1].split() + new(120)
    for i in range(n, n + 12):  # near copies of one text, each with a word of its own
        own = list(near)
        own[r.randrange(len(own))] = f"x{i}"
        rows.append((i, " ".join(own)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("hot, patterns", [(3, 16_384), (16_384, 5), (3, 5)])
def test_hot_seeds_and_small_automata_change_nothing(spark, monkeypatch, hot, patterns):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "PATTERNS", patterns)
    monkeypatch.setattr(repeats, "BROADCAST_TEXTS", 0)
    rows = corpus(7)
    assert run(spark, rows) == brute(rows)


def test_short_windows_and_few_words(spark):
    """Few different words, so that windows overlap themselves and seeds tie."""
    r = random.Random(1)
    rows = [(i, " ".join(r.choice("ab") for _ in range(r.randrange(40)))) for i in range(40)]
    assert run(spark, rows, window=7) == brute(rows, 7)


def test_awkward_rows(spark):
    long = " ".join(f"l{i}" for i in range(30_000))
    same = "a " * 36
    rows = [
        (1, None), (2, ""), (3, " \t\n\x0b\f\r "), (4, same), (None, long), (6, long.replace("l7 ", "other ")), (7, "one two"), (7, "one two"),
        (8, " ".join(f"q{i}" for i in range(35))), (8, "\n".join(f"q{i}" for i in range(35))), (9, " ".join(f"Q{i}" for i in range(35))),
        (10, " ".join(f"n {i}" for i in range(40))), (11, " ".join(f"s{i}" for i in range(34))), (12, " ".join(f"s{i}" for i in range(34))),
    ]
    assert run(spark, rows) == brute(rows)


def test_nothing(spark):
    assert run(spark, []) == [] and run(spark, [(1, None)]) == [(1, 0, 0, "")]


def test_query_over_the_table(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    want = [(i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in brute(rows)]
    got = QUERIES["op11_repeated_phrase_automata"](spark, SF)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert 0 < sum(w[2] for w in want) < sum(w[1] for w in want)
