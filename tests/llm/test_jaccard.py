"""The grouped prefix join against all pairs compared one by one."""

import random

import pytest

from barloom.llm import jaccard
from barloom.llm.common import table
from barloom.llm.queries import QUERIES


def brute(rows):
    """Component per id by comparing everything that shares a shingle; rows are (id, text)."""
    sets = []
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets.append((i, {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()))
    parent = {i: i for i, _ in rows if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by = {}
    for k, (i, s) in enumerate(sets):
        if i is not None:
            for x in s:
                by.setdefault(x, []).append(k)
    seen = set()
    for ks in by.values():
        for a in ks:
            for b in ks:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    (i, x), (j, y) = sets[a], sets[b]
                    if 100 * len(x & y) >= 80 * len(x | y):
                        lo, hi = sorted((root(i), root(j)))
                        parent[hi] = lo
    return sorted(((i, len(s), None if i is None else root(i)) for i, s in sets), key=repr)


def same(df, rows):
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr) == brute(rows)


def near_copies(seed, n, families):
    """Texts that drift: each is an earlier one of its family with a few words changed, dropped or added, or cut short."""
    r, out = random.Random(seed), []
    for i in range(n):
        old = [t for k, t in out if k % families == i % families]
        if not old or r.random() < 0.1:
            words = [f"w{r.randrange(400)}" for _ in range(r.choice([3, 5, 6, 12, 40, 80]))]
        else:
            words = r.choice(old).split()
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                at = r.randrange(len(words) + 1)
                words[at : at + r.choice([0, 1])] = [f"w{r.randrange(400)}"] * r.choice([0, 1])
            words = (words or ["w"]) if r.random() < 0.8 else words[: int(len(words) * 0.9) + 1]
        out.append((i, " ".join(words)))
    return out


@pytest.mark.parametrize("seed,families,bits", [(1, 2, 12), (2, 7, 12), (3, 25, 12), (4, 1, 2)])
def test_against_all_pairs(spark, seed, families, bits):
    rows = near_copies(seed, 220, families)
    random.Random(seed).shuffle(rows)
    same(jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string"), bits), rows)


@pytest.mark.parametrize("sent", [0, 500_000])
def test_shared_passage_and_odd_rows(spark, monkeypatch, sent):
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", sent)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, passage + " " + " ".join(f"x{i}_{j}" for j in range(80))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, " \n"), (103, "a b"), (104, "A  b"), (105, "a b c d e"), (None, "a b"), (None, None), (106, "a b"), (106, "a b"), (107, passage), (108, passage + " q")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, set_key string")
    same(jaccard.groups(docs, 12), rows)
    out = jaccard.keep_first(docs, 12)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect() if r.doc_id) == [*range(1, 40), 100, 101, 102, 103, 105, 107] and out.where("doc_id is null").count() == 2


def test_text_versions_join_their_links(spark):
    rows = [(5, "a b c d e f"), (1, "a b c d e f"), (5, "u v w x y z"), (9, "u v w x y z"), (7, "k l m n o p")]
    got = {(r.doc_id, r.component_id) for r in jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string"), 12).collect()}
    assert got == {(5, 1), (1, 1), (9, 1), (7, 7)}


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.groups(none, 12).count() == 0 and jaccard.keep_first(none, 12).count() == 0


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 3), (3, 5)]
    got = {(r.node, r.component) for r in jaccard.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 100) for i in range(100, 161)} | {(7, 3), (3, 3), (5, 3)}


def test_query_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    same(QUERIES["op9_grouped_prefix_join"](spark, sf), [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()])


@pytest.mark.parametrize("tail", [6, 24])
def test_members_of_one_group(spark, tail):
    """Texts with one rare passage, equal in size, that go on with common passages of their own: one group, linked or torn by the tail's length."""
    passage = lambda name, n: " ".join(f"{name}{j}" for j in range(n))
    start, tails = passage("start", 12), [passage(f"t{k}x", tail) for k in range(6)]
    rare = [passage(f"rare{g}y", 70) for g in range(3)]
    rows = [(100 * g + k, f"{rare[g]} {start} {tails[k]}") for g in range(3) for k in range(6)]
    # the common passages occur in many other texts, so the rare passage makes the prefix
    rows += [(1000 + 10 * i + k, f"{passage(f'own{i}z', 60 + i)} {start} {tails[k]}") for i in range(12) for k in range(6)]
    # a text with a part of the rare passage has another size and group and is near to some members only
    rows += [(5000 + g, " ".join(rare[g].split()[4:]) + f" {start} {tails[2]}") for g in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    signed = jaccard.signatures(docs)
    assert signed.groupBy("group_key").count().where("count >= 6").count() >= 3
    same(jaccard.groups(docs), rows)


def test_groups_without_links_make_few_pairs(spark):
    """Texts that share two thirds of their shingles with all others are no candidates."""
    r = random.Random(3)
    base = [f"b{j}" for j in range(300)]
    rows = []
    for i in range(120):
        words = list(base)
        for j in range(0, 300, 25):
            words[j + r.randrange(20)] = f"n{i}x{j}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    signed = jaccard.signatures(docs)
    lists = signed.selectExpr("posexplode(prefix) as (place, t)", "doc_id as id", "n", "doc_id as component", "false as split")
    assert jaccard.rest_pairs(lists).count() < 120
    same(jaccard.groups(docs), rows)
