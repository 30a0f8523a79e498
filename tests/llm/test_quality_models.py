"""Risk-controlled rules against brute force, and the classifier against its labels."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import nbsvm, risk_rules
from barloom.llm.common import table
from barloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(8)}
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines), len(lines) - len(set(lines)), len(covered))


TEXTS = [
    None, "", " \n\t ", "a", "a b c d e f g h", "a " * 9, "a b c d e f g h " * 3, "x\n\nx\ny\n x\nx", "# * $ % & | < > é é", "a\x0bb\x0cc\rd\x1ce",
    " ".join(str(i % 13) for i in range(40)), "one two\n" * 30, "z " + "q w e r t y u i o p " * 2 + "end", "a b c", "日本 語 🙂",
]


def test_counts(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string").select("doc_id", risk_rules.measures(F.col("text")).alias("m")).collect()
    assert {r.doc_id: tuple(r.m) for r in rows} == {i: counts(t) for i, t in enumerate(TEXTS)}


def test_query_over_the_whole_table(spark):
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    rows = QUERIES["op5_risk_controlled_rules"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n = counts(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 20 or 100 * n[5] > 30 * n[0]) and not (r.base_failed and r.kept)


@pytest.mark.parametrize("n,k,share", [(10, 0, 0.3), (100, 3, 0.1), (2000, 1, 0.004), (2000, 8, 0.004), (5000, 7, 0.004), (3, 3, 0.5)])
def test_binomial(spark, n, k, share):
    exact = sum(math.comb(n, i) * share**i * (1 - share) ** (n - i) for i in range(k + 1))
    for level in (exact * 0.999, exact * 1.001):
        got = spark.range(1).select(risk_rules._few_enough(F.lit(k).cast("bigint"), F.lit(n).cast("bigint"), share, F.lit(level))).first()[0]
        assert got == (exact <= level and k <= n * share)


def _labelled(spark, n_good, n_bad, false=0):
    """Good texts without symbols (but `false` of them), bad ones full of them, in stratum en; a handful in a small stratum."""
    plain, noisy = "word " * 5 + " ".join(f"w{i}" for i in range(30)), " ".join(f"w{i}###" for i in range(30))
    rows = [(i, noisy if i < false or i >= n_good else plain, "en") for i in range(n_good + n_bad)] + [(10**6 + i, noisy, None) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("quality", F.lit(9))
    return docs, spark.createDataFrame([(r[0], int(r[0] < n_good)) for r in rows], "doc_id long, quality int")


def test_cutoffs_only_where_the_bound_holds(spark):
    need = math.ceil(math.log(risk_rules.ERROR / (2 * len(risk_rules.GRIDS))) / math.log1p(-risk_rules.RISK / len(risk_rules.GRIDS)))
    for n_good, rejected in ((need, True), (need - 1, False)):
        docs, labels = _labelled(spark, n_good, 40)
        rows = risk_rules.judge(docs, labels).collect()
        assert all(r.kept != (rejected and r.n_symbols > 0 and r.doc_id < 10**6) for r in rows)
    docs, labels = _labelled(spark, need, 40, false=20)  # too many false rejections
    assert risk_rules.judge(docs, labels).where("kept").count() == docs.count()


def test_keep_gives_the_columns_of_the_documents(spark):
    docs, labels = _labelled(spark, 1600, 40)
    out = risk_rules.keep(docs, labels)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in risk_rules.judge(docs, labels).where("kept").collect())


def test_rules_on_nothing(spark):
    docs, labels = _labelled(spark, 30, 5)
    assert risk_rules.judge(docs.limit(0), labels).count() == 0
    assert risk_rules.judge(docs, labels.limit(0)).count() == docs.count()
    odd = spark.createDataFrame([(None, None, None), (1, None, "en"), (1, "a " * 30, "en"), (1, "b c", None)], docs.select("doc_id", "text", "lang").schema)
    assert [r.kept for r in risk_rules.judge(odd, labels).orderBy("n_words").collect()] == [False, False, False, False]


def test_held_out_accuracy(spark):
    scores = QUERIES["op10_nb_support_vectors"](spark, "/root/testdata/sf0.1")
    rows = scores.where("held_out").join(table(spark, "/root/testdata/sf0.1", "labels"), "doc_id").collect()
    good, bad = [r.score for r in rows if r.quality], [r.score for r in rows if not r.quality]
    auc = np.mean([(g > np.array(bad)).mean() + (g == np.array(bad)).mean() / 2 for g in good])
    right_good, right_bad = np.mean([s >= 0.3 for s in good]), np.mean([s < 0.3 for s in bad])
    assert auc > 0.95 and right_good > 0.98 and right_bad > 0.85, (auc, right_good, right_bad)


def test_scores_are_a_function_of_the_text(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = nbsvm.fit(docs, labels)
    odd = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "a b", 3), (2, "a b", 4), (3, "x" * 3_000_000, 5)], "doc_id long, text string, score int")
    rows = nbsvm.score(odd, model).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert rows[0].score == rows[1].score and rows[2].score == rows[3].score
    again = nbsvm.fit(docs.repartition(7, "lang"), labels.repartition(5))
    assert np.array_equal(again.weights, model.weights) and again.slope == model.slope
    out = nbsvm.keep(odd, model)
    assert out.columns == odd.columns and out.count() == sum(r.predicted for r in rows)


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 0)], [(1, None), (2, 7), (None, 1)]])
def test_without_both_classes(spark, labels):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = nbsvm.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert len({r.score for r in nbsvm.score(docs, model).collect()}) == 1


def test_marks_for_repetition():
    assert nbsvm.symbols(b"a a a b\nx y\nx y\n\nx y") == b"a \x01 \x01 b x y \x02 \x02" and nbsvm.symbols(b"") == b""


def test_long_texts_in_blocks(monkeypatch):
    text = " ".join(f"w{i}é" for i in range(500)).encode()
    whole = nbsvm.Indicators().of(text)
    monkeypatch.setattr(nbsvm, "_BLOCK", 10)
    assert np.array_equal(nbsvm.Indicators().of(text), whole)
