"""Residue products against exact integers, and mined negatives against a plain search."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import rns
from barloom.llm.common import table
from barloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int, rank int, score string, q int"


def brute(rows, positives=5, negatives=10):
    """Rows (id, vector, label) by comparing every anchor with every row in Python integers."""
    rows = [(i, v, y) for i, v, y in rows if i is not None and v is not None and y is not None and all(c is not None and math.isfinite(c) for c in v)]
    q = [[math.floor(256 * float(np.float32(c))) for c in v] for _, v, _ in rows]
    out = []
    for a, (i, _, y) in enumerate(rows):
        if i % 100:
            continue
        scored = sorted((-sum(x * z for x, z in zip(q[a], q[b])), rows[b][0], b) for b in range(len(rows)))
        for s, j, _ in [x for x in scored if rows[x[2]][2] == y and x[2] != a][:positives]:
            found = [x for x in scored if rows[x[2]][2] != y and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives]
            out += [(i, j, rank, n, -s, -t) for rank, (t, n, _) in enumerate(found, 1)]
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame([(i, v, y, 0, "x", 1) for i, v, y in rows], SCHEMA)
    return sorted(tuple(r) for r in rns.mine(df, F.col("vec_id") % 100 == 0).collect())


@pytest.mark.parametrize("size, width", [(1, 1), (300, 64), (40_000, 3000), (2_000_000, 70)])
def test_products_are_exact(size, width):
    r = np.random.default_rng(size)
    a, b = r.integers(-size, size + 1, (9, width)), r.integers(-size, size + 1, (13, width))
    a[0], b[0], b[1] = size, size, -size
    primes = rns.primes_for(size * size * width)
    got = rns.product(rns.residues(a, primes), rns.residues(b, primes), primes)
    assert got.tolist() == (a.astype(object) @ b.T.astype(object)).tolist()


def test_scores_that_do_not_fit_are_an_error():
    with pytest.raises(OverflowError):
        rns.primes_for(1 << 62)


@pytest.mark.parametrize("pack", [3, 512])
def test_against_brute_force(spark, monkeypatch, pack):
    monkeypatch.setattr(rns, "PACK", pack)
    monkeypatch.setattr(rns, "BLOCK", 4)
    r = np.random.default_rng(2)
    rows = [(i * 10, (r.normal(size=6) * 2).tolist(), int(r.integers(3))) for i in range(150)]
    assert run(spark, rows) == brute(rows) != []


def test_ties_and_copies(spark):
    """Few different vectors, so most scores tie; labels with one row, and ids that repeat."""
    r = np.random.default_rng(3)
    rows = [(i * 20, [float(x) for x in r.integers(-1, 2, 3)], int(i % 2)) for i in range(80)] + [(4000, [1.0, 1.0, 1.0], 9)]
    assert run(spark, rows) == brute(rows) != []
    rows += [(100, [1.0, 0.5, 0.0], 1), (100, [1.0, 0.5, 0.0], 1), (300, [0.0, 0.0, 0.0], 0)]
    assert run(spark, rows) == brute(rows)


def test_awkward_rows(spark):
    good = [(i * 50, [1.0 + i, 0.25 * i, -0.001], i % 2) for i in range(30)]
    bad = [(100, None, 1), (200, [1.0, None, 2.0], 0), (300, [float("nan"), 1.0, 1.0], 1), (400, [float("inf"), 1.0, 1.0], 1), (None, [1.0, 1.0, 1.0], 1), (500, [1.0, 1.0, 1.0], None)]
    odd = [(600, [], 1), (700, [2.0], 0), (-100, [3.0, 3.0], 1)]
    assert run(spark, good + bad + odd) == brute(good + bad + odd) != []
    assert run(spark, []) == [] and run(spark, bad) == [] and run(spark, [(100, [1.0], 1)]) == []


def test_query_over_the_table(spark):
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in table(spark, SF, "embeddings").collect()]
    got = QUERIES["op12_residue_gemm_negatives"](spark, SF)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert [t for _, t in got.dtypes] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows) != []
