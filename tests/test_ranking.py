import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import ranking


@pytest.fixture(scope="module")
def skewed(spark):
    """One group with two thirds of the rows, and a third of all rows on one value."""
    rnd = random.Random(5)
    data = []
    for i in range(6000):
        g = "hot" if i % 3 else f"g{i % 7}"
        data.append((g, 1.0 if i % 3 == 1 else round(rnd.gauss(0, 1), 3), i))
    return spark.createDataFrame(data, "g string, value double, id int").cache()


def cut(monkeypatch, sparse, ranges=1024):
    """Ranges of some `4 * sparse` rows."""
    for name, x in (("SPARSE", sparse), ("PER_RANGE", 4), ("RANGES", ranges)):
        monkeypatch.setattr(ranking, name, x)


@pytest.mark.parametrize("sparse, ranges", [(1, 1024), (1, 7), (20, 1024), (300, 3), (1 << 40, 1024)])
def test_ranges_give_the_ranks_of_one_window(skewed, sparse, ranges, monkeypatch):
    cut(monkeypatch, sparse, ranges)
    got = {r["id"]: (r["rn"], r["rank_low"], r["rank_high"], r["n"]) for r in ranking.with_tie_ranks(skewed, ["g"], "value", ["id"]).collect()}
    assert len(got) == 6000
    groups = {}
    for r in skewed.collect():
        groups.setdefault(r["g"], []).append((r["value"], r["id"]))
    for rows in groups.values():
        ordered, vals = sorted(rows), sorted(x for x, _ in rows)
        for pos, (x, i) in enumerate(ordered, 1):
            assert got[i] == (pos, np.searchsorted(vals, x, "left") + 1, np.searchsorted(vals, x, "right"), len(rows))


def test_no_task_holds_the_hot_group(skewed, monkeypatch):
    """The group with two thirds of the rows, half of them on one value, lies in many ranges of bounded size."""
    cut(monkeypatch, 8)
    rows, _, _ = ranking._placed(skewed, ["g"], ["value", "id"], None, None)
    sizes = [r["count"] for r in rows.where("g = 'hot'").groupBy("__range").count().collect()]
    assert sum(sizes) == 4000 and len(sizes) > 50 and max(sizes) < 300


def test_nothing_runs_before_the_result_is_asked_for(spark, skewed):
    tracker, group = spark.sparkContext.statusTracker(), "ranks"
    spark.sparkContext.setJobGroup(group, group)
    try:
        ranked = ranking.with_tie_ranks(skewed, ["g"], "value", ["id"])
        assert not tracker.getJobIdsForGroup(group) and ranked.count() == 6000
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_nulls_and_ties_across_cuts(spark, monkeypatch):
    cut(monkeypatch, 1)
    data = [(None if i % 5 == 0 else i % 2, None if i % 7 == 0 else float(i % 3), i) for i in range(400)]
    df = spark.createDataFrame(data, "g int, value double, id int").withColumn("m", F.col("id") % 3 == 0)
    got = {r["id"]: r for r in ranking.with_tie_ranks(df, ["g"], "value", ["id"], counted="m").collect()}
    first = lambda x: (x[1] is not None, x[1] or 0.0, x[2])
    for g in (None, 0, 1):
        rows, count = sorted((x for x in data if x[0] == g), key=first), 0
        seen = {}
        for _, v, i in rows:
            count += i % 3 == 0
            assert got[i]["rn"] == count
            seen.setdefault(v, []).append(count)
        for _, v, i in rows:
            assert (got[i]["rank_low"], got[i]["rank_high"], got[i]["n"]) == (seen[v][0], seen[v][-1], count)


@pytest.mark.parametrize("sparse", [3, 1 << 40])
def test_counted_rows_only(skewed, sparse, monkeypatch):
    cut(monkeypatch, sparse)
    marked = skewed.withColumn("m", F.col("id") % 4 == 0)
    got = ranking.with_tie_ranks(marked, ["g"], "value", ["id"], counted="m").where("g = 'hot'").collect()
    members = [r["value"] for r in got if r["m"]]
    for r in got[::37]:
        assert r["rank_high"] == sum(x <= r["value"] for x in members)
        assert r["n"] == len(members)


@pytest.mark.parametrize("sparse", [3, 1 << 40])
def test_quantiles_match_numpy(skewed, sparse, monkeypatch):
    cut(monkeypatch, sparse)
    got = ranking.quantiles(skewed, ["g"], "value", ["id"], {"p1": 0.01, "p50": 0.5, "p75": 0.75}).collect()
    for r in got:
        vals = [x["value"] for x in skewed.where(F.col("g") == r["g"]).collect()]
        assert (r["p1"], r["p50"], r["p75"]) == pytest.approx(tuple(np.quantile(vals, [0.01, 0.5, 0.75])))


def test_rank_without_groups(spark, monkeypatch):
    cut(monkeypatch, 2)
    df = spark.createDataFrame([(f"c{i:03d}",) for i in range(300)], "code string")
    got = {r["code"]: r["rn"] for r in ranking.order_rank(df, [], ["code"]).collect()}
    assert got == {f"c{i:03d}": i + 1 for i in range(300)}


@pytest.mark.parametrize("n,sizes", [(52, [11, 10, 10, 10, 11]), (50, [10] * 5), (1, [1])])
def test_first_rank_buckets(spark, n, sizes):
    df = spark.range(n).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("value"), F.col("id").alias("id"))
    ranked = ranking.order_rank(df, ["g"], ["value", "id"], total="n").withColumn("q", ranking.quantile_bucket(5))
    counts = {r["q"]: r["count"] for r in ranked.groupBy("q").count().collect()}
    assert [counts[k] for k in sorted(counts)] == sizes


def test_pages_follow_each_other(spark):
    data = [(None if i % 9 == 0 else i % 4, i) for i in range(95)]
    df, keys = spark.createDataFrame(data, "a int, b int").repartition(5), ["a", "b"]
    seen, last = [], None
    while rows := (page := ranking.page_after(df, keys, 10, last)).collect():
        seen += [tuple(r) for r in rows]
        last = ranking.last_key(page, keys)
    assert seen == sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    with pytest.raises(ValueError):
        ranking.page_after(df, keys, 0)


def test_small_groups_are_not_cut(spark, monkeypatch):
    """Many groups, each below the size of a range, together far above it: one range each, no cut for a row to carry."""
    cut(monkeypatch, 1)
    df = spark.range(3000).select((F.col("id") % 1000).alias("g"), F.col("id").cast("double").alias("value"), "id")
    rows, known, cuts = ranking._placed(df, ["g"], ["value", "id"], None, None)
    assert cuts.count() == 0 and known.count() == 0
    assert [tuple(r) for r in rows.groupBy("__range").count().collect()] == [(0, 3000)]
    got = ranking.with_tie_ranks(df, ["g"], "value", ["id"])
    assert got.where("rn = id div 1000 + 1 and rank_low = rn and rank_high = rn and n = 3").count() == 3000


@pytest.mark.parametrize("sparse", [1, 1 << 40])
def test_cuts_from_cheaper_rows(skewed, sparse, monkeypatch):
    """Cuts taken per coarser group from rows without the attached column give the ranks of the finer groups."""
    cut(monkeypatch, sparse)
    fine = skewed.withColumn("part", F.col("id") % 4).where("id % 5 <> 0")
    got = {r["id"]: (r["rn"], r["rank_low"], r["rank_high"], r["n"]) for r in ranking.with_tie_ranks(
        fine, ["g", "part"], "value", ["id"], sampled=skewed).collect()}
    single = {r["id"]: (r["rn"], r["n"]) for r in ranking.order_rank(fine, ["g", "part"], ["value", "id"], total="n", sampled=skewed).collect()}
    groups = {}
    for r in skewed.collect():
        if r["id"] % 5:
            groups.setdefault((r["g"], r["id"] % 4), []).append((r["value"], r["id"]))
    assert len(got) == len(single) == 4800
    for rows in groups.values():
        ordered, vals = sorted(rows), sorted(x for x, _ in rows)
        for pos, (x, i) in enumerate(ordered, 1):
            assert got[i] == (pos, np.searchsorted(vals, x, "left") + 1, np.searchsorted(vals, x, "right"), len(rows))
            assert single[i] == (pos, len(rows))
