import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.operators import publish as pb
from barloom.schemas import conform, empty, landed, table
from barloom.sources import lake, tables as tb

D1, D2, D3, D4 = dt.date(2026, 7, 13), dt.date(2026, 7, 14), dt.date(2026, 7, 15), dt.date(2026, 8, 3)


def factor_rows(spark, data):
    return conform(spark.createDataFrame(data, "trade_date date, security_id int, factor_name string, version string, value double"), table("factor_value"))


@pytest.fixture
def root(tmp_path):
    return str(tmp_path)


def raw(spark, data):
    return spark.createDataFrame(data, "exchange_code string, close double, source string, dt date")


def test_landing_replaces_partitions_only(spark, root, rows):
    lake.write_raw(raw(spark, [("A", 1.0, "s", D1), ("B", 2.0, "s", D1), ("A", 3.0, "s", D2)]), root, "daily_bar")
    lake.write_raw(raw(spark, [("A", 9.0, "s", D1)]), root, "daily_bar")
    assert rows(lake.scan(spark, root, "daily_bar"), "exchange_code", "close", "dt") == [("A", 3.0, D2), ("A", 9.0, D1)]
    assert lake.read_manifest(spark, root).count() == 3


def test_absent_and_empty_partitions_differ(spark, root):
    lake.write_raw(raw(spark, [("A", 1.0, "s", D1)]), root, "suspend")
    lake.write_raw(raw(spark, []), root, "suspend", source="s", day="2026-07-14")
    grid = spark.createDataFrame([("s", d) for d in (D1, D2, D3)], "source string, dt date")
    assert {r["dt"]: r["n"] for r in lake.row_counts(spark, root, "suspend", grid).collect()} == {D1: 1, D2: 0, D3: None}
    assert lake.read_raw(spark, root, "suspend", "s", "2026-07-14").count() == 0
    with pytest.raises(FileNotFoundError):
        lake.read_raw(spark, root, "suspend", "s", "2026-07-15")


def test_frames_without_columns_are_refused(spark, root):
    with pytest.raises(ValueError):
        lake.write_raw(spark.createDataFrame([], "source string, dt date"), root, "daily_bar", source="s", day="2026-07-13")


def test_landed_nan_reads_as_null(spark, root):
    lake.write_raw(raw(spark, [("A", float("nan"), "s", D1)]), root, "daily_bar")
    assert lake.scan(spark, root, "daily_bar").first()["close"] is None


def test_same_rows_have_the_same_fingerprint(spark, root):
    df = raw(spark, [("A", 1.0, "s", D1), ("B", 2.0, "s", D1)])
    lake.write_raw(df, root, "daily_bar")
    lake.write_raw(df.orderBy(F.desc("exchange_code")).repartition(3), root, "daily_bar")
    lake.write_raw(df.withColumn("close", F.col("close") + 1), root, "daily_bar")
    prints = [r["fingerprint"] for r in lake.read_manifest(spark, root).orderBy("ts").collect()]
    assert prints[0] == prints[1] != prints[2]


def test_source_priority(spark):
    df = raw(spark, [("A", 1.0, "a", D1), ("A", 2.0, "b", D1), ("A", 3.0, "b", D2), ("B", 3.0, "b", D2)])
    order = lake.priorities(spark, lake.candidate_order(["a"], ["b", "a"]))
    got = sorted((r["dt"], r["source"]) for r in lake.pick_source(df, order).collect())
    assert got == [(D1, "a"), (D2, "b"), (D2, "b")]


def test_fallback_pins_the_rest_of_the_day(spark):
    counts = spark.createDataFrame([
        ("a", "daily_bar", D1, 0), ("b", "daily_bar", D1, 9), ("a", "adj_factor", D1, 9), ("b", "adj_factor", D1, 9),
        ("a", "daily_bar", D2, 9), ("b", "daily_bar", D2, 9), ("a", "suspend", D2, 0), ("b", "suspend", D2, 5),
    ], "source string, dataset string, dt date, n int")
    plan = lake.fallback_plan(counts, lake.priorities(spark, ["a", "b"]), ["daily_bar", "adj_factor", "suspend"])
    got = {(r["dt"], r["dataset"]): r["source"] for r in plan.collect()}
    assert got == {(D1, "daily_bar"): "b", (D1, "adj_factor"): "b", (D2, "daily_bar"): "a", (D2, "suspend"): "a"}


def test_snapshots_take_the_partition_day(spark, root):
    df = spark.createDataFrame([("I", "A", "s", D1), ("I", "A", "s", D2)], "index_code string, exchange_code string, source string, dt date")
    lake.write_raw(df, root, "index_member")
    assert sorted(r["as_of_date"] for r in lake.snapshots(spark, root, "index_member", "s").collect()) == [D1, D2]


def test_quote_snapshots(spark, root):
    q = spark.createDataFrame([("600000.SH", 10.0)], "exchange_code string, price double")
    lake.write_snapshot(q, root, "s", dt.datetime(2026, 7, 15, 9, 30))
    lake.write_snapshot(q.withColumn("price", F.lit(11.0)), root, "s", dt.datetime(2026, 7, 15, 9, 31))
    assert [r["ts"] for r in lake.list_snapshots(spark, root, "s", "2026-07-15").collect()] == ["093000", "093100"]
    latest = lake.latest_snapshot(spark, root, "s", "2026-07-15")
    assert latest.first()["price"] == 11.0 and latest.columns == landed("realtime_quote").fieldNames()


def test_day_replacement_clears_and_keeps(spark, root, rows):
    data = [(d, i, "f", "v1", float(i)) for d in (D1, D2, D3, D4) for i in (1, 2)]
    assert tb.append(factor_rows(spark, data), root, "factor_value") == 8
    assert tb.append(factor_rows(spark, []), root, "factor_value") == 0
    tb.replace_days(factor_rows(spark, [(D1, 7, "f", "v1", 7.0), (D3, 8, "f", "v1", 8.0)]), root, "factor_value", [D1, D2])
    got = rows(tb.read(spark, root, "factor_value"), "trade_date", "security_id")
    assert got == sorted([(D1, 7), (D3, 1), (D3, 2), (D4, 1), (D4, 2)], key=repr)
    tb.replace_days(factor_rows(spark, []), root, "factor_value", [D4])
    assert rows(tb.read(spark, root, "factor_value").where(F.col("trade_date") == F.lit(D4)), "security_id") == []


def test_empty_statements_keep_the_day(spark, root, rows):
    st = spark.createDataFrame([(1, D1, D1, "income", 0, {"x": 1.0}), (1, D2, D1, "income", 1, {"x": 2.0})],
                               "security_id int, ann_date date, report_date date, stmt_type string, update_flag int, fields map<string,double>")
    st = conform(st, table("fin_statement"))
    tb.append(st, root, "fin_statement")
    tb.replace_days(st.where("update_flag = 1").withColumn("update_flag", F.lit(2)), root, "fin_statement", [D1, D2], keep_when_empty=True)
    assert rows(tb.read(spark, root, "fin_statement"), "ann_date", "update_flag") == [(D1, 0), (D2, 2)]


def test_factor_slice_replacement(spark, root, rows):
    data = [(D1, 1, f, v, 1.0) for f in ("f", "g") for v in ("v1", "v2")] + [(D2, 1, "f", "v1", 1.0)]
    tb.append(factor_rows(spark, data), root, "factor_value")
    tb.replace_factor_days(factor_rows(spark, []), root, ["f"], "v1", [D1])
    got = rows(tb.read(spark, root, "factor_value"), "trade_date", "factor_name", "version")
    assert got == sorted([(D1, "f", "v2"), (D1, "g", "v1"), (D1, "g", "v2"), (D2, "f", "v1")], key=repr)


def test_range_reads_prune_partitions(spark, root):
    tb.append(factor_rows(spark, [(d, 1, "f", "v1", 1.0) for d in (D1, D4)]), root, "factor_value")
    df = tb.read(spark, root, "factor_value", start=D4, end=D4)
    assert df.count() == 1 and len(df.inputFiles()) <= 2
    assert "PartitionFilters: [isnotnull(month" in df._jdf.queryExecution().toString()


def test_last_write_wins(spark, rows):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "k int, x string, load_ts int")
    assert rows(tb.latest_rows(df, ["k"]), "k", "x") == [(1, "b"), (2, "c")]


def test_artefacts_by_id(spark, root, rows):
    marks = spark.createDataFrame([("s", "2026-07-13", 1.0), ("s", "2026-07-14", 2.0)], "session_id string, mark_date string, total_asset double")
    tb.save_artefact(marks, root, "mark")
    tb.save_artefact(marks.where("mark_date = '2026-07-14'").withColumn("total_asset", F.lit(5.0)), root, "mark")
    assert rows(tb.load_artefact(spark, root, "mark", session_id="s"), "total_asset") == [(1.0,), (5.0,)]
    assert tb.list_artefacts(spark, root, "mark", 1).first()["total_asset"] == 5.0


def test_run_metrics_round_trip(spark, root):
    m = spark.createDataFrame([("r1", 0.1, 1.5), ("r2", 0.2, None)], "run_id string, total_return double, sharpe double")
    meta = spark.createDataFrame([("r1", dt.datetime(2026, 1, 1), "ep"), ("r2", dt.datetime(2026, 1, 2), "bp")], "run_id string, created_at timestamp, factor string")
    tb.save_artefact(tb.pack_run(m, meta, ["run_id"]), root, "run")
    got = tb.metric_matrix(tb.load_artefact(spark, root, "run")).collect()
    assert [(r["run_id"], r["total_return"], r["sharpe"]) for r in got] == [("r2", 0.2, None), ("r1", 0.1, 1.5)]
    assert tb.metric_matrix(tb.load_artefact(spark, root, "run"), factor="ep").count() == 1
    legacy = spark.createDataFrame([("r1", 9.0), ("r9", 9.0)], "run_id string, total_return double")
    assert sorted(r["run_id"] for r in tb.prefer(m, legacy, "run_id").collect()) == ["r1", "r2", "r9"]


def test_bound_parameters_are_not_spliced(spark):
    spark.createDataFrame([("x' or '1'='1",), ("y",)], "c string").createOrReplaceTempView("params_t")
    assert tb.query(spark, "select * from params_t where c = :c", c="x' or '1'='1").count() == 1


def test_typed_empty_frames(spark):
    df = conform(spark.createDataFrame([("A",)], "exchange_code string"), landed("daily_basic"))
    assert df.schema.fieldNames() == landed("daily_basic").fieldNames() and empty(spark, landed("suspend")).count() == 0


# ---- publication ---------------------------------------------------------------------


def versions(spark, data):
    return spark.createDataFrame([("daily_bar", v, n) for v, n in data], "dataset string, version string, row_count bigint")


def test_continuity(spark):
    days = spark.createDataFrame([(D1,), (D2,), (D3,)], "trade_date date")
    vs = versions(spark, [("2026-07-13", 600), ("2026-07-13", 10), ("2026-07-15", 3), ("draft", 1)])
    got = {r["trade_date"]: r["state"] for r in pb.continuity(days, vs, min_rows=500).collect()}
    assert got == {D1: "published", D2: "missing", D3: "thin"}
    s = pb.continuity_summary(pb.continuity(days, vs, min_rows=500)).first()
    assert (s["expected"], s["published"], s["missing"], s["thin"], s["ok"]) == (3, 2, 1, 1, False)
    assert not pb.continuity_summary(pb.continuity(days.limit(0), vs)).first()["ok"]


def test_republishing_replaces(spark):
    days = spark.createDataFrame([(D1,), (D2,)], "trade_date date")
    bars = spark.createDataFrame([(D1,), (D1,)], "trade_date date")
    new = pb.publication_rows({"daily_bar": bars}, days, note="n")
    assert {r["version"]: r["row_count"] for r in new.collect()} == {"2026-07-13": 2, "2026-07-14": 0}
    old = new.withColumn("row_count", F.lit(7).cast("bigint"))
    assert sorted(r["row_count"] for r in pb.replace_versions(old, new.where("version = '2026-07-13'")).collect()) == [2, 7]


def test_alignment(spark):
    pub = spark.createDataFrame([(d,) for d in (dt.date(2025, 7, 1), dt.date(2025, 7, 2), dt.date(2025, 7, 3))], "trade_date date")
    basic = spark.createDataFrame([(dt.date(2025, 7, 3),), (dt.date(2025, 8, 1),)], "trade_date date")
    r = pb.alignment_summary(pb.alignment(pub, basic)).first()
    assert (r["published_days"], r["covered"], r["missing"], r["first_missing"], r["last_missing"], r["ok"]) == (
        3, 1, 2, dt.date(2025, 7, 1), dt.date(2025, 7, 2), False)


def test_reuse_gate(spark):
    counts = spark.createDataFrame([("s", "daily_bar", D1, 600), ("s", "adj_factor", D1, 500), ("s", "suspend", D1, 0), ("s", "suspend", D2, None),
                                    ("s", "adj_factor", D2, 600), ("s", "daily_bar", D3, 600), ("s", "adj_factor", D3, 540)], "source string, dataset string, dt date, n int")
    got = {(r["dataset"], r["dt"]): r["reusable"] for r in pb.reusable(counts, 500).collect()}
    assert got == {("daily_bar", D1): True, ("adj_factor", D1): False, ("suspend", D1): True, ("suspend", D2): False, ("adj_factor", D2): True,
                   ("daily_bar", D3): True, ("adj_factor", D3): True}


def test_incremental_range(spark):
    end = F.lit("2026-07-20").cast("date")
    a = spark.createDataFrame([(D3,)], "d date")
    b = spark.createDataFrame([(D1,)], "d date")
    none = a.limit(0)
    r = pb.incremental_range({"a": (a, "d"), "b": (b, "d"), "c": (none, "d")}, end).first()
    assert (r["start"], r["fresh"]) == (D2, True)
    assert pb.incremental_range({"c": (none, "d")}, end).first()["start"] == dt.date(2026, 6, 20)
    assert not pb.incremental_range({"a": (a, "d")}, F.lit("2026-07-15").cast("date")).first()["fresh"]
