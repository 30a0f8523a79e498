import datetime as dt
import random

from pyspark.sql import functions as F

from barloom.streaming import quotes as qs

SCHEMA = "exchange_code string, price double, ts timestamp"
T0 = dt.datetime(2026, 7, 15, 9, 30)


def write_files(spark, folder, data, parts, seed):
    """One file per part, in shuffled order."""
    rnd = random.Random(seed)
    rnd.shuffle(data)
    for i in range(parts):
        spark.createDataFrame(data[i::parts], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def ticks(n=200):
    rnd = random.Random(1)
    return [(f"c{i % 7}", round(rnd.uniform(5, 15), 2), T0 + dt.timedelta(seconds=37 * i)) for i in range(n)]


def stream(spark, folder):
    return qs.read_quotes(spark, folder, schema=spark.createDataFrame([], SCHEMA).schema, files_per_trigger=1)


def test_latest_quote_ignores_file_order(spark, tmp_path):
    data = ticks()
    want = {}
    for c, p, t in sorted(data, key=lambda r: r[2]):
        want[c] = (p, t)
    for seed in (1, 2):
        base = f"{tmp_path}/{seed}"
        write_files(spark, f"{base}/in", list(data), 6, seed)
        qs.start_latest(stream(spark, f"{base}/in"), f"{base}/latest", f"{base}/cp", ts="ts").awaitTermination()
        got = {r["exchange_code"]: (r["price"], r["ts"]) for r in qs.read_latest(spark, f"{base}/latest").collect()}
        assert got == want
        assert all(len(v) <= 2 for v in qs.bucket_versions(spark, f"{base}/latest").values())


def test_late_older_snapshot_changes_nothing_and_restart_continues(spark, tmp_path):
    base = str(tmp_path)
    write_files(spark, f"{base}/in", [("a", 10.0, T0), ("b", 5.0, T0)], 1, 0)
    qs.start_latest(stream(spark, f"{base}/in"), f"{base}/latest", f"{base}/cp", ts="ts").awaitTermination()
    write_files(spark, f"{base}/in", [("a", 1.0, T0 - dt.timedelta(hours=1)), ("b", 6.0, T0 + dt.timedelta(hours=1))], 1, 0)
    qs.start_latest(stream(spark, f"{base}/in"), f"{base}/latest", f"{base}/cp", ts="ts").awaitTermination()
    got = {r["exchange_code"]: r["price"] for r in qs.read_latest(spark, f"{base}/latest").collect()}
    assert got == {"a": 10.0, "b": 6.0}
    view = qs.quote_view(qs.read_latest(spark, f"{base}/latest"), [" A ", "nobody"])
    assert [r["exchange_code"] for r in view.collect()] == ["a"]


def test_one_code_writes_one_bucket_and_an_old_quote_none(spark, tmp_path):
    base = str(tmp_path)
    run = lambda: qs.start_latest(stream(spark, f"{base}/in"), f"{base}/latest", f"{base}/cp", ts="ts").awaitTermination()
    write_files(spark, f"{base}/in", [(f"c{i}", float(i), T0) for i in range(300)], 1, 0)
    run()
    first = qs.bucket_versions(spark, f"{base}/latest")
    assert len(first) == qs.BUCKETS and all(len(v) == 1 for v in first.values())
    write_files(spark, f"{base}/in", [("c7", 70.0, T0 + dt.timedelta(minutes=1)), ("c8", 80.0, T0 - dt.timedelta(minutes=1))], 1, 0)
    run()
    second = qs.bucket_versions(spark, f"{base}/latest")
    assert [b for b in second if second[b] != first[b]] == [b for b in second if len(second[b]) == 2] and sum(map(len, second.values())) == qs.BUCKETS + 1
    write_files(spark, f"{base}/in", [("c9", 90.0, T0 - dt.timedelta(days=1))], 1, 0)
    run()
    assert qs.bucket_versions(spark, f"{base}/latest") == second
    got = {r["exchange_code"]: r["price"] for r in qs.read_latest(spark, f"{base}/latest").collect()}
    assert got == {f"c{i}": float(i) for i in range(300)} | {"c7": 70.0}


def spans(rows, gap):
    """(code, first, last + gap, open, high, low, close, ticks) by a plain walk."""
    out = []
    for code in sorted({c for c, _, _ in rows}):
        own = sorted((t, p) for c, p, t in rows if c == code)
        at = 0
        for i in range(1, len(own) + 1):
            if i == len(own) or own[i][0] - own[i - 1][0] >= gap:
                part = own[at:i]
                prices = [p for _, p in part]
                out.append((code, part[0][0], part[-1][0] + gap, prices[0], max(prices), min(prices), prices[-1], len(part)))
                at = i
    return out


def test_sessions_on_a_stream_equal_those_of_the_table(spark, tmp_path):
    base, rnd = str(tmp_path), random.Random(8)
    data, t = [], T0
    for i in range(240):
        t += dt.timedelta(seconds=rnd.choice([20, 40, 200, 700]))
        data.append((f"c{rnd.randrange(4)}", float(i), t))
    gap, columns = dt.timedelta(minutes=10), ["exchange_code", "start", "end", "open", "high", "low", "close", "ticks"]
    options = {"code": "exchange_code", "price": "price", "ts": "ts", "gap": "10 minutes"}
    want = spans(data, gap)
    table = qs.sessions(spark.createDataFrame(data, SCHEMA), **options)
    assert sorted(tuple(r[c] for c in columns) for r in table.collect()) == sorted(want)
    for k in range(6):  # files in time order, rows inside in any order; the watermark moves on with each
        part = data[40 * k : 40 * k + 40]
        rnd.shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/in")
        out = qs.sessions(stream(spark, f"{base}/in"), **options)
        qs.start_to_parquet(out, f"{base}/out", f"{base}/cp").awaitTermination()
    got = sorted(tuple(r[c] for c in columns) for r in spark.read.parquet(f"{base}/out").collect())
    assert got == sorted(w for w in want if w[2] <= data[-1][2] - dt.timedelta(minutes=10)) and len(got) > 20
    # a quote behind the watermark changes nothing that was emitted
    spark.createDataFrame([("c0", 9999.0, T0), ("c0", 1.0, data[-1][2] + dt.timedelta(hours=9))], SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/in")
    qs.start_to_parquet(qs.sessions(stream(spark, f"{base}/in"), **options), f"{base}/out", f"{base}/cp").awaitTermination()
    assert spark.read.parquet(f"{base}/out").agg(F.max("high")).first()[0] < 9999


def test_windows_in_append_mode_match_a_batch_run(spark, tmp_path):
    base, data = str(tmp_path), ticks()
    write_files(spark, f"{base}/in", list(data), 1, 3)
    bars = qs.window_bars(stream(spark, f"{base}/in"), code="exchange_code", price="price", ts="ts")
    qs.start_to_parquet(bars, f"{base}/out", f"{base}/cp").awaitTermination()
    got = {(r["exchange_code"], r["start"]): (r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in spark.read.parquet(f"{base}/out").collect()}
    mark = max(t for _, _, t in data) - dt.timedelta(minutes=10)
    want = {}
    for c, p, t in sorted(data, key=lambda r: r[2]):
        s = t - dt.timedelta(minutes=t.minute % 5, seconds=t.second)
        o, h, lo, _, n = want.get((c, s), (p, p, p, p, 0))
        want[(c, s)] = (o, max(h, p), min(lo, p), p, n + 1)
    assert got == {k: x for k, x in want.items() if k[1] + dt.timedelta(minutes=5) <= mark}


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    base = str(tmp_path)

    def run():
        bars = qs.window_bars(stream(spark, f"{base}/in"), code="exchange_code", price="price", ts="ts")
        qs.start_to_parquet(bars, f"{base}/out", f"{base}/cp").awaitTermination()

    write_files(spark, f"{base}/in", [("a", 1.0, T0), ("a", 2.0, T0 + dt.timedelta(hours=1))], 1, 0)
    run()
    write_files(spark, f"{base}/in", [("a", 99.0, T0), ("a", 3.0, T0 + dt.timedelta(hours=2))], 1, 0)
    run()
    rows = spark.read.parquet(f"{base}/out").where(F.col("start") == F.lit(T0)).collect()
    assert [(r["high"], r["volume"]) for r in rows] == [(1.0, 1)]


def test_incremental_landing_reads_new_files_only(spark, tmp_path):
    base, schema = str(tmp_path), spark.createDataFrame([], SCHEMA).schema
    for k in (1, 2, 3):
        write_files(spark, f"{base}/in", [("a", float(k), T0)], 1, 0)
        qs.incremental(spark, f"{base}/in", f"{base}/out", f"{base}/cp", schema).awaitTermination()
        assert spark.read.parquet(f"{base}/out").count() == k
