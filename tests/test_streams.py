"""Streams with state: order of time, timers, files that are out of order, batches that come again."""

import shutil
import time

import pytest
from pyspark.sql import functions as F

from folio.operators import reading as R
from folio.streaming import logs as S

HOUR = 3_600_000
DAY0 = "2024-01-01 "


def put(spark, folder, parts):
    """Files of (log_id, user_id, chunk, time, event_type), one for each part, in this order of their change."""
    for rows in parts:
        df = spark.createDataFrame(rows, "log_id long, user_id long, chunk_index int, ts string, event_type string").selectExpr("*", "1L as book_id", "1 as chapter_number")
        df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(f"file://{folder}")
        time.sleep(0.05)
    return f"file://{folder}"


def stream(spark, path, at_once=1):
    return S.stream_of(spark, path, spark.read.parquet(path), at_once)


FLUSHER = (999, 99, 0, "2024-01-09 00:00:00", "view")  # so that the watermark passes all before


def test_rows_come_in_order_of_time(spark, tmp_path):
    """Inside one batch rows stand as they like; the change of place is judged by their time, and of one time by their id."""
    rows = [(3, 1, 5, DAY0 + "10:00:02", "view"), (1, 1, 5, DAY0 + "10:00:00", "view"), (2, 1, 6, DAY0 + "10:00:01", "view"), (5, 1, 7, DAY0 + "12:30:00", "view"), (4, 1, 5, DAY0 + "12:30:00", "view"), FLUSHER]
    path = put(spark, tmp_path / "t", [rows])
    got = S.run_once(S.live_changes(stream(spark, path)), "append").collect()
    assert sorted((r["log_id"], r["chunk_index"]) for r in got) == [(1, 5), (2, 6), (3, 5), (5, 7)]


def test_timers_bring_what_is_over(spark, tmp_path):
    """A piece of time comes out in the batch after the watermark has passed its end, not before, and the last one waits."""
    parts = [[(1, 1, 1, DAY0 + "10:00:00", "view")], [(2, 1, 2, DAY0 + "10:59:00", "view")], [(3, 1, 3, DAY0 + "11:20:00", "view")], [(4, 1, 4, DAY0 + "11:21:00", "view")]]
    path = put(spark, tmp_path / "t", parts)
    got = {r["log_id"]: r["_batch"] for r in S.run_once(S.live_changes(stream(spark, path)), "append").collect()}
    assert set(got) == {1, 2} and got[1] == got[2] >= 3


def test_idle_keys_are_forgotten(spark, tmp_path):
    parts = [[(1, 1, 5, DAY0 + "10:00:00", "view")], [(2, 2, 5, DAY0 + "20:00:00", "view")], [(3, 2, 5, "2024-01-02 08:00:00", "view")], [(4, 1, 5, "2024-01-02 09:00:00", "view"), FLUSHER]]
    path = put(spark, tmp_path / "t", parts)
    long_ = S.run_once(S.live_changes(stream(spark, path)), "append").collect()
    short = S.run_once(S.live_changes(stream(spark, path), keep_ms=4 * HOUR), "append").collect()
    assert sorted(r["log_id"] for r in long_) == [1, 2] and sorted(r["log_id"] for r in short) == [1, 2, 3, 4]


def test_a_batch_that_comes_again(spark, tmp_path):
    """The last batches are run again from the state before them: the same rows."""
    rows = [(i, i % 3, i % 5, f"2024-01-01 {8 + i // 20:02d}:{i % 20 * 3:02d}:{i % 60:02d}", "saved" if i % 7 == 6 else "view") for i in range(120)]
    path = put(spark, tmp_path / "t", [rows[k : k + 30] for k in range(0, 120, 30)] + [[FLUSHER]])
    out = f"file://{tmp_path}/out"
    first = sorted(map(str, S.run_once(S.live_active_seconds(stream(spark, path), 600.0), "append", path=out).collect()))
    commits = sorted((int(p.name), p) for p in (tmp_path / "out-state" / "commits").iterdir() if p.name.isdigit())
    for n, p in commits[-1:]:
        p.unlink()
        (p.parent / f".{n}.crc").unlink(missing_ok=True)
        shutil.rmtree(tmp_path / "out" / f"_batch={n}", ignore_errors=True)
    again = sorted(map(str, S.run_once(S.live_active_seconds(stream(spark, path), 600.0), "append", path=out).collect()))
    assert again == first and len(first) > 10


def test_saves_of_a_stream_are_those_of_the_table(spark, tmp_path, monkeypatch):
    """A user with nearly all rows, more than are held at once."""
    monkeypatch.setattr(S, "FLUSH", 64)
    rows = [(i, 1 if i % 20 else 2, 0, f"2024-01-0{1 + i // 400} {i % 400 // 20:02d}:{i % 20 * 3:02d}:00", "saved" if i % 11 == 10 else "view") for i in range(1200)]
    path = put(spark, tmp_path / "t", [rows, [FLUSHER]])
    got = S.run_once(S.live_active_seconds(stream(spark, path), 600.0), "append").where("saved_minutes is not null")
    want = R.saved_minutes(spark.read.parquet(path), 600)
    assert sorted((r["log_id"], round(r["seconds"], 3), r["saved_minutes"]) for r in got.collect()) == sorted((r["log_id"], r["seconds"], r["minutes"]) for r in want.collect())


@pytest.mark.parametrize("order", [[0, 1, 2], [2, 0, 1], [1, 2, 0]])
def test_shuffled_files_give_the_sessions_of_the_table(spark, tmp_path, order):
    """Three files, one in a batch: taken as they are, the watermark would drop those that go back."""
    parts = [[(d * 10 + i, 1, 0, f"2024-01-0{1 + d} 10:0{i}:00", "view") for i in range(4)] for d in range(3)]
    path = put(spark, tmp_path / "t", [parts[k] for k in order] + [[FLUSHER]])
    assert (S.disorder(spark, path) > 600) == (order != [0, 1, 2])
    ordered = S.arranged(spark, path)
    assert (ordered == path) == (order == [0, 1, 2])
    assert S.disorder(spark, ordered) <= 600 and spark.read.parquet(ordered).count() == 13
    got = S.run_once(S.live_sessions(stream(spark, ordered)), "append")
    want = R.sessions(spark.read.parquet(path)).where("user_id = 1")
    key = lambda df: sorted((r["started"], r["ended"], r["logs"]) for r in df.select(F.unix_micros(F.col("started").cast("timestamp")).alias("started"), F.unix_micros(F.col("ended").cast("timestamp")).alias("ended"), "logs").collect())
    assert key(got.where("user_id = 1")) == key(want) and len(key(want)) == 3


def test_a_stream_of_nothing(spark, tmp_path):
    path = put(spark, tmp_path / "t", [[FLUSHER]])
    empty = S.stream_of(spark, path, spark.read.parquet(path)).where("user_id = 5")
    for live in (S.live_changes, S.live_active_seconds, S.live_sessions):
        assert S.run_once(live(empty), "append").count() == 0


def test_many_keys_are_few_calls_and_stores(spark, tmp_path, monkeypatch):
    """Keys of a bucket share one call and one state in a batch, and stores follow the cores; before, each key had its own and each partition of a shuffle a store."""
    monkeypatch.setattr(S, "BUCKETS", 3)
    rows = [(i, i % 50 if i % 9 else None, i // 100 % 2, f"2024-01-01 {i // 60 % 10:02d}:{i % 60:02d}:00", "view") for i in range(600)]
    path = put(spark, tmp_path / "t", [rows, [FLUSHER]])
    out, stores = f"file://{tmp_path}/out", S.STORES * spark.sparkContext.defaultParallelism
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(3 * stores))
    try:
        got = sorted(r["log_id"] for r in S.run_once(S.live_changes(stream(spark, path)), "append", path=out).collect())
        assert spark.conf.get("spark.sql.shuffle.partitions") == str(3 * stores)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    last, want = {}, []
    for log_id, user, chunk, _, _ in sorted(rows, key=lambda r: (r[3], r[0])):
        if last.get(user) != chunk:
            want.append(log_id)
        last[user] = chunk
    assert got == sorted(want) and len(want) > 100
    assert all(len([p for p in op.iterdir() if p.name.isdigit()]) <= stores for op in (tmp_path / "out-state" / "state").iterdir())
    spark.conf.set(S.STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        assert spark.read.format("statestore").option("stateVarName", "states").load(out + "-state").count() <= 3
    finally:
        spark.conf.unset(S.STATE_STORE)
