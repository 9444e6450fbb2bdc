"""What keeps a query's work in proportion to its tables, and cases that only larger tables have."""

from pyspark.sql import functions as F

from folio.functions import text as T
from folio.functions.fixed import ABBREVIATIONS


def test_abbreviated_ends_look_at_a_text_once(spark):
    """Not once for each abbreviation, and with the same verdicts as letter by letter."""
    texts = [a + tail for a in ABBREVIATIONS for tail in ("", " ", "　﻿", "x", "\x85")] + [" x " + a.upper() for a in ABBREVIATIONS] + ["", " ", "word.", "ph.d.\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    ends = T.ends_abbreviated(F.col("t"))
    got = {r["t"]: r["yes"] for r in df.select("t", ends.alias("yes")).collect()}
    stripped = {t: t.strip("".join(T.SPACE_CHARACTERS)).lower() for t in texts}
    assert got == {t: stripped[t].endswith(tuple(a.lower() for a in ABBREVIATIONS)) for t in texts}
    plan = df.where(ends)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "regexp_replace" not in plan


def test_chunks_are_given_out_in_small_pieces(monkeypatch):
    """What a task holds is bounded by rows and by letters, whatever number of texts comes in a batch."""
    from folio.functions import chunker

    monkeypatch.setattr(chunker, "ROWS_AT_ONCE", 10)
    monkeypatch.setattr(chunker, "LETTERS_AT_ONCE", 100)
    taken = []

    def rows():
        for i in range(95):
            taken.append(i)
            yield i, "x" * (1 + i % 30), i
        yield 95, "y" * 500, 95

    pieces = []
    for piece in chunker.in_pieces(rows(), 1):
        assert len(taken) <= sum(map(len, pieces)) + len(piece) + 1
        assert len(piece) <= 10 and (len(piece) == 1 or sum(len(r[1]) for r in piece) <= 100)
        pieces.append(piece)
    assert [r[0] for p in pieces for r in p] == list(range(96))


def test_rows_in_cells_are_not_broadcast(spark, small):
    """However small the planner takes them to be."""
    from folio.plans import layout_queries as Q

    assert "Broadcast" not in Q.j10(spark, small)._jdf.queryExecution().executedPlan().toString()


def test_a_bounded_stream_leaves_nothing_waiting(spark, tmp_path):
    """The last hour's rows come too, those without a user among them, and the row that ends the stream does not."""
    from folio.streaming import logs as S

    rows = [(1, 1, 5, "2024-01-01 10:00:00"), (2, 1, 6, "2024-01-01 10:30:00"), (3, 1, 6, "2024-01-01 10:31:00"), (4, None, 1, "2024-01-01 10:59:59"), (5, 2, 3, "2024-01-01 10:59:59.5")]
    df = spark.createDataFrame(rows, "log_id long, user_id long, chunk_index int, ts string").selectExpr("log_id", "user_id", "chunk_index", "cast(ts as timestamp_ntz) as ts", "1L as book_id", "1 as chapter_number")
    path = f"file://{tmp_path}/t"
    df.coalesce(1).write.parquet(path)
    table = spark.read.parquet(path)
    logs, end = S.with_end(spark, S.stream_of(spark, path, table))
    got = S.run_to_end(S.live_changes(logs, keep_ms=None), logs, end, table)
    assert sorted(r["log_id"] for r in got.collect()) == [1, 2, 4, 5]


def test_sessions_are_over_by_the_whole_second(spark, tmp_path):
    """As in the SQL: 10:00:00.2 and five minutes are behind 10:15:00.5 less ten, but not in whole seconds."""
    from folio.plans import stream_queries as Q

    rows = [(1, 1, "2024-01-01 10:00:00.2"), (2, 2, "2024-01-01 10:00:00"), (3, 3, "2024-01-01 10:15:00.5")]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.coalesce(1).write.parquet(f"file://{tmp_path}/events.parquet")
    assert [r["user_id"] for r in Q.t02(spark, f"file://{tmp_path}").collect()] == [2]
