"""Cases derived by hand, and invariants."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.functions.chunker import chunked, sentences
from folio.operators import catalog, chapters, documents, layout, reading, usage
from folio.sources import files
from folio.streaming import logs as streams

DAY = dt.datetime(2024, 1, 1)


def at(seconds):
    return DAY + dt.timedelta(seconds=seconds)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def logs(spark, rows):
    return spark.createDataFrame(rows, "log_id long, user_id long, book_id long, chapter_number int, chunk_index int, ts timestamp_ntz")


def test_sessions_end_after_more_than_the_gap(spark):
    df = logs(spark, [(1, 1, 5, 1, 0, at(0)), (2, 1, 6, 1, 1, at(300)), (3, 1, 5, 1, 2, at(600.001))])
    got = reading.sessions(df).orderBy("session").collect()
    assert [(r["minutes"], r["logs"], r["book_id"]) for r in got] == [(5.0, 2, 5), (0.0, 1, 5)]


def test_sessions_cross_days(spark):
    df = logs(spark, [(1, 1, 5, 1, 0, at(86390)), (2, 1, 5, 1, 1, at(86410)), (3, 1, 5, 1, 1, at(3 * 86400))])
    assert [r["logs"] for r in reading.sessions(df).orderBy("session").collect()] == [2, 1]


def test_sessions_of_missing_books_are_dropped(spark):
    s = reading.sessions(logs(spark, [(1, 1, 5, 1, 0, at(0))]))
    books = spark.createDataFrame([(6, "t", "a")], "book_id long, title string, author string")
    chapters = spark.createDataFrame([(6, 1, 10)], "book_id long, chapter_number int, chapter_words long")
    assert reading.named(s, books, chapters).count() == 0


def test_no_logs_no_sessions(spark):
    assert reading.sessions(logs(spark, [])).count() == 0


def test_progress(spark):
    chunks = spark.createDataFrame([(1, 1, 0, 60), (1, 1, 1, 40), (1, 2, 0, 50), (1, 2, 1, 50)], "book_id long, chapter_number int, chunk_index int, word_count int")
    positions = spark.createDataFrame([(1, 2, 1), (1, 9, 0), (2, 1, 0)], "book_id long, current_chapter int, current_chunk int")
    got = {(r["book_id"], r["current_chapter"]): (r["book_percent"], r["chapter_percent"], r["completed"]) for r in reading.progress(positions, chunks).collect()}
    assert got == {(1, 2): (75, 50, 1), (1, 9): (0, 0, 0), (2, 1): (0, 0, 0)}


@pytest.mark.parametrize("done, left", [(25, 180.0), (0, 0.0), (100, 0.0)])
def test_remaining_time(spark, done, left):
    assert value(spark, reading.remaining_minutes(F.lit(60), F.lit(done))) == left


def test_latest_error_of_equal_times_is_the_first_seen(spark):
    rows = [(1, "polly", "C", "a", at(1)), (3, "polly", "C", "b", at(2)), (2, "polly", "C", "c", at(2))]
    r = usage.latest_by_code(spark.createDataFrame(rows, "error_id long, provider string, code string, original_error string, ts timestamp_ntz")).first()
    assert (r["n"], r["latest"]) == (3, "b")


@pytest.mark.parametrize("model, prompt, completion, cost", [("gpt-4o", 1000, 500, 0.0075), ("gemini-1.5-pro", 128000, 1000, 0.165), ("gemini-1.5-pro", 128001, 1000, 0.3250025)])
def test_call_costs(spark, model, prompt, completion, cost):
    df = spark.createDataFrame([(model, prompt, completion)], "model_id string, prompt_tokens long, completion_tokens long")
    assert usage.with_model_cost(df).first()["cost"] == pytest.approx(cost)


def test_unknown_model_is_an_error(spark):
    df = spark.createDataFrame([("x", 1, 1)], "model_id string, prompt_tokens long, completion_tokens long")
    with pytest.raises(Exception, match="no price for model x"):
        usage.with_model_cost(df).collect()


@pytest.mark.parametrize("text, code", [("Invalid API key", "AUTH_ERROR"), ("Rate limit hit", "RATE_LIMIT_ERROR"), ("ETIMEDOUT connection", "NETWORK_ERROR"), ("voice not found", "INVALID_VOICE"), ("credentials not found", "AUTH_ERROR"), ("boom", "UNKNOWN_ERROR")])
def test_error_codes(spark, text, code):
    assert value(spark, usage.error_code(F.lit(text))) == code


def test_beyond_free_tier(spark):
    rows = [("polly", "neural", 1_500_000, 0, 37_5000_0000, dt.datetime(2024, 3, 1)), ("polly", "neural", 1_500_000, 0, 37_5000_0000, dt.datetime(2024, 2, 1))]
    df = spark.createDataFrame(rows, "provider string, voice_type string, text_length long, audio_tenths long, cost_units long, ts timestamp_ntz")
    assert usage.beyond_free(df, "2024-03").first()["adjusted"] == pytest.approx(12.5)


def test_public_then_own(spark):
    rows = [(1, True, 0), (2, True, 9), (3, False, 9)]
    df = spark.createDataFrame(rows, "book_id long, is_public boolean, uploaded_by long")
    assert [r["book_id"] for r in catalog.public_then_own(df, 9, 2, 2).collect()] == [1, 2]


def test_toggle_twice_is_as_before(spark):
    t = spark.createDataFrame([], "k long")
    row = spark.createDataFrame([(1,)], "k long")
    once = catalog.toggled(t, row, ["k"])
    assert once.count() == 1 and catalog.toggled(once, row, ["k"]).count() == 0


def words_in(text, **k):
    return [len(c.words) for c in chunked(text, **k)]


def test_chunks():
    text = "One two three. Four five six seven. Eight."
    assert words_in(text, plain=True) == [7, 1]
    assert words_in(text) == [8]
    assert words_in(" ".join(["word"] * 40)) == [40]
    assert words_in("") == [] and words_in(None) == []


def test_sentences():
    assert len(list(sentences("Dr. smith left. He ran.".split()))) == 2
    assert len(list(sentences("Dr. Smith left.".split()))) == 2


def test_chunks_keep_words_and_headings():
    text = "Begin here. ⟨⟨HEADING⟩⟩THE AIR⟨⟨/HEADING⟩⟩ Then it goes on and on. It ends."
    got = chunked(text)
    assert [c.kind for c in got] == ["text", "header", "text"]
    assert " ".join(w for c in got for w in c.words) == "Begin here. THE AIR Then it goes on and on. It ends."


@pytest.mark.parametrize("line, after, before, want", [("THE FATE OF PYRUVATE", None, "It ends.", True), ("Deep breathing", "The", None, True), ("Smith, John 123", None, None, False), ("Hello there.", "The", None, False), ("ab", "The", None, False), ("C on top", "The", None, False)])
def test_headings(spark, line, after, before, want):
    df = spark.createDataFrame([(line, after, before)], "t string, f string, p string")
    assert df.select(T.is_heading(F.col("t"), F.col("f"), F.col("p")).alias("v")).first()["v"] is want


@pytest.mark.parametrize("entry, want", [(" 150–51", [150, 151]), ("7, 9-11", [7, 9, 10, 11]), ("none", [])])
def test_index_pages(spark, entry, want):
    assert value(spark, T.index_pages(F.lit(entry))) == want


def test_word_at_time(spark):
    marks = spark.createDataFrame([(1, 0, 0.1), (1, 1, 0.6), (1, 2, 1.1)], "k long, word int, mark double")
    times = spark.createDataFrame([(1, 0.05), (1, 0.6), (1, 9.0)], "k long, t double")
    assert [r["word"] for r in layout.word_at(times, marks, ["k"]).orderBy("t").collect()] == [0, 1, 2]


def test_images_by_place(spark):
    slots = spark.createDataFrame([(1, 1, 1), (1, 4, 2)], "doc_id long, page long, images long")
    names = spark.createDataFrame([(1, f"{i}") for i in range(3)], "doc_id long, file_name string")
    got = layout.images_by_place(slots, names).select(T.image_name(F.col("page"), F.col("nth")).alias("n")).collect()
    assert sorted(r[0] for r in got) == ["page-001-image-1.jpg", "page-004-image-1.jpg", "page-004-image-2.jpg"]


def test_images_by_place_of_many_documents(spark):
    slots = spark.createDataFrame([("a", 1, 1), ("b", 2, 2)], "doc string, page long, images long")
    names = spark.createDataFrame([("a", "x"), ("b", "y")], "doc string, file_name string")
    got = layout.images_by_place(slots, names, ("doc",)).collect()
    assert sorted((r["doc"], r["nth"], r["file_name"]) for r in got if not r["placeholder"]) == [("a", 1, "x"), ("b", 1, "y")] and len(got) == 3


def test_speech_markup(spark):
    marked = T.marked_speech(F.lit("Hello world"))
    assert len(value(spark, T.without_tags(marked))) == 14
    assert len(value(spark, T.without_tags(marked, marks_only=True))) == 29


def test_search_has_no_match_in_missing_values(spark):
    df = spark.createDataFrame([("Banana", None), (None, None)], "title string, author string")
    assert df.where(catalog.found_by("ana", "title", "author")).count() == 1


def test_config_falls_back_to_defaults(tmp_path):
    defaults = {"metadata": {"title": "t", "author": "a"}, "chapterNames": []}
    assert files.book_config(str(tmp_path / "none.json"), defaults) == defaults
    (tmp_path / "c.json").write_text('{"metadata": {"title": "x"}}')
    assert files.book_config(str(tmp_path / "c.json"), defaults)["metadata"] == {"title": "x", "author": "a"}


def test_result_cache(spark):
    cache = files.ResultCache(spark, seconds=100)
    cache.put("k", spark.range(3), 0)
    assert cache.get("k", 50).count() == 3 and cache.get("k", 101) is None
    assert [cache.state("k", t) for t in (5, 50, 200)] == ["fresh", "stale", "expired"]
    assert cache.delete("k") and not cache.delete("k") and cache.clear() == 0


@pytest.mark.parametrize("line, want", [
    ("1. The Search 25", (1, None, "The Search", "25")), ("Introduction: The Old Idea ix", (0, None, "Introduction: The Old Idea", "ix")), ("Appendix A: Brain Basics 302", (None, "Appendix A", "Appendix A: Brain Basics", "302")),
    ("Bibliography 321", (None, None, "Bibliography", "321")), ("Contents", None), ("Table of contents", None), ("Some dots .... 7", None),
])
def test_lines_of_contents(spark, line, want):
    got = value(spark, T.toc_entry(F.lit(line)))
    assert (tuple(got) if got else None) == want


def test_chapters_by_title(spark):
    """The contents name both titles, but what follows them stands further on; the second title is broken over two lines."""
    text = ["Contents", "The First Part 1", "The Second Part 9", "x", "", "The First Part", "a long line of content, number one", "a long line of content, number two", "The Second", "Part", "the content of the second one here", "12", "Copyright of somebody"]
    lines = chapters.book_lines(spark.createDataFrame([(1, "\n".join(text))], "doc_id long, text string"))
    titles = spark.createDataFrame([(1, 0, "The First Part"), (1, 1, "The Second Part")], "doc_id long, nth int, title string")
    got = chapters.chapters_by_title(lines, titles).orderBy("chapter").collect()
    assert [(r["chapter"], r["title"], r["line"], r["content_lines"]) for r in got] == [(1, "The First Part", 4, 2), (2, "The Second Part", 7, 1)]
    assert got[1]["content"] == "the content of the second one here"


def test_saved_minutes_begin_anew(spark):
    rows = [(1, 5, "view", at(0)), (2, 5, "view", at(8)), (3, 5, "saved", at(17)), (4, 5, "view", at(40)), (5, 5, "saved", at(49)), (6, 6, "saved", at(0))]
    df = spark.createDataFrame(rows, "log_id long, user_id long, event_type string, ts timestamp_ntz")
    assert [(r["log_id"], r["seconds"], r["minutes"]) for r in reading.saved_minutes(df).orderBy("log_id").collect()] == [(3, 17.0, 0), (5, 9.0, 0), (6, 0.0, 0)]


def test_an_outline_that_goes_round_is_an_error(spark):
    rows = spark.createDataFrame([(1, None, "a", 0), (2, 1, "b", 0), (3, 2, "contents", 1), (4, 3, "c", 0)], "id long, parent long, title string, pos int")
    assert [(r["id"], r["path"]) for r in documents.outline_paths(rows).orderBy("id").collect()] == [(1, "0" * 19), (2, "0" * 19 + "." + "0" * 19)]
    with pytest.raises(ValueError, match="levels"):
        documents.outline_paths(rows, most_levels=1)


def test_a_stream_that_takes_too_long_is_an_error(spark, small):
    path = f"{small}/events.parquet"
    with pytest.raises(TimeoutError):
        streams.run_once(streams.stream_of(spark, path, spark.read.parquet(path)), "append", 0.001)


def test_a_record_behind_many_newer_files_is_found(spark, tmp_path):
    (tmp_path / "old.json").write_text('{"id": "a", "cost": 1.5}')
    (tmp_path / "broken.json").write_text("{")
    assert files.one_record(spark, str(tmp_path), "a").first()["cost"] == 1.5
    assert files.one_record(spark, str(tmp_path), "b").count() == 0


def test_updates_can_set_null(spark):
    table = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    changes = spark.createDataFrame([(1, None)], "k long, v string")
    assert {r["k"]: r["v"] for r in catalog.updated(table, changes, ["k"]).collect()} == {1: None, 2: "y"}
