"""Reading sessions, progress and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GAP_MINUTES = 5


def minutes_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 60_000_000


def sessionized(logs: DataFrame, keys: tuple[str, ...] = ("user_id",), ts: str = "ts", tiebreak: str = "log_id", gap_minutes: float = GAP_MINUTES) -> DataFrame:
    """The rows with ``session``, counted from 1 for each key: a new one begins after a gap of more than so long.

    In two steps, rows inside a day and days of a key, so a key with very many rows is not in one task.
    """
    day = F.to_date(ts)
    logs = logs.withColumn("_day", day)
    inside = Window.partitionBy(*keys, "_day").orderBy(ts, tiebreak)
    days = logs.groupBy(*keys, "_day").agg(F.max(ts).alias("_last"))
    by_key = Window.partitionBy(*keys).orderBy("_day")
    days = days.select(*keys, "_day", F.lag("_last").over(by_key).alias("_before"))
    logs = logs.join(days, [*keys, "_day"])
    previous = F.coalesce(F.lag(ts).over(inside), F.col("_before"))
    logs = logs.withColumn("_new", F.when(previous.isNull() | (minutes_between(previous, F.col(ts)) > gap_minutes), 1).otherwise(0))
    starts = logs.groupBy(*keys, "_day").agg(F.sum("_new").alias("_starts"))
    starts = starts.select(*keys, "_day", F.coalesce(F.sum("_starts").over(by_key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_earlier"))
    running = F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return logs.join(starts, [*keys, "_day"]).withColumn("session", F.col("_earlier") + running).drop("_day", "_before", "_new", "_earlier")


def sessions(logs: DataFrame, gap_minutes: float = GAP_MINUTES, with_rows: bool = True) -> DataFrame:
    """A row for each session, named after its earliest log. ``with_rows``: with the ids of its logs.

    First the sessions inside each day of a user, then those of a user that follow each other closely are joined: logs are
    dealt once, and what a user with very many logs has in one task are only their sessions.
    """
    inside = Window.partitionBy("user_id", "_day").orderBy("ts", "log_id")
    is_new = F.coalesce((minutes_between(F.lag("ts").over(inside), F.col("ts")) > gap_minutes).cast("int"), F.lit(1))
    rows = logs.withColumn("_day", F.to_date("ts")).withColumn("_new", is_new)
    rows = rows.withColumn("_part", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.struct("ts", "log_id", "book_id", "chapter_number")
    ids = [F.array_sort(F.collect_list(F.struct("ts", "log_id"))).alias("_rows")] if with_rows else []
    parts = rows.groupBy("user_id", "_day", "_part").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("logs"), F.min(first).alias("_first"), *ids)
    order = Window.partitionBy("user_id").orderBy("started", "_first.log_id")
    begins = F.coalesce((minutes_between(F.lag("ended").over(order), F.col("started")) > gap_minutes).cast("int"), F.lit(1))
    parts = parts.withColumn("_begins", begins).withColumn("session", F.sum("_begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ids = [F.array_sort(F.flatten(F.collect_list("_rows"))).alias("_rows")] if with_rows else []
    whole = parts.groupBy("user_id", "session").agg(F.min("started").alias("started"), F.max("ended").alias("ended"), F.sum("logs").alias("logs"), F.min("_first").alias("_first"), *ids)
    name = F.concat(F.col("user_id").cast("string"), F.lit("-"), F.unix_millis(F.col("started").cast("timestamp")).cast("string"))
    listed = [F.transform("_rows", lambda r: r["log_id"]).alias("log_ids")] if with_rows else []
    return whole.select(name.alias("session_id"), "user_id", "session", "started", "ended", F.round(minutes_between(F.col("started"), F.col("ended")), 4).alias("minutes"), "logs", "_first.book_id", "_first.chapter_number", *listed)


def named(sessions_: DataFrame, books: DataFrame, chapters: DataFrame) -> DataFrame:
    """Sessions of books and chapters that are there."""
    return sessions_.join(books.select("book_id", "title", "author"), "book_id").join(chapters.select("book_id", "chapter_number", "chapter_words"), ["book_id", "chapter_number"])


def by_day(sessions_: DataFrame) -> DataFrame:
    return sessions_.groupBy(F.date_format("started", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("sessions"), F.round(F.sum("minutes"), 3).alias("minutes"), F.sort_array(F.collect_list("session_id")).alias("ids"))


def with_running(chunks: DataFrame) -> DataFrame:
    """Chunks (book_id, chapter_number, chunk_index, word_count) with the words and chunks before each: ``words_inside`` and ``chunks_inside`` its
    chapter, ``words_earlier`` and ``chunks_earlier`` in the chapters before. In two steps, so a book is not one task's."""
    chapters = chunks.groupBy("book_id", "chapter_number").agg(F.sum("word_count").alias("_words"), F.count("*").alias("_chunks"))
    earlier = Window.partitionBy("book_id").orderBy("chapter_number").rowsBetween(Window.unboundedPreceding, -1)
    chapters = chapters.select("book_id", "chapter_number", *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"{n}_earlier") for n in ("words", "chunks")])
    inside = Window.partitionBy("book_id", "chapter_number").orderBy("chunk_index")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = chunks.withColumns({"words_inside": F.coalesce(F.sum("word_count").over(before), F.lit(0)), "chunks_inside": F.row_number().over(inside) - 1})
    return rows.join(chapters, ["book_id", "chapter_number"])


def words_before(chunks: DataFrame) -> DataFrame:
    """Chunks with the words before each in its book."""
    return with_running(chunks).select(*chunks.columns, (F.col("words_earlier") + F.col("words_inside")).alias("words_before"))


def running_ids(chunks: DataFrame) -> DataFrame:
    """Chunks with ids that run over a book's chapters from 1."""
    return with_running(chunks).select(*chunks.columns, (F.col("chunks_earlier") + F.col("chunks_inside") + 1).cast("int").alias("chunk_id"))


def percent(part: Column, whole: Column) -> Column:
    """Rounded percentage, 0 of nothing."""
    return F.when(whole > 0, F.round(100 * part / whole)).otherwise(0).cast("long")


def progress(positions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Book and chapter percentages and completed chapters at each position; 0, 0, 0 where its chapter isn't there.

    Words read are those of earlier chapters and of earlier chunks of the current one. A chapter's chunks count from 0 without
    gaps, so a position finds its chunk by equality; behind the last one all of the chapter is read.
    """
    chapters = chunks.groupBy("book_id", "chapter_number").agg(F.sum("word_count").alias("_words"), F.max("chunk_index").alias("_last"))
    book = Window.partitionBy("book_id")
    order = book.orderBy("chapter_number")
    chapters = chapters.select(
        "book_id", F.col("chapter_number").alias("current_chapter"), "_words", "_last", F.sum("_words").over(book).alias("_book_words"),
        F.coalesce(F.sum("_words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_earlier"), (F.row_number().over(order) - 1).alias("_done"),
    )
    inside = Window.partitionBy("book_id", "chapter_number").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    at = chunks.select("book_id", F.col("chapter_number").alias("current_chapter"), F.col("chunk_index").alias("current_chunk"), F.coalesce(F.sum("word_count").over(inside), F.lit(0)).alias("_at"))
    joined = positions.join(chapters, ["book_id", "current_chapter"], "left").join(at, ["book_id", "current_chapter", "current_chunk"], "left")
    read = F.when(F.col("_at").isNotNull(), F.col("_at")).when(F.col("current_chunk") > F.col("_last"), F.col("_words")).otherwise(0)
    there = F.col("_words").isNotNull()
    return joined.select(
        *positions.columns, F.when(there, percent(F.col("_earlier") + read, F.col("_book_words"))).otherwise(0).alias("book_percent"), F.when(there, percent(read, F.col("_words"))).otherwise(0).alias("chapter_percent"),
        F.when(there, F.col("_done")).otherwise(0).cast("long").alias("completed"),
    )


def remaining_minutes(minutes: Column, done: Column) -> Column:
    return F.when((done > 0) & (done < 100), F.round(minutes / done * (100 - done), 4)).otherwise(0.0)


def session_estimate(last: Column, now: Column) -> Column:
    """Minutes since the last reading, between 0 and 60."""
    return F.greatest(F.lit(0.0), F.least(F.lit(60.0), F.round(minutes_between(last, now), 4)))


def status(done: Column) -> Column:
    return F.when(done == 0, "Not started").when(done < 25, "Just started").when(done < 50, "In progress").when(done < 75, "Halfway through").when(done < 100, "Almost done").otherwise("Completed")


def readable_minutes(m: Column) -> Column:
    whole = F.round(m).cast("long")
    hours, rest = F.floor(whole / 60), whole % 60
    return F.when(m < 1, "< 1m").when(whole < 60, F.concat(whole.cast("string"), F.lit("m"))).when(rest == 0, F.concat(hours.cast("string"), F.lit("h"))).otherwise(F.concat(hours.cast("string"), F.lit("h "), rest.cast("string"), F.lit("m")))


def relative_day(then: Column, now: Column) -> Column:
    """Today, Yesterday, a weekday within a week, or the date, by whole days of 24 hours."""
    days = F.floor(minutes_between(then, now) / 1440)
    return F.when(days == 0, "Today").when(days == 1, "Yesterday").when(days < 7, F.date_format(then, "EEEE")).otherwise(F.date_format(then, "yyyy-MM-dd"))


def changes_only(logs: DataFrame) -> DataFrame:
    """Logs whose chunk differs from the one before, of the same user, book and chapter."""
    w = Window.partitionBy("user_id", "book_id", "chapter_number").orderBy("ts", "log_id")
    return logs.withColumn("_last", F.lag("chunk_index").over(w)).where(~F.col("chunk_index").eqNullSafe(F.col("_last"))).drop("_last")


def debounced(logs: DataFrame, seconds: int = 2) -> DataFrame:
    """The last position of each burst of saves of a user and book."""
    bursts = sessionized(logs, keys=("user_id", "book_id"), gap_minutes=seconds / 60)
    last = F.struct("ts", "log_id")
    return bursts.groupBy("user_id", "book_id", "session").agg(F.max("ts").alias("ts"), F.max_by("chapter_number", last).alias("chapter_number"), F.max_by("chunk_index", last).alias("chunk_index"))


def active_minutes(logs: DataFrame, most_seconds: int = 10) -> DataFrame:
    """Minutes that a user was active: the time to the next log, where that is less than so many seconds."""
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "log_id")
    gap = minutes_between(F.col("ts"), F.lead("ts").over(w)) * 60
    return logs.withColumn("_gap", gap).groupBy("user_id").agg(F.round(F.sum(F.when(F.col("_gap") < most_seconds, F.col("_gap")).otherwise(0.0)) / 60, 4).alias("minutes"))


def saved_minutes(logs: DataFrame, most_seconds: int = 10) -> DataFrame:
    """(log_id, user_id, seconds, minutes) of each log of the type ``saved``: the active time since the save before, and its rounded minutes.

    What is less than half a minute is lost with a save, as the count begins anew. In two steps, rows inside a day and days of a user; the
    time of a span is a sum by span, so neither a user nor a span is one task's.
    """
    logs = logs.withColumns({"_day": F.to_date("ts"), "_is_save": (F.col("event_type") == "saved").cast("int")})
    by_user = Window.partitionBy("user_id").orderBy("_day")
    days = logs.groupBy("user_id", "_day").agg(F.max("ts").alias("_last"), F.sum("_is_save").alias("_saves"))
    earlier = F.coalesce(F.sum("_saves").over(by_user.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = days.select("user_id", "_day", F.lag("_last").over(by_user).alias("_before"), earlier.alias("_earlier"))
    inside = Window.partitionBy("user_id", "_day").orderBy("ts", "log_id")
    gap = minutes_between(F.coalesce(F.lag("ts").over(inside), F.col("_before")), F.col("ts")) * 60
    rows = logs.join(days, ["user_id", "_day"]).withColumn("_active", F.when(gap < most_seconds, gap).otherwise(0.0))
    rows = rows.withColumn("_span", F.col("_earlier") + F.sum("_is_save").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_is_save"))
    spans = rows.groupBy("user_id", "_span").agg(F.max(F.when(F.col("_is_save") == 1, F.col("log_id"))).alias("log_id"), F.round(F.sum("_active"), 3).alias("seconds"))
    return spans.where("log_id is not null").select("log_id", "user_id", "seconds", F.round(F.col("seconds") / 60).cast("long").alias("minutes"))
