"""Queries of reading sessions, progress and history."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folio.operators import reading as R
from folio.plans.base import cte, frame
from folio.plans.registry import query

NOW = "2024-01-31 00:00:00"
MINUTES = "(epoch_us({b}) - epoch_us({a})) / 60000000"


def sessionized_sql(keys: str = "user_id", gap: str = "300000000", source: str = "reading_logs") -> str:
    return f"""s0 AS (SELECT *, lag(ts) OVER (PARTITION BY {keys} ORDER BY ts, log_id) AS prev FROM {source}),
 s1 AS (SELECT *, CASE WHEN prev IS NULL OR epoch_us(ts) - epoch_us(prev) > {gap} THEN 1 ELSE 0 END AS is_new FROM s0),
 s2 AS (SELECT *, CAST(sum(is_new) OVER (PARTITION BY {keys} ORDER BY ts, log_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM s1)"""


SESSIONS = sessionized_sql() + f""", ss AS (SELECT CAST(user_id AS VARCHAR) || '-' || CAST(epoch_us(min(ts)) // 1000 AS VARCHAR) AS session_id, user_id, session, min(ts) AS started, max(ts) AS ended, round({MINUTES.format(a='min(ts)', b='max(ts)')}, 4) AS minutes, count(*) AS logs,
 arg_min(book_id, (ts, log_id)) AS book_id, arg_min(chapter_number, (ts, log_id)) AS chapter_number, string_agg(CAST(log_id AS VARCHAR), ',' ORDER BY ts, log_id) AS log_ids FROM s2 GROUP BY user_id, session)"""
CHAPTERS = "chapters AS (SELECT book_id, chapter_number, CAST(sum(word_count) AS BIGINT) AS chapter_words, count(*) AS chunks FROM chunk_rows WHERE book_id % 3 <> 1 OR chapter_number <> 2 GROUP BY ALL)"
CHUNKS = "chunks AS (SELECT book_id, chapter_number, CAST(row_number() OVER (PARTITION BY book_id, chapter_number ORDER BY line, side, size_points) AS INT) - 1 AS chunk_index, word_count, type, line, size_points FROM chunk_rows)"


def logs(spark, folder):
    return frame(spark, folder, "reading_logs")


def chapters(spark, folder):
    return frame(spark, folder, "chunk_rows").where("book_id % 3 <> 1 OR chapter_number <> 2").groupBy("book_id", "chapter_number").agg(F.sum("word_count").alias("chapter_words"), F.count("*").alias("chunks"))


def chunks(spark, folder):
    w = Window.partitionBy("book_id", "chapter_number").orderBy("line", "side", "size_points")
    return frame(spark, folder, "chunk_rows").select("book_id", "chapter_number", (F.row_number().over(w) - 1).alias("chunk_index"), "word_count", "type", "line", "size_points")


@query("w01_sessions", cte("reading_logs") + ", " + SESSIONS + " SELECT * FROM ss")
def w01(spark, folder):
    return R.sessions(logs(spark, folder)).withColumn("log_ids", F.array_join(F.transform("log_ids", lambda x: x.cast("string")), ","))


@query("w01_reading_sessions", cte("reading_logs", "books", "chunk_rows") + ", " + SESSIONS + ", " + CHAPTERS + " SELECT session_id, user_id, session, started, ended, minutes, logs, book_id, chapter_number, log_ids, title, author, chapter_words FROM ss JOIN (SELECT book_id, title, author FROM books) USING (book_id) JOIN (SELECT book_id, chapter_number, chapter_words FROM chapters) USING (book_id, chapter_number)")
def w01_named(spark, folder):
    return R.named(w01(spark, folder), frame(spark, folder, "books"), chapters(spark, folder))


@query("w01_session_of_each_log", cte("reading_logs") + ", " + sessionized_sql() + " SELECT log_id, user_id, session FROM s2")
def w01_rows(spark, folder):
    return R.sessionized(logs(spark, folder)).select("log_id", "user_id", "session")


@query("w01_session_window", cte("reading_logs") + ", " + SESSIONS + " SELECT user_id, started, logs FROM ss")
def w01_window(spark, folder):
    return logs(spark, folder).groupBy("user_id", F.session_window("ts", "5 minutes")).agg(F.min("ts").alias("started"), F.count("*").alias("logs")).select("user_id", "started", "logs")


@query("a12_session_lengths", cte("reading_logs") + ", " + SESSIONS + " SELECT user_id, count(*) AS sessions, round(sum(minutes), 3) AS minutes, max(logs) AS longest FROM ss GROUP BY user_id")
def a12(spark, folder):
    return R.sessions(logs(spark, folder), with_rows=False).groupBy("user_id").agg(F.count("*").alias("sessions"), F.round(F.sum("minutes"), 3).alias("minutes"), F.max("logs").alias("longest"))


@query("a13_sessions_by_day", cte("reading_logs") + ", " + SESSIONS + " SELECT strftime(started, '%Y-%m-%d') AS day, count(*) AS sessions, round(sum(minutes), 3) AS minutes, string_agg(session_id, ',' ORDER BY session_id) AS ids FROM ss GROUP BY 1")
def a13(spark, folder):
    return R.by_day(R.sessions(logs(spark, folder), with_rows=False)).withColumn("ids", F.array_join("ids", ","))


@query("o06_session_page", cte("reading_logs") + ", " + SESSIONS + " SELECT session_id, (SELECT count(*) FROM ss WHERE user_id = 7) AS total FROM ss WHERE user_id = 7 ORDER BY started DESC, session LIMIT 5 OFFSET 3")
def o06(spark, folder):
    mine = R.sessions(logs(spark, folder).where("user_id = 7"), with_rows=False)
    return mine.crossJoin(F.broadcast(mine.agg(F.count("*").alias("total")))).orderBy(F.desc("started"), "session").offset(3).limit(5).select("session_id", "total")


@query("w02_words_before", cte("chunk_rows") + ", " + CHUNKS + " SELECT book_id, chapter_number, chunk_index, word_count, CAST(coalesce(sum(word_count) OVER (PARTITION BY book_id ORDER BY chapter_number, chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS words_before FROM chunks")
def w02(spark, folder):
    return R.words_before(chunks(spark, folder)).select("book_id", "chapter_number", "chunk_index", "word_count", "words_before")


PROGRESS = CHUNKS + """, w AS (SELECT p.*, b.book_words, c.words, coalesce((SELECT sum(word_count) FROM chunks x WHERE x.book_id = p.book_id AND x.chapter_number < p.current_chapter), 0) AS earlier,
 coalesce((SELECT sum(word_count) FROM chunks x WHERE x.book_id = p.book_id AND x.chapter_number = p.current_chapter AND x.chunk_index < p.current_chunk), 0) AS inside,
 (SELECT count(DISTINCT chapter_number) FROM chunks x WHERE x.book_id = p.book_id AND x.chapter_number < p.current_chapter) AS done FROM progress p
 LEFT JOIN (SELECT book_id, sum(word_count) AS book_words FROM chunks GROUP BY 1) b USING (book_id) LEFT JOIN (SELECT book_id, chapter_number AS current_chapter, sum(word_count) AS words FROM chunks GROUP BY ALL) c USING (book_id, current_chapter)),
 pp AS (SELECT progress_id, user_id, book_id, minutes, last_read_at, CASE WHEN words IS NULL OR book_words = 0 THEN 0 ELSE CAST(round(100 * (earlier + inside) / book_words) AS BIGINT) END AS book_percent, CASE WHEN words IS NULL OR words = 0 THEN 0 ELSE CAST(round(100 * inside / words) AS BIGINT) END AS chapter_percent, CASE WHEN words IS NULL THEN 0 ELSE done END AS completed FROM w)"""


def with_progress(spark, folder):
    return R.progress(frame(spark, folder, "progress"), chunks(spark, folder))


@query("j02_progress", cte("progress", "chunk_rows") + ", " + PROGRESS + " SELECT progress_id, user_id, book_id, book_percent, chapter_percent, completed FROM pp")
def j02(spark, folder):
    return with_progress(spark, folder).select("progress_id", "user_id", "book_id", "book_percent", "chapter_percent", "completed")


@query("f25_remaining_time", cte("progress", "chunk_rows") + ", " + PROGRESS + " SELECT progress_id, CASE WHEN book_percent > 0 AND book_percent < 100 THEN round(minutes / book_percent * (100 - book_percent), 4) ELSE 0 END AS remaining FROM pp")
def f25(spark, folder):
    return with_progress(spark, folder).select("progress_id", R.remaining_minutes(F.col("minutes"), F.col("book_percent")).alias("remaining"))


@query("f27_reading_status", cte("progress", "chunk_rows") + ", " + PROGRESS + " SELECT CASE WHEN book_percent = 0 THEN 'Not started' WHEN book_percent < 25 THEN 'Just started' WHEN book_percent < 50 THEN 'In progress' WHEN book_percent < 75 THEN 'Halfway through' WHEN book_percent < 100 THEN 'Almost done' ELSE 'Completed' END AS status, count(*) AS n FROM pp GROUP BY 1")
def f27(spark, folder):
    return with_progress(spark, folder).groupBy(R.status(F.col("book_percent")).alias("status")).agg(F.count("*").alias("n"))


@query("a23_book_totals", cte("chunk_rows") + " SELECT book_id, CAST(sum(word_count) AS BIGINT) AS words, count(DISTINCT chapter_number) AS chapters, count(*) AS chunks FROM chunk_rows GROUP BY book_id")
def a23(spark, folder):
    by_chapter = frame(spark, folder, "chunk_rows").groupBy("book_id", "chapter_number").agg(F.sum("word_count").alias("words"), F.count("*").alias("chunks"))
    return by_chapter.groupBy("book_id").agg(F.sum("words").alias("words"), F.count("*").alias("chapters"), F.sum("chunks").alias("chunks"))


@query("j03_book_with_progress", cte("books", "progress") + " SELECT b.book_id, title, user_id, coalesce(current_chapter, 1) AS current_chapter, coalesce(minutes, 0) AS minutes FROM books b LEFT JOIN progress p USING (book_id)")
def j03(spark, folder):
    joined = frame(spark, folder, "books").join(frame(spark, folder, "progress"), "book_id", "left")
    return joined.select("book_id", "title", "user_id", F.coalesce("current_chapter", F.lit(1)).alias("current_chapter"), F.coalesce("minutes", F.lit(0)).alias("minutes"))


LATEST = ", latest AS (SELECT user_id, arg_max(book_id, (last_read_at, progress_id)) AS book_id, max(last_read_at) AS last_read_at FROM progress GROUP BY user_id)"


@query("j05_latest_book", cte("users", "progress", "books") + LATEST + " SELECT u.user_id, coalesce(l.book_id, (SELECT min(book_id) FROM books)) AS book_id, last_read_at FROM users u LEFT JOIN latest l USING (user_id)")
def j05(spark, folder):
    latest = frame(spark, folder, "progress").groupBy("user_id").agg(F.max_by("book_id", F.struct("last_read_at", "progress_id")).alias("book_id"), F.max("last_read_at").alias("last_read_at"))
    first = frame(spark, folder, "books").agg(F.min("book_id").alias("first_book"))
    return frame(spark, folder, "users").select("user_id").join(latest, "user_id", "left").crossJoin(F.broadcast(first)).select("user_id", F.coalesce("book_id", "first_book").alias("book_id"), "last_read_at")


@query("j04_o10_library_by_last_read", cte("books", "progress") + ", p AS (SELECT book_id, max(last_read_at) AS last_read_at FROM progress GROUP BY 1) SELECT b.book_id, title, last_read_at FROM books b LEFT JOIN p USING (book_id) ORDER BY last_read_at DESC NULLS LAST, b.book_id")
def j04(spark, folder):
    p = frame(spark, folder, "progress").groupBy("book_id").agg(F.max("last_read_at").alias("last_read_at"))
    return frame(spark, folder, "books").join(p, "book_id", "left").select("book_id", "title", "last_read_at").orderBy(F.desc_nulls_last("last_read_at"), "book_id")


@query("o02_progress_newest_first", cte("progress") + " SELECT progress_id, book_id, last_read_at FROM progress WHERE user_id = 9 ORDER BY last_read_at DESC, progress_id")
def o02(spark, folder):
    return frame(spark, folder, "progress").where("user_id = 9").select("progress_id", "book_id", "last_read_at").orderBy(F.desc("last_read_at"), "progress_id")


@query("o05_logs_page", cte("reading_logs") + " SELECT log_id, ts FROM reading_logs WHERE user_id = 8 ORDER BY ts DESC, log_id LIMIT 20 OFFSET 10")
def o05(spark, folder):
    return logs(spark, folder).where("user_id = 8").orderBy(F.desc("ts"), "log_id").offset(10).limit(20).select("log_id", "ts")


@query("f20_f26_time_since_reading", cte("reading_logs") + f", l AS (SELECT user_id, max(ts) AS last FROM reading_logs GROUP BY 1) SELECT user_id, round({MINUTES.format(a='last', b=f'TIMESTAMP {NOW!r}')}, 4) AS since, greatest(0.0, least(60.0, round({MINUTES.format(a='last', b=f'TIMESTAMP {NOW!r}')}, 4))) AS session FROM l")
def f26(spark, folder):
    now = F.lit(NOW).cast("timestamp_ntz")
    last = logs(spark, folder).groupBy("user_id").agg(F.max("ts").alias("last"))
    return last.select("user_id", F.round(R.minutes_between(F.col("last"), now), 4).alias("since"), R.session_estimate(F.col("last"), now).alias("session"))


@query("f21_relative_days", cte("reading_logs") + f", d AS (SELECT log_id, ts, floor({MINUTES.format(a='ts', b=f'TIMESTAMP {NOW!r}')} / 1440) AS days FROM reading_logs) SELECT CASE WHEN days = 0 THEN 'Today' WHEN days = 1 THEN 'Yesterday' WHEN days < 7 THEN dayname(ts) ELSE strftime(ts, '%Y-%m-%d') END AS label, count(*) AS n FROM d GROUP BY 1")
def f21(spark, folder):
    return logs(spark, folder).groupBy(R.relative_day(F.col("ts"), F.lit(NOW).cast("timestamp_ntz")).alias("label")).agg(F.count("*").alias("n"))


@query("f22_readable_minutes", cte("progress") + ", m AS (SELECT DISTINCT minutes / 3 AS m FROM progress), r AS (SELECT m, CAST(round(m) AS BIGINT) AS w FROM m) SELECT round(m, 6) AS m, CASE WHEN m < 1 THEN '< 1m' WHEN w < 60 THEN w || 'm' WHEN w % 60 = 0 THEN (w // 60) || 'h' ELSE (w // 60) || 'h ' || (w % 60) || 'm' END AS label FROM r")
def f22(spark, folder):
    m = frame(spark, folder, "progress").select((F.col("minutes") / 3).alias("m")).distinct()
    return m.select(F.round("m", 6).alias("m"), R.readable_minutes(F.col("m")).alias("label"))


@query("w16_changes_only", cte("reading_logs") + ", l AS (SELECT *, lag(chunk_index) OVER (PARTITION BY user_id, book_id, chapter_number ORDER BY ts, log_id) AS prev FROM reading_logs) SELECT log_id, user_id, chunk_index FROM l WHERE chunk_index IS DISTINCT FROM prev")
def w16(spark, folder):
    return R.changes_only(logs(spark, folder)).select("log_id", "user_id", "chunk_index")


@query("t04_debounced_positions", cte("reading_logs") + ", " + sessionized_sql("user_id, book_id", "2000000") + " SELECT user_id, book_id, session, max(ts) AS ts, arg_max(chapter_number, (ts, log_id)) AS chapter_number, arg_max(chunk_index, (ts, log_id)) AS chunk_index FROM s2 GROUP BY ALL")
def t04(spark, folder):
    return R.debounced(logs(spark, folder))


@query("t03_active_minutes", cte("reading_logs") + ", g AS (SELECT user_id, (epoch_us(lead(ts) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, log_id)) - epoch_us(ts)) / 1000000 AS gap FROM reading_logs) SELECT user_id, round(sum(CASE WHEN gap < 600 THEN gap ELSE 0 END) / 60, 4) AS minutes FROM g GROUP BY user_id")
def t03(spark, folder):
    return R.active_minutes(logs(spark, folder), 600)


SAVES = "e AS (SELECT event_id AS log_id, user_id, ts, event_type FROM events)"


@query("t03_saved_minutes", "WITH " + SAVES + ", g AS (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1000000 AS gap FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, log_id)), s AS (SELECT *, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS save FROM g), p AS (SELECT *, sum(save) OVER (PARTITION BY user_id ORDER BY ts, log_id ROWS UNBOUNDED PRECEDING) - save AS span FROM s), t AS (SELECT *, round(sum(CASE WHEN gap < 900 THEN gap ELSE 0 END) OVER (PARTITION BY user_id, span), 3) AS seconds FROM p) SELECT log_id, user_id, seconds, CAST(round(seconds / 60) AS BIGINT) AS minutes FROM t WHERE save = 1")
def t03_saved(spark, folder):
    e = spark.read.parquet(f"{folder}/events.parquet").select(F.col("event_id").alias("log_id"), "user_id", "ts", F.when(F.col("event_type") == "purchase", "saved").otherwise(F.col("event_type")).alias("event_type"))
    return R.saved_minutes(e, 900)


@query("t06_cache_states", cte("reading_logs") + f", a AS (SELECT log_id, epoch(TIMESTAMP {NOW!r}) - epoch(ts) AS age FROM reading_logs) SELECT log_id, CASE WHEN age < 86400 THEN 'fresh' WHEN age <= 7 * 86400 THEN 'stale' ELSE 'expired' END AS state FROM a")
def t06(spark, folder):
    age = R.minutes_between(F.col("ts"), F.lit(NOW).cast("timestamp_ntz")) * 60
    return logs(spark, folder).select("log_id", F.when(age < 86400, "fresh").when(age <= 7 * 86400, "stale").otherwise("expired").alias("state"))


@query("w07_text_index", cte("chunk_rows") + ", " + CHUNKS + " SELECT book_id, chapter_number, chunk_index, CAST(row_number() OVER (PARTITION BY book_id, chapter_number ORDER BY chunk_index) AS INT) - 1 AS text_index FROM chunks WHERE type = 'text'")
def w07(spark, folder):
    w = Window.partitionBy("book_id", "chapter_number").orderBy("chunk_index")
    return chunks(spark, folder).where("type = 'text'").select("book_id", "chapter_number", "chunk_index", (F.row_number().over(w) - 1).alias("text_index"))


@query("w08_previous_chunks", cte("chunk_rows") + ", " + CHUNKS + " SELECT book_id, chapter_number, chunk_index, coalesce(string_agg(CAST(word_count AS VARCHAR), ' ') OVER (PARTITION BY book_id, chapter_number ORDER BY chunk_index ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS context FROM chunks WHERE type = 'text'")
def w08(spark, folder):
    w = Window.partitionBy("book_id", "chapter_number").orderBy("chunk_index").rowsBetween(-3, -1)
    return chunks(spark, folder).where("type = 'text'").select("book_id", "chapter_number", "chunk_index", F.array_join(F.collect_list(F.col("word_count").cast("string")).over(w), " ").alias("context"))


@query("w09_last_messages", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 4")
def w09(spark, folder):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role").withColumn("n", F.row_number().over(w)).where("n <= 4").drop("n")


@query("w11_running_chunk_ids", cte("chunk_rows") + ", " + CHUNKS + " SELECT book_id, chapter_number, chunk_index, CAST(row_number() OVER (PARTITION BY book_id ORDER BY chapter_number, chunk_index) AS INT) AS chunk_id FROM chunks")
def w11(spark, folder):
    return R.running_ids(chunks(spark, folder)).select("book_id", "chapter_number", "chunk_index", "chunk_id")


@query("w12_estimated_pages", cte("chunk_rows") + ", " + CHUNKS + ", n AS (SELECT *, count(*) OVER (PARTITION BY book_id, chapter_number) AS n, chapter_number + 1 AS pages FROM chunks) SELECT book_id, chapter_number, chunk_index, CAST(chapter_number * 10 + least(pages - 1, floor(chunk_index / ceil(n / pages))) AS BIGINT) AS page FROM n")
def w12(spark, folder):
    n, pages = F.count("*").over(Window.partitionBy("book_id", "chapter_number")), F.col("chapter_number") + 1
    page = F.col("chapter_number") * 10 + F.least(pages - 1, F.floor(F.col("chunk_index") / F.ceil(n / pages)))
    return chunks(spark, folder).select("book_id", "chapter_number", "chunk_index", page.cast("long").alias("page"))


@query("w13_word_offsets", cte("chunk_rows") + ", " + CHUNKS + ", s AS (SELECT *, CAST(sum(word_count) OVER (PARTITION BY book_id, chapter_number ORDER BY chunk_index ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM chunks) SELECT book_id, chapter_number, chunk_index, upto - word_count AS start_word, upto - 1 AS end_word FROM s")
def w13(spark, folder):
    upto = F.sum("word_count").over(Window.partitionBy("book_id", "chapter_number").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, 0))
    return chunks(spark, folder).select("book_id", "chapter_number", "chunk_index", (upto - F.col("word_count")).alias("start_word"), (upto - 1).alias("end_word"))


@query("w03_chapter_ends", cte("chunk_rows") + ", c AS (SELECT book_id, chapter_number, chapter_number * 12 - 5 AS start_page FROM chunk_rows GROUP BY ALL) SELECT book_id, chapter_number, start_page, coalesce(lead(start_page) OVER (PARTITION BY book_id ORDER BY start_page) - 1, 120) AS end_page FROM c")
def w03(spark, folder):
    c = frame(spark, folder, "chunk_rows").select("book_id", "chapter_number").distinct().withColumn("start_page", F.col("chapter_number") * 12 - 5)
    return c.withColumn("end_page", F.coalesce(F.lead("start_page").over(Window.partitionBy("book_id").orderBy("start_page")) - 1, F.lit(120)))


@query("a21_chapter_pages", cte("chunk_rows") + " SELECT book_id, chapter_number, min(line % 50) AS first_page, max(line % 50) AS last_page, string_agg(DISTINCT CAST(line % 50 AS VARCHAR), ',' ORDER BY CAST(line % 50 AS VARCHAR)) AS pages FROM chunk_rows GROUP BY ALL")
def a21(spark, folder):
    page = F.col("line") % 50
    return frame(spark, folder, "chunk_rows").groupBy("book_id", "chapter_number").agg(F.min(page).alias("first_page"), F.max(page).alias("last_page"), F.array_join(F.sort_array(F.collect_set(page.cast("string"))), ",").alias("pages"))


@query("w17_oldest_evicted", cte("chunk_rows") + ", o AS (SELECT line, side, chapter_number, word_count, coalesce(sum(word_count) OVER (PARTITION BY book_id ORDER BY line, side, size_points ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed, sum(word_count) OVER (PARTITION BY book_id) AS total, book_id FROM chunk_rows) SELECT book_id, line, side, chapter_number FROM o WHERE freed < 0.25 * total")
def w17(spark, folder):
    w = Window.partitionBy("book_id")
    freed = F.coalesce(F.sum("word_count").over(w.orderBy("line", "side", "size_points").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return frame(spark, folder, "chunk_rows").withColumn("freed", freed).withColumn("total", F.sum("word_count").over(w)).where(F.col("freed") < 0.25 * F.col("total")).select("book_id", "line", "side", "chapter_number")


@query("w04_word_durations", cte("reading_logs") + ", m AS (SELECT user_id, log_id, epoch_us(ts) / 1000000 / 3600 AS mark FROM reading_logs), l AS (SELECT *, lead(mark) OVER (PARTITION BY user_id ORDER BY mark, log_id) - mark AS gap FROM m) SELECT log_id, round(greatest(0.2, least(2.0, coalesce(gap, 0.8))), 6) AS seconds FROM l")
def w04(spark, folder):
    mark = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000 / 3600
    marks = logs(spark, folder).select("user_id", "log_id", mark.alias("mark"))
    return marks.select("log_id", F.round(word_seconds(F.col("mark"), Window.partitionBy("user_id").orderBy("mark", "log_id")), 6).alias("seconds"))


def word_seconds(mark, w):
    """Time to the next mark, 0.8 for the last, between 0.2 and 2."""
    return F.greatest(F.lit(0.2), F.least(F.lit(2.0), F.coalesce(F.lead(mark).over(w) - mark, F.lit(0.8))))
