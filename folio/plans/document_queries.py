"""Queries of chapters and outlines, and of what the other modules leave open."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators import catalog, documents, usage
from folio.plans import chunk_sql
from folio.plans.base import cte, frame
from folio.plans.reading_queries import CHUNKS, chunks
from folio.plans.registry import query
from folio.plans.text_queries import LINES, docs, lines

OUTLINE = "outline AS (SELECT p_partkey AS id, CASE WHEN p_partkey >= 10 THEN p_partkey // 4 END AS parent, CASE WHEN p_partkey = 7 THEN 'Contents' ELSE p_name END AS title, p_partkey % 4 AS pos FROM part)"


@query("x10_outline", "WITH RECURSIVE " + OUTLINE + """, tree(id, title, depth, path) AS (SELECT id, title, 0, lpad(CAST(pos AS VARCHAR), 19, '0') FROM outline WHERE parent IS NULL AND lower(title) <> 'contents'
 UNION ALL SELECT o.id, o.title, t.depth + 1, t.path || '.' || lpad(CAST(o.pos AS VARCHAR), 19, '0') FROM outline o JOIN tree t ON o.parent = t.id WHERE lower(o.title) <> 'contents') SELECT * FROM tree""")
def x10(spark, folder):
    k = F.col("p_partkey")
    outline = spark.read.parquet(f"{folder}/part.parquet").select(k.alias("id"), F.when(k >= 10, F.floor(k / 4)).alias("parent"), F.when(k == 7, "Contents").otherwise(F.col("p_name")).alias("title"), (k % 4).alias("pos"))
    return documents.outline_paths(outline)


SHAPE = """regexp_matches(trim(text), '^(?i:chapter)\\s+\\w+|^\\d+[.:]\\s+\\S|^[A-Za-z][A-Za-z\\s]{4,}$') AND NOT regexp_matches(trim(text), '^(?i:page\\s+)?\\d+$') AND NOT regexp_matches(trim(text), '(?i)^(?:isbn|copyright|typeset|printed|published|all rights|first published|volume)')
 AND length(trim(text)) BETWEEN 5 AND 50 AND NOT regexp_matches(trim(text), '[,;]|(?:of|the|and)$') AND NOT regexp_matches(trim(text), '(?i)\\(\\w+,|\\d{4}\\)|press|oxford|university|journal')"""


@query("p16_chapter_lines", "WITH " + LINES + f" SELECT doc_id, line FROM lines WHERE {SHAPE}")
def p16(spark, folder):
    return lines(spark, folder).where(documents.chapter_line(F.col("text"))).select("doc_id", "line")


SECTIONS_OF_LINES = f"""m AS (SELECT doc_id, line, text, {SHAPE} AS h FROM lines), s AS (SELECT *, sum(CASE WHEN h THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS chapter FROM m),
 p AS (SELECT doc_id, CAST(chapter AS BIGINT) AS chapter, max(CASE WHEN h THEN trim(text) END) AS title, CAST(sum(CASE WHEN h THEN 0 ELSE length(text) END) AS BIGINT) AS chars FROM s WHERE chapter > 0 GROUP BY doc_id, chapter HAVING sum(CASE WHEN h THEN 0 ELSE length(text) END) > 200),
 sections AS (SELECT * FROM p UNION ALL SELECT doc_id, 0, 'Full Text', CAST(sum(length(text)) AS BIGINT) FROM lines WHERE doc_id NOT IN (SELECT doc_id FROM p) GROUP BY doc_id)"""
SECTIONS = LINES + ", " + SECTIONS_OF_LINES


@query("x15_chapters_by_pattern", "WITH " + SECTIONS + " SELECT * FROM sections")
def x15(spark, folder):
    return documents.sections(lines(spark, folder), documents.chapter_line(F.col("text")))


TOC = "toc AS (SELECT DISTINCT conv_id AS doc_id, turn // 3 AS chapter, turn // 3 * 3 AS start_page FROM conversations WHERE conv_id % 2 = 0), pages_ AS (SELECT conv_id AS doc_id, turn AS page, text FROM conversations)"
BY_TOC = TOC + ", t AS (SELECT p.doc_id, page // 3 AS chapter, min(page) AS first_page, max(page) AS last_page, count(*) AS pages, CAST(sum(length(text)) + count(*) - 1 AS BIGINT) AS chars FROM pages_ p WHERE p.doc_id % 2 = 0 AND length(text) > 50 GROUP BY p.doc_id, page // 3)"


def contents(spark, folder):
    c = spark.read.parquet(f"{folder}/conversations.parquet")
    toc = c.where("conv_id % 2 = 0").select(F.col("conv_id").alias("doc_id"), F.floor(F.col("turn") / 3).alias("chapter")).distinct().withColumn("start_page", F.col("chapter") * 3)
    done = documents.chapters_of_contents(toc, c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text"))
    return done.select("doc_id", "chapter", "first_page", "last_page", "pages", F.char_length("text").cast("long").alias("chars"))


@query("x17_chapters_by_contents", "WITH " + BY_TOC + " SELECT * FROM t")
def x17(spark, folder):
    return contents(spark, folder)


@query("x22_buffered_sentences", chunk_sql.X22)
def x22(spark, folder):
    return documents.buffered_sentences(docs(spark, folder), "doc_id", "text")


@query("x23_parts_between_markers", cte("users") + "SELECT user_id, CAST(unnest([0, 1]) AS INT) AS nth, unnest(['ONE ' || segment || ' ', 'TWO ' || username]) AS text FROM users")
def x23(spark, folder):
    text = F.concat(F.lit("before ONE "), F.col("segment"), F.lit(" TWO "), F.col("username"))
    parts = frame(spark, folder, "users").select("user_id", F.posexplode(documents.split_at(text, ["TWO ", "ONE ", "THREE "])).alias("nth", "p"))
    return parts.select("user_id", "nth", F.col("p.text").alias("text"))


@query("x09_without_heading", cte("books") + "SELECT book_id, 'Xy ' || description || ' and more than ten letters' AS text FROM books")
def x09(spark, folder):
    raw = F.concat(F.lit("X "), F.upper("title"), F.lit("y "), F.col("description"), F.lit(" and more than ten letters"))
    return frame(spark, folder, "books").select("book_id", documents.without_heading(raw, F.col("title")).alias("text"))


@query("x07_sentences_that_go_on", "WITH " + LINES + ", l AS (SELECT doc_id, line, trim(split_part(text, '. ', 1)) AS a, lower(trim(lead(text) OVER (PARTITION BY doc_id ORDER BY line))) AS b FROM lines) SELECT doc_id, line FROM l WHERE length(a) > 0 AND length(b) > 0 AND regexp_matches(b, '^[a-z]') AND NOT regexp_matches(a, '[.!?;:]$')")
def x07(spark, folder):
    after = F.lead("text").over(Window.partitionBy("doc_id").orderBy("line"))
    pairs = lines(spark, folder).withColumn("after", after)
    first, second = F.substring_index("text", ". ", 1), F.lower("after")
    return pairs.where(documents.goes_on(first, second) & ~F.trim(first).endswith(".")).select("doc_id", "line")


@query("x01_sentences", chunk_sql.X01)
def x01(spark, folder):
    worded = docs(spark, folder).select("doc_id", T.words("text").alias("w"))
    return worded.select("doc_id", F.posexplode(T.sentences(F.col("w"))).alias("nth", "s")).select("doc_id", "nth", "s.start", "s.words", "s.text")


@query("p11_text_chunks", cte("chunk_rows") + "SELECT book_id, chapter_number, count(*) FILTER (type = 'text') AS texts FROM chunk_rows GROUP BY ALL")
def p11(spark, folder):
    nested = frame(spark, folder, "chunk_rows").groupBy("book_id", "chapter_number").agg(F.collect_list(F.struct("type", "line")).alias("chunks"))
    return nested.select("book_id", "chapter_number", F.size(F.filter("chunks", lambda c: c["type"] == "text")).cast("long").alias("texts"))


@query("a26_chunk_counts", cte("chunk_rows") + "SELECT book_id, count(*) AS chunks, count(*) FILTER (type = 'image') AS images FROM chunk_rows GROUP BY 1")
def a26(spark, folder):
    return frame(spark, folder, "chunk_rows").groupBy("book_id").agg(F.count("*").alias("chunks"), F.count_if(F.col("type") == "image").alias("images"))


@query("j21_markers_without_prefix", cte("users", "books") + "SELECT DISTINCT segment AS folder FROM users WHERE segment NOT IN (SELECT description FROM books)")
def j21(spark, folder):
    prefixes = frame(spark, folder, "books").select(F.col("description").alias("folder"))
    return catalog.deleted(frame(spark, folder, "users").select(F.col("segment").alias("folder")).distinct(), prefixes, ["folder"])


@query("o13_o14_first_positions", cte("chunk_rows") + ", " + CHUNKS + " SELECT book_id, arg_min(word_count, (chapter_number, chunk_index)) AS first_words, max(chapter_number) AS last_chapter FROM chunks GROUP BY 1 ORDER BY 1")
def o14(spark, folder):
    first = F.min_by("word_count", F.struct("chapter_number", "chunk_index"))
    return chunks(spark, folder).groupBy("book_id").agg(first.alias("first_words"), F.max("chapter_number").alias("last_chapter")).orderBy("book_id")


@query("f06_joined_texts", cte("chunk_rows") + ", " + CHUNKS + " SELECT book_id, string_agg(type || ':' || word_count, ' ' ORDER BY chapter_number, chunk_index) AS joined FROM chunks GROUP BY 1")
def f06(spark, folder):
    rows = F.array_sort(F.collect_list(F.struct("chapter_number", "chunk_index", F.concat_ws(":", "type", F.col("word_count").cast("string")).alias("t"))))
    return chunks(spark, folder).groupBy("book_id").agg(F.array_join(F.transform(rows, lambda r: r["t"]), " ").alias("joined"))


@query("f12_folded_titles", cte("books") + "SELECT book_id, title AS folded FROM books")
def f12(spark, folder):
    raw = F.concat(F.lit("  "), F.regexp_replace("title", " ", "  "), F.lit("   xii "))
    return frame(spark, folder, "books").select("book_id", T.folded(raw).alias("folded"))


@query("f24_percentages", cte("progress") + "SELECT progress_id, CASE WHEN current_chunk > 0 THEN CAST(round(100 * current_chapter / current_chunk) AS BIGINT) ELSE 0 END AS percent FROM progress")
def f24(spark, folder):
    from folio.operators.reading import percent

    return frame(spark, folder, "progress").select("progress_id", percent(F.col("current_chapter"), F.col("current_chunk")).alias("percent"))


VOICE_NAME = "CASE usage_id % 7 WHEN 0 THEN 'Danielle' WHEN 1 THEN 'Ivy' WHEN 2 THEN 'Amy' WHEN 3 THEN 'Nobody' WHEN 4 THEN 'en-US-Neural2-C' WHEN 5 THEN 'en-GB-Wavenet-A' ELSE 'Stephen' END"


@query("f33_voice_classes", cte("tts_usage") + f", v AS (SELECT provider, {VOICE_NAME} AS voice_id FROM tts_usage) SELECT provider, voice_id, CASE WHEN provider = 'polly' AND voice_id IN ('Danielle', 'Gregory', 'Burrow') THEN 'long-form' WHEN provider = 'polly' AND voice_id IN ('Emma', 'Olivia', 'Aria', 'Ayanda', 'Ivy') THEN 'neural' WHEN provider = 'google' AND contains(voice_id, 'Neural2') THEN 'neural' ELSE 'standard' END AS tier, count(*) AS n FROM v GROUP BY ALL")
def f33(spark, folder):
    voices = frame(spark, folder, "tts_usage").select("provider", F.expr(VOICE_NAME).alias("voice_id"))
    return voices.groupBy("provider", "voice_id", usage.voice_class(F.col("provider"), F.col("voice_id")).alias("tier")).agg(F.count("*").alias("n"))


@query("f42_k02_generated_ids", "SELECT count(*) AS n, count(*) AS different, count(*) AS well_formed, true AS stamped FROM orders")
def f42(spark, folder):
    rows = catalog.stamped(spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey"), F.current_timestamp())
    form = F.col("id").rlike(r"^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\z")
    return rows.agg(F.count("*").alias("n"), F.count_distinct("id").alias("different"), F.count_if(form).alias("well_formed"), F.every(F.col("created_at") == F.col("updated_at")).alias("stamped"))


@query("f46_footnote_patterns", cte("images") + "SELECT image_id, CASE WHEN length(CAST(image_id * 37 AS VARCHAR)) <= 3 THEN '(^|\\s)' || image_id * 37 || '(\\.|\\s|$)' ELSE CAST(image_id * 37 AS VARCHAR) END AS pattern FROM images")
def f46(spark, folder):
    return frame(spark, folder, "images").select("image_id", T.footnote_pattern((F.col("image_id") * 37).cast("string")).alias("pattern"))


@query("k07_appended_history", cte("reading_logs") + "SELECT user_id, string_agg(CAST(log_id AS VARCHAR), ',' ORDER BY log_id % 2, log_id) AS history FROM reading_logs GROUP BY 1")
def k07(spark, folder):
    logs = frame(spark, folder, "reading_logs")
    history = logs.select("user_id").distinct().join(logs.where("log_id % 2 = 0").groupBy("user_id").agg(F.array_sort(F.collect_list("log_id")).alias("history")), "user_id", "left")
    done = catalog.pushed(history, logs.where("log_id % 2 = 1").select("user_id", F.col("log_id").alias("entry")), "user_id", "history")
    return done.select("user_id", F.array_join("history", ",").alias("history"))


@query("k14_settings_reset", cte("settings") + "SELECT user_id, CASE WHEN user_id % 3 = 0 THEN 1.0 ELSE CAST(playback_speed AS DOUBLE) END AS playback_speed, voice_id, CASE WHEN user_id % 3 = 0 THEN 'light' ELSE theme END AS theme FROM settings")
def k14(spark, folder):
    settings = frame(spark, folder, "settings").withColumn("playback_speed", F.col("playback_speed").cast("double"))
    asked = settings.where("user_id % 3 = 0")
    return catalog.updated(settings, catalog.reset(asked, {"playback_speed": 1.0, "theme": "light"}).select("user_id", "playback_speed", "theme"), ["user_id"])


@query("s18_values_with_defaults", cte("users", "settings") + "SELECT user_id, coalesce(s.theme, 'light') AS theme FROM users LEFT JOIN settings s USING (user_id)")
def s18(spark, folder):
    return catalog.with_defaults(frame(spark, folder, "users"), frame(spark, folder, "settings").select("user_id", "theme"), "user_id", {"theme": "light"})


@query("t05_streamed_words", "SELECT event_id, CAST(floor(value / 10) AS BIGINT) AS word FROM events")
def t05(spark, folder):
    from folio.streaming import logs as S

    path = f"{folder}/events.parquet"
    stream = S.stream_of(spark, path, spark.read.parquet(path))
    slots = spark.read.parquet(path).select(F.floor(F.col("value") / 10).alias("slot")).distinct()
    marks = slots.select(F.col("slot").alias("word"), (F.col("slot") * 10).cast("double").alias("low"), (F.col("slot") * 10 + 10).cast("double").alias("high"), "slot")
    # each word's interval is found by its slot, so the stream is joined by equality
    met = stream.withColumn("slot", F.floor(F.col("value") / 10)).join(marks, "slot").where((F.col("value") >= F.col("low")) & (F.col("value") < F.col("high")))
    return S.run_once(met.select("event_id", "word"), "append").select("event_id", "word")
