"""Queries of the catalog, and changes of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.operators import catalog as C
from folio.plans.base import cte, frame
from folio.plans.reading_queries import CHAPTERS, chapters
from folio.plans.registry import query
from folio.sources.files import shared_path
from folio.sources.tables import BucketTable, cascaded_delete

POSITION = ["user_id", "book_id", "chapter_number", "chunk_index"]


@query("s03_lookup_by_key", cte("books") + "SELECT book_id, title, author FROM books WHERE book_id = 42")
def s03(spark, folder):
    return frame(spark, folder, "books").where("book_id = 42").limit(1).select("book_id", "title", "author")


@query("s04_lookup_by_keys", cte("bookmarks") + "SELECT min(bookmark_id) AS bookmark_id FROM bookmarks WHERE user_id = 8 AND chapter_number = 2 AND book_id = 6")
def s04(spark, folder):
    return frame(spark, folder, "bookmarks").where("user_id = 8 AND chapter_number = 2 AND book_id = 6").agg(F.min("bookmark_id").alias("bookmark_id"))


@query("s05_lookup_by_name", cte("users") + "SELECT user_id, username FROM users WHERE username = 'customer#000000012'")
def s05(spark, folder):
    return frame(spark, folder, "users").where("username = 'customer#000000012'").select("user_id", "username")


@query("p01_book_cards", cte("books") + "SELECT CAST(book_id AS VARCHAR) AS id, title, coalesce(chapter_start_number, 1) AS chapter_start_number FROM books")
def p01(spark, folder):
    return frame(spark, folder, "books").select(F.col("book_id").cast("string").alias("id"), "title", F.coalesce("chapter_start_number", F.lit(1)).alias("chapter_start_number"))


@query("p02_without_balance", cte("users") + "SELECT user_id, username, segment, nation_id FROM users")
def p02(spark, folder):
    return frame(spark, folder, "users").drop("balance")


@query("p03_renamed_settings", cte("settings") + "SELECT user_id, coalesce(nullif(voice_id, ''), 'Joanna') AS selected_voice, coalesce(nullif(theme, ''), 'light') AS theme FROM settings")
def p03(spark, folder):
    return frame(spark, folder, "settings").select("user_id", F.coalesce(F.nullif("voice_id", F.lit("")), F.lit("Joanna")).alias("selected_voice"), F.coalesce(F.nullif("theme", F.lit("")), F.lit("light")).alias("theme"))


@query("p06_search", cte("books") + "SELECT book_id, title FROM books WHERE is_public AND (regexp_matches(coalesce(title, ''), '(?i)ring|BOLT') OR regexp_matches(coalesce(author, ''), '(?i)ring|BOLT') OR regexp_matches(coalesce(description, ''), '(?i)ring|BOLT'))")
def p06(spark, folder):
    return frame(spark, folder, "books").where(F.col("is_public") & C.found_by("ring|BOLT", "title", "author", "description")).select("book_id", "title")


@query("p07_filter_from_dict", cte("books") + "SELECT book_id FROM books WHERE author IS NULL AND description IN ('ECONOMY', 'SMALL') AND regexp_matches(title, '(?i)WIDGET')")
def p07(spark, folder):
    return frame(spark, folder, "books").where(C.matching({"author": None, "description": ["ECONOMY", "SMALL"], "title": ("~", "WIDGET")})).select("book_id")


@query("p08_others_of_the_name", cte("books") + "SELECT b.book_id FROM books b WHERE b.title = (SELECT title FROM books WHERE book_id = 3) AND b.book_id <> 3")
def p08(spark, folder):
    books = frame(spark, folder, "books")
    mine = books.where("book_id = 3").select("title")
    return books.where("book_id <> 3").join(F.broadcast(mine), "title", "left_semi").select("book_id")


@query("p09_missing_field", cte("books") + "SELECT count(*) FILTER (chapter_start_number IS NULL) AS missing, count(*) FILTER (chapter_start_number IS NOT NULL) AS present FROM books")
def p09(spark, folder):
    return frame(spark, folder, "books").agg(F.count_if(F.col("chapter_start_number").isNull()).alias("missing"), F.count_if(F.col("chapter_start_number").isNotNull()).alias("present"))


@query("p10_readable_books", cte("books") + "SELECT book_id FROM books WHERE is_public OR uploaded_by = 6")
def p10(spark, folder):
    return frame(spark, folder, "books").where(C.readable_by(6)).select("book_id")


@query("p22_id_format", cte("users") + "SELECT username, regexp_full_match(md5(username), '[0-9a-fA-F]{24}') AS whole, regexp_full_match(substr(md5(username), 1, 24), '[0-9a-fA-F]{24}') AS cut FROM users")
def p22(spark, folder):
    is_id = lambda c: c.rlike(r"^[0-9a-fA-F]{24}\z")
    h = F.md5(F.col("username").cast("binary"))
    return frame(spark, folder, "users").select("username", is_id(h).alias("whole"), is_id(F.substring(h, 1, 24)).alias("cut"))


@query("o03_bookmarks_in_order", cte("bookmarks") + "SELECT DISTINCT user_id, book_id, chapter_number, chunk_index FROM bookmarks ORDER BY 1, 2, 3, 4")
def o03(spark, folder):
    return frame(spark, folder, "bookmarks").select(*POSITION).distinct().orderBy(*POSITION)


@query("o04_chapters_in_order", cte("chunk_rows") + ", " + CHAPTERS + " SELECT chapter_number, chapter_words FROM chapters WHERE book_id = 17 ORDER BY chapter_number")
def o04(spark, folder):
    return chapters(spark, folder).where("book_id = 17").select("chapter_number", "chapter_words").orderBy("chapter_number")


@query("o07_first_books", cte("books") + "SELECT book_id, title FROM books WHERE is_public ORDER BY book_id LIMIT 50")
def o07(spark, folder):
    return C.page(frame(spark, folder, "books").where("is_public"), ["book_id"], limit=50).select("book_id", "title")


@query("o10_titles_in_order", cte("books") + "SELECT book_id, title FROM books ORDER BY title, book_id LIMIT 100")
def o10(spark, folder):
    return frame(spark, folder, "books").select("book_id", "title").orderBy(F.collate("title", "UNICODE"), "book_id").limit(100)


@query("o15_first_chapters", cte("chunk_rows") + ", " + CHAPTERS + " SELECT book_id, min(chapter_number) AS first FROM chapters GROUP BY 1")
def o15(spark, folder):
    return chapters(spark, folder).groupBy("book_id").agg(F.min("chapter_number").alias("first"))


@query("u01_public_then_own", cte("books") + ", p AS (SELECT book_id, title FROM books WHERE is_public ORDER BY book_id LIMIT 50), b AS (SELECT *, 0 AS part FROM p UNION ALL SELECT book_id, title, 1 FROM books WHERE uploaded_by = 6) SELECT book_id, arg_min(title, part) AS title FROM b GROUP BY book_id ORDER BY min(part), book_id LIMIT 80")
def u01(spark, folder):
    return C.public_then_own(frame(spark, folder, "books").select("book_id", "title", "is_public", "uploaded_by"), 6, 50, 80).select("book_id", "title")


@query("u02_union_all", cte("bookmarks", "tts_errors") + "SELECT user_id, created_at AS ts FROM bookmarks UNION ALL SELECT user_id, ts FROM tts_errors")
def u02(spark, folder):
    return frame(spark, folder, "bookmarks").select("user_id", F.col("created_at").alias("ts")).unionAll(frame(spark, folder, "tts_errors").select("user_id", "ts"))


@query("u03_distinct", cte("bookmarks") + "SELECT DISTINCT book_id, chapter_number FROM bookmarks")
def u03(spark, folder):
    return frame(spark, folder, "bookmarks").select("book_id", "chapter_number").distinct()


@query("u04_removed_by_key", cte("books", "bookmarks") + "SELECT book_id FROM books WHERE book_id NOT IN (SELECT book_id FROM bookmarks)")
def u04(spark, folder):
    return C.deleted(frame(spark, folder, "books"), frame(spark, folder, "bookmarks"), ["book_id"]).select("book_id")


NEW_MARKS = ", n AS (SELECT DISTINCT user_id, book_id, chapter_number, chunk_index FROM reading_logs WHERE log_id % 5 = 0), t AS (SELECT DISTINCT user_id, book_id, chapter_number, chunk_index FROM bookmarks)"


def marks(spark, folder):
    return frame(spark, folder, "bookmarks").select(*POSITION).distinct(), frame(spark, folder, "reading_logs").where("log_id % 5 = 0").select(*POSITION).distinct()


@query("k11_j17_guarded_insert", cte("bookmarks", "reading_logs") + NEW_MARKS + " SELECT * FROM t UNION SELECT * FROM n")
def k11(spark, folder):
    table, rows = marks(spark, folder)
    return C.inserted(table, rows, POSITION)


@query("k11_refused", cte("bookmarks", "reading_logs") + NEW_MARKS + " SELECT * FROM n INTERSECT SELECT * FROM t")
def k11_refused(spark, folder):
    table, rows = marks(spark, folder)
    return C.refused(table, rows, POSITION)


@query("k10_toggled_bookmarks", cte("bookmarks", "reading_logs") + NEW_MARKS + " (SELECT * FROM t EXCEPT SELECT * FROM n) UNION ALL (SELECT * FROM n EXCEPT SELECT * FROM t)")
def k10(spark, folder):
    return C.toggled(*marks(spark, folder), POSITION)


@query("j22_bookmarked_logs", cte("bookmarks", "reading_logs") + ", t AS (SELECT DISTINCT user_id, book_id, chapter_number, chunk_index FROM bookmarks) SELECT log_id, (SELECT count(*) FROM t WHERE t.user_id = l.user_id AND t.book_id = l.book_id AND t.chapter_number = l.chapter_number AND t.chunk_index = l.chunk_index) > 0 AS marked FROM reading_logs l")
def j22(spark, folder):
    table, _ = marks(spark, folder)
    joined = frame(spark, folder, "reading_logs").join(table.withColumn("m", F.lit(True)), POSITION, "left")
    return joined.select("log_id", F.coalesce("m", F.lit(False)).alias("marked"))


@query("k05_updated_users", cte("users", "settings") + "SELECT u.user_id, CASE WHEN s.user_id IS NULL THEN u.segment ELSE s.theme END AS segment, username FROM users u LEFT JOIN settings s ON s.user_id = u.user_id")
def k05(spark, folder):
    changes = frame(spark, folder, "settings").select("user_id", F.col("theme").alias("segment"))
    table = BucketTable(spark, shared_path(spark, "users"), ["user_id"]).create(frame(spark, folder, "users").select("user_id", "segment", "username"))
    table.update(changes)
    return table.read()


@query("k06_upserted_positions", cte("progress", "reading_logs") + """, p AS (SELECT user_id, book_id, max(current_chapter) AS current_chapter, max(current_chunk) AS current_chunk, CAST(sum(minutes) AS BIGINT) AS words, max(minutes) AS minutes FROM progress GROUP BY ALL),
 s AS (SELECT user_id, book_id, max(chapter_number) AS c, max(chunk_index) AS k, count(*) AS w, count(*) AS m FROM reading_logs GROUP BY ALL)
 SELECT coalesce(p.user_id, s.user_id) AS user_id, coalesce(p.book_id, s.book_id) AS book_id, coalesce(c, current_chapter) AS current_chapter, coalesce(k, current_chunk) AS current_chunk, coalesce(words, 0) + coalesce(w, 0) AS words, coalesce(minutes, 0) + coalesce(m, 0) AS minutes FROM p FULL JOIN s ON p.user_id = s.user_id AND p.book_id = s.book_id""")
def k06(spark, folder):
    p = frame(spark, folder, "progress").groupBy("user_id", "book_id").agg(F.max("current_chapter").alias("current_chapter"), F.max("current_chunk").alias("current_chunk"), F.sum("minutes").alias("words"), F.max("minutes").alias("minutes"))
    s = frame(spark, folder, "reading_logs").groupBy("user_id", "book_id").agg(F.max("chapter_number").alias("current_chapter"), F.max("chunk_index").alias("current_chunk"), F.count("*").alias("words"), F.count("*").alias("minutes"))
    table = BucketTable(spark, shared_path(spark, "positions"), ["user_id", "book_id"]).create(p)
    table.upsert(s, C.upserted_positions)
    return table.read()


@query("k08_deleted_by_user", cte("bookmarks") + "SELECT bookmark_id FROM bookmarks WHERE user_id NOT IN (3, 5)")
def k08(spark, folder):
    table = BucketTable(spark, shared_path(spark, "bookmarks"), ["bookmark_id"]).create(frame(spark, folder, "bookmarks"))
    table.delete_by(spark.createDataFrame([(3,), (5,)], "user_id long"))
    return table.read().select("bookmark_id")


@query("k09_cascaded_delete", cte("books", "bookmarks", "progress", "reading_logs") + ", gone AS (SELECT book_id FROM books WHERE uploaded_by = 4) SELECT 'books' AS what, count(*) AS n FROM books WHERE book_id NOT IN (SELECT * FROM gone) UNION ALL SELECT 'bookmarks', count(*) FROM bookmarks WHERE book_id NOT IN (SELECT * FROM gone) UNION ALL SELECT 'progress', count(*) FROM progress WHERE book_id NOT IN (SELECT * FROM gone) UNION ALL SELECT 'logs', count(*) FROM reading_logs")
def k09(spark, folder):
    keys = {"books": ["book_id"], "bookmarks": ["bookmark_id"], "progress": ["progress_id"]}
    tables = {n: BucketTable(spark, shared_path(spark, n), k).create(frame(spark, folder, n)) for n, k in keys.items()}
    cascaded_delete(tables["books"], [tables["bookmarks"], tables["progress"]], frame(spark, folder, "books").where("uploaded_by = 4"))
    left = {n: t.read() for n, t in tables.items()} | {"logs": frame(spark, folder, "reading_logs")}
    out = None
    for name, df in left.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
        out = row if out is None else out.unionAll(row)
    return out


@query("k12_settings_with_defaults", cte("users", "settings") + "SELECT user_id, coalesce(playback_speed, 1.0) AS playback_speed, coalesce(nullif(voice_id, ''), 'Joanna') AS voice_id, coalesce(nullif(theme, ''), 'light') AS theme FROM users LEFT JOIN settings USING (user_id)")
def k12(spark, folder):
    return C.with_defaults(frame(spark, folder, "users"), frame(spark, folder, "settings"), "user_id", {"playback_speed": 1.0, "voice_id": "Joanna", "theme": "light"})


@query("k13_partial_settings", cte("settings") + "SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 1.5 ELSE playback_speed END AS playback_speed, theme FROM settings")
def k13(spark, folder):
    settings = frame(spark, folder, "settings").select("user_id", F.col("playback_speed").cast("double").alias("playback_speed"), "theme")
    return C.updated(settings, settings.where("user_id % 2 = 0").select("user_id", F.lit(1.5).alias("playback_speed")), ["user_id"])


@query("k15_reimported_books", cte("books") + ", i AS (SELECT DISTINCT title FROM books WHERE book_id % 10 = 1), k AS (SELECT title, min(book_id) AS book_id FROM books GROUP BY 1) SELECT book_id, title FROM books WHERE title NOT IN (SELECT title FROM i) UNION ALL SELECT k.book_id, title FROM i JOIN k USING (title)")
def k15(spark, folder):
    books = frame(spark, folder, "books").select("book_id", "title")
    return C.replaced_by_natural_key(books, books.where("book_id % 10 = 1").select("title").distinct(), "title").select("book_id", "title")


@query("k16_reconciled_totals", cte("books", "chunk_rows") + ", " + CHAPTERS + ", r AS (SELECT book_id, count(*) AS n, CAST(sum(chapter_words) AS BIGINT) AS real_words FROM chapters GROUP BY 1) SELECT b.book_id, CAST(coalesce(n, 0) AS INT) AS total_chapters, real_words, coalesce(n, 0) IS DISTINCT FROM total_chapters AS differs FROM books b LEFT JOIN r USING (book_id)")
def k16(spark, folder):
    return C.reconciled(frame(spark, folder, "books").select("book_id", "total_chapters"), chapters(spark, folder)).select("book_id", "total_chapters", "real_words", "differs")


@query("k18_backfilled_start", cte("books", "chunk_rows") + ", " + CHAPTERS + ", l AS (SELECT book_id, min(chapter_number) AS low FROM chapters GROUP BY 1) SELECT b.book_id, coalesce(chapter_start_number, low, 1) AS chapter_start_number FROM books b LEFT JOIN l USING (book_id)")
def k18(spark, folder):
    return C.backfilled_start(frame(spark, folder, "books"), chapters(spark, folder)).select("book_id", "chapter_start_number")


IMAGE_CHUNKS = "c AS (SELECT book_id, chapter_number, line, side, type, 'https://x/y/Supplier#' || lpad(CAST(side AS VARCHAR), 9, '0') AS url, 'Supplier#' || lpad(CAST(side AS VARCHAR), 9, '0') AS base FROM chunk_rows)"


@query("k17_j18_uploaded_images", cte("images", "chunk_rows") + ", names AS (SELECT DISTINCT file_name FROM images WHERE image_id % 2 = 0), " + IMAGE_CHUNKS + ", u AS (SELECT c.*, type = 'image' AND n.file_name IS NOT NULL AS hit FROM c LEFT JOIN names n ON n.file_name = c.base) SELECT book_id, chapter_number, count(*) AS chunks, count(*) FILTER (hit) AS named, md5(string_agg(CASE WHEN hit THEN base ELSE url END, ',' ORDER BY line, side, type)) AS names FROM u GROUP BY ALL")
def k17(spark, folder):
    files = frame(spark, folder, "images").where("image_id % 2 = 0").select("file_name")
    url = F.concat(F.lit("https://x/y/Supplier#"), F.lpad(F.col("side").cast("string"), 9, "0"))
    chunk = F.struct("line", "side", "type", url.alias("url"), F.lit(None).cast("string").alias("name"))
    chapters = frame(spark, folder, "chunk_rows").groupBy("book_id", "chapter_number").agg(F.array_sort(F.collect_list(chunk)).alias("chunks"))
    done = C.with_uploaded_names(chapters, ["book_id", "chapter_number"], files)
    shown = F.array_join(F.transform("chunks", lambda c: F.coalesce(c["name"], c["url"])), ",")
    return done.select("book_id", "chapter_number", F.size("chunks").cast("long").alias("chunks"), F.size(F.filter("chunks", lambda c: c["name"].isNotNull())).cast("long").alias("named"), F.md5(shown.cast("binary")).alias("names"))


@query("k04_batches_of_ten", cte("bookmarks") + "SELECT CAST(user_id % 16 AS INT) AS bucket, count(*) AS rows, true AS in_tens, CAST(count(*) FILTER (bookmark_id % 2 = 1) AS BIGINT) AS later FROM bookmarks GROUP BY 1")
def k04(spark, folder):
    rows = frame(spark, folder, "bookmarks")
    table = BucketTable(spark, shared_path(spark, "batches"), ["user_id"], bucket=F.col("user_id") % 16)
    for rest in (0, 1):
        table.insert(rows.where(F.col("bookmark_id") % 2 == rest), 10)
    files = table.read().withColumn("later", (F.col("bookmark_id") % 2).cast("long")).groupBy((F.col("user_id") % 16).cast("int").alias("bucket"), F.input_file_name().alias("file")).agg(F.count("*").alias("n"), F.sum("later").alias("later"))
    return files.groupBy("bucket").agg(F.sum("n").alias("rows"), (F.max("n") <= 10).alias("in_tens"), F.sum("later").alias("later"))
