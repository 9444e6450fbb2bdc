"""Queries of chapters by title, of what chooses between ways to find chapters, and of summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators import chapters as C
from folio.operators import documents, layout
from folio.operators import summaries as S
from folio.plans.base import cte, frame
from folio.plans.document_queries import SECTIONS_OF_LINES
from folio.plans.reading_queries import CHUNKS, chunks
from folio.plans.registry import query
from folio.plans.text_queries import docs

# a document's configured titles here: the first letters of some of its lines
BOOK_LINES = r"bl AS (SELECT doc_id, CAST(unnest(range(len(l))) AS INT) AS line, unnest(l) AS text FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, E' \t\n\r\f\v')), lambda x: x <> '') AS l FROM documents))"
TITLES = "ti AS (SELECT doc_id, line AS nth, substr(text, 1, 40) AS title FROM bl WHERE line % 6 = 2 AND length(text) > 10)"


def folded(c: str) -> str:
    plain = f"translate(regexp_replace({c}, '[\\s]+', ' ', 'g'), '“”″‶‘’', '\"\"\"\"''''')"
    return f"trim(regexp_replace({plain}, '(?i)\\s+(?:ix|xi{{1,3}}|[0-9]+)\\s*$', ''))"


def first_match(c: str) -> str:
    """The first of the titles ts, folded fs, that the folded line matches."""
    cuts = " OR ".join(f"(length(fs[k]) - {k_} > 8 AND starts_with({c}, substr(fs[k], {k_ + 1})))" for k_ in (1, 2, 3))
    return f"ts[list_filter(range(1, len(ts) + 1), lambda k: starts_with({c}, fs[k]) OR (length(fs[k]) > 10 AND (contains({c}, fs[k]) OR {cuts})))[1]]"


MATCHED = BOOK_LINES + ", " + TITLES + f""", tl AS (SELECT doc_id, list(title ORDER BY nth) AS ts, list({folded('title')} ORDER BY nth) AS fs FROM ti GROUP BY doc_id),
 fl AS (SELECT doc_id, line, text, {folded('text')} AS one, {folded("text || ' ' || lead(text) OVER (PARTITION BY doc_id ORDER BY line)")} AS two FROM bl),
 ma AS (SELECT doc_id, line, text, {first_match('one')} AS title, CASE WHEN two IS NOT NULL THEN {first_match('two')} END AS joined FROM fl LEFT JOIN tl USING (doc_id))"""
PLACES = MATCHED + """, pa AS (SELECT *, sum(CASE WHEN title IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS part, CASE WHEN length(text) > 20 AND NOT regexp_full_match(text, '\\d+') THEN 1 ELSE 0 END AS counts FROM ma),
 co AS (SELECT *, CAST(coalesce(sum(counts) OVER (PARTITION BY doc_id, part ORDER BY line ROWS BETWEEN 1 FOLLOWING AND 99 FOLLOWING), 0) AS BIGINT) AS content_lines FROM pa),
 oc AS (SELECT doc_id, line, title, false AS is_joined, content_lines FROM co WHERE title IS NOT NULL UNION ALL SELECT doc_id, line, joined, true, content_lines FROM co WHERE joined IS NOT NULL)"""
BEST = PLACES + """, ra AS (SELECT *, row_number() OVER (PARTITION BY doc_id, title ORDER BY content_lines DESC, line, is_joined) AS nth, min(line * 2 + CAST(is_joined AS INT)) OVER (PARTITION BY doc_id, title) AS seen FROM oc), be AS (SELECT * FROM ra WHERE nth = 1 AND content_lines >= 1)"""
BY_TITLE = BEST + """, st AS (SELECT doc_id, line, arg_max(title, seen) AS st FROM be GROUP BY doc_id, line),
 pl AS (SELECT l.doc_id, l.line, text, st, last_value(CASE WHEN st IS NOT NULL THEN l.line END IGNORE NULLS) OVER w AS start, last_value(st IGNORE NULLS) OVER w AS title FROM bl l LEFT JOIN st s ON s.doc_id = l.doc_id AND s.line = l.line WINDOW w AS (PARTITION BY l.doc_id ORDER BY l.line ROWS UNBOUNDED PRECEDING)),
 ct AS (SELECT doc_id, start, title, count(*) AS content_lines, string_agg(text, chr(10) ORDER BY line) AS content FROM pl WHERE st IS NULL AND start IS NOT NULL AND length(text) > 10 AND NOT regexp_full_match(text, '\\d+') AND NOT regexp_matches(text, '(?i)^(?:isbn|copyright|typeset|printed|published|all rights|first published|volume)') GROUP BY ALL),
 ch AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) AS INT) AS chapter, title, start AS line, content_lines, content FROM ct)"""


def lines(spark, folder):
    return C.book_lines(docs(spark, folder))


def titles(spark, folder):
    return lines(spark, folder).where("line % 6 = 2 and length(text) > 10").select("doc_id", F.col("line").alias("nth"), F.substring("text", 1, 40).alias("title"))


@query("x05_j12_title_matches", "WITH " + MATCHED + " SELECT doc_id, line, title, joined FROM ma WHERE title IS NOT NULL OR joined IS NOT NULL")
def j12(spark, folder):
    return C.with_titles(lines(spark, folder), titles(spark, folder)).where("title is not null or joined is not null").select("doc_id", "line", "title", "joined")


@query("w10_best_occurrence", "WITH " + BEST + " SELECT doc_id, title, line, is_joined AS joined, content_lines FROM be")
def w10(spark, folder):
    best = C.best_occurrences(C.occurrences(C.with_titles(lines(spark, folder), titles(spark, folder))))
    return best.select("doc_id", "title", "line", "joined", "content_lines")


@query("x14_chapters_by_title", "WITH " + BY_TITLE + " SELECT doc_id, chapter, title, line, content_lines, md5(content) AS content FROM ch")
def x14(spark, folder):
    return C.chapters_by_title(lines(spark, folder), titles(spark, folder)).withColumn("content", F.md5(F.col("content").cast("binary")))


CONTENTS = "h AS (SELECT *, min(CASE WHEN line < 200 AND contains(lower(text), {word}) THEN line END) OVER (PARTITION BY doc_id) AS i FROM ma) SELECT doc_id, CASE WHEN i IS NULL THEN 0 ELSE coalesce(min(CASE WHEN title IS NOT NULL AND line BETWEEN i + 5 AND i + 99 THEN line END) - 2, i + 15) END AS start FROM h GROUP BY doc_id, i"


@query("x13_content_start", "WITH " + MATCHED.replace("lambda x: x <> '')", "lambda x: x <> '')", 1).replace("FROM documents", "FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN text ELSE 'Contents' || chr(10) || text END AS text FROM documents)", 1) + ", " + CONTENTS.format(word="'contents'"))
def x13(spark, folder):
    # most documents get a heading of contents before all
    headed = docs(spark, folder).select("doc_id", F.when(F.col("doc_id") % 4 == 1, F.col("text")).otherwise(F.concat(F.lit("Contents\n"), F.col("text"))).alias("text"))
    all_lines = C.book_lines(headed)
    config = all_lines.where("line % 6 = 2 and length(text) > 10").select("doc_id", F.col("line").alias("nth"), F.substring("text", 1, 40).alias("title"))
    return C.content_start(C.with_titles(all_lines, config))


ENTRIES = """e AS (SELECT p_partkey AS entry_id, CASE WHEN p_partkey % 5 < 2 THEN CAST(p_partkey % 9 - 1 AS INT) END AS number, CASE p_partkey % 7 WHEN 3 THEN 'The Epilogue' WHEN 4 THEN 'Appendix A' END AS label, p_name AS title, CASE WHEN p_partkey % 11 = 0 THEN 0 WHEN p_partkey % 13 <> 0 THEN p_size END AS page FROM part)"""


@query("p14_content_chapters", "WITH " + ENTRIES + " SELECT entry_id FROM e WHERE coalesce(page <> 0, false) AND (coalesce(number >= 0, false) OR coalesce(contains(lower(label), 'epilogue'), false) OR contains(title, 'blue') OR contains('a red nut of old', title))")
def p14(spark, folder):
    k = F.col("p_partkey")
    e = spark.read.parquet(f"{folder}/part.parquet").select(
        k.alias("entry_id"), F.when(k % 5 < 2, (k % 9 - 1).cast("int")).alias("number"), F.when(k % 7 == 3, "The Epilogue").when(k % 7 == 4, "Appendix A").alias("label"), F.col("p_name").alias("title"),
        F.when(k % 11 == 0, 0).when(k % 13 != 0, F.col("p_size")).alias("page"),
    )
    return e.where(C.content_chapter(F.col("number"), F.col("label"), F.col("title"), F.col("page"), ["blue", "a red nut of old"])).select("entry_id")


@query("p17_content_lines", "WITH " + BOOK_LINES + " SELECT doc_id, line FROM bl WHERE length(text) > 10 AND NOT regexp_full_match(text, '\\d+') AND NOT regexp_matches(text, '(?i)^(?:isbn|copyright|typeset|printed|published|all rights|first published|volume)')")
def p17(spark, folder):
    return lines(spark, folder).where(C.content_line(F.col("text"))).select("doc_id", "line")


@query("p18_usable_links", "WITH a AS (SELECT o_orderkey AS link_id, CASE o_orderkey % 5 WHEN 0 THEN 'Text' WHEN 1 THEN NULL ELSE 'Link' END AS subtype, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN '' ELSE 'page.' || o_custkey END AS dest, CASE o_orderkey % 6 WHEN 0 THEN 'https://x.y' WHEN 1 THEN '' END AS url FROM orders) SELECT link_id FROM a WHERE subtype = 'Link' AND dest <> '' AND coalesce(url, '') = ''")
def p18(spark, folder):
    k = F.col("o_orderkey")
    a = spark.read.parquet(f"{folder}/orders.parquet").select(
        k.alias("link_id"), F.when(k % 5 == 0, "Text").when(k % 5 != 1, "Link").alias("subtype"), F.when((k % 7 != 0) & (k % 11 == 0), "").when(k % 7 != 0, F.concat(F.lit("page."), F.col("o_custkey").cast("string"))).alias("dest"),
        F.when(k % 6 == 0, "https://x.y").when(k % 6 == 1, "").alias("url"),
    )
    return a.where(C.usable_link(F.col("subtype"), F.col("dest"), F.col("url"))).select("link_id")


# a third of the documents have a table of contents with a chapter every two pages, a third have titles
PAGED = ", pg AS (SELECT doc_id, line // 4 AS page, string_agg(text, ' ' ORDER BY line) AS text FROM bl WHERE doc_id % 3 = 0 GROUP BY ALL), t AS (SELECT doc_id, page // 2 AS chapter, CAST(sum(length(text)) + count(*) - 1 AS BIGINT) AS chars FROM pg WHERE length(text) > 50 GROUP BY ALL)"
TITLED = BY_TITLE.replace("length(text) > 10)", "length(text) > 10 AND doc_id % 3 = 1)", 1)


@query("x18_contents_or_text", "WITH " + TITLED + PAGED + ", lines AS (SELECT * FROM bl WHERE doc_id NOT IN (SELECT doc_id FROM ti)), " + SECTIONS_OF_LINES + ", r AS (SELECT doc_id, CAST(chapter AS BIGINT) AS chapter, length(content) AS chars FROM ch UNION ALL SELECT doc_id, chapter, chars FROM sections) SELECT * FROM t UNION ALL SELECT * FROM r WHERE doc_id NOT IN (SELECT doc_id FROM t)")
def x18(spark, folder):
    all_lines = lines(spark, folder)
    # a page is its lines with spaces between, and a chapter its pages with line feeds: only their lengths are asked for
    chars = F.sum(F.char_length("text").cast("long")) + F.count("*") - 1
    pages = all_lines.where("doc_id % 3 = 0").groupBy("doc_id", F.floor(F.col("line") / 4).alias("page")).agg(chars.alias("chars"))
    toc = pages.select("doc_id", F.floor(F.col("page") / 2).alias("chapter")).distinct().withColumn("start_page", F.col("chapter") * 2)
    by_contents = documents.pages_of_contents(toc, pages).groupBy("doc_id", "chapter").agg((F.sum("chars") + F.count("*") - 1).alias("chars"))
    return C.detected(by_contents, all_lines, titles(spark, folder).where("doc_id % 3 = 1"), documents.chapter_line(F.col("text")))


MARKED = BOOK_LINES.replace("list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, E' \\t\\n\\r\\f\\v')), lambda x: x <> '')", "string_split(text, chr(10))").replace("bl AS", "lines AS")


@query("x12_contents_lines", """WITH r AS (SELECT p_partkey AS k, p_name AS n, p_size AS s FROM part), l AS (SELECT *, CASE k % 8 WHEN 0 THEN k || '. The ' || n || ' ' || s WHEN 1 THEN k || '  ' || n || '   ' || s WHEN 2 THEN 'Introduction: ' || n || ' ix' WHEN 3 THEN 'Appendix B: ' || n || ' ' || s WHEN 4 THEN n || ' ' || s WHEN 5 THEN 'Table of Contents' WHEN 6 THEN n || ' .... ' || s ELSE 'introduction to ' || n || ' ' || s END AS raw FROM r)
 SELECT k AS line_id, CASE WHEN k % 8 < 2 THEN CAST(k AS INT) WHEN k % 8 IN (2, 7) THEN 0 END AS number, CASE WHEN k % 8 = 3 THEN 'Appendix B' END AS label, CASE k % 8 WHEN 0 THEN 'The ' || n WHEN 1 THEN n WHEN 2 THEN 'Introduction: ' || n WHEN 3 THEN 'Appendix B: ' || n WHEN 4 THEN n WHEN 7 THEN 'introduction to ' || n END AS title, CASE WHEN k % 8 = 2 THEN 'ix' WHEN k % 8 NOT IN (5, 6) THEN CAST(s AS VARCHAR) END AS page FROM l""")
def x12(spark, folder):
    k, n, s = F.col("p_partkey"), F.col("p_name"), F.col("p_size").cast("string")
    forms = [[k.cast("string"), F.lit(". The "), n, F.lit(" "), s], [k.cast("string"), F.lit("  "), n, F.lit("   "), s], [F.lit("Introduction: "), n, F.lit(" ix")], [F.lit("Appendix B: "), n, F.lit(" "), s], [n, F.lit(" "), s], [F.lit("Table of Contents")], [n, F.lit(" .... "), s], [F.lit("introduction to "), n, F.lit(" "), s]]
    raw = F.element_at(F.array(*[F.concat(*f) for f in forms]), (k % 8 + 1).cast("int"))
    return spark.read.parquet(f"{folder}/part.parquet").select(k.alias("line_id"), T.toc_entry(raw).alias("c")).select("line_id", "c.number", "c.label", "c.title", "c.page")


# chunks of books with pages, links by page and images by page
ASSEMBLED = CHUNKS + """, n AS (SELECT *, count(*) OVER (PARTITION BY book_id, chapter_number) AS n, chapter_number + 1 AS pages FROM chunks),
 pc AS (SELECT book_id, chapter_number, chunk_index, word_count, type, CAST(row_number() OVER (PARTITION BY book_id ORDER BY chapter_number, chunk_index) AS BIGINT) AS chunk_id, CAST(chapter_number * 10 + least(pages - 1, floor(chunk_index / ceil(n / pages))) AS BIGINT) AS page FROM n),
 lk AS (SELECT o_orderkey % 2000 AS book_id, o_orderkey % 7 * 10 + 10 + o_custkey % 3 AS page, list_sort(list(o_orderkey)) AS links FROM orders GROUP BY ALL),
 ac AS (SELECT pc.*, coalesce(links, []) AS links FROM pc LEFT JOIN lk ON lk.book_id = pc.book_id AND lk.page = pc.page),
 im AS (SELECT s_suppkey % 300 AS book_id, s_nationkey % 7 * 10 + 10 AS page, s_name AS image FROM supplier),
 cr AS (SELECT book_id, chapter_number, min(page) AS first_page, max(page) AS last_page, list_sort(list(DISTINCT page)) AS pages, count(*) AS chunks, CAST(sum(word_count) AS BIGINT) AS words, CAST(sum(len(links)) AS BIGINT) AS links FROM ac GROUP BY ALL),
 ci AS (SELECT cr.*, (SELECT count(*) FROM im WHERE im.book_id = cr.book_id AND im.page BETWEEN first_page AND last_page) AS images FROM cr)"""


def assembled(spark, folder):
    n = F.col("chapter_number")
    rows = chunks(spark, folder).select("book_id", n, "chunk_index", "word_count", "type", (n * 10).alias("start_page"), (n * 11).alias("end_page")).withColumn("end_page", F.col("start_page") + n)
    k = F.col("o_orderkey")
    found = spark.read.parquet(f"{folder}/orders.parquet").select((k % 2000).alias("book_id"), (k % 7 * 10 + 10 + F.col("o_custkey") % 3).alias("page"), k.alias("link_id"))
    return layout.page_aware(rows, found)


def images(spark, folder):
    return spark.read.parquet(f"{folder}/supplier.parquet").select((F.col("s_suppkey") % 300).alias("book_id"), (F.col("s_nationkey") % 7 * 10 + 10).cast("long").alias("page_number"), F.col("s_name").alias("image"))


@query("x19_page_aware_chunks", cte("chunk_rows") + ", " + ASSEMBLED + " SELECT book_id, chapter_number, chunk_index, chunk_id, page, array_to_string(links, ',') AS links FROM ac")
def x19(spark, folder):
    return assembled(spark, folder).select("book_id", "chapter_number", "chunk_index", "chunk_id", "page", F.array_join("links", ",").alias("links"))


@query("a21_j07_chapters_of_chunks", cte("chunk_rows") + ", " + ASSEMBLED + " SELECT book_id, chapter_number, first_page, last_page, array_to_string(pages, ',') AS pages, images FROM ci")
def a21_j07(spark, folder):
    done = layout.chapters_of_chunks(assembled(spark, folder), images(spark, folder))
    return done.select("book_id", "chapter_number", "first_page", "last_page", F.array_join("pages", ",").alias("pages"), F.size("images").cast("long").alias("images"))


@query("a16_parser_summary", cte("chunk_rows") + ", " + ASSEMBLED + " SELECT book_id, chapter_number, words, chunks, first_page || '-' || last_page AS page_range, images, links, count(*) OVER b AS total_chapters, CAST(sum(chunks) OVER b AS BIGINT) AS total_chunks, CAST(sum(words) OVER b AS BIGINT) AS total_words, CAST(sum(images) OVER b AS BIGINT) AS total_images, CAST(sum(links) OVER b AS BIGINT) AS total_links FROM ci WINDOW b AS (PARTITION BY book_id)")
def a16(spark, folder):
    return S.parser_summary(layout.chapters_of_chunks(assembled(spark, folder), images(spark, folder)))


BOOK_OF_TURNS = "c AS (SELECT conv_id // 4 AS book_id, conv_id % 4 + 1 AS chapter_number, turn AS chunk_index, text, CASE WHEN turn % 5 = 1 THEN 'image' ELSE 'text' END AS type, len(regexp_extract_all(text, '\\S+')) AS word_count FROM conversations)"


@query("a17_book_summary", "WITH " + BOOK_OF_TURNS + """, s AS (SELECT book_id, chapter_number, count(*) FILTER (type = 'text') AS text_chunks, count(*) AS chunks, CAST(sum(word_count) AS BIGINT) AS words, substr(coalesce(array_to_string(list(text ORDER BY chunk_index) FILTER (type = 'text')[1:3], ' '), ''), 1, 200) || '...' AS preview FROM c GROUP BY ALL)
 SELECT *, count(*) OVER b AS total_chapters, CAST(sum(words) OVER b AS BIGINT) AS total_words, CAST(sum(chunks) OVER b AS BIGINT) AS total_chunks, CAST(round(sum(words) OVER b / count(*) OVER b) AS BIGINT) AS mean_words, CAST(round(sum(chunks) OVER b / count(*) OVER b) AS BIGINT) AS mean_chunks FROM s WINDOW b AS (PARTITION BY book_id)""")
def a17(spark, folder):
    c = spark.read.parquet(f"{folder}/conversations.parquet")
    kind = F.when(F.col("turn") % 5 == 1, "image").otherwise("text")
    rows = c.select(F.floor(F.col("conv_id") / 4).alias("book_id"), (F.col("conv_id") % 4 + 1).alias("chapter_number"), F.col("turn").alias("chunk_index"), "text", kind.alias("type"), F.regexp_count("text", F.lit(r"\S+")).alias("word_count"))
    return S.book_summary(rows)
