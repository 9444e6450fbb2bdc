"""Queries of texts: scalar functions, lines, headings, titles, chunks."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from folio.functions import chunker
from folio.functions import text as T
from folio.functions.fixed import ABBREVIATIONS, NUMBER_WORDS, ROMAN
from folio.plans import chunk_sql
from folio.plans.base import cte, frame
from folio.plans.registry import query

LINES = "lines AS (SELECT doc_id, CAST(unnest(range(len(l))) AS INT) AS line, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"


def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def lines(spark, folder):
    return docs(spark, folder).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))


@query("f01_word_counts", "SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[\\s]+'), lambda x: x <> '')) AS words FROM documents")
def f01(spark, folder):
    return docs(spark, folder).select("doc_id", F.size(T.words(F.col("text"))).cast("long").alias("words"))


@query("f02_split_sizes", "SELECT doc_id, CAST(len(regexp_split_to_array(text, '[\\s]+')) AS INT) AS parts FROM documents")
def f02(spark, folder):
    return docs(spark, folder).select("doc_id", T.split_size(F.col("text")).alias("parts"))


@query("f03_f04_strings", cte("books") + "SELECT book_id, upper(title) AS up, lower(description) AS low, trim('  ' || title || ' ') AS trimmed, starts_with(title, 'red') AS red, ends_with(title, 'bolt') AS bolt, contains(title, 'in') AS has_in, instr(title, ' ') AS space, substr(title, 2, 4) AS part FROM books")
def f03(spark, folder):
    t = F.col("title")
    return frame(spark, folder, "books").select("book_id", F.upper(t).alias("up"), F.lower("description").alias("low"), F.trim(F.concat(F.lit("  "), t, F.lit(" "))).alias("trimmed"), t.startswith("red").alias("red"), t.endswith("bolt").alias("bolt"), t.contains("in").alias("has_in"), F.instr(t, " ").alias("space"), F.substring(t, 2, 4).alias("part"))


@query("f05_previews", "SELECT doc_id, substr(text, 1, 100) || CASE WHEN length(text) > 100 THEN '...' ELSE '' END AS preview FROM documents")
def f05(spark, folder):
    return docs(spark, folder).select("doc_id", T.preview(F.col("text")).alias("preview"))


@query("f07_slugs", cte("users") + "SELECT user_id, regexp_replace(lower(username), '[^a-z0-9]', '-', 'g') AS plain, regexp_replace(regexp_replace(lower(username || ' -- x'), '[^a-z0-9]', '-', 'g'), '-+', '-', 'g') AS collapsed FROM users")
def f07(spark, folder):
    u = F.col("username")
    return frame(spark, folder, "users").select("user_id", T.slug(u, False).alias("plain"), T.slug(F.concat(u, F.lit(" -- x"))).alias("collapsed"))


@query("f08_image_names", cte("images") + "SELECT image_id, 'page-' || lpad(CAST(page_number AS VARCHAR), 3, '0') || '-image-' || image_id || '.jpg' AS name, 'page-' || page_number || '-image-' || image_id || '.jpg' AS placeholder FROM images")
def f08(spark, folder):
    return frame(spark, folder, "images").select("image_id", T.image_name(F.col("page_number"), F.col("image_id")).alias("name"), T.image_name(F.col("page_number"), F.col("image_id"), False).alias("placeholder"))


@query("f09_file_kinds", "SELECT page_id, list_extract(string_split(url, '/'), -1) AS base, CASE page_id % 3 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' ELSE 'application/octet-stream' END AS mime FROM pages")
def f09(spark, folder):
    name = F.concat(F.lit("a/b."), F.element_at(F.array(F.lit("PNG"), F.lit("jpg"), F.lit("bin")), (F.col("page_id") % 3 + 1).cast("int")))
    return spark.read.parquet(f"{folder}/pages.parquet").select("page_id", T.base_name(F.col("url")).alias("base"), T.mime_type(name).alias("mime"))


@query("f10_initials", cte("books") + "SELECT book_id, upper(substr(split_part(title, ' ', 1), 1, 1)) || upper(substr(split_part(title, ' ', 2), 1, 1)) AS initials FROM books")
def f10(spark, folder):
    return frame(spark, folder, "books").select("book_id", T.initials(F.col("title")).alias("initials"))


@query("f11_escaped_patterns", cte("users") + "SELECT user_id, regexp_replace(username || '(a.b)*', '([.*+?^${}()|\\[\\]\\\\])', '\\\\\\1', 'g') AS escaped FROM users")
def f11(spark, folder):
    return frame(spark, folder, "users").select("user_id", T.regex_escaped(F.concat("username", F.lit("(a.b)*"))).alias("escaped"))


# a title of each kind from a part's name; white space is of several kinds
NUMBER_LIST = "[" + ", ".join(f"'{w}'" for w in NUMBER_WORDS) + "]"
ROMAN_LIST = "[" + ", ".join(f"'{r}'" for r in ROMAN) + "]"
KINDS_OF_TITLES = [
    "k || '. ' || n", "k || chr(160) || 'The ' || n || '  '", "'Chapter ' || word || ': ' || n", "'CHAPTER' || chr(8195) || upper(word) || ':' || n", "'Chapter ' || k || ': ' || n", "chr(65279) || 'Introduction to ' || n",
    "'Appendix ' || k || ' ' || n", "'Epilogue'", "roman || '. ' || n", "n || ' (notes)'", "'Preface'", "'Chapter ' || word || ' ' || n",
]
TITLED = f"p AS (SELECT p_partkey AS k, p_name AS n, ({NUMBER_LIST})[CAST(p_partkey % 20 AS INT) + 1] AS word, ({ROMAN_LIST})[CAST(p_partkey % 15 AS INT) + 1] AS roman FROM part), titled AS (SELECT *, CASE k % {len(KINDS_OF_TITLES)} {' '.join(f'WHEN {i} THEN {e}' for i, e in enumerate(KINDS_OF_TITLES))} END AS raw FROM p), trimmed AS (SELECT *, regexp_replace(raw, '^{T.SPACE}|{T.SPACE}$', '', 'g') AS t FROM titled)"


def titled(spark, folder):
    k = F.col("p_partkey")
    named = lambda names: F.element_at(F.array(*[F.lit(x) for x in names]), (k % len(names) + 1).cast("int"))
    p = spark.read.parquet(f"{folder}/part.parquet").select(k.alias("k"), F.col("p_name").alias("n"), named(NUMBER_WORDS).alias("word"), named(ROMAN).alias("roman"))
    kind = F.col("k") % len(KINDS_OF_TITLES)
    raw = F.coalesce(*[F.when(kind == i, F.expr(re.sub(r"chr\((\d+)\)", lambda m: f"decode(unhex('{chr(int(m[1])).encode().hex()}'), 'UTF-8')", e))) for i, e in enumerate(KINDS_OF_TITLES)])
    return p.withColumn("raw", raw)


@query("f13_f18_numbers", "WITH " + TITLED + f", c AS (SELECT k, nullif(lower(regexp_extract(t, '(?i)^(?:chapter{T.SPACE})?([a-z]+|[0-9]+)[.:]', 1)), '') AS captured FROM trimmed) SELECT k, captured, CAST(coalesce(TRY_CAST(captured AS INT), nullif(list_position({NUMBER_LIST}, captured), 0), nullif(list_position({ROMAN_LIST}[1:10], captured), 0)) AS INT) AS number FROM c")
def f18(spark, folder):
    captured = F.nullif(F.lower(F.regexp_extract(T.trimmed(F.col("raw")), rf"(?i)^(?:chapter{T.SPACE})?([a-z]+|[0-9]+)[.:]", 1)), F.lit(""))
    return titled(spark, folder).select("k", captured.alias("captured")).select("k", "captured", F.coalesce(F.col("captured").try_cast("int"), T.number_of(F.col("captured"))).alias("number"))


@query("f14_marked_parts", "SELECT page_id, array_to_string(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1), ' ') AS links FROM pages")
def f14(spark, folder):
    return spark.read.parquet(f"{folder}/pages.parquet").select("page_id", F.array_join(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1)), " ").alias("links"))


@query("f15_any_pattern", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)idiot') OR regexp_matches(text, '(?i)token\\s*=')")
def f15(spark, folder):
    found = F.col("text").rlike("(?iu)idiot") | F.col("text").rlike(r"(?iu)token\s*=")
    return docs(spark, folder).where(found).select("doc_id")


@query("f16_without_tags", "SELECT page_id, regexp_replace(html, '<[^>]*>', '', 'g') AS plain FROM pages")
def f16(spark, folder):
    return spark.read.parquet(f"{folder}/pages.parquet").select("page_id", T.without_tags(F.col("html")).alias("plain"))


@query("f17_marked_speech", cte("books") + """SELECT book_id, '<speak> <mark name="' || split_part(title, ' ', 1) || '-0"/> ' || split_part(title, ' ', 1) || ' <mark name="' || split_part(title, ' ', 2) || '-1"/> ' || split_part(title, ' ', 2) || '</speak>' AS speech FROM books""")
def f17(spark, folder):
    return frame(spark, folder, "books").select("book_id", T.marked_speech(F.col("title")).alias("speech"))


@query("f19_day_and_month", cte("progress") + "SELECT progress_id, strftime(last_read_at, '%Y-%m-%d') AS day, strftime(last_read_at, '%Y-%m') AS month FROM progress")
def f19(spark, folder):
    return frame(spark, folder, "progress").select("progress_id", F.date_format("last_read_at", "yyyy-MM-dd").alias("day"), F.date_format("last_read_at", "yyyy-MM").alias("month"))


@query("f23_rounding", cte("images") + "SELECT image_id, round(size_points, 1) AS r, CAST(ceil(size_points) AS BIGINT) AS c, CAST(floor(size_points) AS BIGINT) AS f, abs(size_points) AS a, round(sqrt(abs(size_points)), 6) AS s, round(pow(size_points / 100, 2), 4) AS p, least(greatest(size_points, 100), 5000) AS clamped FROM images")
def f23(spark, folder):
    x = F.col("size_points")
    return frame(spark, folder, "images").select("image_id", F.round(x, 1).alias("r"), F.ceil(x).alias("c"), F.floor(x).alias("f"), F.abs(x).alias("a"), F.round(F.sqrt(F.abs(x)), 6).alias("s"), F.round(F.pow(x / 100, F.lit(2)), 4).alias("p"), F.least(F.greatest(x, F.lit(100.0)), F.lit(5000.0)).alias("clamped"))


@query("f28_fixed_point", cte("books") + "SELECT book_id, '$' || printf('%.4f', price) AS shown FROM books")
def f28(spark, folder):
    return frame(spark, folder, "books").select("book_id", F.concat(F.lit("$"), F.regexp_replace(F.format_number("price", 4), ",", "")).alias("shown"))


@query("f35_navigation_kinds", cte("reading_logs") + "SELECT log_id, CASE WHEN log_id % 4 = 0 THEN 'coordinate' WHEN length(CAST(log_id AS VARCHAR)) <= 3 THEN 'pattern' ELSE 'text-search' END AS kind FROM reading_logs")
def f35(spark, folder):
    return frame(spark, folder, "reading_logs").select("log_id", T.navigation_kind(F.col("log_id").cast("string"), F.col("log_id") % 4 == 0).alias("kind"))


@query("f36_f37_arrays_and_maps", cte("chunk_rows") + "SELECT book_id, CAST(sum(word_count * 2) AS BIGINT) AS doubled, count(*) FILTER (word_count > 25) AS large, bool_or(type = 'image') AS some_image, bool_and(word_count > 0) AS all_words, max(word_count) AS most FROM chunk_rows GROUP BY 1")
def f36(spark, folder):
    packed = frame(spark, folder, "chunk_rows").groupBy("book_id").agg(F.collect_list(F.struct("word_count", "type")).alias("c"))
    c = F.col("c")
    return packed.select("book_id", F.aggregate(F.transform(c, lambda x: (x["word_count"] * 2).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x).alias("doubled"), F.size(F.filter(c, lambda x: x["word_count"] > 25)).cast("long").alias("large"), F.exists(c, lambda x: x["type"] == "image").alias("some_image"), F.forall(c, lambda x: x["word_count"] > 0).alias("all_words"), F.array_max(F.transform(c, lambda x: x["word_count"])).alias("most"))


@query("f38_json_fields", "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events")
def f38(spark, folder):
    return spark.read.parquet(f"{folder}/events.parquet").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("f39_f40_cache_keys", cte("books") + "SELECT book_id, md5('books:' || '{\"description\":\"' || description || '\",\"title\":\"' || title || '\"}') AS cache_key FROM books")
def f40(spark, folder):
    entries = F.array_sort(F.array(F.struct(F.lit("title").alias("k"), F.col("title").alias("v")), F.struct(F.lit("description").alias("k"), F.col("description").alias("v"))))
    canonical = F.to_json(F.map_from_entries(entries))
    return frame(spark, folder, "books").select("book_id", F.md5(F.concat_ws(":", F.lit("books"), canonical).cast("binary")).alias("cache_key"))


@query("f41_rolling_hashes", cte("books") + "SELECT book_id, lower(to_hex(abs(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(title, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda h, c: ((h * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648)))) AS hash FROM books")
def f41(spark, folder):
    return frame(spark, folder, "books").select("book_id", T.rolling_hash(F.col("title")).alias("hash"))


@query("f43_base64", cte("books") + "SELECT book_id, base64(encode(title)) AS coded, decode(from_base64(base64(encode(title)))) AS back FROM books")
def f43(spark, folder):
    coded = F.base64(F.col("title").cast("binary"))
    return frame(spark, folder, "books").select("book_id", coded.alias("coded"), F.unbase64(coded).cast("string").alias("back"))


@query("f44_addresses", cte("images") + "SELECT image_id, 'https://x.y/books/' || page_number || '/' || file_name AS address FROM images")
def f44(spark, folder):
    return frame(spark, folder, "images").select("image_id", T.image_address(F.lit("https://x.y/books/"), F.col("page_number").cast("string"), F.col("file_name")).alias("address"))


@query("f45_prompts", "SELECT a.conv_id, a.turn, CASE WHEN p.text IS NULL THEN '' ELSE 'Conversation: ' || p.text || chr(10) END || 'Question: ' || a.text AS prompt FROM conversations a LEFT JOIN conversations p ON p.conv_id = a.conv_id AND p.turn = a.turn - 1 WHERE a.role = 'user'")
def f45(spark, folder):
    c = spark.read.parquet(f"{folder}/conversations.parquet")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return c.withColumn("before", before).where("role = 'user'").select("conv_id", "turn", T.prompt(F.lit(""), F.lit(""), F.col("before"), F.col("text")).alias("prompt"))


@query("p15_content_lines", "WITH " + LINES + " SELECT doc_id, count(*) AS n FROM lines WHERE length(text) > 50 GROUP BY doc_id")
def p15(spark, folder):
    return lines(spark, folder).where(F.char_length("text") > 50).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("p20_chunk_violations", cte("chunk_rows") + "SELECT count(*) FILTER (type NOT IN ('text', 'image', 'header')) AS bad_type, count(*) FILTER (word_count <= 0) AS no_words FROM chunk_rows")
def p20(spark, folder):
    return frame(spark, folder, "chunk_rows").agg(F.count_if(~F.col("type").isin("text", "image", "header")).alias("bad_type"), F.count_if(F.col("word_count") <= 0).alias("no_words"))


@query("p21_blank_texts", "SELECT count(*) FILTER (trim(text) = '') AS blank, count(*) AS n FROM documents")
def p21(spark, folder):
    return docs(spark, folder).agg(F.count_if(F.trim("text") == "").alias("blank"), F.count("*").alias("n"))


@query("w05_w06_line_contexts", "WITH " + LINES + " SELECT doc_id, line, length(lag(text) OVER w) AS before, length(lead(text) OVER w) AS after FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line)")
def w05(spark, folder):
    w = Window.partitionBy("doc_id").orderBy("line")
    return lines(spark, folder).select("doc_id", "line", F.char_length(F.lag("text").over(w)).cast("long").alias("before"), F.char_length(F.lead("text").over(w)).cast("long").alias("after"))


HEAD = """h AS (SELECT doc_id, line, trim(text) AS t, lag(text) OVER w AS p, lead(text) OVER w AS f, list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '') AS ws FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
 d AS (SELECT doc_id, line, length(t) >= 3 AND NOT contains(t, '@') AND len(ws) <= 10 AND NOT regexp_matches(t, '[.!?;)@]$') AND regexp_matches(t, '^[A-Z]') AND (p IS NULL OR length(trim(p)) = 0 OR regexp_matches(trim(p), '[.!?;0-9]$'))
 AND NOT coalesce(len(ws) >= 2 AND regexp_matches(ws[1], '^[A-Z][a-z]?$') AND regexp_matches(ws[2], '^[a-z]|^\\d+$'), false) AND NOT regexp_matches(t, '\\b\\d+[-–]\\d+|\\b\\d+n\\d+|\\b\\d+,\\s*\\d+|\\s\\d+$') AND NOT regexp_matches(t, '^[A-Z]\\)\\s')
 AND (t = upper(t) OR ends_with(t, ':') OR (len(ws) <= 6 AND coalesce(regexp_matches(trim(f), '^[A-Z0-9]'), false))) AS heading FROM h)"""


@query("x03_x04_headings", "WITH " + LINES + ", " + HEAD + " SELECT doc_id, line FROM d WHERE heading")
def x04(spark, folder):
    w = Window.partitionBy("doc_id").orderBy("line")
    marked = lines(spark, folder).withColumn("previous", F.lag("text").over(w)).withColumn("following", F.lead("text").over(w))
    return marked.where(T.is_heading(F.col("text"), F.col("following"), F.col("previous"))).select("doc_id", "line")


@query("w18_w19_sections", "WITH " + LINES + ", " + HEAD + ", s AS (SELECT doc_id, line, sum(CASE WHEN heading THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS section FROM d) SELECT doc_id, CAST(section AS BIGINT) AS section, min(line) AS first_line, count(*) AS lines FROM s GROUP BY ALL")
def w19(spark, folder):
    w = Window.partitionBy("doc_id").orderBy("line")
    marked = lines(spark, folder).withColumn("previous", F.lag("text").over(w)).withColumn("following", F.lead("text").over(w))
    flag = T.is_heading(F.col("text"), F.col("following"), F.col("previous")).cast("long")
    s = marked.withColumn("flag", flag).withColumn("section", F.sum("flag").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("doc_id", "section").agg(F.min("line").alias("first_line"), F.count("*").alias("lines"))


@query("x06_abbreviated_ends", "WITH " + LINES + f" SELECT doc_id, line FROM lines WHERE {' OR '.join(f'ends_with(lower(trim(text)), {chr(39)}{a.lower()}{chr(39)})' for a in ABBREVIATIONS)}")
def x06(spark, folder):
    return lines(spark, folder).where(T.ends_abbreviated(F.col("text"))).select("doc_id", "line")


@query("x08_page_numbers", cte("reading_logs") + "SELECT log_id, regexp_replace(CASE WHEN log_id % 2 = 0 THEN chapter_number || ' The text' ELSE 'iv The text' END, CASE WHEN log_id % 2 = 0 THEN '^\\s*' || chapter_number || '\\s+' ELSE '^\\s*iv\\s+' END, '') AS text FROM reading_logs")
def x08(spark, folder):
    raw = F.when(F.col("log_id") % 2 == 0, F.concat(F.col("chapter_number").cast("string"), F.lit(" The text"))).otherwise("iv The text")
    return frame(spark, folder, "reading_logs").select("log_id", T.without_page_number(raw, F.col("chapter_number") + 1).alias("text"))


@query("x11_chapter_titles", "WITH " + TITLED + """ SELECT k, CASE WHEN k % 12 < 2 THEN CAST(k AS INT) WHEN k % 12 IN (2, 3) THEN CAST(k % 20 + 1 AS INT) WHEN k % 12 = 5 THEN 0 END AS number,
 CASE k % 12 WHEN 6 THEN 'Appendix ' || k WHEN 7 THEN 'Epilogue' END AS label, CASE k % 12 WHEN 0 THEN n WHEN 1 THEN 'The ' || n ELSE t END AS title FROM trimmed""")
def x11(spark, folder):
    return titled(spark, folder).select("k", T.chapter_of_title(F.col("raw")).alias("c")).select("k", "c.number", "c.label", "c.title")


@query("x11_outline_titles", "WITH " + TITLED + """ SELECT k, CASE WHEN k % 12 < 2 OR k % 12 = 4 THEN CAST(k AS INT) WHEN k % 12 IN (2, 3, 11) AND k % 20 < 12 THEN CAST(k % 20 + 1 AS INT) WHEN k % 12 = 8 AND k % 15 < 10 THEN CAST(k % 15 + 1 AS INT) END AS number,
 CASE WHEN k % 12 = 8 AND k % 15 >= 10 THEN roman WHEN k % 12 IN (7, 10) THEN lower(t) END AS label, CASE WHEN k % 12 IN (7, 10) THEN t WHEN k % 12 = 1 THEN 'The ' || n WHEN k % 12 IN (0, 4, 8) OR k % 12 IN (2, 3, 11) AND k % 20 < 12 THEN n END AS title FROM trimmed""")
def x11_outline(spark, folder):
    return titled(spark, folder).select("k", T.chapter_of_outline(F.col("raw")).alias("c")).select("k", "c.number", "c.label", "c.title")


@query("x16_index_pages", cte("images") + "SELECT image_id, array_to_string(list_sort(list_distinct(list_concat(range(150 + image_id % 40, 152 + image_id % 40), [CAST(7 AS BIGINT)]))), ',') AS pages FROM images")
def x16(spark, folder):
    n = (F.lit(150) + F.col("image_id") % 40).cast("string")
    entry = F.concat(F.lit("Smith, John 7, "), n, F.lit("–"), F.substring((F.lit(151) + F.col("image_id") % 40).cast("string"), 2, 2))
    return frame(spark, folder, "images").select("image_id", F.array_join(T.index_pages(entry), ",").alias("pages"))


def marked(spark, folder):
    """Documents with marks around their headings, lines joined."""
    w = Window.partitionBy("doc_id").orderBy("line")
    around = lines(spark, folder).withColumn("previous", F.lag("text").over(w)).withColumn("following", F.lead("text").over(w))
    kept = around.where(F.trim("text") != "").withColumn("text", T.marked_heading(F.col("text"), F.col("following"), F.col("previous")))
    rows = F.array_sort(F.collect_list(F.struct("line", "text")))
    return kept.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r["text"]), " ").alias("text"))


@query("x03_marked_texts", "WITH " + LINES + ", " + HEAD + f" SELECT doc_id, md5(string_agg(CASE WHEN heading THEN '{T.HEADING_OPENS}' || t || '{T.HEADING_CLOSES}' ELSE t END, ' ' ORDER BY line)) AS text FROM (SELECT d.*, t FROM d JOIN h USING (doc_id, line)) WHERE t <> '' GROUP BY doc_id")
def x03(spark, folder):
    return marked(spark, folder).withColumn("text", F.md5(F.col("text").cast("binary")))


@query("x02_chunks", chunk_sql.x02(LINES + ", " + HEAD))
def x02(spark, folder):
    return chunker.chunk_table(marked(spark, folder), "doc_id", "text")


@query("x02_headers", "WITH " + LINES + ", " + HEAD + " SELECT doc_id, count(*) AS headers, CAST(sum(len(ws)) AS BIGINT) AS words FROM (SELECT d.*, ws FROM d JOIN h USING (doc_id, line)) WHERE heading GROUP BY doc_id")
def x02_headers(spark, folder):
    return x02(spark, folder).where("type = 'header'").groupBy("doc_id").agg(F.count("*").alias("headers"), F.sum("word_count").alias("words"))


@query("x21_plain_chunks", chunk_sql.X21)
def x21(spark, folder):
    return chunker.chunk_table(docs(spark, folder), "doc_id", "text", plain=True)


@query("x21_plain_totals", "SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS BIGINT) AS words FROM documents WHERE len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) > 0")
def x21_totals(spark, folder):
    return x21(spark, folder).groupBy("doc_id").agg(F.sum("word_count").alias("words"))


@query("x02_chunk_totals", "SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS BIGINT) AS words FROM documents WHERE len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) > 0")
def x02_totals(spark, folder):
    return x02(spark, folder).groupBy("doc_id").agg(F.sum("word_count").alias("words"))


@query("a18_book_totals", cte("chunk_rows") + "SELECT book_id, count(DISTINCT chapter_number) AS chapters, CAST(sum(word_count) AS BIGINT) AS words, CAST(round(avg(word_count)) AS BIGINT) AS mean_words FROM chunk_rows GROUP BY 1")
def a18(spark, folder):
    return frame(spark, folder, "chunk_rows").groupBy("book_id").agg(F.count_distinct("chapter_number").alias("chapters"), F.sum("word_count").alias("words"), F.round(F.avg("word_count")).cast("long").alias("mean_words"))
