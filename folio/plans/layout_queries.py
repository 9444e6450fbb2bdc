"""Queries of page layout, links, images and speech timing."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.operators import layout as L
from folio.plans.base import cte, frame
from folio.plans.reading_queries import CHAPTERS, chapters
from folio.plans.registry import query

ITEMS = "items AS (SELECT l_orderkey // 40 AS doc_id, CAST(l_linenumber AS BIGINT) AS page, l_partkey * 1000000 + l_orderkey * 10 + l_suppkey % 10 AS pos, CASE WHEN l_partkey % 9 = 0 THEN ' ' ELSE l_shipmode END AS text, l_quantity * 2 AS y FROM (SELECT *, 'w' || l_partkey AS l_shipmode FROM lineitem) GROUP BY ALL)"


def items(spark, folder):
    rows = spark.read.parquet(f"{folder}/lineitem.parquet")
    return rows.select(F.floor(F.col("l_orderkey") / 40).alias("doc_id"), F.col("l_linenumber").cast("long").alias("page"), (F.col("l_partkey") * 1000000 + F.col("l_orderkey") * 10 + F.col("l_suppkey") % 10).alias("pos"), F.when(F.col("l_partkey") % 9 == 0, " ").otherwise(F.concat(F.lit("w"), F.col("l_partkey").cast("string"))).alias("text"), (F.col("l_quantity") * 2).alias("y")).distinct()


@query("w14_lines_of_items", "WITH " + ITEMS + """, n AS (SELECT *, CASE WHEN abs(round(y) - lag(round(y)) OVER w) > 5 THEN 1 ELSE 0 END AS nw FROM items WINDOW w AS (PARTITION BY doc_id, page ORDER BY pos, y)), l AS (SELECT *, sum(nw) OVER (PARTITION BY doc_id, page ORDER BY pos, y ROWS UNBOUNDED PRECEDING) AS line FROM n)
 SELECT doc_id, page, CAST(line AS BIGINT) AS line, string_agg(text, ' ' ORDER BY pos, y) AS text, count(*) AS items FROM l WHERE trim(text) <> '' GROUP BY doc_id, page, line""")
def w14(spark, folder):
    return L.lines_of_items(items(spark, folder))


@query("w15_lines_by_first_item", "WITH RECURSIVE " + ITEMS + """, n AS (SELECT doc_id, page, text, round(y) AS y, row_number() OVER (PARTITION BY doc_id, page ORDER BY pos, round(y), text) AS i FROM items),
 r AS (SELECT doc_id, page, i, y AS first, 0 AS line, text FROM n WHERE i = 1 UNION ALL SELECT n.doc_id, n.page, n.i, CASE WHEN abs(n.y - first) > 5 THEN n.y ELSE first END, CASE WHEN abs(n.y - first) > 5 THEN line + 1 ELSE line END, n.text FROM r JOIN n ON n.doc_id = r.doc_id AND n.page = r.page AND n.i = r.i + 1)
 SELECT doc_id, page, CAST(line AS INT) AS line, string_agg(text, ' ' ORDER BY i) AS text FROM r GROUP BY doc_id, page, line""")
def w15(spark, folder):
    return L.lines_by_first_item(items(spark, folder))


# links and pieces of documents of 8 pages
RECTS = """links AS (SELECT o_orderkey AS link_id, o_orderkey // 300 AS doc_id, o_custkey % 8 AS page, CAST(o_orderkey % 500 AS DOUBLE) AS lx1, CAST(o_orderkey % 500 + 30 AS DOUBLE) AS lx2, CAST(o_orderkey % 700 AS DOUBLE) AS ly1, CAST(o_orderkey % 700 + 12 AS DOUBLE) AS ly2, CASE WHEN o_orderkey % 50 <> 7 THEN o_orderkey % 9 END AS target, CASE WHEN o_orderkey % 31 = 0 THEN ' ' ELSE 'w' || (o_orderkey % 900) END AS link_text FROM orders),
 pieces AS (SELECT p_partkey // 40 AS doc_id, p_partkey % 8 AS page, p_partkey AS pos, 'w' || p_partkey || ' 7 w' || p_partkey % 9 AS text, CAST(p_partkey * 7 % 520 AS DOUBLE) AS ix1, CAST(p_partkey * 7 % 520 + 40 AS DOUBLE) AS ix2, CAST(p_partkey * 11 % 720 AS DOUBLE) AS iy1, CAST(p_partkey * 11 % 720 + 10 AS DOUBLE) AS iy2 FROM part)"""


def links(spark, folder):
    k = F.col("o_orderkey")
    num = lambda c: c.cast("double")
    text = F.when(k % 31 == 0, " ").otherwise(F.concat(F.lit("w"), (k % 900).cast("string")))
    return spark.read.parquet(f"{folder}/orders.parquet").select(k.alias("link_id"), F.floor(k / 300).alias("doc_id"), (F.col("o_custkey") % 8).alias("page"), num(k % 500).alias("lx1"), num(k % 500 + 30).alias("lx2"), num(k % 700).alias("ly1"), num(k % 700 + 12).alias("ly2"), F.when(k % 50 != 7, k % 9).alias("target"), text.alias("link_text"))


def pieces(spark, folder):
    k = F.col("p_partkey")
    num = lambda c: c.cast("double")
    text = F.concat(F.lit("w"), k.cast("string"), F.lit(" 7 w"), (k % 9).cast("string"))
    return spark.read.parquet(f"{folder}/part.parquet").select(F.floor(k / 40).alias("doc_id"), (k % 8).alias("page"), k.alias("pos"), text.alias("text"), num(k * 7 % 520).alias("ix1"), num(k * 7 % 520 + 40).alias("ix2"), num(k * 11 % 720).alias("iy1"), num(k * 11 % 720 + 10).alias("iy2"))


def boxes(spark, folder):
    p = pieces(spark, folder)
    return p.select("doc_id", "page", F.col("pos").alias("chunk_id"), F.col("text").alias("chunk_text"), F.col("ix1").alias("cx1"), F.col("ix2").alias("cx2"), F.col("iy1").alias("cy1"), F.col("iy2").alias("cy2"))


@query("j09_text_under_links", "WITH " + RECTS + " SELECT link_id, l.doc_id, l.page, CASE WHEN count(pos) = 0 THEN 'Link' ELSE string_agg(text, ' ' ORDER BY pos) END AS text FROM links l LEFT JOIN pieces i ON l.doc_id = i.doc_id AND l.page = i.page AND lx1 <= ix2 AND ix1 <= lx2 AND ly1 <= iy2 AND iy1 <= ly2 GROUP BY ALL")
def j09(spark, folder):
    return L.text_under(links(spark, folder), pieces(spark, folder))


@query("j10_o12_nearest_chunk", "WITH " + RECTS + " SELECT link_id AS point_id, arg_min(pos, (power(lx1 - (ix1 + ix2) / 2, 2) + power(ly1 - (iy1 + iy2) / 2, 2), pos)) AS chunk_id FROM links l JOIN pieces i ON l.doc_id = i.doc_id AND l.page = i.page AND lx1 BETWEEN ix1 - 50 AND ix2 + 50 AND ly1 BETWEEN iy1 - 50 AND iy2 + 50 GROUP BY 1")
def j10(spark, folder):
    points = links(spark, folder).select(F.col("link_id").alias("point_id"), "doc_id", "page", F.col("lx1").alias("x"), F.col("ly1").alias("y"))
    return L.nearest_chunk(points, boxes(spark, folder))


@query("j08_resolved_links", "WITH " + RECTS + """, m AS (SELECT link_id, pos, CASE WHEN coalesce(ly1 BETWEEN iy1 AND iy2, false) THEN 1 WHEN length(trim(link_text)) <= 3 AND contains(' ' || text || ' ', ' ' || trim(link_text) || ' ') THEN 2 WHEN contains(text, trim(link_text)) THEN 3 ELSE 4 END AS level FROM links l LEFT JOIN pieces i ON l.doc_id = i.doc_id AND l.target = i.page)
 SELECT link_id, arg_min(pos, (level, pos)) AS chunk_id, CASE WHEN count(pos) > 0 THEN min(level) END AS level FROM m GROUP BY link_id""")
def j08(spark, folder):
    return L.resolved(links(spark, folder).withColumn("link_y", F.col("ly1")), boxes(spark, folder))


@query("j23_index_resolved_links", "WITH " + RECTS + r""", e AS (SELECT link_id, l.doc_id, trim(link_text) AS t, unnest(CASE WHEN link_id % 3 = 0 THEN [link_id % 8] ELSE range(link_id % 8, link_id % 8 + 2) END) AS page FROM links l),
 m AS (SELECT link_id, pos, i.page, CASE WHEN length(t) <= 3 THEN CASE WHEN regexp_matches(text, '(^|\s)' || t || '(\.|\s|$)') THEN 0 ELSE 1 END WHEN contains(text, t) THEN 0 ELSE 1 END AS plain FROM e JOIN pieces i USING (doc_id, page)) SELECT link_id, arg_min(pos, (plain, page, pos)) AS chunk_id, min(plain) = 0 AS by_pattern FROM m GROUP BY link_id""")
def j23(spark, folder):
    page = F.col("link_id") % 8
    entry = F.when(F.col("link_id") % 3 == 0, "no page").otherwise(F.concat(F.lit("Smith "), page.cast("string"), F.lit("-"), (page + 1).cast("string")))
    return L.resolved_by_index(links(spark, folder).withColumn("entry", entry).withColumn("target", page), boxes(spark, folder))


@query("j11_target_chunks", "WITH " + RECTS + " SELECT pos AS chunk_id, (doc_id, page) IN (SELECT (doc_id, target) FROM links WHERE target IS NOT NULL) AS is_target FROM pieces")
def j11(spark, folder):
    return L.with_targets(boxes(spark, folder), links(spark, folder)).select("chunk_id", "is_target")


@query("j13_a24_link_faults", "WITH " + RECTS + ", p AS (SELECT DISTINCT doc_id, page FROM pieces) SELECT concat_ws(',', CASE WHEN target IS NULL THEN 'no target' END, CASE WHEN target IS NOT NULL AND p.page IS NULL THEN 'out of range' END, CASE WHEN trim(link_text) = '' THEN 'empty text' END) AS faults, count(*) AS n FROM links l LEFT JOIN p ON p.doc_id = l.doc_id AND p.page = l.target GROUP BY 1")
def j13(spark, folder):
    found = L.link_faults(links(spark, folder), pieces(spark, folder).select("doc_id", "page").distinct())
    return found.groupBy(F.array_join("faults", ",").alias("faults")).agg(F.count("*").alias("n"))


@query("j06_chunks_with_links", "WITH " + RECTS + ", l AS (SELECT doc_id, page, count(*) AS n, min(link_id) AS first FROM links GROUP BY ALL) SELECT pos AS chunk_id, coalesce(n, 0) AS links, first FROM pieces LEFT JOIN l USING (doc_id, page)")
def j06(spark, folder):
    done = L.with_links(boxes(spark, folder), links(spark, folder))
    return done.select("chunk_id", F.size("links").cast("long").alias("links"), F.array_min("links").alias("first"))


@query("a20_page_bounds", "WITH " + RECTS + " SELECT doc_id, page, min(ix1) AS min_x, max(ix2) AS max_x, min(iy1) AS min_y, max(iy2) AS max_y FROM pieces GROUP BY ALL")
def a20(spark, folder):
    return pieces(spark, folder).groupBy("doc_id", "page").agg(F.min("ix1").alias("min_x"), F.max("ix2").alias("max_x"), F.min("iy1").alias("min_y"), F.max("iy2").alias("max_y"))


@query("a22_images_by_page", cte("images") + "SELECT page_number AS page, count(*) AS images FROM images GROUP BY 1 HAVING count(*) > 0")
def a22(spark, folder):
    return frame(spark, folder, "images").groupBy(F.col("page_number").alias("page")).agg(F.count("*").alias("images")).where("images > 0")


@query("j07_images_of_chapters", cte("chunk_rows", "images") + ", " + CHAPTERS + ", c AS (SELECT book_id, chapter_number, chapter_number * 3 AS first_page, chapter_number * 3 + book_id % 9 AS last_page FROM chapters) SELECT book_id, chapter_number, image_id FROM c JOIN images ON page_number BETWEEN first_page AND last_page")
def j07(spark, folder):
    c = chapters(spark, folder).select("book_id", "chapter_number", (F.col("chapter_number") * 3).cast("long").alias("first_page"), (F.col("chapter_number") * 3 + F.col("book_id") % 9).alias("last_page"))
    return L.images_of_chapters(c, frame(spark, folder, "images").select("image_id", "page_number")).select("book_id", "chapter_number", "image_id")


@query("j20_images_by_place", cte("images") + ", s AS (SELECT doc_id, page, n + page % 2 AS n FROM (SELECT image_id % 20 AS doc_id, page_number AS page, count(*) AS n FROM images GROUP BY ALL)), p AS (SELECT doc_id, page, unnest(range(1, n + 1)) AS nth FROM s), q AS (SELECT doc_id, page, CAST(nth AS INT) AS nth, row_number() OVER (PARTITION BY doc_id ORDER BY page, nth) AS i FROM p), f AS (SELECT image_id % 20 AS doc_id, file_name, row_number() OVER (PARTITION BY image_id % 20 ORDER BY file_name) AS i FROM images) SELECT doc_id, page, nth, file_name, file_name IS NULL AS placeholder FROM q LEFT JOIN f USING (doc_id, i)")
def j20(spark, folder):
    images = frame(spark, folder, "images").select((F.col("image_id") % 20).alias("doc_id"), F.col("page_number").alias("page"), "file_name")
    slots = images.groupBy("doc_id", "page").agg(F.count("*").alias("n")).select("doc_id", "page", (F.col("n") + F.col("page") % 2).alias("images"))
    return L.images_by_place(slots, images.select("doc_id", "file_name"))


@query("x20_estimated_rectangles", "WITH " + RECTS + ", n AS (SELECT pos AS chunk_id, count(*) OVER (PARTITION BY doc_id, page) AS n, row_number() OVER (PARTITION BY doc_id, page ORDER BY pos) - 1 AS i FROM pieces) SELECT chunk_id, round(792.0 - i * 792.0 / n, 4) AS top, round(792.0 - (i + 1) * 792.0 / n, 4) AS bottom FROM n")
def x20(spark, folder):
    return L.estimated_rectangles(boxes(spark, folder).select("doc_id", "page", "chunk_id")).select("chunk_id", F.round("cy2", 4).alias("top"), F.round("cy1", 4).alias("bottom"))


@query("j19_word_at_time", "WITH m AS (SELECT user_id, event_id AS word, value AS mark FROM events WHERE event_type = 'view'), t AS (SELECT user_id, event_id, value AS t FROM events WHERE event_type = 'click'), l AS (SELECT *, lead(mark) OVER w AS e, row_number() OVER w = 1 AS f FROM m WINDOW w AS (PARTITION BY user_id ORDER BY mark, word)) SELECT event_id, word FROM t JOIN l USING (user_id) WHERE (f OR t >= mark) AND (e IS NULL OR t < e)")
def j19(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet")
    marks = events.where("event_type = 'view'").select("user_id", F.col("event_id").alias("word"), F.col("value").alias("mark"))
    times = events.where("event_type = 'click'").select("user_id", "event_id", F.col("value").alias("t"))
    return L.word_at(times, marks, ["user_id"]).select("event_id", "word")


@query("j14_sections_by_number", cte("chunk_rows") + """, m AS (SELECT DISTINCT book_id, chapter_number FROM chunk_rows), t AS (SELECT book_id, chapter_number, line % 3 AS pos, list(side ORDER BY side) AS sections FROM (SELECT DISTINCT book_id, chapter_number, line, side FROM chunk_rows WHERE book_id % 4 <> 1) GROUP BY ALL),
 f AS (SELECT book_id, chapter_number, arg_min(sections, pos) AS sections FROM t GROUP BY ALL) SELECT m.book_id, m.chapter_number, coalesce(array_to_string(sections, ','), '') AS sections FROM m LEFT JOIN f USING (book_id, chapter_number)""")
def j14(spark, folder):
    rows = frame(spark, folder, "chunk_rows")
    sides = rows.where("book_id % 4 <> 1").select("book_id", "chapter_number", "line", "side").distinct()
    contents = sides.groupBy("book_id", "chapter_number", (F.col("line") % 3).alias("pos")).agg(F.sort_array(F.collect_list("side")).alias("sections"))
    done = L.with_sections(rows.select("book_id", "chapter_number").distinct(), contents, ["book_id"])
    return done.select("book_id", "chapter_number", F.array_join("sections", ",").alias("sections"))
