"""Page layout: lines from positioned items, links and their targets, images, chapters over pages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text as T

LINE_GAP = 5
TOLERANCE = 50
#: Side of a cell of the grid in points, and how many cells a rectangle may touch before it meets its whole page.
CELL, MOST_CELLS = 64.0, 256
#: Rows of a key beyond which it is parted, and into how many runs.
RUN_ROWS, RUNS = 200_000, 256
#: Images of a page that go together, about how many chapters meet them at once, and how many of such groups are dealt together.
BLOCK_IMAGES, GROUP_CHAPTERS, PART_GROUPS = 256, 64, 256


def lines_of_items(items: DataFrame) -> DataFrame:
    """Lines of a page: a new one where an item is further than the gap from the item before. Blank items only move the place."""
    w = Window.partitionBy("doc_id", "page").orderBy("pos", "y")
    y = F.round("y")
    new = F.when(F.abs(y - F.lag(y).over(w)) > LINE_GAP, 1).otherwise(0)
    marked = items.withColumn("_new", new).withColumn("line", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    full = marked.where(F.trim("text") != "")
    return full.groupBy("doc_id", "page", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "y", "text"))), lambda r: r["text"]), " ").alias("text"), F.count("*").alias("items"))


def lines_by_first_item(items: DataFrame) -> DataFrame:
    """As above, but against the first item of the line, which is carried from item to item: a page's items in batches of pages."""
    pages = items.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("pos", F.round("y").alias("y"), "text"))).alias("items"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for doc, page, rows in zip(f["doc_id"], f["page"], f["items"], strict=True):
                first, line, texts = None, 0, []
                for r in rows:
                    if first is None:
                        first = r["y"]
                    elif abs(r["y"] - first) > LINE_GAP:
                        out.append((doc, page, line, " ".join(texts)))
                        first, line, texts = r["y"], line + 1, []
                    texts.append(r["text"])
                out.append((doc, page, line, " ".join(texts)))
            yield pd.DataFrame(out, columns=["doc_id", "page", "line", "text"])

    kinds = dict(items.dtypes)
    return pages.mapInPandas(run, f"doc_id {kinds['doc_id']}, page {kinds['page']}, line int, text string")


def overlaps(a: str, b: str) -> Column:
    """Whether two rectangles (x1, y1, x2, y2 with a prefix) share a point."""
    return (F.col(f"{a}x1") <= F.col(f"{b}x2")) & (F.col(f"{b}x1") <= F.col(f"{a}x2")) & (F.col(f"{a}y1") <= F.col(f"{b}y2")) & (F.col(f"{b}y1") <= F.col(f"{a}y2"))


def in_cells(rects: DataFrame, p: str, grow: float = 0.0, cell: float = CELL) -> tuple[DataFrame, DataFrame]:
    """Rectangles of a prefix in each cell (``_cx``, ``_cy``) that they touch, and apart those of ``no_cells``.

    A rectangle without all four corners touches nothing and is in neither.
    """
    low, high = lambda c: F.floor((F.col(p + c) - grow) / cell), lambda c: F.floor((F.col(p + c) + grow) / cell)
    whole = rects.where(F.expr(" and ".join(f"{p}{c} is not null" for c in ("x1", "x2", "y1", "y2")))).withColumn("_apart", no_cells(p, grow, cell))
    narrow = whole.where(~F.col("_apart")).withColumn("_cx", F.explode(F.sequence(low("x1"), high("x2")))).withColumn("_cy", F.explode(F.sequence(low("y1"), high("y2"))))
    return narrow.drop("_apart"), whole.where("_apart").drop("_apart")


def no_cells(p: str, grow: float = 0.0, cell: float = CELL) -> Column:
    """Whether a rectangle touches more than ``MOST_CELLS`` cells or has its corners exchanged, so that it is to meet its whole page."""
    n = [(F.floor((F.col(p + c + "2") + grow) / cell) - F.floor((F.col(p + c + "1") - grow) / cell) + 1).cast("double") for c in ("x", "y")]
    return F.coalesce((n[0] * n[1] > MOST_CELLS) | (F.col(p + "x1") > F.col(p + "x2")) | (F.col(p + "y1") > F.col(p + "y2")), F.lit(False))


def touching(a: DataFrame, b: DataFrame, p: str, q: str, cell: float = CELL) -> DataFrame:
    """Pairs of rectangles of one document's page (``doc_id``, ``page``) that share a point, each pair once.

    By a grid: only what lies in one cell meets, and the cell of the lower corner of what both share gives out the pair. What is
    not in cells meets all of its page. The joins are sorted ones at all sizes: of rows in cells, which are many times their
    rectangles, the planner knows no size, and would send them through the driver.
    """
    (small_a, wide_a), (small_b, wide_b) = in_cells(a, p, cell=cell), in_cells(b, q, cell=cell)
    near = small_a.join(small_b.hint("merge"), ["doc_id", "page", "_cx", "_cy"]).where(overlaps(p, q))
    corner = [F.floor(F.greatest(F.col(p + c), F.col(q + c)) / cell) == F.col(k) for c, k in (("x1", "_cx"), ("y1", "_cy"))]
    columns = ["doc_id", "page", *[c for d in (a, b) for c in d.columns if c not in ("doc_id", "page")]]
    far = wide_a.join(b.hint("merge"), ["doc_id", "page"]).where(overlaps(p, q))
    rest = a.join(wide_b.hint("merge"), ["doc_id", "page"]).where(overlaps(p, q) & ~no_cells(p, cell=cell))
    return near.where(corner[0] & corner[1]).select(*columns).unionByName(far.select(*columns)).unionByName(rest.select(*columns))


def text_under(links: DataFrame, items: DataFrame, cell: float = CELL) -> DataFrame:
    """links (link_id, doc_id, page, l..) with the items (doc_id, page, pos, text, i..) that their rectangle touches, in order; "Link" if none."""
    places = links.select("link_id", "doc_id", "page", "lx1", "lx2", "ly1", "ly2")
    touched = touching(places, items.select("doc_id", "page", "pos", "text", "ix1", "ix2", "iy1", "iy2"), "l", "i", cell)
    found = touched.groupBy("link_id", "doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda r: r["text"]), " ").alias("text"))
    return links.select("link_id", "doc_id", "page").join(found, ["link_id", "doc_id", "page"], "left").withColumn("text", F.coalesce("text", F.lit("Link")))


def nearest_chunk(points: DataFrame, chunks: DataFrame, tolerance: float = TOLERANCE, cell: float = CELL) -> DataFrame:
    """points (point_id, doc_id, page, x, y) with the chunk of the page whose rectangle, widened, has the point and whose middle is nearest.

    By a grid too, and by sorted joins: a point is in one cell, and meets the chunks that reach it.
    """
    inside = F.col("x").between(F.col("cx1") - tolerance, F.col("cx2") + tolerance) & F.col("y").between(F.col("cy1") - tolerance, F.col("cy2") + tolerance)
    middle = F.pow(F.col("x") - (F.col("cx1") + F.col("cx2")) / 2, 2) + F.pow(F.col("y") - (F.col("cy1") + F.col("cy2")) / 2, 2)
    placed, wide = in_cells(chunks, "c", tolerance, cell)
    near = points.withColumns({"_cx": F.floor(F.col("x") / cell), "_cy": F.floor(F.col("y") / cell)}).join(placed.hint("merge"), ["doc_id", "page", "_cx", "_cy"]).drop("_cx", "_cy")
    met = near.unionByName(points.join(wide.hint("merge"), ["doc_id", "page"])).where(inside)
    return met.groupBy("point_id").agg(F.min_by("chunk_id", F.struct(middle, F.col("chunk_id"))).alias("chunk_id"))


def resolved(links: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each link's chunk on its document's target page: one that its point is in, one that has its text as a mark, one that has its text, or the first."""
    met = links.join(chunks.withColumnRenamed("page", "target"), ["doc_id", "target"], "left")
    t = F.trim("link_text")
    in_point = F.coalesce(F.col("link_y").between(F.col("cy1"), F.col("cy2")), F.lit(False))
    marked = (F.char_length(t) <= 3) & F.concat(F.lit(" "), F.col("chunk_text"), F.lit(" ")).contains(F.concat(F.lit(" "), t, F.lit(" ")))
    level = F.when(in_point, 1).when(marked, 2).when(F.col("chunk_text").contains(t), 3).otherwise(4)
    return met.groupBy("link_id").agg(F.min_by(F.struct("chunk_id", level.alias("level")), F.struct(level, F.col("chunk_id"))).alias("b")).select("link_id", "b.chunk_id", F.when(F.col("b.chunk_id").isNotNull(), F.col("b.level")).alias("level"))


def resolved_by_index(links: DataFrame, chunks: DataFrame) -> DataFrame:
    """Links (link_id, doc_id, target, link_text, entry) of an index or of footnotes: the first chunk that has the footnote's pattern, on the
    pages that the entry names or else on the target page, or the first chunk of these pages."""
    named = F.transform(T.index_pages(F.col("entry")), lambda p: p.cast("bigint"))
    pages = links.select("link_id", "doc_id", "link_text", F.explode(F.when(F.size(named) > 0, named).otherwise(F.array(F.col("target").cast("bigint")))).alias("page"))
    met = pages.join(chunks, ["doc_id", "page"])
    plain = F.when(F.regexp(F.col("chunk_text"), T.footnote_pattern(F.col("link_text"))), 0).otherwise(1)
    return met.groupBy("link_id").agg(F.min_by(F.struct("chunk_id", plain.alias("plain")), F.struct(plain, F.col("page"), F.col("chunk_id"))).alias("b")).select("link_id", "b.chunk_id", (F.col("b.plain") == 0).alias("by_pattern"))


def link_faults(links: DataFrame, pages: DataFrame) -> DataFrame:
    """What is wrong with each link, as a list."""
    known = pages.select("doc_id", F.col("page").alias("target"), F.lit(True).alias("_there"))
    joined = links.join(known, ["doc_id", "target"], "left")
    faults = F.array_compact(F.array(F.when(F.col("target").isNull(), "no target"), F.when(F.col("target").isNotNull() & F.col("_there").isNull(), "out of range"), F.when(F.trim("link_text") == "", "empty text")))
    return joined.select("link_id", faults.alias("faults"))


def with_targets(chunks: DataFrame, links: DataFrame) -> DataFrame:
    """Chunks with ``is_target``: whether a link of their document goes to their page."""
    targets = links.select("doc_id", F.col("target").alias("page")).distinct().withColumn("_target", F.lit(True))
    return chunks.join(targets, ["doc_id", "page"], "left").withColumn("is_target", F.coalesce("_target", F.lit(False))).drop("_target")


def with_links(chunks: DataFrame, links: DataFrame) -> DataFrame:
    """Chunks with all links of their page."""
    by_page = links.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list("link_id")).alias("links"))
    return chunks.join(by_page, ["doc_id", "page"], "left").withColumn("links", F.coalesce("links", F.array().cast("array<bigint>")))


def page_aware(chunks: DataFrame, links: DataFrame) -> DataFrame:
    """Chunks (book_id, chapter_number, chunk_index, start_page, end_page and what else) with ids, pages and the links of their page.

    Ids run over a book's chapters from 1. A chapter's pages share its chunks evenly, the last page has what is left.
    """
    chapters = chunks.groupBy("book_id", "chapter_number").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("book_id").orderBy("chapter_number").rowsBetween(Window.unboundedPreceding, -1)
    chapters = chapters.withColumn("_earlier", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    pages = F.col("end_page") - F.col("start_page") + 1
    placed = chunks.join(chapters, ["book_id", "chapter_number"])
    inside = F.row_number().over(Window.partitionBy("book_id", "chapter_number").orderBy("chunk_index"))
    placed = placed.withColumn("chunk_id", F.col("_earlier") + inside).withColumn("page", (F.col("start_page") + F.least(pages - 1, F.floor((inside - 1) / F.ceil(F.col("_n") / pages)))).cast("long"))
    of_page = links.groupBy("book_id", "page").agg(F.sort_array(F.collect_list("link_id")).alias("links"))
    return placed.drop("_n", "_earlier").join(of_page, ["book_id", "page"], "left").withColumn("links", F.coalesce("links", F.array().cast("array<bigint>")))


def chapters_of_chunks(chunks: DataFrame, images: DataFrame) -> DataFrame:
    """Chapters of ``page_aware`` chunks with words, chunks, links, their pages in order, and the images from the first to the last page."""
    chapters = chunks.groupBy("book_id", "chapter_number").agg(
        F.sum("word_count").alias("words"), F.count("*").alias("chunks"), F.sum(F.size("links")).alias("links"), F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.sort_array(F.collect_set("page")).alias("pages"),
    )
    spans = chapters.select("book_id", "chapter_number", "first_page", "last_page")
    shown = spans.join(images, "book_id").where(F.col("page_number").between(F.col("first_page"), F.col("last_page")))
    shown = shown.groupBy("book_id", "chapter_number").agg(F.array_sort(F.collect_list(F.struct("page_number", "image"))).alias("images"))
    return chapters.join(shown, ["book_id", "chapter_number"], "left").withColumn("images", F.transform(F.coalesce("images", F.array().cast("array<struct<page_number:bigint,image:string>>")), lambda i: i["image"]))


def images_of_chapters(chapters: DataFrame, images: DataFrame) -> DataFrame:
    """Chapters (first_page, last_page) with the images of their pages (page_number); by page buckets, so the range join is an equi-join.

    Groups of chapters meet blocks of a page's images, so that a file repeats a short run of images for chapter after chapter, which takes
    less than a fifth of a byte a row, however many images a page has. A bucket is dealt to tasks by its chapters, and the number of
    tasks is the session's: by bytes, which adaptive execution goes by, these rows look few. The coalesce parts nothing anew: it ends
    the join's generated code, which would hold all rows of a block otherwise.
    """
    size, tasks = 10, int(chapters.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spans = chapters.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("first_page") / size), F.floor(F.col("last_page") / size))))
    parts = spans.groupBy("_bucket").agg(F.ceil(F.count("*") / (GROUP_CHAPTERS * PART_GROUPS)).alias("_parts"))
    keyed = spans.join(parts, "_bucket").withColumn("_group", F.pmod(F.xxhash64(*chapters.columns), F.col("_parts") * PART_GROUPS)).withColumn("_part", F.floor(F.col("_group") / PART_GROUPS))
    dealt = keyed.repartition(tasks, "_bucket", "_part").groupBy("_bucket", "_part", "_group").agg(F.collect_list(F.struct(*chapters.columns)).alias("_chapters"))
    order = Window.partitionBy("page_number").orderBy(*[c for c in images.columns if c != "page_number"])
    numbered = images.where("page_number is not null").withColumn("_block", F.floor((F.row_number().over(order) - 1) / BLOCK_IMAGES))
    blocks = numbered.groupBy(F.col("page_number").alias("_page"), "_block").agg(F.collect_list(F.struct(*images.columns)).alias("_images"))
    placed = blocks.withColumn("_bucket", F.floor(F.col("_page") / size)).join(parts, "_bucket").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    met = placed.repartition(tasks, "_bucket", "_part").join(dealt.hint("merge"), ["_bucket", "_part"]).select("_page", "_images", "_chapters").coalesce(tasks)
    found = met.select("_page", "_images", F.inline("_chapters")).where(F.col("_page").between(F.col("first_page"), F.col("last_page")))
    return found.select(*chapters.columns, F.inline("_images"))


def images_by_place(slots: DataFrame, files: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The i-th file of a document for its i-th place, of slots (keys, page, images); a place without a file is one to be filled."""
    if not keys:
        raise ValueError("places are counted by document: name the columns that tell documents apart")
    places = slots.where("images > 0").select(*keys, "page", F.explode(F.sequence(F.lit(1), F.col("images").cast("int"))).alias("nth"))
    w = Window.partitionBy(*keys)
    numbered = places.withColumn("i", F.row_number().over(w.orderBy("page", "nth")))
    return numbered.join(files.withColumn("i", F.row_number().over(w.orderBy("file_name"))), [*keys, "i"], "left").select(*keys, "page", "nth", "file_name", F.col("file_name").isNull().alias("placeholder"))


def estimated_rectangles(chunks: DataFrame, height: float = 792.0) -> DataFrame:
    """Chunks of a document's page share its height from the top."""
    w = Window.partitionBy("doc_id", "page")
    n, i = F.count("*").over(w), F.row_number().over(w.orderBy("chunk_id")) - 1
    return chunks.withColumn("cy2", height - i * height / n).withColumn("cy1", height - (i + 1) * height / n)


def word_at(times: DataFrame, marks: DataFrame, keys: list[str], run_rows: int = RUN_ROWS) -> DataFrame:
    """As-of join: for each time the word whose mark is the latest not after it, the first before all marks; none without marks.

    Marks (keys, word, mark) and times (keys, t, ..) stand in one order, and a time looks back to the last mark. A key with more than
    ``run_rows`` of them is parted into runs at its quantiles: inside a run by a window, and what is the last mark before a
    run comes from a second window over the runs of the key. A null time, key or mark: a null time stands before all marks,
    null keys match nothing, a null mark is none.
    """
    known = marks.where(F.col("mark").isNotNull()).select(*keys, F.col("mark").cast("double").alias("_at"), F.lit(0).alias("_kind"), "word")
    asked = times.withColumns({"_at": F.col("t").cast("double"), "_kind": F.lit(1)})
    both = known.unionByName(asked, allowMissingColumns=True).where(F.coalesce(*[F.col(k).isNotNull() for k in keys]))
    cuts = F.percentile_approx("_at", [i / RUNS for i in range(1, RUNS)])
    parted = both.groupBy(*keys).agg(F.count("*").alias("_n"), cuts.alias("_cuts")).where(F.col("_n") > run_rows).select(*keys, F.array_distinct("_cuts").alias("_cuts"))
    run = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("_at"))), F.lit(0))
    rows = both.join(parted, keys, "left").withColumn("_run", F.when(F.col("_cuts").isNull(), 0).otherwise(run)).drop("_cuts")
    mark = F.when(F.col("_kind") == 0, F.struct("_at", "word"))
    runs = rows.groupBy(*keys, "_run").agg(F.max(mark).alias("_last"), F.min(mark).alias("_first"))
    w = Window.partitionBy(*keys)
    before = F.last("_last", ignorenulls=True).over(w.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1))
    carried = runs.select(*keys, "_run", F.coalesce(before, F.min("_first").over(w)).alias("_carried"))
    inside = Window.partitionBy(*keys, "_run").orderBy("_at", "_kind", "word").rowsBetween(Window.unboundedPreceding, 0)
    latest = rows.withColumn("_latest", F.last(mark, ignorenulls=True).over(inside)).where("_kind = 1")
    met = latest.drop("word").join(carried, [*keys, "_run"]).withColumn("word", F.coalesce("_latest", "_carried")["word"])
    return met.where(F.coalesce("_latest", "_carried").isNotNull()).select(*times.columns, "word")


def with_sections(markers: DataFrame, contents: DataFrame, keys: list[str]) -> DataFrame:
    """Chapters (keys, chapter_number, ..) with the sections of the first entry of their book's contents (keys, chapter_number, pos, sections) that has
    their number; none where there is no such entry. A book's entries are few and its sections are those of one chapter, as they stand there."""
    first = contents.where(F.col("chapter_number").isNotNull()).groupBy(*keys, "chapter_number").agg(F.min_by("sections", "pos").alias("sections"))
    return markers.join(first, [*keys, "chapter_number"], "left").withColumn("sections", F.coalesce("sections", F.array().cast(dict(contents.dtypes)["sections"])))
