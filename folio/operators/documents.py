"""Documents to chapters: outlines, tables of contents, headings, page-aware chunks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.functions.chunker import by_text
from folio.sources.files import shared_path

SENTENCE = re.compile(r"[^.!?]+[.!?]")

#: Digits of a position in a path; as many as the largest one has.
PLACES = 19
LEAST_CHAPTER = 200
LEAST_PAGE = 50


def outline_paths(outline: DataFrame, most_levels: int = 100) -> DataFrame:
    """Entries (id, parent, title, pos) of an outline with depth and a path that sorts depth first; what is called contents is left out with all below.

    Level by level, each written before the next is joined to it, so plans don't grow with the depth.
    """
    spark = outline.sparkSession
    path = shared_path(spark, "outline")
    entries = outline.where(F.lower("title") != "contents").withColumn("_place", F.lpad(F.col("pos").cast("string"), PLACES, "0"))
    level = entries.where("parent is null").select("id", "title", F.lit(0).alias("depth"), F.col("_place").alias("path"))
    for depth in range(most_levels):
        level.write.parquet(f"{path}/level-{depth}")
        done = spark.read.schema(level.schema).parquet(f"{path}/level-{depth}")
        if done.isEmpty():
            return spark.read.schema(level.schema).parquet(f"{path}/*")
        above = done.select(F.col("id").alias("_id"), F.col("path").alias("_path"))
        level = entries.join(above, F.col("parent") == F.col("_id")).select("id", "title", F.lit(depth + 1).alias("depth"), F.concat("_path", F.lit("."), "_place").alias("path"))
    raise ValueError(f"an outline with more than {most_levels} levels, or one that goes round")


# fixed values: what a chapter's line begins with, what a line of publishing data begins with, and what a reference has
CHAPTER_PATTERNS = (rf"(?iu)^chapter{T.SPACE}\w+", rf"^\d+[.:]{T.SPACE}[^{T.SPACES}]", rf"(?iu)^[a-z][a-z{T.SPACES}]{{4,}}\z")
PUBLISHING = "isbn|copyright|typeset|printed|published|all rights|first published|volume"
REFERENCE = r"\(\w+,|\d{4}\)|press|oxford|university|journal"


def chapter_line(line: Column, patterns: tuple[str, ...] = CHAPTER_PATTERNS) -> Column:
    """Whether a line can be a chapter's heading: it fits a pattern, and is no page number, publishing data, part of a sentence or reference."""
    t = T.trimmed(line)
    fits = F.lit(False)
    for p in patterns:
        fits = fits | t.rlike(p)
    part = t.rlike("[,;]") | t.rlike(r"(?:of|the|and)\z")
    return fits & ~t.rlike(rf"(?iu)^(?:page{T.SPACE})?\d+\z") & ~t.rlike(f"(?iu)^(?:{PUBLISHING})") & F.char_length(t).between(5, 50) & ~part & ~t.rlike(f"(?iu){REFERENCE}")


def without_heading(text: Column, title: Column) -> Column:
    """A text without its chapter's title, where that stands in the first 200 letters and enough is left."""
    plain = F.upper(F.regexp_replace(title, "[:?]", ""))
    at = F.instr(F.upper(text), plain)
    left = T.trimmed(F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.char_length(plain), F.char_length(text))))
    return F.when((at > 0) & (at <= LEAST_CHAPTER) & (F.char_length(left) > 10), joined_first_letter(left)).otherwise(text)


def joined_first_letter(text: Column) -> Column:
    return F.regexp_replace(text, rf"^([A-Z]){T.SPACE}([a-z])", "$1$2")


def goes_on(first: Column, second: Column, first_kind: Column | None = None, second_kind: Column | None = None) -> Column:
    """Whether a second piece of text goes on with the first one's sentence; never a header. It begins with a small letter, so it is no heading
    by its looks, as these begin with a large one."""
    a, b = T.trimmed(first), T.trimmed(second)
    plain = F.lit(True)
    for kind in (first_kind, second_kind):
        if kind is not None:
            plain = plain & F.coalesce(kind != "header", F.lit(True))
    small = b.rlike("^[a-z]")
    open_ = ~a.rlike(r"[.!?;:]\z")
    short = a.rlike(r"\b\w{1,3}\.\z") | T.ends_abbreviated(a)
    return plain & small & (F.char_length(a) > 0) & (open_ | (a.endswith(".") & short))


def marked_lines(lines: DataFrame, heading: Column) -> DataFrame:
    """(doc_id, line, is_heading, title, chars): what ``sections_of`` asks of lines, so that their texts are not dealt."""
    return lines.select("doc_id", "line", F.coalesce(heading, F.lit(False)).alias("is_heading"), F.char_length("text").cast("long").alias("chars"), "text").select(
        "doc_id", "line", "is_heading", F.when(F.col("is_heading"), T.trimmed("text")).alias("title"), "chars"
    )


def sections(lines: DataFrame, heading: Column) -> DataFrame:
    """(doc_id, chapter, title, chars) of the parts between heading lines; short ones are dropped, and a document without any is one chapter."""
    return sections_of(marked_lines(lines, heading))


def sections_of(marked: DataFrame) -> DataFrame:
    """``sections`` of ``marked_lines``."""
    w = Window.partitionBy("doc_id").orderBy("line")
    placed = marked.withColumn("chapter", F.sum(F.col("is_heading").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = placed.where("chapter > 0").groupBy("doc_id", "chapter").agg(F.max("title").alias("title"), F.sum(F.when(~F.col("is_heading"), F.col("chars")).otherwise(0)).alias("chars"))
    parts = parts.where(F.col("chars") > LEAST_CHAPTER)
    whole = marked.groupBy("doc_id").agg(F.sum("chars").alias("chars"))
    none = whole.join(parts.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.lit(0).cast("long").alias("chapter"), F.lit("Full Text").alias("title"), "chars")
    return parts.unionByName(none)


def pages_of_contents(toc: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages (doc_id, page, chars, ..) with the chapter of a table (doc_id, chapter, start_page) that they are in, without pages of little text.

    Each page finds its chapter as the last start that isn't behind it, by a window over both.
    """
    starts = toc.select("doc_id", F.col("start_page").alias("page"), "chapter", F.lit(0).alias("kind"))
    both = pages.withColumn("kind", F.lit(1)).unionByName(starts, allowMissingColumns=True)
    w = Window.partitionBy("doc_id").orderBy("page", "kind", "chapter").rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("chapter", F.last("chapter", ignorenulls=True).over(w))
    return placed.where((F.col("kind") == 1) & F.col("chapter").isNotNull() & (F.col("chars") > LEAST_PAGE)).drop("kind")


def chapters_of_contents(toc: DataFrame, pages: DataFrame) -> DataFrame:
    """Chapters (doc_id, chapter, start_page) with their pages' texts: up to the next start, and only of pages with text."""
    placed = pages_of_contents(toc, pages.withColumn("chars", F.char_length("text")))
    return placed.groupBy("doc_id", "chapter").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count("*").alias("pages"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n").alias("text"))


def preferred(first: DataFrame, second: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of the first for keys that it has, else those of the second."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"))


def buffered_sentences(texts: DataFrame, key: str, text: str, least: int = 5) -> DataFrame:
    """(key, nth, text): sentences, joined until each has so many words; what is left at the end stands alone. In batches, as a sentence's place hangs on those before."""

    def rows(k, t):
        held, n, nth = [], 0, 0
        t = t or ""
        # behind the last closing sign nothing can match, and looking for it from every place would take long
        for found in SENTENCE.finditer(t[: max(t.rfind(c) for c in ".!?") + 1]):
            part = found.group()
            words = part.split()
            if words:
                held.append(part.strip())
                n += len(words)
            if n >= least:
                yield k, nth, " ".join(held)
                held, n, nth = [], 0, nth + 1
        if held:
            yield k, nth, " ".join(held)

    return by_text(texts, key, text, rows, {key: dict(texts.dtypes)[key], "nth": "int", "text": "string"})


def split_at(text: Column, markers: list[str]) -> Column:
    """The parts of a text from each marker to the next one that is found."""
    places = F.array_sort(F.filter(F.array(*[F.struct(F.instr(text, m).alias("at"), F.lit(m).alias("marker")) for m in markers]), lambda p: p["at"] > 0))

    def part(p: Column, i: Column) -> Column:
        end = F.coalesce(F.get(places, i + 1)["at"], F.char_length(text) + 1)
        return F.struct(p["marker"].alias("marker"), F.substring(text, p["at"], end - p["at"]).alias("text"))

    return F.transform(places, part)
