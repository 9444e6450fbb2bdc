"""Summaries of parsed books: a row for each chapter, with its book's totals beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PREVIEW_CHUNKS, PREVIEW_LETTERS = 3, 200


def with_totals(chapters: DataFrame, names: list[str]) -> DataFrame:
    """The chapters with their number and the sums of these columns over their book."""
    book = Window.partitionBy("book_id")
    totals = [F.sum(n).over(book).alias(f"total_{n}") for n in names]
    return chapters.select("*", F.count("*").over(book).alias("total_chapters"), *totals)


def parser_summary(chapters: DataFrame) -> DataFrame:
    """Of chapters (book_id, chapter_number, words, chunks, links, first_page, last_page, images): sizes, page range, totals."""
    flat = chapters.select("book_id", "chapter_number", "words", "chunks", F.concat_ws("-", F.col("first_page").cast("string"), F.col("last_page").cast("string")).alias("page_range"), F.size("images").cast("long").alias("images"), "links")
    return with_totals(flat, ["chunks", "words", "images", "links"])


def book_summary(chunks: DataFrame) -> DataFrame:
    """Of chunks (book_id, chapter_number, chunk_index, text, type, word_count): sizes, the beginning of the first text chunks, totals and rounded means."""
    is_text = F.col("type") == "text"
    # only the first few texts of a chapter are gathered
    ranked = chunks.withColumn("_nth", F.row_number().over(Window.partitionBy("book_id", "chapter_number", "type").orderBy("chunk_index")))
    first = F.array_sort(F.collect_list(F.when(is_text & (F.col("_nth") <= PREVIEW_CHUNKS), F.struct("chunk_index", "text"))))
    preview = F.concat(F.substring(F.array_join(F.transform(first, lambda c: c["text"]), " "), 1, PREVIEW_LETTERS), F.lit("..."))
    flat = ranked.groupBy("book_id", "chapter_number").agg(F.count_if(is_text).alias("text_chunks"), F.count("*").alias("chunks"), F.sum("word_count").alias("words"), preview.alias("preview"))
    mean = lambda name: F.round(F.col(f"total_{name}") / F.col("total_chapters")).cast("long").alias(f"mean_{name}")
    return with_totals(flat, ["words", "chunks"]).select("*", mean("words"), mean("chunks"))
