"""Titles with white space of all kinds, with letters that are no ASCII, and by both sets of rules."""

import re

import pytest
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators import chapters, documents, usage
from folio.plans import all_queries, registry  # noqa: F401


def one(spark, c):
    r = spark.range(1).select(c.alias("c")).first()["c"]
    return tuple(r) if r is not None and not isinstance(r, (str, bool, int)) else r


NB, BOM, EM = " ", "﻿", " "


@pytest.mark.parametrize(
    "line, want",
    [
        (f"1.{NB}The Search{EM}25", (1, None, "The Search", "25")), (f"{BOM}12 Air 7{NB}", (12, None, "Air", "7")), (f"INTRODUCTION:{NB}All of it{NB}ix", (0, None, f"INTRODUCTION:{NB}All of it", "ix")),
        (f"Appendix{NB}B: More{EM}9", (None, "Appendix B", f"Appendix{NB}B: More", "9")), (f"Letters{NB}only 3", (None, None, f"Letters{NB}only", "3")), (f"{BOM}Contents{NB}", None), ("1.\u0085The Search 25", None), ("99999999999 Far 1", (None, None, "Far", "1")),
    ],
)
def test_contents_lines(spark, line, want):
    assert one(spark, T.toc_entry(F.lit(line))) == want


@pytest.mark.parametrize(
    "title, first, second",
    [
        ("1. The Search", (1, None, "The Search"), (1, None, "The Search")), (f"7{NB}Air ", (7, None, "Air"), (7, None, "Air")), (f"{BOM}Chapter{EM}Two: Air", (2, None, f"Chapter{EM}Two: Air"), (2, None, "Air")),
        ("Chapter Twenty: Air", (20, None, "Chapter Twenty: Air"), None), ("Chapter Sixteen: Air", (16, None, "Chapter Sixteen: Air"), None), ("Chapter 4 Air", (None, None, "Chapter 4 Air"), (4, None, "Air")),
        ("An Introduction", (0, None, "An Introduction"), None), ("Introduction", (0, None, "Introduction"), (None, "introduction", "Introduction")), ("appendix b2 More", (None, "Appendix b2", "appendix b2 More"), None),
        ("EPILOGUE", (None, "Epilogue", "EPILOGUE"), (None, "epilogue", "EPILOGUE")), ("IV. Air", (None, None, "IV. Air"), (4, None, "Air")), ("XI. Air", (None, None, "XI. Air"), (None, "xi", "Air")),
        ("Notes", (None, None, "Notes"), None), ("", (None, None, ""), None), (None, (None, None, None), None),
    ],
)
def test_titles_by_both_sets_of_rules(spark, title, first, second):
    c = F.lit(title).cast("string")
    assert one(spark, T.chapter_of_title(c)) == first and one(spark, T.chapter_of_outline(c)) == second


def test_lines_of_books_are_trimmed_of_all_white_space(spark):
    docs = spark.createDataFrame([(1, f"{NB}{BOM}One{EM}\n{NB}\nTwo")], "doc_id long, text string")
    assert [tuple(r) for r in chapters.book_lines(docs).collect()] == [(1, 0, "One"), (1, 1, "Two")]
    assert one(spark, T.title_match(F.lit(f"{NB}The{EM}long title of it 12"), F.lit(f"The long{NB}title of it{BOM}")))


@pytest.mark.parametrize("line, want", [(f"CHAPTER{NB}Two", True), (f"3.{NB}Air", True), (f"page{NB}12", False), (f"{BOM}Quiet{EM}days", True), ("Quiet days,", False)])
def test_chapter_lines(spark, line, want):
    assert one(spark, documents.chapter_line(F.lit(line))) == want


def test_positions_of_seven_digits_stay_in_order(spark):
    rows = [(1, None, "root", 0), (2, 1, "b", 10_000_000), (3, 1, "a", 1_000_001), (4, 1, "c", 2_000_000_000)]
    found = documents.outline_paths(spark.createDataFrame(rows, "id long, parent long, title string, pos long")).orderBy("path")
    assert [r["title"] for r in found.collect()] == ["root", "a", "b", "c"]


@pytest.mark.parametrize("provider, voice, want", [("polly", "Burrow", "long-form"), ("polly", "Aria", "neural"), ("polly", "Kevin", "standard"), ("polly", "x-Neural2", "standard"), ("google", "de-Neural2-A", "neural"), ("google", "Aria", "standard"), ("elevenlabs", "Adam", "standard"), (None, None, "standard")])
def test_voice_classes(spark, provider, voice, want):
    assert one(spark, usage.voice_class(F.lit(provider).cast("string"), F.lit(voice).cast("string"))) == want


def plain_match(a, b):
    """Whether a folded line a matches a folded title b."""
    return a.startswith(b) or len(b) > 10 and (b in a or any(len(b) - k > 8 and a.startswith(b[k:]) for k in (1, 2, 3)))


def test_matches_beside_all_pairs(spark):
    """Titles of all shapes; lines that have them whole, cut at the front, going on behind, inside words, and over two lines."""
    import random

    rng = random.Random(8)
    names = ["", "A", "The", "Air", "Breathing", "A cat sat on it", "Introduction", "Acknowledgements", "On it all", "The Long Road Home", "Oxygenation advantages", "I am the walrus here", "Of mice", "Xy", "Two  words here", "ab cdefghijkl", "The Oxygen"]
    texts = []
    for _ in range(400):
        n = rng.choice(names)
        texts.append(rng.choice([n, n[rng.randint(0, 4) :], n + "s and more", "Re" + n.lower(), "in " + n + " 12", n[: len(n) // 2], n.upper(), "x" + n, n + " " + rng.choice(names)]) or "-")
    lines = spark.createDataFrame([(1 + i % 2, i // 2, t) for i, t in enumerate(texts)], "doc_id long, line int, text string")
    titles = spark.createDataFrame([(1, i, n) for i, n in enumerate(names) if n] + [(2, 5, "The Long Road Home"), (2, 3, "The Long"), (2, 9, None)], "doc_id long, nth int, title string")
    folded = {r["text"]: r["f"] for r in lines.select("text", T.folded(F.col("text")).alias("f")).collect()}
    rows = {(r["doc_id"], r["line"]): r["text"] for r in lines.collect()}
    after = lines.select("doc_id", "line", T.folded(F.concat("text", F.lit(" "), F.lead("text").over(chapters.Window.partitionBy("doc_id").orderBy("line")))).alias("two"))
    two = {(r["doc_id"], r["line"]): r["two"] for r in after.collect()}
    own = {1: [(n, one(spark, T.folded(F.lit(n)))) for n in names if n], 2: [("The Long", "The Long"), ("The Long Road Home", "The Long Road Home")]}
    got = {(r["doc_id"], r["line"]): (r["title"], r["joined"]) for r in chapters.with_titles(lines, titles).collect()}
    first = lambda x, d: next((n for n, f in own[d] if x is not None and plain_match(x, f)), None)
    want = {k: (first(folded[t], k[0]), first(two[k], k[0])) for k, t in rows.items()}
    assert got == want and sum(v[0] is not None for v in want.values()) > 100


def test_many_titles_are_not_lines_times_titles(spark):
    """A book with 10,000 titles and 10,000 lines: what meets is in proportion to them."""
    n = 10_000
    name = F.concat(F.lit("The tale of w"), F.md5(F.col("id").cast("string")), F.lit(" and others"))
    titles = spark.range(n).select(F.lit(1).alias("doc_id"), F.col("id").alias("nth"), name.alias("title"))
    lines = spark.range(n).select(F.lit(1).alias("doc_id"), F.col("id").alias("line"), F.concat(F.lit("so "), name, F.lit(" went on")).alias("text"))
    keyed = titles.withColumn("_folded", T.folded(F.col("title")))
    assert chapters.candidates(lines.withColumn("_text", T.folded(F.col("text"))), keyed).count() == n
    assert chapters.with_titles(lines, titles).where("title = concat(substring(text, 4, length(text) - 11))").count() == n


def test_lines_are_dealt_twice_only(spark):
    """By document for the next line and by line for the titles; short prefixes and beginnings of words are keys only where a title goes by them."""
    lines = spark.createDataFrame([(1, i, f"line {i} of the tale of many words") for i in range(9)], "doc_id long, line int, text string")
    titles = spark.createDataFrame([(1, 0, "the tale of many others"), (1, 1, "5 of the tale of many")], "doc_id long, nth int, title string")
    found = chapters.with_titles(lines, titles)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 4
    assert {r["line"]: (r["title"], r["joined"]) for r in found.collect()} == {i: ("5 of the tale of many",) * 2 if i == 5 else (None, "5 of the tale of many" if i == 4 else None) for i in range(9)}


def test_what_goes_on_is_not_asked_for_a_headings_looks(spark):
    """A small letter at its beginning tells it, so the patterns of headings are not run over all lines."""
    texts = ["on it went", "HEADING:", "The Air", "x", "", None, "1 a", "so: it is:", "ab@c", " small", "Éa"]
    df = spark.createDataFrame([(a, b) for a in ["It was", "It was.", "see Mr.", "", None, "a;", "etc."] for b in texts], "a string, b string")
    out = df.select("a", "b", documents.goes_on(F.col("a"), F.col("b")).alias("on"), (~T.is_heading(T.trimmed("b"), F.lit(None).cast("string"), T.trimmed("a"))).alias("plain"))
    assert all(r["plain"] for r in out.collect() if r["on"]) and {(r["a"], r["b"]) for r in out.where("on").collect()} >= {("It was", "on it went"), ("see Mr.", "x"), ("It was", " small"), ("It was", "ab@c")}
    assert "[.!?;)@]" not in out.select("on")._jdf.queryExecution().optimizedPlan().toString()


def test_lines_without_an_id_or_with_the_same_one_stay(spark):
    lines = spark.createDataFrame([(None, 0, "a"), (None, 0, "a"), (1, 0, "The tale of it"), (1, 0, "other"), (1, 0, "other")], "doc_id long, line int, text string")
    titles = spark.createDataFrame([(1, 0, "The tale of it")], "doc_id long, nth int, title string")
    got = [(r["doc_id"], r["text"], r["title"]) for r in chapters.with_titles(lines, titles).collect()]
    assert sorted(got, key=str) == [(1, "The tale of it", "The tale of it"), (1, "other", None), (1, "other", None), (None, "a", None), (None, "a", None)]


def exchanges_of_texts(spark, df):
    """What the plan's exchanges deal that has a line's text."""
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    dealt = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", df._jdf.queryExecution().explainString(mode))
    assert dealt
    return [x for x in dealt if re.search(r"\b(?:text|_own|_both|_one|_two|_text|_after)#", x)]


@pytest.mark.parametrize("name, most", [("x05_j12_title_matches", 1), ("w10_best_occurrence", 1), ("x13_content_start", 1), ("x14_chapters_by_title", 2), ("x15_chapters_by_pattern", 0), ("x18_contents_or_text", 1)])
def test_texts_are_not_dealt_again(spark, small, name, most):
    """Once to look for titles and once for the chapters' contents; six times for x14 and nine for x18 before."""
    assert len(exchanges_of_texts(spark, registry.QUERIES[name](spark, small))) <= most


def test_only_keys_of_titles_are_dealt(spark):
    """A long line of words of which one title shares one: one row goes on, as does a line that shares none; before, each word did."""
    lines = spark.createDataFrame([(1, 0, " ".join(f"word{i}" for i in range(500)) + " breathing"), (1, 1, "no more"), (2, 0, "other")], "doc_id long, line int, text string").withColumn("_text", F.col("text"))
    titles = spark.createDataFrame([(1, i, t, t) for i, t in enumerate(["On breathing in", *[f"On tale{i} of" for i in range(99)]])], "doc_id long, nth int, title string, _folded string")
    asked = lines.join(chapters.kinds_of_titles(titles).drop("_given"), "doc_id", "left")
    got = sorted((r["doc_id"], r["line"], r["_title"], r["text"] is None) for r in chapters.with_candidates(asked, titles, "text").collect())
    assert got == [(1, 0, "On breathing in", False), (1, 1, None, True), (2, 0, None, True)]


@pytest.mark.parametrize("few", [0, 3, 32])
def test_few_titles_and_many_are_found_alike(spark, monkeypatch, few):
    monkeypatch.setattr(chapters, "FEW_TITLES", few)
    test_matches_beside_all_pairs(spark)
    test_lines_without_an_id_or_with_the_same_one_stay(spark)
