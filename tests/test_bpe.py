"""Tokens of byte-pair encoding beside a library's, and sections by chapter."""

import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from folio.functions import bpe
from folio.operators import layout as L
from folio.plans import registry, usage_queries

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks_of(usage_queries.VOCABULARY), special_tokens={})


def test_counts_of_the_table(spark, small, library):
    got = {r["doc_id"]: r["tokens"] for r in registry.QUERIES["f32_bpe_counts"](spark, small).collect()}
    want = duckdb.sql(f"SELECT doc_id, text FROM '{small}/documents.parquet'").fetchall()
    assert got == {i: len(library.encode_ordinary(t or "")) for i, t in want}


ODD = [None, "", " ", "  \n\n x", "a  b   ", "don't we'll I'M", "x" * 300, "été 漢字かな 🙂🙂 ½ ٣٤", "tab\t\ttab \r\n end\n", "<|endoftext|> 123456789 !!!???", " nbsp　wide end", "ab" * 50 + " " * 40 + "c", "\x1c\x1d \x85x"]


def test_counts_of_odd_texts(spark, library):
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice("ab c\n'st1,é漢") for _ in range(rng.randint(1, 80))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("tokens", F.lit("a clashing name"))
    got = {r["doc_id"]: r["tokens"] for r in bpe.token_counts(df.select("doc_id", "text"), "doc_id", "text", usage_queries.VOCABULARY).collect()}
    assert got == {i: len(library.encode_ordinary(t or "")) for i, t in enumerate(texts)}


def test_words_are_not_dealt_out(spark, library, monkeypatch):
    """A row's words stay in its task, rows of one key too; what a task knows begins anew when it is full."""
    monkeypatch.setattr(bpe, "MOST_KNOWN", 3)
    rows = [(i % 7, f"one two three four {i} " * (i % 3) + "x" * 5 * i if i % 5 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = bpe.token_counts(df, "doc_id", "text", usage_queries.VOCABULARY)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.collect())) == sorted((i, len(library.encode_ordinary(t or ""))) for i, t in rows)


def test_a_very_long_word_ends(library):
    ranks, word = bpe.ranks_of(usage_queries.VOCABULARY), "abcdefgh" * 20_000
    began = time.time()
    n = bpe.token_count(word.encode(), ranks)
    assert time.time() - began < 20 and n < len(word) / 2 and bpe.token_count(word[:4000].encode(), ranks) == len(library.encode_ordinary(word[:4000]))


def test_sections_by_number(spark):
    markers = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 1), (2, None)], "book_id long, chapter_number int")
    contents = spark.createDataFrame([(1, 1, 5, ["later"]), (1, 1, 2, ["first", "second"]), (1, 3, 1, []), (2, None, 1, ["none"])], "book_id long, chapter_number int, pos long, sections array<string>")
    got = {(r["book_id"], r["chapter_number"]): r["sections"] for r in L.with_sections(markers, contents, ["book_id"]).collect()}
    assert got == {(1, 1): ["first", "second"], (1, 2): [], (1, 3): [], (2, 1): [], (2, None): []}
