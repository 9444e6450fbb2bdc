"""Rows of one id with different texts, ids at the ends of their range, names that clash, and samples that are bounded."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folio.llm import mixing, neardup, sharding, substrings, tokenfile, toxicity
from tests.llm.conftest import SCHEMA, put

WORDS = [f"w{i}" for i in range(400)]


def text(k, n=60):
    rng = np.random.default_rng(k)
    return " ".join(rng.choice(WORDS, n))


def test_a_document_has_one_verdict(spark):
    """Rows without words are of the component that the others of their id are of."""
    rows = [(1, text(1)), (10, None), (10, text(1)), (10, ""), (11, None), (12, text(2)), (12, " "), (None, None)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    found = {}
    for r in got:
        found.setdefault(r["doc_id"], set()).add((r["component_id"], r["kept"]))
    assert len(got) == len(rows) and found == {1: {(1, True)}, 10: {(1, False)}, 11: {(11, True)}, 12: {(12, True)}, None: {(None, True)}}


def stage(spark, tmp_path, rows):
    folder = put(tmp_path, [(i, t, "en", "a", len(t or "")) for i, t in rows])
    got = corpus_pipeline.without_copies(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).collect()
    return sorted(((r["doc_id"], r["text"]) for r in got), key=str)


def test_the_stage_loses_no_unique_text(spark, tmp_path):
    y = text(3)
    z = y.replace(" ", "  ", 1)  # the same words
    assert stage(spark, tmp_path, [(10, None), (10, text(4)), (11, y), (11, z)]) in (sorted([(10, None), (10, text(4)), (11, y)], key=str), sorted([(10, None), (10, text(4)), (11, z)], key=str))
    rows = [(10, None), (10, text(4)), (10, text(5)), (11, y), (11, y), (12, y + " more"), (None, y), (None, y), (13, ""), (13, "")]
    assert stage(spark, tmp_path, rows) == sorted([(10, None), (10, text(4)), (10, text(5)), (11, y), (None, y), (None, y), (13, "")], key=str)


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_token_file_does_not_hang_on_partitions(spark, tmp_path, parts):
    rows = [(i % 5, text(i, 5 + i)) for i in range(60)] + [(2, None), (2, ""), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    path = f"file://{tmp_path}/f"
    tokenfile.write(docs, path, __import__("public_tokenizers").path("byte_bpe_50k.json"))
    got = sorted(map(str, map(tuple, tokenfile.digest(spark, path).collect())))
    one = f"file://{tmp_path}/g"
    tokenfile.write(docs.coalesce(1), one, __import__("public_tokenizers").path("byte_bpe_50k.json"))
    assert got == sorted(map(str, map(tuple, tokenfile.digest(spark, one).collect()))) and len(got) == 63


def test_repeats_of_ids_at_both_ends(spark):
    passage = text(9, 80)
    rows = [(-(1 << 63), "a " + passage), ((1 << 63) - 1, "b " + passage), (0, "c " + passage)]
    got = {r["doc_id"]: r["n_removed"] for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    n = len(passage.encode()) + 1
    assert got == {-(1 << 63): 0, 0: n, (1 << 63) - 1: n}
    with pytest.raises(ValueError, match="no number left"):
        substrings.remove_repeats(spark.createDataFrame([*rows, (None, "x")], "doc_id long, text string"))


def test_columns_of_clashing_names(spark, tmp_path):
    """Shards replace columns of their own names; the mix counts the words of the text, whatever a column is called."""
    rows = [(i, text(i, 3), "en", "s", 1) for i in range(50)]
    table = pa.table({f.name: [r[i] for r in rows] for i, f in enumerate(SCHEMA)}, schema=SCHEMA)
    for c in ("_weight", "_s", "_b", "_first", "size", "shard", "bucket"):
        table = table.append_column(c, pa.array([999] * 50))
    pq.write_table(table, tmp_path / "documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    scattered = sharding.scatter(docs)
    assert scattered.count() == 50 and scattered.agg(F.max("shard")).first()[0] < 40 and scattered.where("size = 999").count() == 50
    assert {r["size"] for r in mixing.rows_of(docs).collect()} == {3}
    assert {r["size"] for r in mixing.rows_of(docs.drop("text")).collect()} == {999}


def test_too_many_sources_raise(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SOURCES", 5)
    docs = spark.createDataFrame([(i, f"s{i}", "a b") for i in range(6)], "doc_id long, source string, text string")
    with pytest.raises(ValueError, match="sources"):
        mixing.mix(mixing.rows_of(docs))


def test_the_labelled_sample_is_bounded(spark, monkeypatch):
    """One text for each labelled id, and no more bytes than are allowed."""
    ids = [i for i in range(60) if __import__("zlib").crc32(str(i).encode()) % 4 != 2]
    docs = spark.createDataFrame([(ids[0], f"copy {k}") for k in range(5000)] + [(i, f"text {i} " + "x" * 90) for i in ids[1:]], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in ids], "doc_id long, quality int, toxic int")
    texts, toxic = toxicity.labelled(docs, labels)
    assert len(texts) == len(ids) == len(toxic)
    assert toxicity.labelled(docs.repartition(9), labels)[0] == texts
    monkeypatch.setattr(toxicity, "MOST_BYTES", 1000)
    few = toxicity.labelled(docs, labels)[0]
    assert 5 <= len(few) <= 15 and set(few) <= set(texts)
