"""Every operator and stage on odd rows and on empty tables: no crash, and a row for each row where that is the rule."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folio.llm.queries import QUERIES

DOCUMENT_QUERIES = [n for n in QUERIES if int(n[2:].split("_")[0]) <= 10]
PER_ROW = [n for n in QUERIES if n.split("_")[0] in ("op2", "op3", "op4", "op6", "op7", "op8", "op9", "op10")]


@pytest.mark.parametrize("name", DOCUMENT_QUERIES)
def test_empty_table(spark, nothing, name):
    df = QUERIES[name](spark, nothing)
    assert df.columns and df.count() == 0


@pytest.mark.parametrize("name", DOCUMENT_QUERIES)
def test_odd_rows(spark, odd, name):
    got = QUERIES[name](spark, odd).collect()
    assert {r["doc_id"] for r in got} == ({13} if name.startswith("op5") else set(range(1, 17)))
    if name in PER_ROW:
        assert len(got) == 17


@pytest.mark.parametrize("name", [n for n in PER_ROW])
def test_null_doc_id(spark, tmp_path, name):
    from tests.llm.conftest import put

    folder = put(tmp_path, [(None, "some words that stand here alone", "en", "a", 32), (3, "some words that stand here alone", "en", "a", 32), (5, None, None, None, None)])
    got = QUERIES[name](spark, folder).collect()
    assert sorted(map(str, (r["doc_id"] for r in got))) == ["3", "5", "None"]


SECRET = "531ccd051a92ebcb68d04f"


def without_ids(folder):
    """Rows without id, of one id with different texts, and one of nulls."""
    from tests.llm.conftest import put

    text = f"password={SECRET} is here, with some words to read and then more of them"
    return put(folder, [(None, text, "en", "a", len(text)), (3, text, "en", "a", len(text)), (3, "other words of the same document that stand by themselves", "en", "b", 58), (5, None, None, None, None)])


def test_packing_without_ids(spark, tmp_path):
    got = QUERIES["op1_packing"](spark, without_ids(tmp_path)).toPandas()
    by_doc = got.fillna({"doc_id": -1}).groupby("doc_id").agg(length=("length", "sum"), tokens=("doc_tokens", "unique"))
    assert by_doc.loc[5, "length"] == 1 and by_doc.loc[-1, "length"] == by_doc.loc[-1, "tokens"][0] and by_doc.loc[3, "length"] == sum(by_doc.loc[3, "tokens"])


def test_secrets_without_ids(spark, tmp_path):
    got = QUERIES["op5_secrets"](spark, without_ids(tmp_path)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["3", "None"] and {r["value"] for r in got} == {SECRET}


@pytest.mark.parametrize("name, left", [("toxicity", 4), ("near_duplicates", 4), ("secrets", 4), ("mixing", None), ("packing", None)])
def test_stage_without_ids(spark, tmp_path, name, left):
    folder = without_ids(tmp_path)
    got = dict(corpus_pipeline.STAGES)[name](spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).collect()
    if left is not None:
        assert len(got) == left and {r["doc_id"] for r in got} == {None, 3, 5}
    if name == "secrets":
        assert sum("[SECRET]" in (r["text"] or "") for r in got) == 2 and not any(SECRET in (r["text"] or "") for r in got)
    if name == "mixing":
        assert got and all(r["text"] for r in got)
    if name == "packing":
        assert {r["doc_id"] for r in got} == {None, 3, 5}


def test_near_duplicates_stage_keeps_one_of_each_group(spark, medium, texts):
    """Beside brute force over all pairs: five words, 80 percent."""
    from tests.llm.test_operators import linked, shingles

    want = {d for d, top in linked({d: shingles(t, 5) for d, t in texts(medium)}, 80).items() if d == top}
    got = corpus_pipeline.without_copies(spark, spark.read.parquet(f"{medium}/documents.parquet"), medium)
    assert {r["doc_id"] for r in got.select("doc_id").collect()} == want


@pytest.mark.parametrize("name", [k for k, _ in corpus_pipeline.STAGES])
@pytest.mark.parametrize("which", ["odd", "nothing"])
def test_stage(spark, request, name, which):
    folder = request.getfixturevalue(which)
    df = dict(corpus_pipeline.STAGES)[name](spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    n = df.count()
    assert (n == 0) == (which == "nothing")
    if name != "packing":
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_pipeline_runs(spark, small):
    out = corpus_pipeline.run(spark, small)
    assert out.count() > 0 and out.agg(F.max("length")).first()[0] <= 4096
