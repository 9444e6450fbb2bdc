"""Tables that are changed in place."""

import os

import pytest
from pyspark.sql import functions as F

from folio.operators import catalog
from folio.sources.tables import BUCKET, BucketTable, cascaded_delete


def people(spark, n=500):
    return spark.range(n).select(F.col("id").alias("user_id"), F.concat(F.lit("u"), F.col("id").cast("string")).alias("name"), F.lit(0).alias("visits"))


@pytest.fixture
def table(spark, tmp_path):
    return BucketTable(spark, f"file://{tmp_path}/t", ["user_id"], 16).create(people(spark))


def folders(t):
    return {b: tuple(v) for b, v in t._manifest()[1]["buckets"].items()}


def values(df):
    return {r["user_id"]: (r["name"], r["visits"]) for r in df.collect()}


def test_an_update_of_one_key_rewrites_one_bucket(spark, table):
    before = folders(table)
    after_image = table.update(spark.createDataFrame([(7, "seven")], "user_id long, name string"))
    assert [tuple(r) for r in after_image.collect()] == [(7, "seven", 0)]
    now = folders(table)
    assert sum(before[b] != now[b] for b in before) == 1 and set(before) == set(now) and table.version() == 2
    assert values(table.read()) == {i: ("seven" if i == 7 else f"u{i}", 0) for i in range(500)}


def test_a_killed_change_leaves_the_old_table(spark, table, tmp_path):
    before = folders(table)

    def breaks(old, new):
        return old.withColumn("name", F.when(F.col("user_id") == 7, F.raise_error(F.lit("killed"))).otherwise(F.col("name")))

    with pytest.raises(Exception, match="killed"):
        table.change(spark.createDataFrame([(7,)], "user_id long"), breaks)
    assert folders(table) == before and table.read().count() == 500
    # what had been written before the manifest would have come is not seen, and goes
    table._write(people(spark, 20))
    assert table.read().count() == 500 and table.vacuum() >= 1 and table.read().count() == 500
    assert len(os.listdir(tmp_path / "t" / "data")) == 1


def test_the_second_of_two_writers_raises(spark, table):
    def other_ends_first(old, new):
        BucketTable(spark, table.path, ["user_id"], 16).delete(spark.createDataFrame([(1,)], "user_id long"))
        return catalog.updated(old, new, ["user_id"])

    with pytest.raises(RuntimeError, match="another change"):
        table.change(spark.createDataFrame([(7, "seven")], "user_id long, name string"), other_ends_first)
    assert values(table.read()) == {i: (f"u{i}", 0) for i in range(500) if i != 1}


def test_upsert_delete_and_insert(spark, table):
    new = spark.createDataFrame([(3, "three", 1), (900, "new", 1)], "user_id long, name string, visits int")
    assert len(table.upsert(new)) <= 2
    table.insert_new(spark.createDataFrame([(3, "not this", 9), (901, "this", 9)], "user_id long, name string, visits int"))
    table.delete(spark.createDataFrame([(4,), (5,), (77777,)], "user_id long"))
    got = values(table.read())
    assert got[3] == ("three", 1) and got[900] == ("new", 1) and got[901] == ("this", 9) and not {4, 5} & set(got) and len(got) == 500


def test_insert_reads_and_rewrites_nothing(spark, table):
    before = folders(table)
    table.insert(people(spark, 45).withColumn("user_id", F.col("user_id") + 1000), 10)
    now = folders(table)
    assert all(now[b][: len(v)] == v for b, v in before.items())
    per_file = table.read().where("user_id >= 1000").groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]
    assert table.read().count() == 545 and per_file <= 10
    table.update(spark.createDataFrame([(1007, "x")], "user_id long, name string"))
    assert values(table.read())[1007] == ("x", 0) and table.read().count() == 545


def test_empty_buckets_null_keys_and_nothing(spark, tmp_path):
    t = BucketTable(spark, f"file://{tmp_path}/t", ["a", "b"], 4).create(spark.createDataFrame([(1, None, "x"), (None, None, "y"), (2, 2, "z")], "a long, b long, v string"))
    t.delete(spark.createDataFrame([(2, 2), (1, None)], "a long, b long"))
    assert sorted(r["v"] for r in t.read().collect()) == ["x", "y"]
    assert t.delete(spark.createDataFrame([], "a long, b long")) == []
    t.delete_by(spark.createDataFrame([("x",), ("y",)], "v string"))
    assert t.read().count() == 0 and t.read().columns == ["a", "b", "v"]
    t.insert(spark.createDataFrame([(5, 5, "w")], "a long, b long, v string"))
    assert t.read().count() == 1
    with pytest.raises(ValueError, match="no table"):
        BucketTable(spark, f"file://{tmp_path}/none", ["a"]).read()


def test_batches_are_written_by_all_tasks(spark, tmp_path):
    """Files of ten rows cost their number, so none of the tasks has them all."""
    t = BucketTable(spark, f"file://{tmp_path}/b", ["user_id"], 4)
    for start in (0, 400):
        t.insert(people(spark, 400).withColumn("user_id", F.col("user_id") + start), 10)
    files = t.read().groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n"), F.min("user_id").alias("k"))
    rows = files.select("n", "k", F.regexp_extract("file", r"part-(\d+)-", 1).alias("task")).collect()
    assert len(values(t.read())) == 800 and sum(r["n"] for r in rows) == 800 and max(r["n"] for r in rows) <= 10
    assert {len({r["task"] for r in rows if (r["k"] >= 400) == late}) for late in (False, True)} == {spark.sparkContext.defaultParallelism}


def test_cascade_rewrites_only_what_it_touches(spark, tmp_path):
    books = BucketTable(spark, f"file://{tmp_path}/books", ["book_id"], 8).create(spark.range(50).withColumnRenamed("id", "book_id"))
    marks = BucketTable(spark, f"file://{tmp_path}/marks", ["mark_id"], 32).create(spark.range(400).select(F.col("id").alias("mark_id"), (F.col("id") % 50).alias("book_id")))
    before = folders(marks)
    cascaded_delete(books, [marks], spark.createDataFrame([(9,)], "book_id long"))
    assert books.read().count() == 49 and marks.read().count() == 392
    assert sum(before[b] != folders(marks).get(b) for b in before) <= 8 and BUCKET not in marks.read().columns
