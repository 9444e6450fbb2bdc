"""The source and sink of objects."""

import os
import time

import pytest
from pyspark.sql import functions as F

from folio.sources import files, objects


def put(folder, n, start=0, text="{\"id\": \"%d\"}"):
    folder.mkdir(parents=True, exist_ok=True)
    for i in range(start, start + n):
        p = folder / f"{i}.json"
        p.write_text(text % i if "%d" in text else text)
        os.utime(p, (1_700_000_000 + i, 1_700_000_000 + i))


def test_only_the_newest_are_opened(spark, tmp_path):
    """Of 10,040 files 10,000 are opened: reading would fail on the others, which are not readable as files at all."""
    put(tmp_path / "b", 10_000, 40)
    (tmp_path / "a").mkdir()
    for i in range(40):
        os.symlink(tmp_path / "b" / "40.json", tmp_path / "a" / f"{i}.json")
        os.utime(tmp_path / "a" / f"{i}.json", (1_600_000_000, 1_600_000_000), follow_symlinks=False)
    found = objects.newest(objects.entries(objects.pafs.LocalFileSystem(), str(tmp_path)), 10_000)
    assert len(found) == 10_000 and all("/b/" in e.path for e in found[:9000])
    rows = files.json_lake(spark, f"file://{tmp_path}")
    assert rows.count() == 10_000


def test_opened_objects_are_counted(tmp_path, monkeypatch):
    put(tmp_path, 60)
    reader = objects.ObjectReader({"path": str(tmp_path), "most": "25", "shareBytes": str(objects.OPENING_BYTES * 10)})
    parts = reader.partitions()
    assert [len(p.objects) for p in parts] == [10, 10, 5]
    opened = []
    real = objects.file_system

    class Counting:
        def __init__(self, fs):
            self.fs = fs

        def open_input_stream(self, path):
            opened.append(path)
            return self.fs.open_input_stream(path)

    monkeypatch.setattr(objects, "file_system", lambda p: (Counting(real(p)[0]), real(p)[1]))
    names = [n for p in parts for b in reader.read(p) for n in b.column("path").to_pylist()]
    assert opened == names and [n.split("/")[-1] for n in names] == [f"{i}.json" for i in range(59, 34, -1)]


def test_broken_records_are_left_out(spark, tmp_path):
    put(tmp_path, 5)
    put(tmp_path / "deep" / "er", 3, 100, "{broken")
    put(tmp_path / "empty", 2, 200, "")
    put(tmp_path / "_hidden", 2, 300)
    assert sorted(r["id"] for r in files.json_lake(spark, f"file://{tmp_path}").collect()) == list("01234")
    assert files.json_lake(spark, f"file://{tmp_path}", most=2).count() == 0
    assert files.json_lake(spark, f"file://{tmp_path}/nothing").count() == 0


def rows(spark, n, text="x"):
    return spark.range(n).select(F.concat(F.lit("a/b "), F.col("id").cast("string")).alias("id"), F.lit(text).alias("content"))


def test_put_again_and_over(spark, tmp_path):
    path = f"file://{tmp_path}/lake"
    objects.put_objects(rows(spark, 20, "first").repartition(4), path)
    objects.put_objects(rows(spark, 5, "second"), path)
    got = {r["path"].split("/")[-1]: r["content"] for r in objects.read_objects(spark, path).collect()}
    assert len(got) == 20 and list(got.values()).count("second") == 5 and got["a%2Fb%203"] == "second"
    assert {r["content"] for r in objects.read_objects(spark, path, most=5).collect()} == {"second"}
    objects.put_objects(rows(spark, 3, "third"), path, overwrite=True)
    assert [r["content"] for r in objects.read_objects(spark, path).collect()] == ["third"] * 3
    assert len([p for p in (tmp_path / "lake").iterdir() if p.name.startswith("_write-")]) == 1


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/lake"
    objects.put_objects(rows(spark, 4, "kept"), path)
    bad = rows(spark, 50).withColumn("id", F.when(F.col("id") == "a/b 49", None).otherwise(F.col("id"))).repartition(5)
    with pytest.raises(Exception, match="without id"):
        objects.put_objects(bad, path)
    assert objects.read_objects(spark, path).count() == 4
    assert len([p for p in (tmp_path / "lake").iterdir() if p.name.startswith("_write-")]) == 1


def test_what_no_manifest_names_is_not_there(tmp_path):
    w = objects.ObjectWriter({"path": str(tmp_path)}, False)
    batch = objects.pa.RecordBatch.from_pydict({"id": ["1", "2"], "content": ["x", None]})
    lost, kept = w.write(iter([batch])), w.write(iter([batch.slice(0, 1)]))
    assert not objects.ObjectReader({"path": str(tmp_path)}).partitions()[0].objects
    w.commit([kept])
    (share,) = objects.ObjectReader({"path": str(tmp_path)}).partitions()
    assert [e.path for e in share.objects] == [f"{tmp_path}/{kept.task}/1"] and not (tmp_path / lost.task).exists()
    assert time.time() - share.objects[0].modified < 60


def test_whole_texts_are_files_of_rows_in_few_folders(spark, tmp_path):
    """A key that comes again or is missing has a file for each of its rows, and no row has a folder of its own."""
    from folio.plans import all_queries  # noqa: F401
    from folio.plans.registry import QUERIES

    rows = [(i, f"name {i}") for i in range(40)] + [(3, "again"), (3, "again"), (-7, "below"), (None, "none")]
    spark.createDataFrame(rows, "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    found = QUERIES["s13_whole_texts"](spark, str(tmp_path))
    assert sorted([tuple(r) for r in found.collect()], key=str) == sorted([(None if k is None else str(k), n + "\n") for k, n in rows], key=str)
    assert len({f.rsplit("/", 1)[0] for f in found.inputFiles()}) <= spark.sparkContext.defaultParallelism < len(found.inputFiles()) == len(rows)
