"""File sources and sinks: lakes of JSON records, listings, texts, speech marks, parsed documents, settings; result caches."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.sources.objects import read_objects

RECORD_SCHEMA = "id string, timestamp string, modelId string, provider string, usage struct<promptTokens bigint, completionTokens bigint, totalTokens bigint>, cost double, endpoint string"
MARK_SCHEMA = "time bigint, type string, start int, end int, value string"
CHUNK_KINDS = ("text", "image", "header")
BOOK_SCHEMA = "book struct<title string, author string, totalWords bigint>, chapters array<struct<chapterNumber int, title string, wordCount int, content struct<chunks array<struct<index int, text string, wordCount int, type string, imageName string>>>>>"


#: What a file of an image ends with.
IMAGE_KINDS = ("jpg", "jpeg", "png", "gif", "webp")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors see, the setting ``spark.checkpoint.dir``.

    Without the setting a temporary folder is made and set, but only where driver and executors are one process.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="folio-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/folio-files/{name}-{uuid.uuid4().hex}"


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of the JVM, which knows all kinds of folders."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def records(spark: SparkSession, path: str, schema: str = RECORD_SCHEMA, most: int | None = None) -> DataFrame:
    """The records of a folder with a JSON document in each object, with ``_modified`` and ``_path``; what can't be read is left out."""
    parsed = F.from_json("content", schema + ", _broken string", {"columnNameOfCorruptRecord": "_broken"})
    rows = read_objects(spark, path, most).select(parsed.alias("r"), F.col("modified").alias("_modified"), F.col("path").alias("_path"))
    return rows.where("r is not null and r._broken is null").select("r.*", "_modified", "_path").drop("_broken")


def json_lake(spark: SparkSession, path: str, schema: str = RECORD_SCHEMA, most: int = 10_000) -> DataFrame:
    """The records of the newest objects, at most so many: listed and cut before any is opened."""
    return records(spark, path, schema, most).drop("_modified", "_path")


def one_record(spark: SparkSession, path: str, record: str, schema: str = RECORD_SCHEMA) -> DataFrame:
    """The record of this id, of the newest object that has it; however many objects are newer."""
    return records(spark, path, schema).where(F.col("id") == record).orderBy(F.desc("_modified"), "_path").limit(1).drop("_modified", "_path")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Files and bytes of each folder directly below the path; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    below = F.substring_index(F.col("path"), path.rstrip("/").split("/")[-1] + "/", -1)
    folder = F.when(below.contains("/"), F.substring_index(below, "/", 1)).otherwise("")
    return files.groupBy(folder.alias("folder")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def images(spark: SparkSession, path: str, kinds: tuple[str, ...] = IMAGE_KINDS) -> DataFrame:
    """Files of these kinds of a folder and those below; contents are not read."""
    pattern = "*.{" + ",".join(kinds) + "}"
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "length", "modificationTime")


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def speech_marks(spark: SparkSession, path: str) -> DataFrame:
    """Time in seconds and name of each mark in lines of JSON; other and broken lines are left out."""
    return spark.read.schema(MARK_SCHEMA).json(path).where("type = 'ssml' and value is not null").select("value", (F.col("time") / 1000).alias("seconds"))


def word_times(alignments: DataFrame, key: str) -> DataFrame:
    """Words and their first letters' times from aligned arrays of characters and times."""
    letters = alignments.select(key, F.posexplode(F.arrays_zip("characters", "times")).alias("pos", "z")).select(key, "pos", F.col("z.characters").alias("c"), F.col("z.times").alias("t"))
    w = Window.partitionBy(key).orderBy("pos")
    words = letters.withColumn("word", F.sum((F.col("c") == " ").cast("int")).over(w)).where("c != ' '")
    return words.groupBy(key, "word").agg(F.min("t").alias("seconds"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "c"))), lambda x: x["c"]), "").alias("text"))


def book_config(path: str, defaults: dict) -> dict:
    """Settings of a book from a JSON file over the defaults; ``metadata`` is merged too. No or a broken file: the defaults."""
    try:
        found = json.loads(Path(path).read_text())
    except (OSError, ValueError):
        return dict(defaults)
    return defaults | found | {"metadata": defaults.get("metadata", {}) | found.get("metadata", {})}


def settings_of_books(text: Column, defaults: dict) -> Column:
    """The same from a column of JSON texts: title and author of ``metadata``, and the lists of names and patterns."""
    lists = [k for k in ("chapterNames", "chapterPatterns", "excludePatterns") if k in defaults]
    found = F.from_json(text, "metadata struct<title string, author string>, " + ", ".join(f"{k} array<string>" for k in lists))
    metadata = F.struct(*[F.coalesce(found["metadata"][k], F.lit(defaults.get("metadata", {}).get(k))).alias(k) for k in ("title", "author")])
    default_list = lambda k: F.array(*[F.lit(x) for x in defaults[k]]).cast("array<string>")
    return F.struct(metadata.alias("metadata"), *[F.coalesce(found[k], default_list(k)).alias(k) for k in lists])


def parsed_books(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BOOK_SCHEMA).option("multiLine", True).json(path)


def book_faults() -> Column:
    """What is wrong with a parsed book, as a list."""
    chunks = F.flatten(F.transform("chapters", lambda c: c["content"]["chunks"]))
    checks = [
        (F.col("book.title").isNull(), "no title"),
        (F.coalesce(F.size("chapters"), F.lit(0)) <= 0, "no chapters"),
        (F.exists(chunks, lambda c: ~c["type"].isin(*CHUNK_KINDS)), "unknown kind of chunk"),
        (F.exists(chunks, lambda c: (c["type"] == "image") & c["imageName"].isNull()), "image without name"),
        (F.exists("chapters", lambda c: ~F.exists(c["content"]["chunks"], lambda x: x["type"] == "text")), "chapter without text"),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), name) for bad, name in checks]))


def appended(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replaced(df: DataFrame, path: str) -> None:
    """Overwrite a table with a post-image; write beside it first where it is read from the same path."""
    df.write.mode("overwrite").parquet(path)


def json_documents(df: DataFrame, path: str) -> None:
    """A JSON document for each row; null fields are left out."""
    df.write.mode("overwrite").json(path)


class ResultCache:
    """Results by key with a time to live, as tables in a folder: put, get, delete, clear, keys, state.

    The folder itself is the index: a folder for each key, in it one for the time of its entry. So a cache outlives its session.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, seconds: float = 3600):
        self.spark, self.folder, self.seconds = spark, folder or shared_path(spark, "cache"), seconds

    def _of(self, key: str) -> str:
        return f"{self.folder}/{hashlib.md5(key.encode()).hexdigest()}"

    def _below(self, path: str) -> list[str]:
        fs, p = hadoop_path(self.spark, path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _drop(self, path: str) -> bool:
        fs, p = hadoop_path(self.spark, path)
        return bool(fs.delete(p, True))

    def _made(self, key: str) -> str | None:
        made = self._below(self._of(key))
        return made[-1] if made else None

    def put(self, key: str, df: DataFrame, now: float) -> DataFrame:
        before = self._below(self._of(key))
        path = f"{self._of(key)}/{round(now * 1000):020d}"
        df.write.mode("overwrite").parquet(path)
        for old in before:
            if not path.endswith(old):
                self._drop(f"{self._of(key)}/{old}")
        return self.spark.read.parquet(path)

    def get(self, key: str, now: float) -> DataFrame | None:
        made = self._made(key)
        return self.spark.read.parquet(f"{self._of(key)}/{made}") if made is not None and now <= int(made) / 1000 + self.seconds else None

    def state(self, key: str, now: float, fresh: float = 10) -> str:
        made = self._made(key)
        if made is None:
            return "missing"
        age = now - int(made) / 1000
        return "fresh" if age < fresh else "stale" if age <= self.seconds else "expired"

    def delete(self, key: str) -> bool:
        return self._drop(self._of(key))

    def clear(self) -> int:
        there = self._below(self.folder)
        self._drop(self.folder)
        return len(there)
