"""A store of objects, one for each record, as a data source of Spark: ``folio_objects``.

Reading lists first, cuts to the newest ``most`` objects, and only then deals them out to partitions in shares of about as many
bytes; nothing else is opened. Listing goes folder by folder and holds ``most`` entries and one folder at a time.

Writing puts each record under its id in a folder of its own for each task, and what tasks have written counts only once the
driver has put a manifest of it. A task that fails leaves files that no manifest names; they go when the write ends, with
success or not. A reader of a folder with manifests sees what they name, of each id the newest; without manifests all files.

Names are percent-encoded ids. A null content is an empty object, a null id an error. The path is of a file system that
pyarrow can open (local, hdfs, s3, gs); on a cluster it is one that all executors see.
"""

from __future__ import annotations

import contextlib
import heapq
import json
import time
import urllib.parse
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

MANIFESTS = "_manifests"
#: Bytes of one partition; each object counts as so many at least, as opening takes time too.
SHARE_BYTES, OPENING_BYTES = 32 << 20, 64 << 10
#: Bytes of one batch that a reader hands over.
BATCH_BYTES = 8 << 20
#: How often an ended write tries to clear its folder, a fifth of a second apart.
ABORT_TRIES = 25
SCHEMA = "path string, modified timestamp, size bigint, content string"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    scheme, colon, rest = path.partition(":")
    if colon and scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    if colon and scheme in ("s3a", "s3n"):
        path = "s3:" + rest
    return pafs.FileSystem.from_uri(path) if colon else (pafs.LocalFileSystem(), path)


@dataclass(frozen=True)
class Entry:
    path: str
    modified: float
    size: int


def entries(fs: pafs.FileSystem, folder: str) -> Iterator[Entry]:
    """All files of a folder and those below, but for names that begin with a sign for what is hidden; folder by folder."""
    todo = [folder]
    while todo:
        for i in fs.get_file_info(pafs.FileSelector(todo.pop(), allow_not_found=True)):
            if i.base_name[:1] in ("_", "."):
                continue
            if i.type == pafs.FileType.Directory:
                todo.append(i.path)
            else:
                yield Entry(i.path, i.mtime.timestamp(), i.size)


def manifested(fs: pafs.FileSystem, folder: str) -> Iterator[Entry] | None:
    """What the manifests name, the newest of each id; None where there are no manifests."""
    found = sorted((i for i in fs.get_file_info(pafs.FileSelector(f"{folder}/{MANIFESTS}", allow_not_found=True)) if i.base_name.endswith(".json")), key=lambda i: i.base_name)
    if not found:
        return None
    newest: dict[str, Entry] = {}
    for i in found:
        with fs.open_input_stream(i.path) as f:
            for task in json.loads(f.read())["tasks"]:
                with fs.open_input_stream(f"{folder}/{task}/{MANIFESTS}") as t:
                    for name, modified, size in json.loads(t.read()):
                        newest[name] = Entry(f"{folder}/{task}/{name}", modified, size)
    return iter(newest.values())


def newest(found: Iterator[Entry], most: int | None) -> list[Entry]:
    """The newest first, of one time by path; at most so many."""
    key = lambda e: (-e.modified, e.path)
    return sorted(found, key=key) if most is None else heapq.nsmallest(most, found, key=key)


def shares(found: list[Entry], share_bytes: int = SHARE_BYTES) -> list[list[Entry]]:
    out: list[list[Entry]] = []
    held = share_bytes
    for e in found:
        size = max(e.size, OPENING_BYTES)
        if held + size > share_bytes:
            out.append([])
            held = 0
        out[-1].append(e)
        held += size
    return out


class Share(InputPartition):
    def __init__(self, objects: list[Entry]):
        super().__init__(None)
        self.objects = objects


class ObjectReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.most = int(options["most"]) if "most" in options else None
        self.share_bytes = int(options.get("sharebytes", options.get("shareBytes", SHARE_BYTES)))

    def partitions(self) -> list[Share]:
        fs, folder = file_system(self.path)
        found = manifested(fs, folder)
        return [Share(s) for s in shares(newest(entries(fs, folder) if found is None else found, self.most), self.share_bytes)] or [Share([])]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(self.path)
        schema = pa.schema([("path", pa.string()), ("modified", pa.timestamp("us", "UTC")), ("size", pa.int64()), ("content", pa.string())])
        held, rows = 0, []
        for e in partition.objects:
            with fs.open_input_stream(e.path) as f:
                content = f.read()
            rows.append((e.path, round(e.modified * 1e6), e.size, content.decode("utf-8", "replace")))
            held += len(content)
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                held, rows = 0, []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


@dataclass
class Written(WriterCommitMessage):
    task: str


class ObjectWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.name = options["path"], overwrite, f"_write-{time.time_ns():020d}-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = file_system(self.path)
        task = f"{self.name}/task-{uuid.uuid4().hex}"
        fs.create_dir(f"{folder}/{task}")
        put: dict[str, tuple[str, float, int]] = {}
        for batch in iterator:
            for key, content in zip(batch.column("id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if key is None:
                    raise ValueError("a record without id can't be put")
                data, name = (content or "").encode(), urllib.parse.quote(str(key), safe="")
                with fs.open_output_stream(f"{folder}/{task}/{name}") as f:
                    f.write(data)
                put[name] = (name, time.time(), len(data))
        with fs.open_output_stream(f"{folder}/{task}/{MANIFESTS}") as f:
            f.write(json.dumps(list(put.values())).encode())
        return Written(task)

    def commit(self, messages: list[Written]) -> None:
        fs, folder = file_system(self.path)
        tasks = [m.task for m in messages if m is not None]
        before = [i.path for i in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)) if self.overwrite and not i.path.endswith("/" + self.name)]
        for i in fs.get_file_info(pafs.FileSelector(f"{folder}/{self.name}", allow_not_found=True)):
            if f"{self.name}/{i.base_name}" not in tasks:
                fs.delete_dir(i.path)
        fs.create_dir(f"{folder}/{MANIFESTS}")
        old = [i.path for i in fs.get_file_info(pafs.FileSelector(f"{folder}/{MANIFESTS}"))] if self.overwrite else []
        with fs.open_output_stream(f"{folder}/{MANIFESTS}/{self.name}.tmp") as f:
            f.write(json.dumps({"tasks": tasks}).encode())
        fs.move(f"{folder}/{MANIFESTS}/{self.name}.tmp", f"{folder}/{MANIFESTS}/{self.name}.json")
        for p in old:
            fs.delete_file(p)
        for p in before:
            if not p.endswith("/" + MANIFESTS):
                (fs.delete_dir if fs.get_file_info(p).type == pafs.FileType.Directory else fs.delete_file)(p)

    def abort(self, messages: list[Written]) -> None:
        fs, folder = file_system(self.path)
        for _ in range(ABORT_TRIES):  # a task that is being ended may still put an object
            if fs.get_file_info(f"{folder}/{self.name}").type != pafs.FileType.Directory:
                return
            with contextlib.suppress(OSError):
                fs.delete_dir(f"{folder}/{self.name}")
            time.sleep(0.2)


class ObjectSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folio_objects"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ObjectReader:
        return ObjectReader(self.options)

    def writer(self, schema, overwrite: bool) -> ObjectWriter:
        return ObjectWriter(self.options, overwrite)


def read_objects(spark: SparkSession, path: str, most: int | None = None, share_bytes: int = SHARE_BYTES) -> DataFrame:
    """path, modified, size and content (as UTF-8) of the newest objects of a folder."""
    spark.dataSource.register(ObjectSource)
    rows = spark.read.format("folio_objects").option("shareBytes", share_bytes)
    return (rows if most is None else rows.option("most", most)).load(path)


def put_objects(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Put an object for each row of (id, content)."""
    df.sparkSession.dataSource.register(ObjectSource)
    df.select("id", "content").write.format("folio_objects").mode("overwrite" if overwrite else "append").save(path)


def folders(path: str) -> str:
    """The pattern of the folders with the objects of a store that has been put once, for Spark's own readers of files."""
    return f"{path.rstrip('/')}/_write-*/task-*"
