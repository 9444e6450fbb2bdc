"""Tables in a folder that are changed in place: hashed into buckets by key, each change rewriting only the buckets it touches.

A bucket's rows are a folder of Parquet of the change that last wrote it, and of inserts since; a manifest names these folders. A change
writes new folders beside the old ones and ends with a new manifest, put in place by a rename; until then, and after a job that was
killed, readers see the table as it was. Two writers that start from one manifest can't both end: the second raises.

The buckets that a change touches, at most as many as there are, are the only thing that comes to the driver. Rows with a null in
their key have a bucket too, but match nothing. A bucket whose rows all go has no folder.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators import catalog
from folio.sources.files import hadoop_path

BUCKET = "_bucket"


def versions(manifest: dict, bucket: int | str) -> list[str]:
    """The folders of a bucket: that of the change that last wrote it whole, and those of inserts since."""
    return manifest["buckets"].get(str(bucket), [])


class BucketTable:
    def __init__(self, spark: SparkSession, path: str, key: list[str], buckets: int = 64, bucket: Column | None = None):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.bucket = (F.pmod(F.xxhash64(*key), F.lit(buckets)) if bucket is None else bucket).cast("int")

    # manifests

    def _manifests(self) -> list[int]:
        fs, folder = hadoop_path(self.spark, f"{self.path}/manifests")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit()) if fs.exists(folder) else []

    def _manifest(self) -> tuple[int, dict]:
        known = self._manifests()
        if not known:
            return 0, {}
        (text,) = self.spark.read.text(f"{self.path}/manifests/{known[-1]:020d}", wholetext=True).first()
        return known[-1], json.loads(text)

    def _commit(self, before: int, content: dict) -> None:
        fs, target = hadoop_path(self.spark, f"{self.path}/manifests/{before + 1:020d}")
        _, staged = hadoop_path(self.spark, f"{self.path}/manifests/_{uuid.uuid4().hex}")
        out = fs.create(staged)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        if fs.exists(target) or not fs.rename(staged, target):
            fs.delete(staged, True)
            raise RuntimeError(f"another change of {self.path} has ended since this one began")

    # reading

    def version(self) -> int:
        """The number of changes so far."""
        return self._manifest()[0]

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows, of some buckets or of all."""
        return self._rows(self._manifest()[1], buckets)

    def _rows(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        if not manifest:
            raise ValueError(f"no table at {self.path}")
        wanted = None if buckets is None else set(buckets)
        folders = [f"{self.path}/data/{v}/{BUCKET}={b}" for b in manifest["buckets"] if wanted is None or int(b) in wanted for v in versions(manifest, b)]
        return self.spark.read.schema(manifest["schema"]).parquet(*folders) if folders else self.spark.createDataFrame([], manifest["schema"])

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets of rows that have these keys."""
        return sorted(r[0] for r in keys.select(self.bucket.alias("b")).distinct().collect())

    # changing

    def _write(self, rows: DataFrame, most_in_file: int = 0) -> tuple[str, list[int]]:
        version = uuid.uuid4().hex
        folder = f"{self.path}/data/{version}"
        placed = rows.withColumn(BUCKET, self.bucket)
        # a bucket is one task's, but for one that is too large, which is dealt to several; small files cost their number, so all tasks share those
        dealt = placed.repartition(self.spark.sparkContext.defaultParallelism) if most_in_file else placed.hint("rebalance", BUCKET)
        dealt.write.partitionBy(BUCKET).option("maxRecordsPerFile", most_in_file).parquet(folder)
        fs, p = hadoop_path(self.spark, folder)
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return version, [int(n.split("=")[1]) for n in names if n.startswith(BUCKET + "=") and n.split("=")[1].lstrip("-").isdigit()]

    def create(self, rows: DataFrame, most_in_file: int = 0) -> BucketTable:
        """The table as these rows, in the place of any that was there."""
        before, _ = self._manifest()
        version, there = self._write(rows, most_in_file)
        self._commit(before, {"schema": rows._jdf.schema().toDDL(), "buckets": {str(b): [version] for b in there}})
        return self

    def change(self, changes: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Rewrite the buckets that have keys of the changes as ``how`` makes of their rows and the changes; these buckets."""
        before, manifest = self._manifest()
        if not manifest:
            raise ValueError(f"no table at {self.path}")
        touched = self.touched(changes)
        if not touched:
            return []
        version, there = self._write(how(self._rows(manifest, touched), changes))
        kept = {b: v for b, v in manifest["buckets"].items() if int(b) not in touched}
        self._commit(before, manifest | {"buckets": kept | {str(b): [version] for b in there}})
        return touched

    def insert(self, rows: DataFrame, most_in_file: int = 10) -> None:
        """Put rows beside what is there, in batches: files of at most so many. Nothing is read or rewritten, and a key may come twice; see ``insert_new``."""
        before, manifest = self._manifest()
        if not manifest:
            self.create(rows, most_in_file)
            return
        version, there = self._write(self._rows(manifest, []).unionByName(rows), most_in_file)
        self._commit(before, manifest | {"buckets": manifest["buckets"] | {str(b): [*versions(manifest, b), version] for b in there}})

    def insert_new(self, rows: DataFrame) -> list[int]:
        """Insert rows whose key is not there."""
        return self.change(rows, lambda old, new: catalog.inserted(old, new, self.key))

    def update(self, changes: DataFrame) -> DataFrame:
        """Set columns by key; the rows of these keys as they are then."""
        touched = self.change(changes, lambda old, new: catalog.updated(old, new, self.key))
        return self.read(touched).join(changes.select(*self.key).distinct(), self.key, "left_semi")

    def upsert(self, rows: DataFrame, merged: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> list[int]:
        """Rows take the place of those with their key or come anew; ``merged`` tells otherwise how old and new rows go together."""
        return self.change(rows, merged or (lambda old, new: catalog.deleted(old, new, self.key).unionByName(new)))

    def delete(self, keys: DataFrame) -> list[int]:
        return self.change(keys.select(*self.key), lambda old, gone: catalog.deleted(old, gone, self.key))

    def delete_by(self, values: DataFrame) -> list[int]:
        """Delete the rows that have these values of other columns than the key: only buckets that have such rows are rewritten."""
        columns = values.columns
        return self.change(self.read().join(values.distinct(), columns, "left_semi"), lambda old, _: catalog.deleted(old, values, columns))

    def vacuum(self) -> int:
        """Delete what the last manifest does not name; no reader of an older one may be at work. The number of folders."""
        known, manifest = self._manifests(), self._manifest()[1]
        used, gone = {v for b in manifest.get("buckets", {}) for v in versions(manifest, b)}, 0
        fs, folder = hadoop_path(self.spark, f"{self.path}/data")
        for s in fs.listStatus(folder) if fs.exists(folder) else []:
            if s.getPath().getName() not in used:
                gone += bool(fs.delete(s.getPath(), True))
        for n in known[:-1]:
            fs.delete(hadoop_path(self.spark, f"{self.path}/manifests/{n:020d}")[1], True)
        return gone


def cascaded_delete(parent: BucketTable, children: list[BucketTable], keys: DataFrame) -> None:
    """Delete keys of a table, and before them the rows of other tables that name them in a column of the same name."""
    keys = keys.select(*parent.key).distinct()
    for child in children:
        child.delete_by(keys)
    parent.delete(keys)
