"""What the operators of this subpackage share: reading tables, shared folders, written tables."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but a space, a tab, a line end or the like (the code points 9 to 13).
WORD = r"[^\x20\x09-\x0D]+"
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: The columns of the documents table, in order.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir`` of the session.

    Where the setting is missing a temporary folder is set and used, but only where driver and executors are one process.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="folio-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it again, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/folio/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(noted(spark, path))
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A point in the list of written tables, for ``release``."""
    return len(_written)


def release(since: int = 0) -> None:
    """Delete the tables written after ``since``; call it once what was made from them is stored."""
    while len(_written) > since:
        drop(*_written.pop())


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def noted(spark: SparkSession, path: str) -> str:
    """A folder that ``release`` is to delete as well."""
    _written.append((spark, path))
    return path


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text as an array; none for an empty or blank text."""
    return F.filter(F.split(text, SPACE_RUN), lambda w: w != "")


def row_hash(seed: int, columns: list[str]) -> Column:
    """A seeded hash of a row; it also tells in which columns nulls stand, which Spark's hash alone passes over."""
    return F.xxhash64(F.lit(seed), *columns, *[F.col(c).isNull() for c in columns])


def quantile(numerator: int, denominator: int) -> int:
    """The division rounded up, at least 1: a number of buckets for so much data."""
    return max(1, -(-numerator // max(1, denominator)))


def with_facts(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """The rows with the columns of ``facts``, which has one row for each key.

    One plan at all sizes: Spark broadcasts facts that it has found to be small; else both sides are sorted, and what a hot key has too much
    of is parted while the join runs, as the other side of it is one row.
    """
    facts = facts.withColumnRenamed(key, "_fact_key").where("_fact_key is not null")
    return rows.join(facts, F.col(key) == F.col("_fact_key")).drop("_fact_key")


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once in a session, for operators that run Python there."""
    sc = spark.sparkContext
    if getattr(sc, "_folio_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="folio-")) / "folio_package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(path))
    sc._folio_shipped = True
