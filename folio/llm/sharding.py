"""Sharding by a two-pass external shuffle.

Pass one scatters the rows by seeded hashes: a row's shard is the one of highest random weight for its ``doc_id`` (so
the key and the number of shards decide, and one more shard only takes rows), and a second seeded hash, of the whole
row, picks one of the shard's buckets, whose number follows the bytes and rows of the corpus, so that a bucket fits
in memory. Pass two takes each bucket into memory, in the order of a third seeded hash, shuffles it by Fisher-Yates swaps
and writes it, a folder for each shard. A swap's partner is a hash of the seed, the bucket and the place, not of the task, so a
retried task or another plan gives the same shards. A row's slot, given when shards are read, is the number of rows in
the shard's buckets before its own plus its place in the bucket.

Rows of one ``doc_id`` with different texts are in different buckets of its shard. Equal whole rows are told by their hash alone, so they
share a bucket while one holds them; of more, which are found by a count of hashes, each copy has a number and goes to a bucket of its
own. Which of equal rows has which slot is all the same.

Defined cases: a null text has no bytes and the checksum of the empty text; a null ``doc_id`` is a key of its own;
repeated rows stay, each with a slot of its own; an empty table gives no rows; other columns are written too, but for
those of this module's own names (``MADE``), which are replaced.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folio.llm import common
from folio.llm.common import quantile, row_hash, table, text_or_empty

SHARDS = 40
SEED = 20_011
#: Bytes of rows, and rows, that one bucket may hold on average: a task has a bucket in memory, and a swap copies its row numbers.
BUCKET_BYTES = 8 << 20
BUCKET_ROWS = 2048
#: Bytes that a row needs besides its text.
RECORD_BYTES = 16
#: Buckets whose first slots may be broadcast.
MOST_BROADCAST = 100_000
MADE = ("shard", "grown_shard", "bucket", "place", "slot", "_weight", "_s", "_b", "_first", "_copy", "_n", "_h", "_k", "_block")


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + RECORD_BYTES


def weights(key: Column, shards: int, seed: int = SEED) -> Column:
    """A seeded hash of the key for each shard."""
    return F.array(*[F.xxhash64(key, F.lit(seed + i)) for i in range(shards)])


def highest(weight: Column) -> Column:
    return (F.array_position(weight, F.array_max(weight)) - 1).cast("int")


def copies_apart(docs: DataFrame, most: int, seed: int = SEED) -> DataFrame:
    """The rows with ``_copy``: a number from 0 for each copy of a whole row that there are more than ``most`` of, else 0.

    Copies are counted by hashes, without texts. Those of a row with many are one row with their number before they are shuffled, and come
    apart in blocks.
    """
    hashes = [row_hash(seed - k, docs.columns) for k in (4, 5)]
    counts = docs.select(F.struct(*hashes).alias("_k")).groupBy("_k").agg(F.count("*").alias("_n"))
    # written, so that its size is known and texts are shuffled for the joins only where it can't be broadcast
    many = common.written(counts.where(F.col("_n") > most).select("_k"), "copies")
    hashed = docs.withColumn("_h", F.struct(*hashes))
    usual = hashed.join(many, F.col("_h") == F.col("_k"), "left_anti").select(*docs.columns, F.lit(0).cast("long").alias("_copy"))
    counted = hashed.join(many, F.col("_h") == F.col("_k"), "left_semi").groupBy(*docs.columns).agg(F.count("*").alias("_n"))
    blocks = counted.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(most).cast("long")))).repartition(F.col("_block"), *docs.columns)
    last = F.least(F.col("_block") + most, F.col("_n")) - 1
    return usual.unionByName(blocks.select(*docs.columns, F.explode(F.sequence(F.col("_block"), last)).alias("_copy")))


def scatter(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Pass one: every row with shard, grown_shard (with one shard more) and bucket."""
    n, total = docs.agg(F.count("*"), F.sum(size_of())).first()
    buckets = max(quantile(total or 0, shards * bucket_bytes), quantile(n, shards * bucket_rows))
    kept = [c for c in docs.columns if c not in MADE]
    return (
        copies_apart(docs.select(*kept), bucket_rows, seed)
        .withColumn("_weight", weights(F.col("doc_id"), shards + 1, seed))
        .withColumn("shard", highest(F.slice("_weight", 1, shards)))
        .withColumn("grown_shard", highest(F.col("_weight")))
        .withColumn("bucket", F.pmod(F.xxhash64(row_hash(seed - 1, kept), "_copy"), F.lit(buckets)).cast("int"))
        .drop("_weight", "_copy")
    )


def fisher_yates(n: Column, *seeds: Column) -> Column:
    """The numbers below ``n`` in an order made by swaps from the last place down, each with a place not behind it."""

    def swapped(a: Column, i: Column) -> Column:
        j = F.pmod(F.xxhash64(*seeds, i), i + 1)
        # the place j is bound as a one-element array, so its hash is made once
        return F.get(F.transform(F.array(j.cast("int")), lambda k: exchanged(a, k, i)), 0)

    def exchanged(a: Column, k: Column, i: Column) -> Column:
        moved = F.concat(F.slice(a, F.lit(1), k), F.array(F.get(a, i)), F.slice(a, k + 2, i - k - 1), F.array(F.get(a, k)), F.slice(a, i + 2, F.size(a)))
        return F.when(k == i, a).otherwise(moved)

    n = n.cast("int")
    downwards = F.when(n > 1, F.sequence(n - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(downwards, F.sequence(F.lit(0), n - 1), swapped)


def shuffled(scattered: DataFrame, seed: int = SEED) -> DataFrame:
    """Pass two: the rows of each bucket in the order of Fisher-Yates swaps, with their place there."""
    kept = [c for c in scattered.columns if c not in MADE]
    row = F.struct(*[row_hash(seed - k, kept).alias(f"h{k}") for k in (2, 3)], F.struct(*kept, "grown_shard").alias("row"))
    buckets = scattered.repartition("shard", "bucket").groupBy("shard", "bucket").agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    order = fisher_yates(F.size("_rows"), F.lit(seed), F.col("shard"), F.col("bucket"))
    placed = buckets.select("shard", "bucket", F.posexplode(F.transform(order, lambda i: F.get(F.col("_rows"), i)["row"])).alias("place", "_row"))
    return placed.select(*[F.col("_row")[c].alias(c) for c in kept], "shard", F.col("_row.grown_shard").alias("grown_shard"), "bucket", F.col("place").cast("long").alias("place"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS) -> StructType:
    """Write the whole rows, a folder for each shard, and return the schema of what was written."""
    rows = shuffled(scatter(docs, shards, seed, bucket_bytes, bucket_rows), seed)
    rows.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return rows.schema


def read_shards(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The written rows with their shard, bucket and place."""
    return spark.read.schema(schema).parquet(path)


def with_slots(rows: DataFrame) -> DataFrame:
    """Rows of ``read_shards`` with their slot; slots are gapless from 0 in each shard.

    The first slots of buckets are broadcast while there are few buckets, so rows stay where they are; else they are joined sorted.
    """
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    first = counts.select(F.col("shard").alias("_s"), F.col("bucket").alias("_b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    first = first.hint("broadcast" if first.count() <= MOST_BROADCAST else "merge")
    return rows.join(first, (F.col("shard") == F.col("_s")) & (F.col("bucket") == F.col("_b"))).withColumn("slot", F.col("_first") + F.col("place")).drop("_s", "_b", "_first", "bucket", "place")


def op4_sharding(spark: SparkSession, folder: str) -> DataFrame:
    path = common.noted(spark, f"{common.shared_folder(spark)}/folio/shards-{uuid.uuid4().hex}")
    schema = write_shards(table(spark, folder, "documents").select("doc_id", "text"), path)
    crc = F.crc32(text_or_empty().cast("binary"))
    rows = read_shards(spark, path, schema).select("doc_id", size_of().alias("size"), crc.alias("text_crc32"), F.lit("key").alias("law"), "shard", "grown_shard", "bucket", "place")
    return with_slots(rows)
