"""Threshold-scaled fingerprints: of all hashes of a document's word shingles those below a fixed fraction are kept.

As the fraction is the same for all, the fingerprint of a union is the union of fingerprints (``merged``), and the share
of one fingerprint found in another estimates how much of the one document is in the other (``containment``), however
unequal their sizes. A document none of whose hashes is below keeps its least one, so only a document without words has
an empty fingerprint.

Defined cases: a null text is empty; with fewer words than a shingle has, the whole sequence is the one shingle; two
documents without words are alike (1), one of them and one with words are not (0); a null ``doc_id`` is the least;
repeated rows have fingerprints of their own and follow each other, those of one id in descending order of their texts' hashes; a
single row is its own next; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.common import SPACE_RUN, quantile, table, text_or_empty

WORDS = 5
#: Hashes have 42 bits; those below are kept: a quarter of all.
BITS, BELOW = 42, 1 << 40
#: Bytes of text in one run of neighbouring ids, on average, while there are fewer runs than the most; a run is sorted, which spills.
RUN_BYTES, MOST_RUNS = 8 << 20, 100_000
#: Quantiles of ids at which runs are cut first.
COARSE = 256


def bound(value: Column, f) -> Column:
    """f of a value that is computed once, although f names it often."""
    return F.transform(F.array(value), f)[0]


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """The hashes of all runs of so many words."""

    def of(w: Column) -> Column:
        def run(i: Column) -> Column:
            return F.shiftrightunsigned(F.xxhash64(*[w[i + k] for k in range(words)]), 64 - BITS)

        short = F.when(F.size(w) > 0, F.array(F.shiftrightunsigned(F.xxhash64(F.size(w), F.array_join(w, " ")), 64 - BITS))).otherwise(F.array().cast("array<bigint>"))
        return F.when(F.size(w) < words, short).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - words, F.lit(0))), run))

    return bound(F.filter(F.split(text, SPACE_RUN), lambda x: x != ""), of)


def fingerprint(text: Column, words: int = WORDS) -> Column:
    """The kept hashes, different and in order."""

    def of(h: Column) -> Column:
        low = F.array_sort(F.array_distinct(F.filter(h, lambda x: x < BELOW)))
        return F.when((F.size(h) == 0) | F.exists(h, lambda x: x < BELOW), low).otherwise(F.array(F.array_min(h)))

    return bound(shingle_hashes(text, words), of)


def merged(a: Column, b: Column) -> Column:
    """The fingerprint of both documents together."""
    return bound(F.array_sort(F.array_union(a, b)), lambda x: F.when(F.exists(x, lambda v: v < BELOW), F.filter(x, lambda v: v < BELOW)).otherwise(F.slice(x, 1, 1)))


def _shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def containment(a: Column, b: Column) -> Column:
    """The estimated share of the first document's shingles that the second has."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(_shared(a, b) / F.size(a)).cast("double")


def likeness(a: Column, b: Column) -> Column:
    """The estimated Jaccard similarity."""
    shared = _shared(a, b)
    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(shared / (F.size(a) + F.size(b) - shared)).cast("double")


def as_text(print_: Column) -> Column:
    return F.array_join(F.transform(print_, F.hex), ",")


def runs_of_ids(docs: DataFrame, run_bytes: int = RUN_BYTES) -> DataFrame:
    """docs (doc_id, _id, _hash, text) with ``_run``: neighbours by (_id, _hash) have neighbouring numbers, and a run has so many bytes.

    Ids are cut at quantiles and evenly between these; rows of an id that is a quantile are cut by their texts' hashes, so an
    id that very many rows share is many runs. Only the quantiles are collected, at most ``COARSE``.
    """
    quantiles = [i / COARSE for i in range(1, COARSE)]
    facts = docs.agg(F.sum(F.octet_length("text")).alias("total"), F.percentile_approx("_id", quantiles, 10_000).alias("cuts"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    runs = min(MOST_RUNS, quantile(facts["total"] or 0, run_bytes))
    if runs == 1:
        return docs.withColumn("_run", F.lit(0).cast("long"))
    values = sorted(set(facts["cuts"]))
    slices = quantile(runs, len(values))
    known = F.array(*[F.lit(v) for v in values]).cast("array<bigint>")
    cut = bound(known, lambda c: F.size(F.filter(c, lambda x: x <= F.col("_id"))))
    low = F.coalesce(F.get(known, F.col("_cut") - 1), F.lit(facts["low"])).cast("double")
    high = F.coalesce(F.get(known, F.col("_cut")), F.lit(facts["high"])).cast("double")
    is_value = F.coalesce(F.get(known, F.col("_cut") - 1) == F.col("_id"), F.lit(False))
    part = F.when(is_value, F.col("_hash").cast("double") / 2.0**64 + 0.5).otherwise(F.coalesce((F.col("_id").cast("double") - low) / (high - low + 1), F.lit(0.0)))
    inside = F.least(F.greatest(F.floor(part * slices), F.lit(0)), F.lit(slices - 1))
    return docs.withColumn("_cut", cut).withColumn("_run", ((2 * F.col("_cut") + (~is_value).cast("int")) * slices + inside).cast("long")).drop("_cut")


def with_next(docs: DataFrame, run_bytes: int = RUN_BYTES) -> DataFrame:
    """doc_id, text, next_text and both fingerprints; the next is by descending doc_id, after the last the first.

    Each run of neighbouring ids is sorted by itself; the first row of a run also stands behind the run before. Which rows
    these are is a table of one row for each run, at most about ``MOST_RUNS``, and broadcast. The texts are dealt once.
    """
    docs = docs.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_id"), text_or_empty().alias("text")).withColumn("_hash", F.xxhash64("text"))
    docs = runs_of_ids(docs, run_bytes)
    heads = docs.groupBy("_run").agg(F.max(F.struct("_id", "_hash")).alias("_head"))
    # a run's last row is followed by the head of the run below, the lowest run's by the highest head
    order = Window.orderBy("_run")
    lowest = F.first("_run").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = heads.select(F.col("_head._id").alias("_i"), F.col("_head._hash").alias("_h"), F.coalesce(F.lead("_run").over(order), lowest).alias("_to"))
    behind = docs.join(F.broadcast(after), (F.col("_id") == F.col("_i")) & (F.col("_hash") == F.col("_h"))).select(*[c for c in docs.columns if c != "_run"], F.col("_to").alias("_run"))
    rows = docs.withColumn("_guest", F.lit(False)).unionByName(behind.withColumn("_guest", F.lit(True)))
    w = Window.partitionBy("_run").orderBy("_guest", F.desc("_id"), F.desc("_hash"), F.desc("text"))
    rows = rows.withColumn("next_text", F.lead("text").over(w)).withColumn("print", fingerprint(F.col("text"))).withColumn("next_print", F.lead("print").over(w))
    return rows.where(~F.col("_guest")).select("doc_id", "text", "next_text", "print", "next_print")


def op7_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    rows = with_next(table(spark, folder, "documents")).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", "n_chars", "print", "next_print", edited.alias("edited"))
    rows = rows.select("doc_id", "n_chars", "print", "next_print", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprint(F.col("edited")).alias("edited_print"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("print")).alias("fingerprint"), as_text(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"), likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
