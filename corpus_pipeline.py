"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (session, documents, folder) and returns a DataFrame that is written as Parquet and read again as the
next one's documents. All but the last return the columns of documents.

1. toxicity: documents whose score reaches the threshold go; a null text is scored as an empty one;
2. near_duplicates: of each group of near copies the text with the least doc_id stays; different texts of one doc_id are
   judged one by one, of rows with the same id and text one stays, and documents without words or id have no copies and stay;
3. secrets: what the scan takes for a secret is replaced in its text, and n_chars follows; a null text stays null;
4. mixing: documents are repeated or left out so that sources reach their target weights; without words they are left out;
5. packing: the pieces of all that is left, in sequences of one window.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import common, mixing, neardup, packing, secrets, toxicity
from folio.llm.common import DOCUMENT_COLUMNS, table

#: SQL has no recurrent networks, forests or tokenizers; the stages are tested one by one.
ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    docs = docs.select(*DOCUMENT_COLUMNS)
    model = toxicity.train(*toxicity.labelled(docs, table(spark, folder, "labels")))
    return toxicity.scored(docs, model).where(F.col("score") < toxicity.THRESHOLD).select(*DOCUMENT_COLUMNS)


def without_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return neardup.without_near_copies(docs.select(*DOCUMENT_COLUMNS))


def without_secrets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    found = secrets.scanned(docs.select(*DOCUMENT_COLUMNS), secrets.trained(spark))
    has = F.col("text").isNotNull() & (F.size("findings") > 0)
    out = found.withColumn("text", F.when(has, secrets.redacted(F.col("text"), F.col("findings"))).otherwise(F.col("text")))
    return out.withColumn("n_chars", F.when(has, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*DOCUMENT_COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", without_toxic), ("near_duplicates", without_copies), ("secrets", without_secrets), ("mixing", mixed), ("packing", packed)]


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages. What a stage wrote for itself goes when it has ended, in whatever way, and its documents when the next stage's are there."""
    docs, before = table(spark, folder, "documents"), None
    for name, stage in STAGES[:-1]:
        since = common.mark()
        path = f"{common.shared_folder(spark)}/folio/stage-{name}-{uuid.uuid4().hex}"
        try:
            stage(spark, docs, folder).write.parquet(path)
        finally:
            common.release(since)
        if before:
            common.drop(spark, before)
        docs, before = spark.read.parquet(path), path
    common.noted(spark, before)
    return STAGES[-1][1](spark, docs, folder)
