"""Token ids in files of canonical, length-limited Huffman codes.

Format: a folder with two tables. ``code`` has one row: the code length of each id (a byte each), from which the
canonical codes follow. ``blocks`` has the documents in ascending order of ``doc_id``, by part and block: the
documents' ids and lengths, the coded bits of all ids of the block, most significant first, and the bit offset of
every ``STEP``-th id. Blocks don't need each other; inside one, the runs between two checkpoints are decoded side by
side with one lookup table of all codes of the greatest length.

Code lengths come from the counts of all ids (package-merge, at most ``LIMIT`` bits, more only if there are more ids
in use than so many bits can tell apart). A block holds whole documents, so its size is bounded by ``BLOCK`` ids and the longest document.

Defined cases: a null text is empty, and a document is never empty, as the end id belongs to it; a null ``doc_id``
comes first; repeated rows are written as often as they stand there; the string of a special token in a text is that
token, as in the library's own call; an empty table gives files without blocks.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm import common, tokens
from folio.llm.common import quantile, ship, table, text_or_empty, written

END = 0
LIMIT = 16  # a block's 32-bit reads hold a code of up to 25 bits at any bit offset
STEP = 256
BLOCK = 1 << 18
#: Ids of one part of the files.
PART = 8 << 20


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """For each id its code's length, 0 if it has no count: package-merge, which is optimal for the limit."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n < 2:
        out[used] = 1
        return out
    limit = max(limit, int(n - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.float64)
    # packages of each level: their weights, and how many leaves stand before each in the merged order
    merged, marks = leaf, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaf, pairs])
        at = np.argsort(both, kind="stable")
        merged = both[at]
        marks.append(at < n)
    take, lengths = 2 * n - 2, np.zeros(n, np.int64)
    for is_leaf in reversed(marks):
        leaves = int(is_leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by (length, id)."""
    codes, code, last = np.zeros(len(lengths), np.uint32), 0, 0
    used = np.flatnonzero(lengths)
    for i in used[np.lexsort((used, lengths[used]))]:
        code <<= int(lengths[i]) - last
        codes[i], last = code, int(lengths[i])
        code += 1
    return codes


def encode(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of the ids, and the bit offset of every STEP-th. ``lengths`` of 64 bits and ``codes`` too spare copies."""
    size = lengths.astype(np.int64, copy=False)[ids]
    ends = np.cumsum(size)
    starts = ends - size
    bits = int(ends[-1]) if len(ends) else 0
    # a code is in the 64 bits from the 32-bit word where it begins; codes of one word stand side by side
    at = starts >> 5
    value = codes.astype(np.uint64, copy=False)[ids] << (64 - (starts & 31) - size).astype(np.uint64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else at
    out = np.zeros((bits >> 5) + 3, np.uint32)
    if len(at):
        joined = np.bitwise_or.reduceat(value, first)
        out[at[first]] = (joined >> np.uint64(32)).astype(np.uint32)
        out[at[first] + 1] |= (joined & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return out.astype(">u4").tobytes()[: (bits + 7) >> 3], starts[::STEP].astype("<u4")


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """For all bit strings of the greatest length: the id that they begin with, times 32, and its code's length."""
    most = int(lengths.max(initial=1))
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    spread = np.repeat(order.astype(np.uint32) << 5 | lengths[order], 1 << (most - lengths[order].astype(np.int64)))
    return np.concatenate([spread, np.ones((1 << most) - len(spread), np.uint32)]), most


def decode(blocks: list[tuple[bytes, np.ndarray, int]], lookup: tuple[np.ndarray, int]) -> list[np.ndarray]:
    """The ids of blocks of (bits, checkpoints, number of ids); all their runs advance together."""
    table_, most = lookup
    sizes = [len(b[0]) + 8 for b in blocks]
    base = np.concatenate([[0], np.cumsum(sizes)])
    data = np.zeros(int(base[-1]) + 8, np.uint8)
    for b, at in zip(blocks, base, strict=False):
        data[at : at + len(b[0])] = np.frombuffer(b[0], np.uint8)
    word = (data[:-3].astype(np.uint32) << 24) | (data[1:-2].astype(np.uint32) << 16) | (data[2:-1].astype(np.uint32) << 8) | data[3:]
    at = np.concatenate([b[1].astype(np.uint32) + np.uint32(8 * s) for b, s in zip(blocks, base, strict=False)])
    runs = np.array([len(b[1]) for b in blocks])
    left = np.full(len(at), STEP)
    left[np.cumsum(runs)[runs > 0] - 1] = [(b[2] - 1) % STEP + 1 for b in blocks if b[2]]
    out = np.zeros((STEP, len(at)), np.uint32)
    shift = np.uint32(32 - most)
    # past its end a run reads zeros or the next one's bits, in bounds; those ids are not taken
    last = np.uint32(8 * len(word) - 8)
    for k in range(STEP):
        found = table_[(word[at >> 3] << (at & 7)) >> shift]
        out[k] = found
        at = np.minimum(at + (found & 31), last)
    flat, edge = (out >> 5).T.reshape(-1), np.concatenate([[0], np.cumsum(runs)]) * STEP
    return [flat[edge[i] : edge[i] + b[2]] for i, b in enumerate(blocks)]


def write(docs: DataFrame, folder: str, path: str, end: int = END, special: bool = True) -> None:
    """Encode the texts of ``docs`` (doc_id, text) by the vocabulary at ``path`` and write the files. ``special``: as ``tokens`` has it."""
    spark = docs.sparkSession
    ship(spark)
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(path).get_vocab_size()
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def tokenized(frames):
        total = np.zeros(vocabulary, np.int64)
        for f in frames:
            ids = [x.astype(kind).tobytes() for x in tokens.documents_ids(f["text"], path, tokens.by_run, end, special)]
            for at in range(0, len(ids), 500):
                total += np.bincount(np.frombuffer(b"".join(ids[at : at + 500]), kind), minlength=vocabulary)
            yield pd.DataFrame({"doc_id": f["doc_id"].astype("Int64"), "text_hash": f["text_hash"], "ids": ids, "counts": None})
        # the last row of a task has its counts, so the ids aren't read again for them
        yield pd.DataFrame({"doc_id": pd.array([None], "Int64"), "text_hash": [0], "ids": [None], "counts": [total.tobytes()]})

    def counted(frames):
        for f in frames:
            for x in f["counts"]:
                total = np.frombuffer(x, np.int64)
                used = np.flatnonzero(total)
                yield pd.DataFrame({"id": used, "n": total[used]})

    hashed = docs.select("doc_id", "text", F.xxhash64(text_or_empty()).alias("text_hash"))
    both = written(hashed.mapInPandas(tokenized, "doc_id long, text_hash long, ids binary, counts binary"), "ids")
    ids = both.where("ids is not null").select("doc_id", "text_hash", "ids")
    counts = np.zeros(vocabulary, np.int64)
    for r in both.where("counts is not null").select("counts").mapInPandas(counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts)
    codes, wide = canonical(lengths).astype(np.uint64), lengths.astype(np.int64)
    parts = quantile(int(counts.sum()), PART)

    def coded(frames):
        part, block = TaskContext.get().partitionId(), 0

        def close(doc_ids, run):
            bits, marks = encode(np.concatenate(run), codes, wide)
            return pd.DataFrame({"part": [part], "block": [block], "doc_ids": [doc_ids], "doc_lengths": [[len(x) for x in run]], "n_ids": [sum(map(len, run))], "bits": [bits], "checkpoints": [marks.tobytes()]})

        doc_ids, run, n = [], [], 0
        for f in frames:
            for doc, x in zip(f["doc_id"], f["ids"], strict=True):
                doc_ids.append(None if pd.isna(doc) else int(doc))
                run.append(np.frombuffer(x, kind))
                n += len(run[-1])
                if n >= BLOCK:
                    yield close(doc_ids, run)
                    block, doc_ids, run, n = block + 1, [], [], 0
        if run:
            yield close(doc_ids, run)

    schema = "part int, block int, doc_ids array<long>, doc_lengths array<long>, n_ids long, bits binary, checkpoints binary"
    # rows of one id stand in the order of their texts' hashes, so starts do not hang on the plan and an id with very many rows is parted too
    ranged = ids.repartitionByRange(parts, "doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash")
    ranged.mapInPandas(coded, schema).write.option("compression", "none").parquet(f"{folder}/blocks")
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{folder}/code")


def read(spark: SparkSession, folder: str, rows, schema: str) -> DataFrame:
    """Decode the files. ``rows(doc_ids, starts, arrays)``: what becomes of a block's documents, columns of ``schema``; part and block go before."""
    ship(spark)
    lengths = np.frombuffer(bytes(spark.read.parquet(f"{folder}/code").first()["lengths"]), np.uint8)

    def decoded(frames):
        lookup = decoding_table(lengths)
        for f in frames:
            for at in range(0, len(f), 8):
                some = f.iloc[at : at + 8]
                found = decode([(r.bits, np.frombuffer(r.checkpoints, "<u4"), r.n_ids) for r in some.itertuples()], lookup)
                for r, ids in zip(some.itertuples(), found, strict=True):
                    edge = np.concatenate([[0], np.cumsum(r.doc_lengths)]).astype(np.int64)
                    out = rows(r.doc_ids, edge[:-1], [ids[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)])
                    out.insert(0, "part", r.part)
                    out.insert(1, "block", r.block)
                    yield out

    return spark.read.parquet(f"{folder}/blocks").mapInPandas(decoded, "part int, block int, " + schema)


def digest(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document in the files."""

    def rows(doc_ids, starts, arrays):
        crc = [zlib.crc32(np.ascontiguousarray(x, "<u4")) for x in arrays]
        return pd.DataFrame({"doc_id": pd.array(doc_ids, "Int64"), "at": starts, "n_tokens": [len(x) for x in arrays], "ids_crc32": crc})

    docs = read(spark, folder, rows, "doc_id long, at long, n_tokens long, ids_crc32 long")
    blocks = spark.read.parquet(f"{folder}/blocks").select("part", "block", "n_ids")
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_at"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    places = blocks.select("part", "block", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("block_at")).join(parts, "part")
    return docs.join(places, ["part", "block"]).select("doc_id", (F.col("part_at") + F.col("block_at") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op8_token_file(spark: SparkSession, folder: str) -> DataFrame:
    path = common.noted(spark, f"{common.shared_folder(spark)}/folio/tokens-{uuid.uuid4().hex}")
    write(table(spark, folder, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return digest(spark, path)
