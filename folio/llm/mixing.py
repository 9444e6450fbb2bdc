"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source gets a target number of words: its share of all words by weight, stopped at ``most_passes`` times what it
has, the excess shared again by weight. A source's documents stand in a seeded random order; whole passes over it and
then the documents at its head, up to the target, are cut into blocks, whose number is the source's quota. A binary tree
over the output shards splits the quotas: at each node the number of a source's blocks that go left is drawn from the
multivariate hypergeometric distribution, given the room on the left, so the quotas of all leaves add up exactly. A leaf
draws its quota of blocks, disjoint from all others', from a seeded permutation of the source's blocks; a document is
taken as often as a leaf draws a block that it begins in. A seeded hash shuffles what a shard has got.

Only one row for each source comes to the driver (a mix names its sources with weights, so their number is that of a
configuration), and which leaf draws a block is a table of ``shards`` x ``BLOCKS_PER_SHARD`` numbers. Sizes are counted
once; equal rows are one row with a count until they are drawn; whole texts move twice, to their draws and to their shards.

Defined cases: null source is a source of its own, last in order; a null or blank text has size 0 and is not taken; a
source without words has target 0; repeated rows are documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.common import DOCUMENT_COLUMNS, SPACE_RUN, quantile, row_hash, table, text_or_empty, written

SEED = 31_013
WEIGHTS = (1.0, 2.0, 3.0)
MOST_PASSES = 3
#: Sources for which quotas are made; each is a row on the driver.
MOST_SOURCES = 100_000
SHARDS = 32
BLOCKS_PER_SHARD = 64
#: Documents of a source that close what its head leaves open of the target, at most.
CLOSING_DOCUMENTS = 4
#: Documents in a block on average, at least; it has more where the corpus is larger.
BLOCK_DOCUMENTS = 4
#: Words of a shard that are shuffled together, on average.
PIECE_WORDS = 8_000_000
#: Runs of the random order into which a source is dealt for its running sums, at least, and the documents of one: a hot source is never in one task.
RUNS, RUN_ROWS = 512, 100_000


def word_count(text: Column) -> Column:
    """Words of a text: the parts between its spaces, less the empty ones before the first and after the last word."""
    spaces = [chr(c) for c in (32, 9, 10, 11, 12, 13)]
    ends = [F.substring(text, at, 1).isin(spaces).cast("int") for at in (1, -1)]
    return F.when(F.length(text) == 0, F.lit(0)).otherwise(F.size(F.split(text, SPACE_RUN)) - ends[0] - ends[1]).cast("long")


def targets(sizes: dict, weights: Sequence[float] = WEIGHTS, most_passes: float = MOST_PASSES, total: float | None = None) -> dict:
    """Source to target. ``sizes``: source (or None) to its words. ``total``: of the mix, by default of all sources."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    cap = {s: float(most_passes) * sizes[s] for s in order}
    left, open_, out = float(sum(sizes.values()) if total is None else total), set(order), dict.fromkeys(order, 0.0)
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = [s for s in order if s in open_ and cap[s] <= share * weight[s]]
        if not full:
            out |= {s: share * weight[s] for s in open_}
            break
        for s in full:
            out[s] = cap[s]
            left -= cap[s]
            open_.discard(s)
    return out


def hypergeometric(rng: random.Random, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` from good and bad are good. Inversion from the mode, so few steps."""
    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (good + bad + 2)))

    def up(k: int) -> float:
        return (good - k) * (drawn - k) / ((k + 1) * (bad - drawn + k + 1))

    below, above, p = [], [], 1.0
    for k in range(mode, high):
        p *= up(k)
        above.append(p)
        if p < 1e-14:
            break
    p = 1.0
    for k in range(mode, low, -1):
        p /= up(k - 1)
        below.append(p)
        if p < 1e-14:
            break
    u = rng.random() * (1.0 + sum(below) + sum(above)) - 1.0
    if u < 0:
        return mode
    for step, run in ((1, above), (-1, below)):
        for i, x in enumerate(run, 1):
            u -= x
            if u < 0:
                return mode + step * i
    return mode


def split_quotas(blocks: Sequence[int], shards: int, seed: int = SEED) -> list[list[int]]:
    """Blocks of each source to be dealt; for each shard how many of each source it gets. Shards differ by a block at most."""
    total, rng = sum(blocks), random.Random(seed)
    room = [total // shards + (i < total % shards) for i in range(shards)]
    out: list[list[int]] = [[] for _ in range(shards)]
    todo = [(0, shards, list(blocks))]
    while todo:
        first, last, have = todo.pop()
        if last - first == 1:
            out[first] = have
            continue
        middle = (first + last) // 2
        drawn, rest, left = sum(room[first:middle]), sum(have), []
        for n in have:
            rest -= n
            left.append(hypergeometric(rng, n, rest, drawn))
            drawn -= left[-1]
        todo += [(first, middle, left), (middle, last, [a - b for a, b in zip(have, left, strict=True)])]
    return out


def literal_table(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """A small table made by the JVM from a literal; no Python reads it."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{ddl}>>")))


def dealt(quotas: Sequence[Sequence[int]], blocks: Sequence[int], seed: int = SEED) -> list[list[int]]:
    """For each source the shard that draws each of its blocks, -1 where none does: leaves take their quotas of a permutation."""
    out = []
    for i, n in enumerate(blocks):
        order = list(range(n))
        random.Random(seed + i).shuffle(order)
        mine, at = [-1] * n, 0
        for shard, quota in enumerate(quotas):
            for b in order[at : at + quota[i]]:
                mine[b] = shard
            at += quota[i]
        out.append(mine)
    return out


def rows_of(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and two hashes of the whole row, which tell different documents apart."""
    size = word_count(text_or_empty()) if "text" in docs.columns else F.col("size")
    return docs.select("doc_id", "source", size.alias("size"), *[row_hash(k, docs.columns).alias(f"_k{k}") for k in (1, 2)])


def mix(rows: DataFrame, weights: Sequence[float] = WEIGHTS, most_passes: int = MOST_PASSES, shards: int = SHARDS, seed: int = SEED, total: float | None = None) -> DataFrame:
    """The rows of ``rows_of`` (written) with source_size, target, taken and draws.

    ``draws`` is an array of (pass, block, shard, place); a row with an empty one is not in the mix; ``place`` orders
    a shard's rows. What the documents at the head leave open is closed, as far as a few documents can, by those of
    the source whose sizes are nearest to it.
    """
    spark = rows.sparkSession
    bits = max(RUNS, quantile(rows.count(), RUN_ROWS)).bit_length() - 1
    keys = ["doc_id", "source", "size", "_k1", "_k2"]
    groups = rows.groupBy(*keys).agg(F.count("*").alias("_copies"))
    groups = groups.withColumn("_order", F.xxhash64("doc_id", "_k1", F.lit(seed))).withColumn("_run", F.shiftrightunsigned("_order", 64 - bits).cast("int"))
    groups = written(groups, "mix-rows")
    size = F.col("size")
    sums = groups.groupBy("source", "_run").agg(F.sum(size * F.col("_copies")).alias("words"), F.sum(F.when(size > 0, F.col("_copies"))).alias("documents"))
    found = sums.groupBy("source").agg(F.sum("words").alias("words"), F.sum("documents").alias("documents")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: their quotas are made on the driver")
    have = {r["source"]: int(r["words"] or 0) for r in found}
    mean = sum(have.values()) / max(1, sum(r["documents"] or 0 for r in found))
    goal = targets(have, weights, most_passes, total)
    names = sorted(have, key=lambda s: (s is None, s or ""))
    block_words = max(1.0, sum(goal.values()) / (shards * BLOCKS_PER_SHARD), BLOCK_DOCUMENTS * mean)
    blocks = [int(-(-goal[s] // block_words)) if goal[s] else 0 for s in names]
    deal = dealt(split_quotas(blocks, shards, seed), blocks, seed)
    facts = literal_table(spark, [{"name": s, "source_size": have[s], "target": goal[s], "deal": deal[i]} for i, s in enumerate(names)], "name string, source_size bigint, target double, deal array<int>")
    before = Window.partitionBy("source").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    heads = sums.select("source", "_run", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("_head"))
    heads = heads.join(facts.drop("deal"), heads["source"].eqNullSafe(facts["name"])).select(F.col("source").alias("_s"), F.col("_run").alias("_r"), "_head", "source_size", "target")
    inside = Window.partitionBy("source", "_run").orderBy("_order", *keys).rowsBetween(Window.unboundedPreceding, -1)
    whole = F.col("source_size")
    passes = F.when(whole > 0, F.least(F.floor(F.col("target") / whole), F.lit(most_passes))).otherwise(0).cast("int")
    placed = groups.withColumn("_inside", F.coalesce(F.sum(size * F.col("_copies")).over(inside), F.lit(0)))
    placed = placed.join(heads, placed["source"].eqNullSafe(heads["_s"]) & (placed["_run"] == heads["_r"])).drop("_s", "_r")
    placed = placed.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))
    placed = placed.withColumn("_at", F.col("_head") + F.col("_inside") + F.col("_copy") * size).withColumn("_passes", passes).withColumn("_rest", F.col("target") - F.col("_passes") * whole)
    placed = placed.withColumn("_is_head", (size > 0) & (F.col("_passes") < most_passes) & (F.col("_at") + size / 2 <= F.col("_rest")))
    placed = written(placed.drop("_inside", "_head", "_copy", "_copies", "_run"), "mix-placed")
    found = placed.groupBy("source").agg((F.max("_rest") - F.coalesce(F.sum(F.when(F.col("_is_head"), size)), F.lit(0))).alias("open")).collect()
    open_, moved = {r["source"]: float(r["open"]) for r in found}, {r["source"]: [] for r in found}

    def with_moved(rows_: DataFrame) -> DataFrame:
        """The rows with what is open of their source and whether they were moved into or out of the mix's head."""
        state = literal_table(spark, [{"name": s, "open": open_[s], "moved": moved[s]} for s in open_], "name string, open double, moved array<struct<o:bigint,at:bigint>>")
        out = rows_.join(state, rows_["source"].eqNullSafe(state["name"])).drop("name")
        return out.withColumn("_moved", F.exists("moved", lambda m: (m["o"] == F.col("_order")) & (m["at"] == F.col("_at"))) & (size > 0))

    for _ in range(CLOSING_DOCUMENTS):
        # a document that is not taken closes an open rest, one that is taken an excess
        near = with_moved(placed).where(~F.col("_moved") & (size > 0) & (F.col("_passes") < most_passes) & (F.col("_is_head") == (F.col("open") < 0)) & (size < 2 * F.abs("open")))
        best = near.groupBy("source").agg(F.min_by(F.struct("_order", "_at", "size"), F.struct(F.abs(size - F.abs("open")), "_order", "_at")).alias("m")).collect()
        for r in best:
            open_[r["source"]] -= math.copysign(r["m"]["size"], open_[r["source"]])
            moved[r["source"]].append({"o": r["m"]["_order"], "at": r["m"]["_at"]})
        if not best:
            break
    out = with_moved(placed)
    out = out.join(facts.select("name", "deal"), out["source"].eqNullSafe(facts["name"]))
    wanted = F.when(size == 0, 0).otherwise(F.col("_passes") + (F.col("_is_head") != F.col("_moved")).cast("int"))

    def draw(p: Column) -> Column:
        # the document that closes a rest may stand anywhere; it goes with the last block
        block = F.least(F.floor((p * whole + F.col("_at")) / F.lit(block_words)).cast("int"), F.size("deal") - 1)
        return F.struct(p.alias("pass"), block.alias("block"), F.get("deal", block).alias("shard"), F.xxhash64("_order", "_at", p, F.lit(seed + 1)).alias("place"))

    draws = F.when(wanted > 0, F.filter(F.transform(F.sequence(F.lit(0), F.greatest(wanted - 1, F.lit(0))), draw), lambda d: d["shard"] >= 0)).otherwise(F.array())
    out = out.withColumn("draws", draws)
    return out.select(*keys, "source_size", "target", (size * F.size("draws")).alias("taken"), "draws")


def mixed_documents(docs: DataFrame, shards: int = SHARDS, **options) -> DataFrame:
    """The mix itself: a row of the documents' columns for each draw, in shards that are shuffled locally."""
    docs = docs.select(*DOCUMENT_COLUMNS)
    rows = written(rows_of(docs), "mix-sizes")
    drawn = mix(rows, shards=shards, **options)
    words = rows.agg(F.sum("size")).first()[0] or 0
    pieces = quantile(words, shards * PIECE_WORDS)
    drawn = drawn.select(F.col("_k1").alias("_d1"), F.col("_k2").alias("_d2"), F.explode("draws").alias("_d")).select("_d1", "_d2", F.col("_d.shard").alias("_shard"), F.col("_d.place").alias("_place"))
    # equal rows have their draws together, so one of their texts is enough
    whole = docs.select("*", *[row_hash(k, docs.columns).alias(f"_k{k}") for k in (1, 2)]).dropDuplicates(["_k1", "_k2"])
    out = drawn.join(whole.hint("merge"), (F.col("_d1") == F.col("_k1")) & (F.col("_d2") == F.col("_k2"))).withColumn("_piece", F.pmod("_place", F.lit(pieces)))
    return out.repartition("_shard", "_piece").sortWithinPartitions("_shard", "_piece", "_place").select(*DOCUMENT_COLUMNS)


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    drawn = mix(written(rows_of(table(spark, folder, "documents").select("doc_id", "source", "text")), "mix-sizes"))
    return drawn.select("doc_id", "size", "source_size", "target", "taken", *[F.col(f"draws.{k}").alias(f"{k}s") for k in ("block", "shard", "place")])
