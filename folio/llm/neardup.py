"""Near duplicates by minhash signatures and a multi-index Hamming join.

A document is its set of word shingles. Its signature has ``chunks`` x ``WIDTH`` places of b = 32 bits, each the least of
the shingles' hashes under one hash function; the signature distance of two documents is the number of places that
differ. Split into ``chunks`` chunks, two signatures at a distance of at most 2 * chunks - 1 agree, by pigeonhole, up to one place in
some chunk. So for each chunk its allowed errors are enumerated: the chunk with each one of its places left open. Who
agrees in none of these has a greater distance; all pairs below that distance meet in a bucket.

No bucket emits its pairs. First each document of a bucket is held against one of it, its first; links are confirmed on
the full sets, and components are formed. Then only buckets that still hold several components are looked at: in
pairs of blocks of bounded size their members' signatures are compared across components, pairs within the distance
``reach`` are confirmed on the full sets, in the same pairs of blocks, and links that join components are all that leaves
the task. A pair that is left out is connected already. Documents of equal words are one text throughout, and facts about
a bucket, a first or a component are sums of partial sums that are joined back, so none of these is one task's.

Defined cases: letters A to Z count as small ones; a null, empty or blank text has an empty set and no links; with
fewer words than a shingle has, the whole sequence is the one shingle; a null ``doc_id`` is not linked and has no
component, and its row is kept; rows of one ``doc_id`` are one document, which is linked with all that any of its texts
is linked with, rows without words included; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import quantile, ship, table, text_or_empty, with_facts, written
from folio.llm.components import components
from folio.llm.textbytes import Texts, mixed, shingles
from folio.llm.tokens import drop_encoders, in_portions

WIDTH = 5
SEED = 51_001
#: Pairs that are confirmed in one group, members of a bucket in one block, and members beside a first one in one group.
PAIRS, BLOCK, BESIDE = 1000, 512, 256
#: Ways in which a bucket names its first document.
FIRSTS = 4


def shape(percent: int) -> tuple[int, int]:
    """(chunks, reach) for a similarity of so many percent: a pair at the limit is missed with a chance below 1e-6."""
    t = percent / 100
    hit = t**WIDTH + WIDTH * (1 - t) * t ** (WIDTH - 1)
    chunks = math.ceil(math.log(1e-6) / math.log(max(1 - hit, 1e-12)))
    places = chunks * WIDTH
    return chunks, min(places, math.ceil(places * (1 - t) + 6 * math.sqrt(places * t * (1 - t))))


def signatures(texts: list[str], words: int, places: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the word sequence, size of the set, signature) of each text."""
    rng = np.random.default_rng(SEED)
    factor = rng.integers(1, 1 << 63, places, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    offset = rng.integers(1, 1 << 63, places, dtype=np.uint64)
    keys, sizes, out = [], [], []
    for _, run in in_portions(texts, 1 << 20):
        t = Texts(run, lower=True)
        found, edge = shingles(t, words)
        size = np.diff(edge)
        signature = np.zeros((len(run), places), np.uint32)
        full = size > 0
        if full.any():
            at = edge[:-1][full]
            for j in range(places):
                signature[full, j] = np.minimum.reduceat((found ^ offset[j]) * factor[j], at) >> np.uint64(32)
        h = t.word_hashes()
        place = np.arange(len(h)) - np.repeat(t.word_edge[:-1], t.n_words) + 1
        run_ = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(h + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64)])
        keys.append(mixed(run_[t.word_edge[1:]] - run_[t.word_edge[:-1]] + t.n_words.astype(np.uint64)).view(np.int64))
        sizes.append(size)
        out.append(signature)
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, places), np.uint32)
    return np.concatenate(keys), np.concatenate(sizes), np.concatenate(out)


def sets_of(texts, words: int) -> list[np.ndarray]:
    """The sorted hashes of each text's shingles; a few texts at a time, as what is made for each byte is much larger."""
    out: list[np.ndarray] = []
    for _, run in in_portions(texts, 1 << 20):
        found, edge = shingles(Texts(run, lower=True), words)
        out += [found[a:b].copy() for a, b in zip(edge[:-1], edge[1:], strict=True)]
    return out


def open_chunks(signature: np.ndarray) -> np.ndarray:
    """For each row the keys of all its chunks with one place left open."""
    places = signature.shape[1]
    spread = mixed(signature.astype(np.uint64) + (np.arange(places, dtype=np.uint64) << np.uint64(32)))
    whole = spread.reshape(len(signature), places // WIDTH, WIDTH).sum(2, dtype=np.uint64)
    place = mixed(np.arange(1, places + 1, dtype=np.uint64))
    return mixed(np.repeat(whole, WIDTH, axis=1) - spread + place).view(np.int64)


def sketched(docs: DataFrame, words: int, places: int) -> DataFrame:
    """doc_id, hash of the text, and of its words the key, the size of the set and the signature."""
    ship(docs.sparkSession)

    def run(frames):
        drop_encoders()
        for f in frames:
            keys, sizes, signature = signatures([x or "" for x in f["text"]], words, places)
            yield pd.DataFrame({"doc_id": f["doc_id"].astype("Int64"), "text_hash": f["text_hash"], "key": keys, "n": sizes, "signature": [s.tobytes() for s in signature]})

    hashed = docs.select("doc_id", "text", F.xxhash64(text_or_empty()).alias("text_hash"))
    return hashed.mapInPandas(run, "doc_id long, text_hash long, key long, n long, signature binary")


def with_texts(needed: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of ``needed`` with the text of their ``doc`` and ``text_hash``. All is joined sorted: what is needed grows with the corpus."""
    placed = needed.withColumnsRenamed({"doc": "_doc", "text_hash": "_hash"})
    wanted = placed.select(F.col("_doc").alias("_d"), F.col("_hash").alias("_h")).distinct()
    texts = docs.select(F.col("doc_id").alias("_of"), F.xxhash64(text_or_empty()).alias("_of_hash"), "text").where("_of is not null")
    texts = texts.join(wanted.hint("merge"), (F.col("_of") == F.col("_d")) & (F.col("_of_hash") == F.col("_h")), "left_semi").dropDuplicates(["_of", "_of_hash"])
    return placed.join(texts.hint("merge"), (F.col("_doc") == F.col("_of")) & (F.col("_hash") == F.col("_of_hash"))).drop("_doc", "_hash", "_of", "_of_hash")


def bucketed(firsts: DataFrame, places: int) -> DataFrame:
    """(bucket, id) for each document and open chunk."""

    def run(frames):
        for f in frames:
            if len(f):
                keys = open_chunks(np.frombuffer(b"".join(f["signature"]), np.uint32).reshape(len(f), places))
                yield pd.DataFrame({"bucket": keys.ravel(), "id": np.repeat(f["id"].to_numpy(np.int64), keys.shape[1])})

    return firsts.select("id", "signature").mapInPandas(run, "bucket long, id long")


def confirmed(pairs: DataFrame, firsts: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ids whose full sets are similar enough."""
    pairs = written(pairs, "pairs")
    total = pairs.count()
    groups = quantile(total, PAIRS)
    placed = with_facts(pairs, pairs.groupBy("a").agg(F.count("*").alias("n")), "a")
    beside = F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / BESIDE))
    # written, as what stands before a table that is read twice is made twice
    placed = written(placed.select(F.pmod(F.xxhash64("a", beside), F.lit(groups)).alias("group"), "a", "b"), "dealt")
    needed = placed.select("group", "a", F.col("b").alias("id")).unionAll(placed.select("group", "a", F.col("a").alias("id")).distinct())
    needed = written(needed.join(firsts.select(F.col("id").alias("_i"), "doc", "text_hash").hint("merge"), F.col("id") == F.col("_i")).drop("_i"), "needed")
    texts = with_texts(needed, docs).select("group", "a", "id", "text")

    def run(f):
        sets = sets_of(f["text"], words)
        a, b = f["a"].to_numpy(np.int64), f["id"].to_numpy(np.int64)
        is_first = a == b
        first = {a[i]: sets[i] for i in np.flatnonzero(is_first)}
        out = []
        for i in np.flatnonzero(~is_first):
            x, y = first[a[i]], sets[i]
            less, more = min(len(x), len(y)), max(len(x), len(y))
            if less and 100 * less >= percent * more:
                at = np.searchsorted(x, y)
                both = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                if 100 * both >= percent * (len(x) + len(y) - both):
                    out.append((a[i], b[i]))
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return written(texts.groupBy("group").applyInPandas(run, "a long, b long"), "confirmed")


def shared_counts(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each pair (i, j) how many hashes its two sorted sets share."""
    if len(i) < 4 * len(sets):
        out = np.zeros(len(i), np.int64)
        for k, (a, b) in enumerate(zip(i, j, strict=True)):
            x, y = (sets[a], sets[b]) if len(sets[a]) < len(sets[b]) else (sets[b], sets[a])
            if len(x):
                out[k] = (y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()
        return out
    # many pairs of few sets: products of their rows, over the hashes that are in more than one
    whose = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    more = count[column] > 1
    whose, column = whose[more], np.unique(column[more], return_inverse=True)[1]
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    whose, column = whose[order], column[order]
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [low, low + 4096])
        part = np.zeros((len(sets), 4096), np.float32)
        part[whose[a:b], column[a:b] - low] = 1
        out += part @ part.T
    return out[i, j].astype(np.int64)


def spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the links (a, b) join what the ones before have not joined."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while top.get(x, x) != x:
            top[x] = x = top.get(top[x], top[x])
        return x

    out = np.zeros(len(a), bool)
    for k in range(len(a)):
        x, y = find(int(a[k])), find(int(b[k]))
        if x != y:
            top[max(x, y)], out[k] = min(x, y), True
    return out


def block_pairs(members: DataFrame) -> DataFrame:
    """The members, in each pair of blocks (x, y) of their bucket that they belong to; y holds no rows of the largest component.

    A bucket's largest component needs no pairs inside; its rows are dealt to blocks of their own, the others' to further
    ones, and every block of others meets each block before it and itself. So no task gets more than two blocks.
    """
    counts = members.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    mains = counts.groupBy("bucket").agg(F.max_by(F.struct("component", "n"), F.struct("n", "component")).alias("main"), F.sum("n").alias("n"))
    mains = mains.select("bucket", F.col("main.component").alias("main"), F.ceil(F.col("main.n") / BLOCK).cast("int").alias("m"), F.ceil((F.col("n") - F.col("main.n")) / BLOCK).cast("int").alias("o"), "n")
    rows = with_facts(members, mains, "bucket")
    m, o, mine = F.col("m"), F.col("o"), F.col("block")
    other = F.col("component") != F.col("main")
    rows = rows.withColumn("block", F.when(other, m + F.pmod(F.xxhash64("id"), o)).otherwise(F.pmod(F.xxhash64("id"), m)).cast("int"))
    pair = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    none = F.array().cast("array<struct<x:int,y:int>>")
    before = F.transform(F.sequence(F.lit(0), mine), lambda x: pair(x, mine))
    behind = F.when(mine + 1 < m + o, F.transform(F.sequence(mine + 1, m + o - 1), lambda y: pair(mine, y))).otherwise(none)
    pairs = F.when(other, F.concat(before, behind)).otherwise(F.transform(F.sequence(m, m + o - 1), lambda y: pair(mine, y)))
    rows = rows.select(*members.columns, "block", F.explode(pairs).alias("_p"))
    return rows.select(*members.columns, "block", "_p.x", "_p.y")


def close_pairs(f: pd.DataFrame, places: int, reach: int):
    """For each pair of blocks of a frame: (i, j), the rows of different components whose signatures are near."""
    signature = np.frombuffer(b"".join(f["signature"]), np.uint32).reshape(len(f), places)
    keys = open_chunks(signature)
    ids, component, block, x, y = (f[c].to_numpy(np.int64) for c in ("id", "component", "block", "x", "y"))
    for (bucket, _, _), at in f.groupby(["bucket", "x", "y"]).indices.items():
        left, right, pairs = at[block[at] == x[at]], at[block[at] == y[at]], []
        inside = x[at[0]] == y[at[0]]
        for i in left:
            j = right[component[right] != component[i]]
            if inside:
                j = j[ids[j] > ids[i]]
            j = j[(signature[i] != signature[j]).sum(1) <= reach]
            # a pair that meets in several buckets is compared in the first of them
            if len(j):
                j = j[keys[i][(keys[i] == keys[j]).argmax(1)] == bucket]
                pairs.append(np.stack([np.full(len(j), i), j], 1))
        if any(map(len, pairs)):
            i, j = np.concatenate(pairs).T
            yield i, j


def across(members: DataFrame, docs: DataFrame, words: int, percent: int, places: int, reach: int) -> DataFrame:
    """Links between different components of the same bucket. members: bucket, id, component, doc, text_hash, signature.

    Signatures are compared first, by pairs of blocks. Only who is near another one there comes again, with its text, once
    for each pair of blocks; pairs are compared where they are, and only links that join components leave the task.
    """
    rows = written(block_pairs(members), "blocks")
    # which pair of blocks goes to which task is the same both times
    dealt = lambda df, most: df.withColumn("group", F.pmod(F.xxhash64("bucket", "x", "y"), F.lit(quantile(df.count(), most))))
    columns = "bucket long, id long, component long, doc long, text_hash long, signature binary, block int, x int, y int"

    def near(f):
        own = [np.unique(np.concatenate([i, j])) for i, j in close_pairs(f, places, reach)]
        return f.iloc[np.concatenate(own) if own else []].drop(columns="group")

    some = written(dealt(rows, 8 * BLOCK).groupBy("group").applyInPandas(near, columns), "near")

    def run(f):
        sets = sets_of(f["text"], words)
        ids, component = f["id"].to_numpy(np.int64), f["component"].to_numpy(np.int64)
        sizes_ = np.array([len(x) for x in sets])
        out = []
        for i, j in close_pairs(f, places, reach):
            own, place = np.unique(np.concatenate([i, j]), return_inverse=True)
            both = shared_counts([sets[k] for k in own], place[: len(i)], place[len(i) :])
            good = (both > 0) & (100 * both >= percent * (sizes_[i] + sizes_[j] - both))
            i, j = i[good], j[good]
            keep = spanning(component[i], component[j])
            out += zip(np.maximum(ids[i], ids[j])[keep].tolist(), np.minimum(ids[i], ids[j])[keep].tolist(), strict=True)
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return with_texts(dealt(some, BLOCK), docs).groupBy("group").applyInPandas(run, "a long, b long")


def components_of(docs: DataFrame, words: int, percent: int, same_ids: bool) -> tuple[DataFrame, DataFrame]:
    """(rows, texts): the rows with key and size of their set, and the different texts (id, doc, text_hash, label) with the label of their component.

    What is linked are different texts, each with an ``id``, the hash of its words; ``doc`` is the least of its documents.
    ``same_ids``: rows of one ``doc_id`` are linked too.
    """
    chunks, reach = shape(percent)
    places = chunks * WIDTH
    rows = written(sketched(docs, words, places), "signatures")
    usable = rows.where("doc_id is not null and n > 0")
    firsts = usable.groupBy("key").agg(F.min_by(F.struct("doc_id", "text_hash", "signature"), F.struct("doc_id", "text_hash")).alias("x"))
    firsts = written(firsts.select(F.col("key").alias("id"), F.col("x.doc_id").alias("doc"), "x.text_hash", "x.signature"), "firsts")
    buckets = written(bucketed(firsts, places), "buckets")
    # buckets of one group of copies name different firsts, so a copy that is far from one of them is near another
    shared = buckets.groupBy("bucket").agg(F.min_by("id", F.struct(F.xxhash64("id", F.pmod("bucket", F.lit(FIRSTS))), F.col("id"))).alias("first"), F.count("*").alias("members")).where("members > 1")
    met = written(with_facts(buckets, shared, "bucket").select("bucket", "id", "first", "members"), "met")
    pairs = met.where("id != first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    links = confirmed(pairs, firsts, docs, words, percent)
    if same_ids:
        links = links.unionAll(of_one_document(usable))
    found = written(components(links), "components")
    more = written(met.where("members > 2").select("bucket", "id").distinct().join(found.withColumnRenamed("id", "_i"), F.col("id") == F.col("_i"), "left").select("bucket", "id", F.coalesce("component", "id").alias("component")), "more")
    mixed_ = more.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket")
    more = with_facts(more, mixed_, "bucket")
    more = written(more.join(firsts.select(F.col("id").alias("_i"), "doc", "text_hash", "signature").hint("merge"), F.col("id") == F.col("_i")).drop("_i"), "open")
    if not more.isEmpty():
        again = written(across(more, docs, words, percent, places, reach), "across")
        found = written(components(links.unionAll(again)), "components")
    texts = firsts.join(found.withColumnRenamed("id", "_i"), F.col("id") == F.col("_i"), "left").select("id", "doc", "text_hash", F.coalesce("component", "id").alias("label"))
    return rows, written(texts, "labels")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row."""
    rows, texts = components_of(docs, words, percent, same_ids=True)
    # the least document of a component, then of each text, then of each row
    least = texts.groupBy("label").agg(F.min("doc").alias("component_id"))
    of_text = with_facts(texts, least, "label").select(F.col("id").alias("key"), "component_id")
    usable = rows.where("doc_id is not null and n > 0").select("doc_id", "key", F.col("n").alias("n_shingles"))
    linked = written(with_facts(usable, of_text, "key").select("doc_id", "n_shingles", "component_id"), "linked")
    alone = rows.where("doc_id is null or n = 0").select("doc_id", F.col("n").alias("n_shingles"))
    # a row without words is of the component that other rows of its document are of
    empty = alone.select("doc_id").distinct().withColumnRenamed("doc_id", "_d")
    of_id = linked.join(empty, F.col("doc_id") == F.col("_d"), "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("_c")).withColumnRenamed("doc_id", "_d")
    alone = alone.join(of_id, F.col("doc_id") == F.col("_d"), "left").select("doc_id", "n_shingles", F.coalesce("_c", "doc_id").alias("component_id"))
    return linked.unionByName(alone).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def without_near_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` (its columns, ``text`` and ``doc_id`` among them) that stay when of each group of near copies one text does.

    Here a text is judged by itself: of a group the text of the least ``doc_id`` stays, and of its texts the one of least hash. Different texts of one
    ``doc_id`` are no copies of each other by that. Of rows with the same id and text one stays; without words or id all others do.
    """
    rows, texts = components_of(docs, words, percent, same_ids=False)
    tops = texts.groupBy("label").agg(F.min(F.struct("doc", "text_hash")).alias("t")).select(F.col("t.doc").alias("_d"), F.col("t.text_hash").alias("_h"))
    stay = tops.unionByName(rows.where("doc_id is not null and n = 0").select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).distinct())
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    # equal rows are brought together where they are read, before they are dealt out
    single = docs.where("doc_id is not null").withColumn("_hash", F.xxhash64(text_or_empty())).groupBy("doc_id", "_hash").agg(F.min(F.struct(*others, "text")).alias("_r"))
    kept = single.join(stay, (F.col("doc_id") == F.col("_d")) & (F.col("_hash") == F.col("_h")), "left_semi").select("doc_id", "_r.*")
    return kept.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def of_one_document(usable: DataFrame) -> DataFrame:
    """Links between the different texts of rows with the same doc_id, which are one document."""
    several = usable.groupBy("doc_id").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high").select("doc_id", "low")
    found = with_facts(usable.select("doc_id", "key"), several, "doc_id").where("key != low")
    return written(found.select(F.col("key").alias("a"), F.col("low").alias("b")).distinct(), "same-ids")


def op2_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), words=3, percent=85)
