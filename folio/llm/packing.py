"""Packing token ids into sequences of one window by non-negative least squares.

A document's whole windows fill sequences of their own. What is left of it, its rest, falls in one of ``units``
classes by length. All shallow combinations of classes that fill the window (at most ``parts`` of them) are listed;
non-negative least squares solves how often each is repeated so that together they use up the histogram of rests; the
counts are rounded down, and held so low that the rests left over can fill the gaps which the rounding of lengths to
classes leaves. Ranks inside a class then say which rest goes to which slot. The rests left over are packed greedily:
as one stream they are cut into the gaps, in order, and then into further sequences, of which only the last is short.

Histogram, plan and combinations are as large as ``units`` says, not as the corpus. Ranks and running sums are in two
steps (inside a run of the rows by hash, and over the runs), so no class, no stream and no repeated row is one task's.

Defined cases: a null text is empty, and a document is never empty, as the end id belongs to it; a null ``doc_id`` is
a document of its own; repeated rows are packed as often as they stand there; the string of a
special token in a text is that token, as in the library's own call; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm import tokens
from folio.llm.common import quantile, ship, table, written

WINDOW = 4096
END = 2
UNITS = 64
PARTS = 5
#: Runs into which documents are dealt for ranks and running sums, at least, and the documents of one.
RUNS, RUN_ROWS = 256, 100_000
SEED = 10_007


def combinations(units: int = UNITS, parts: int = PARTS) -> list[tuple[int, ...]]:
    """All ways to fill ``units`` with at most ``parts`` classes, largest first."""
    out: list[tuple[int, ...]] = []

    def add(left: int, most: int, have: tuple[int, ...]) -> None:
        if not left:
            out.append(have)
        elif len(have) < parts:
            for x in range(min(left, most), 0, -1):
                if x * (parts - len(have)) < left:
                    break
                add(left - x, x, (*have, x))

    add(units, units, ())
    return out


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 that minimises |a x - b|: the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0.0)))
    for _ in range(3 * n):
        w = a.T @ (b - a @ x)
        w[passive] = -np.inf
        if passive.all() or w.max() <= tolerance:
            break
        passive[int(w.argmax())] = True
        while True:
            s = np.zeros(n)
            s[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            if s[passive].min() > 0:
                x = s
                break
            bad = passive & (s <= 0)
            step = np.min(x[bad] / np.maximum(x[bad] - s[bad], 1e-300))
            x = x + step * (s - x)
            passive &= x > 1e-12
            x[~passive] = 0
            if not passive.any():
                break
    return x


def plan(histogram: dict[int, tuple[int, int]], units: int = UNITS, parts: int = PARTS, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """Combinations with their repeats. ``histogram``: class to (rests, their ids)."""
    listed = combinations(units, parts)
    count = np.array([histogram.get(u, (0, 0))[0] for u in range(1, units + 1)], float)
    total = np.array([histogram.get(u, (0, 0))[1] for u in range(1, units + 1)], float)
    if not count.sum():
        return []
    a = np.zeros((units, len(listed)))
    for j, combo in enumerate(listed):
        for u in combo:
            a[u - 1, j] += 1
    scale = count.max()
    x = nonnegative_least_squares(a, count / scale) * scale
    mean = np.divide(total, count, out=np.zeros(units), where=count > 0)
    unit = window // units
    share = 1.0
    while True:
        repeats = np.floor(x * share)
        over = a @ repeats > count  # rounding errors of the solution
        repeats[(a[over] > 0).any(0)] -= 1
        repeats = np.maximum(repeats, 0)
        used = a @ repeats
        gaps = float((used * (unit * np.arange(1, units + 1) - mean)).sum())
        left = float(((count - used) * mean).sum())
        if (used <= count).all() and (left >= 1.02 * gaps or share <= 0):
            return [(combo, int(n)) for combo, n in zip(listed, repeats, strict=True) if n > 0]
        share -= 0.01


def measured(docs: DataFrame, path: str, window: int = WINDOW, end: int = END, special: bool = True) -> DataFrame:
    """row, doc_id, n, the checksums of its whole windows, its rest's and the rest's ids. Texts are tokenized here, once.

    ``row`` tells rows apart, repeated ones too; it is fixed once this is written.
    """

    def run(frames):
        row = TaskContext.get().partitionId() << 40
        for f in frames:
            n, heads, rests, crcs = [], [], [], []
            for ids in tokens.documents_ids(f["text"], path, tokens.by_space, end, special):
                n.append(len(ids))
                heads.append([zlib.crc32(ids[i : i + window]) for i in range(0, len(ids) - window + 1, window)])
                rests.append(ids[len(ids) // window * window :].tobytes())
                crcs.append(zlib.crc32(rests[-1]))
            yield pd.DataFrame({"row": np.arange(row, row + len(f)), "doc_id": f["doc_id"].astype("Int64"), "n": n, "heads": heads, "rest_crc": crcs, "rest_ids": rests})
            row += len(f)

    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInPandas(run, "row long, doc_id long, n long, heads array<long>, rest_crc long, rest_ids binary")


def before(value: Column, *partition: str, order: list) -> Column:
    return F.coalesce(F.sum(value).over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def running(df: DataFrame, value: str, name: str, group: list[str], order: list[str]) -> DataFrame:
    """``name``: the sum of ``value`` over all rows before, of the same group, by (_run, order), in two steps."""
    runs = df.groupBy(*group, "_run").agg(F.sum(value).alias("_sum"))
    runs = runs.select(*group, "_run", before(F.col("_sum"), *(group or [F.lit(0)]), order=["_run"]).alias("_first"))
    inside = before(F.col(value), *group, "_run", order=order)
    return df.withColumn("_in", inside).join(runs, [*group, "_run"]).withColumn(name, F.col("_first") + F.col("_in")).drop("_first", "_in")


def pack(docs: DataFrame, path: str, window: int = WINDOW, end: int = END, units: int = UNITS, parts: int = PARTS, special: bool = True) -> DataFrame:
    """The pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. ``special``: as ``tokens`` has it."""
    spark = docs.sparkSession
    base = written(measured(docs, path, window, end, special), "measured")
    base = base.withColumn("_run", F.pmod(F.xxhash64("row", F.lit(SEED)), F.lit(max(RUNS, quantile(base.count(), RUN_ROWS)))).cast("int"))
    unit = window // units
    rests = base.drop("heads", "rest_ids").withColumn("rest", F.col("n") % window).where("rest > 0").withColumn("class", F.ceil(F.col("rest") / unit).cast("int"))
    histogram = {r["class"]: (r["count"], r["ids"]) for r in rests.groupBy("class").agg(F.count("*").alias("count"), F.sum("rest").alias("ids")).collect()}
    planned = plan(histogram, units, parts, window)
    order = ["doc_id", "row"]
    # slots: for each class the ranks that go to a place of a combination's repeats
    slots, taken, first = [], dict.fromkeys(range(1, units + 1), 0), 0
    for combo, n in planned:
        for place, u in enumerate(combo):
            slots.append((u, taken[u], taken[u] + n, first, place))
            taken[u] += n
        first += n
    combined = first
    slot_table = spark.createDataFrame(slots or [(0, 0, 0, 0, 0)], "class int, low long, high long, first long, place int")
    ranked = running(rests.withColumn("_one", F.lit(1)), "_one", "rank", ["class"], order).drop("_one")
    placed = ranked.join(F.broadcast(slot_table), (ranked["class"] == slot_table["class"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")), "left").drop(slot_table["class"])
    placed = written(placed.withColumn("sequence_id", F.col("first") + F.col("rank") - F.col("low")).select("row", "doc_id", "n", "rest", "rest_crc", "_run", "sequence_id", "place"), "placed")
    in_combos = placed.where("sequence_id is not null").withColumn("offset", before(F.col("rest"), "sequence_id", order=["place"]))
    combo_pieces = in_combos.select("doc_id", (F.col("n") - F.col("rest")).alias("start"), F.col("rest").alias("length"), F.col("rest_crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), "sequence_id", "offset")
    # the gaps on one axis, and the rests left over as a stream on the same axis
    gaps = in_combos.groupBy("sequence_id").agg(F.sum("rest").alias("filled")).where(F.col("filled") < window)
    gaps = gaps.select("sequence_id", "filled", (window - F.col("filled")).alias("gap"), F.floor(F.col("sequence_id") / window).alias("_run"))
    gaps = running(gaps, "gap", "at", [], ["sequence_id"])
    room = placed.where("sequence_id is not null").agg(F.sum("rest"), F.count_distinct("sequence_id")).first()
    room = int((room[1] or 0) * window - (room[0] or 0))
    left = running(placed.where("sequence_id is null").select("row", "doc_id", "n", "rest", "rest_crc", "_run"), "rest", "at", [], order)
    left = left.withColumn("until", F.col("at") + F.col("rest"))
    blocks = lambda a, b: F.explode(F.sequence(F.floor(a / window), F.floor((b - 1) / window)))
    g = gaps.select(F.col("at").alias("g_at"), (F.col("at") + F.col("gap")).alias("g_until"), "filled", "sequence_id", blocks(F.col("at"), F.col("at") + F.col("gap")).alias("block"))
    s = left.where(F.col("at") < room).withColumn("_until", F.least("until", F.lit(room))).withColumn("block", blocks(F.col("at"), F.col("_until")))
    low, high = F.greatest("at", "g_at"), F.least("_until", "g_until")
    in_gaps = s.join(g, "block").where((low < high) & (F.floor(low / window) == F.col("block")))
    in_gaps = in_gaps.select("row", "doc_id", "n", "rest", "rest_crc", "at", low.alias("low"), high.alias("high"), "sequence_id", (F.col("filled") + low - F.col("g_at")).alias("offset"))
    more = left.where(F.col("until") > room).withColumn("_from", F.greatest("at", F.lit(room)) - room)
    more = more.withColumn("block", blocks(F.col("_from"), F.col("until") - room))
    low, high = F.greatest(F.col("_from"), F.col("block") * window), F.least(F.col("until") - room, (F.col("block") + 1) * window)
    in_more = more.select("row", "doc_id", "n", "rest", "rest_crc", "at", (low + room).alias("low"), (high + room).alias("high"), (F.col("block") + combined).alias("sequence_id"), (low - F.col("block") * window).alias("offset"))
    cut = in_gaps.unionByName(in_more)
    cut = cut.select("row", "doc_id", (F.col("n") - F.col("rest") + F.col("low") - F.col("at")).alias("start"), (F.col("low") - F.col("at")).alias("inside"), (F.col("high") - F.col("low")).alias("length"), "rest", "rest_crc", F.col("n").alias("doc_tokens"), "sequence_id", "offset")
    cut = written(cut, "cut")
    stream = int(placed.where("sequence_id is null").agg(F.sum("rest")).first()[0] or 0)
    further = -(-max(0, stream - room) // window)
    uncut = cut.where("length = rest").withColumn("ids_crc32", F.col("rest_crc"))
    cut_pieces = checksums(base, cut.where("length < rest"))
    # whole windows
    heads = base.where(F.size("heads") > 0).withColumn("_blocks", F.size("heads").cast("long"))
    heads = running(heads, "_blocks", "first", [], order).select("doc_id", "n", "first", F.posexplode("heads").alias("block", "ids_crc32"))
    head_pieces = heads.select("doc_id", (F.col("block").cast("long") * window).alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32", F.col("n").alias("doc_tokens"), (F.col("first") + F.col("block") + combined + further).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    out = None
    for part in (combo_pieces, uncut, cut_pieces, head_pieces):
        part = part.select(*[F.col(c).cast("long").alias(c) for c in columns])
        out = part if out is None else out.unionByName(part)
    return out


def checksums(base: DataFrame, cut: DataFrame) -> DataFrame:
    """The pieces with their ids_crc32, from the ids of the rests that are cut."""
    ids = base.select(F.col("row").alias("_row"), "rest_ids")
    # sorted on both sides: the ids never go to every executor, however few rests are cut
    found = cut.join(ids.hint("merge"), F.col("row") == F.col("_row"))
    part = F.substring("rest_ids", (4 * F.col("inside") + 1).cast("int"), (4 * F.col("length")).cast("int"))
    return found.withColumn("ids_crc32", F.crc32(part))


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
