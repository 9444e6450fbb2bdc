"""Hard negatives by branch and bound over partition-local ball trees.

A score is an inner product of integer vectors (``balltree``). An anchor's positives are its nearest rows of its own label; for
each positive the negatives are the best rows of other labels whose score stands in a window below the positive's. Both
searches go down each tree with all anchors of a round at once: with the ball's middle m and radius r, the scores of an
anchor a below a node lie between a.m - |a| r and a.m + |a| r. A node is left out for an anchor when it is wholly outside
the window, has no row of a label asked for, or is strictly beneath the anchor's current last place; at equal
scores the smaller id decides, so what is equal is still looked at. A task keeps the best few of an anchor over all its trees,
and these few are ranked by a window over the anchor.

Anchors are a stated set (every ``ANCHOR_EVERY``th id) against all rows. They go out in rounds of at most ``ROUND_CELLS``
components (16 MB as 32-bit integers), which is all that is ever sent to the driver and broadcast at once; trees stay where
they are. A round's positives and negatives are tables in the shared folder.

Defined cases: rows with a null label or a vector that is null or has a component that is null or not finite take no part, as
with an empty table; only vectors of one length have a score; a null ``vec_id`` is no anchor, keeps its label, and stands
last among equal scores; rows of an anchor's own id are not its others; of a repeated row each counts, as anchor too; a positive
with a score below 0 has an empty window (50 s > 95 s); a component of 65536 or more raises; other columns are not read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm import balltree, common
from folio.llm.balltree import Tree, integers, product, trees_of, usable
from folio.llm.common import table, written

ANCHOR_EVERY, POSITIVES, NEGATIVES = 50, 5, 3
#: A negative's score is between these hundredths of the positive's.
LEAST, MOST = 50, 95
#: Components of the anchors of one round.
ROUND_CELLS = 1 << 22
#: Every so many ids have their label moved on by one, out of so many.
MOVED, LABELS = 7, 10
LOWEST = np.iinfo(np.int64).min
COLUMNS = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


class Best:
    """The ``k`` best (score, id) of each query, by score from above, then by id; ``known`` tells a null id from others."""

    def __init__(self, queries: int, k: int):
        self.scores = np.full((queries, k), LOWEST)
        self.ids = np.zeros((queries, k), np.int64)
        self.known = np.zeros((queries, k), bool)

    def last(self) -> np.ndarray:
        return self.scores[:, -1]

    def add(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        """Scores of (queries x rows); what does not count is ``LOWEST``."""
        some = (scores > LOWEST) & (scores >= self.last()[queries][:, None])
        hit = some.any(1)
        if not hit.any():
            return
        q, scores = queries[hit], np.where(some[hit], scores[hit], LOWEST)
        used = (scores > LOWEST).any(0)
        scores, ids, known = scores[:, used], ids[used], known[used]
        all_scores = np.concatenate([self.scores[q], scores], 1)
        all_ids = np.concatenate([self.ids[q], np.broadcast_to(ids, scores.shape)], 1)
        all_known = np.concatenate([self.known[q], np.broadcast_to(known, scores.shape)], 1)
        # the bitwise complement turns the order of integers round without leaving them
        best = np.lexsort((all_ids, ~all_known, ~all_scores), axis=1)[:, : self.scores.shape[1]]
        self.scores[q], self.ids[q], self.known[q] = (np.take_along_axis(x, best, 1) for x in (all_scores, all_ids, all_known))

    def batch(self) -> pa.RecordBatch:
        q, at = np.nonzero(self.scores > LOWEST)
        return pa.RecordBatch.from_pydict({"query": pa.array(q, pa.int32()), "id": pa.array(self.ids[q, at], pa.int64(), mask=~self.known[q, at]), "score": pa.array(self.scores[q, at], pa.int64())})


class Queries:
    """Anchors of one length, and the queries on them: an anchor, a window of scores, and whether labels are to be equal."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool):
        self.ids, self.labels, self.vectors, self.anchor, self.low, self.high, self.same = ids, labels, vectors, anchor, low, high, same
        self.length = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))

    def search(self, tree: Tree, best: Best) -> None:
        ids = np.array([0 if i is None else i for i in tree.ids], np.int64)
        known = np.array([i is not None for i in tree.ids], bool)
        middle = self.vectors.astype(np.float64) @ tree.center.T
        spread = self.length[:, None] * tree.radius
        slack = 1e-9 * (np.abs(middle) + spread) + 1e-6
        upper, lower = middle + spread + slack, middle - spread - slack
        first = np.array([tree.labels[a:b].min(initial=0) for a, b in zip(tree.start, tree.stop, strict=True)])
        final = np.array([tree.labels[a:b].max(initial=0) for a, b in zip(tree.start, tree.stop, strict=True)])
        todo = [(0, np.arange(len(self.anchor)))]
        while todo:
            node, q = todo.pop()
            a = self.anchor[q]
            mine = self.labels[a]
            asked = (mine >= first[node]) & (mine <= final[node]) if self.same else (first[node] != mine) | (final[node] != mine)
            q = q[asked & (upper[a, node] >= np.maximum(self.low[q], best.last()[q])) & (lower[a, node] <= self.high[q])]
            if not len(q):
                continue
            below = tree.below[node]
            if below >= 0:
                # the child that reaches higher is taken from the stack first
                further, nearer = sorted((below, below + 1), key=lambda n: upper[self.anchor[q], n].sum())
                todo += [(further, q), (nearer, q)]
                continue
            rows = slice(tree.start[node], tree.stop[node])
            a, of = np.unique(self.anchor[q], return_inverse=True)
            scores = product(self.vectors[a], tree.vectors[rows])
            same = self.labels[a][:, None] == tree.labels[rows]
            out = (same != self.same) | ((self.ids[a][:, None] == ids[rows]) & known[rows])
            scores = np.where(out, LOWEST, scores)[of]
            scores[(scores < self.low[q][:, None]) | (scores > self.high[q][:, None])] = LOWEST
            best.add(q, scores, ids[rows], known[rows])


def searched(trees: DataFrame, queries: dict[int, Queries], k: int) -> DataFrame:
    """query, id and score of the ``k`` best of each task; queries by the length of their vectors, numbered through."""
    sent = trees.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        best = {dim: Best(len(q.anchor), k) for dim, q in sent.value.items()}
        for tree in trees_of(batches):
            dim = tree.vectors.shape[1]
            if dim in best:
                sent.value[dim].search(tree, best[dim])
        base = 0
        for dim, q in sent.value.items():
            b = best[dim].batch()
            yield b.set_column(0, "query", pa.array(b.column("query").to_numpy() + base, pa.int32()))
            base += len(q.anchor)

    found = trees.mapInArrow(run, "query int, id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rounds(anchors: DataFrame, cells: int = ROUND_CELLS):
    """The anchors in lists of at most ``cells`` components (one anchor at least)."""
    kept, held = [], 0
    for r in anchors.toLocalIterator():
        size = max(1, len(r["embedding"]))
        if kept and held + size > cells:
            yield kept
            kept, held = [], 0
        kept.append(r)
        held += size
    if kept:
        yield kept


def of_round(anchors: list) -> dict[int, tuple]:
    by_dim: dict[int, list] = {}
    for r in anchors:
        by_dim.setdefault(len(r["embedding"]), []).append(r)
    return {
        dim: (np.array([r["vec_id"] for r in rows], np.int64), np.array([r["label"] for r in rows], np.int64), integers(np.array([r["embedding"] for r in rows], np.float64).reshape(len(rows), dim)))
        for dim, rows in by_dim.items()
    }


def mined(vectors: DataFrame, every: int = ANCHOR_EVERY, cells: int = ROUND_CELLS) -> DataFrame:
    """``COLUMNS`` for every anchor of (vec_id, label, embedding) and each of its positives."""
    spark = vectors.sparkSession
    rows = vectors.where(F.col("label").isNotNull() & usable("embedding")).select("vec_id", F.col("label").cast("long"), "embedding")
    trees = balltree.forest(rows, "trees")
    anchors = written(rows.where(F.col("vec_id") % every == 0), "anchors")
    path = common.noted(spark, f"{common.shared_folder(spark)}/folio/negatives-{uuid.uuid4().hex}")
    empty = True
    for part in rounds(anchors, cells):
        known = of_round(part)
        everything = {dim: np.arange(len(ids)) for dim, (ids, _, _) in known.items()}
        all_scores = {dim: (np.full(len(n), LOWEST + 1), np.full(len(n), -LOWEST - 1)) for dim, n in everything.items()}
        positives = written(searched(trees, {dim: Queries(*known[dim], everything[dim], *all_scores[dim], same=True) for dim in known}, POSITIVES), "positives")
        queries, numbers, base, done = {}, [], 0, 0
        scores = positives.where("score >= 0").select("query", "score").distinct().orderBy("query", "score").toPandas()
        for dim, (ids, labels, values) in known.items():
            mine = scores[(scores["query"] >= base) & (scores["query"] < base + len(ids))]
            s = mine["score"].to_numpy(np.int64)
            queries[dim] = Queries(ids, labels, values, mine["query"].to_numpy(np.int64) - base, -(-LEAST * s // 100), MOST * s // 100, same=False)
            numbers += [(int(done + k), int(ids[q - base]), int(q), int(score)) for k, (q, score) in enumerate(zip(mine["query"], s, strict=True))]
            base, done = base + len(ids), done + len(mine)
        if not numbers:
            continue
        asked = spark.createDataFrame(numbers, "number int, anchor_id long, anchor int, positive_score long")
        negatives = searched(trees, queries, NEGATIVES).select(F.col("query").alias("number"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), "rank")
        found = positives.select(F.col("query").alias("anchor"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(asked, ["anchor", "positive_score"]).join(negatives, "number")
        found.select(*[c.split()[0] for c in COLUMNS.split(", ")]).write.mode("append").parquet(path)
        empty = False
    return spark.createDataFrame([], COLUMNS) if empty else spark.read.schema(COLUMNS).parquet(path)


def moved_labels(vectors: DataFrame) -> DataFrame:
    """Labels of every ``MOVED``th id are the next ones."""
    moved = F.coalesce(F.col("vec_id") % MOVED == 0, F.lit(False))
    label = F.col("label").cast("long")
    return vectors.select("vec_id", F.when(moved, (label + 1) % LABELS).otherwise(label).alias("label"), "embedding")


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return mined(moved_labels(table(spark, folder, "embeddings").select("vec_id", "label", "embedding")))


ORACLE = f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % {MOVED} = 0 THEN (label::BIGINT + 1) % {LABELS} ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS x
 FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
 s AS MATERIALIZED (SELECT a.r AS anchor, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, coalesce(list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2])), 0) AS score
 FROM v a JOIN v b ON a.vec_id % {ANCHOR_EVERY} = 0 AND b.vec_id IS DISTINCT FROM a.vec_id AND len(a.x) = len(b.x)),
 p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id NULLS LAST) <= {POSITIVES}),
 n AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.id NULLS LAST) AS rank
 FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND {LEAST} * p.score <= 100 * s.score AND 100 * s.score <= {MOST} * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, CAST(positive_score AS BIGINT) AS positive_score, CAST(negative_score AS BIGINT) AS negative_score FROM n WHERE rank <= {NEGATIVES}"""
