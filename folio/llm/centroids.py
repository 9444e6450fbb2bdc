"""Clustering by centroids with partition-local ball trees (the filtering way of k-means).

Vectors are integers, floor(256 x) of each component, and so are the centroids; every decision is exact. Trees are built once
(``balltree``). A round goes down each tree with the centroids that may still be nearest: by the triangle inequality a
centroid is out for a whole ball when its distance from the ball's middle less the radius is more than the nearest
one's plus the radius. A ball with one centroid left gives its count and integer sum to it unread; other leaves are
compared row by row. A task returns a count and a sum for each centroid, so what is shuffled does not grow with the rows.

Broadcast are the centroids only, ``CENTROIDS`` vectors of ``DIM`` components. Trees and assignments are tables in the
shared folder, so a lost executor costs a part of one round.

Defined cases: vectors that are null, of another length, or with a component that is null or not finite are left out, as are
all of an empty table; with fewer vectors than centroids there are as many centroids as vectors; equal vectors stay
together at one centroid; at equal distance the smaller number counts; a repeated row counts and is returned each time; a
null ``vec_id`` has a null hash, which comes last; a component of 65536 or more raises, as its squares would not fit; columns
besides ``vec_id`` and ``embedding`` are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import balltree
from folio.llm.balltree import Tree, integers, product, trees_of, usable
from folio.llm.common import table, written

DIM, CENTROIDS, ROUNDS = 64, 40, 5
SALT = "2:"


def first_centroids(rows: DataFrame, k: int = CENTROIDS) -> np.ndarray:
    """The vectors of least hash of their ids; among rows of one id the least vector first."""
    order = F.sha2(F.concat(F.lit(SALT), F.col("vec_id").cast("string")), 256)
    found = rows.orderBy(order.asc_nulls_last(), "embedding").limit(k).select("embedding").collect()
    return integers(np.array([r["embedding"] for r in found], np.float64))


def nearest(x: np.ndarray, centroids: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """The number of the nearest centroid of those alive, the smaller one at equal distance, on integers."""
    gap = (centroids * centroids).sum(1) - 2 * product(x, centroids)
    return np.where(alive, gap, np.iinfo(np.int64).max).argmin(1)


def assigned(tree: Tree, centroids: np.ndarray):
    """Pairs of (node, centroid) for balls that go whole, and (rows, centroids of these) for what was compared row by row."""
    whole_nodes, whole_owner, rows, masks = [], [], [], []
    squares = (centroids * centroids).sum(1).astype(np.float64)
    node, alive = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
    while len(node):
        c = tree.center[node]
        own = (c * c).sum(1)
        # what rounding can add to a distance that comes as a difference of squares
        slack = 2 * np.sqrt(1e-12 * (own + squares.max())) + 1e-6
        d = np.sqrt(np.maximum(own[:, None] + squares - 2 * c @ centroids.T, 0))
        best = np.where(alive, d, np.inf).min(1)
        alive = alive & (d <= (best + 2 * tree.radius[node] + slack)[:, None])
        single, leaf = alive.sum(1) == 1, tree.below[node] < 0
        whole_nodes.append(node[single])
        whole_owner.append(alive[single].argmax(1))
        for n, a in zip(node[leaf & ~single], alive[leaf & ~single], strict=True):
            rows.append(np.arange(tree.start[n], tree.stop[n]))
            masks.append(np.broadcast_to(a, (len(rows[-1]), len(a))))
        down = ~single & ~leaf
        node = np.concatenate([tree.below[node[down]], tree.below[node[down]] + 1])
        alive = np.concatenate([alive[down], alive[down]])
    rows = np.concatenate([np.zeros(0, np.int64), *rows])
    owner = nearest(tree.vectors[rows], centroids, np.concatenate(masks)) if len(rows) else np.zeros(0, np.int64)
    return (np.concatenate(whole_nodes), np.concatenate(whole_owner)), (rows, owner)


def next_centroids(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid becomes the floor of its vectors' mean; one without vectors stays."""
    k, dim = centroids.shape

    def run(batches):
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for tree in trees_of(batches):
            (nodes, owner), (rows, of_row) = assigned(tree, centroids)
            np.add.at(counts, owner, tree.counts[nodes])
            np.add.at(sums, owner, tree.totals[nodes])
            np.add.at(counts, of_row, 1)
            np.add.at(sums, of_row, tree.vectors[rows])
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(some, pa.int32()), "n": counts[some], "sums": pa.array(sums[some].tolist(), pa.list_(pa.int64()))})

    parts = trees.select("dim", "ids", "labels", "vectors", "start", "stop", "below", "radius", "totals").mapInArrow(run, "cluster int, n long, sums array<bigint>")
    total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(dim)])
    out = centroids.copy()
    for r in total.collect():
        out[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(dim)]
    return out


def assignments(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and squared distance of every vector."""

    def run(batches):
        for tree in trees_of(batches):
            (nodes, owner), (rows, of_row) = assigned(tree, centroids)
            cluster = np.zeros(len(tree.ids), np.int64)
            for n, z in zip(nodes, owner, strict=True):
                cluster[tree.start[n] : tree.stop[n]] = z
            cluster[rows] = of_row
            away = ((tree.vectors - centroids[cluster]) ** 2).sum(1)
            yield pa.RecordBatch.from_pydict({"vec_id": pa.array(tree.ids, pa.int64()), "cluster": pa.array(cluster, pa.int32()), "distance": pa.array(away, pa.int64())})

    return trees.mapInArrow(run, "vec_id long, cluster int, distance long")


def clustered(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector."""
    spark = vectors.sparkSession
    kept = vectors.where(usable("embedding", dim)).select("vec_id", F.lit(0).alias("label"), "embedding")
    centroids = first_centroids(kept, k)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    trees = balltree.forest(kept, "trees")
    for _ in range(rounds):
        centroids = next_centroids(trees, centroids)
    rows = written(assignments(trees, centroids), "assigned")
    sums = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = spark.createDataFrame([(z, s, sum(sums.values()), digests[z]) for z, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return clustered(table(spark, folder, "embeddings").select("vec_id", "embedding"))


def oracle_sql(k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM) -> str:
    """DuckDB SQL of the same rows: every distance of every round."""
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS x FROM embeddings "
        f"WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SALT}' || vec_id) NULLS LAST, x) - 1 AS c, x FROM v QUALIFY c < {k})",
    ]
    for i in range(rounds + 1):
        parts.append(
            f"a{i} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.r, c{i}.c, list_sum(list_transform(list_zip(v.x, c{i}.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, c{i}) GROUP BY r)"
        )
        if i < rounds:
            parts.append(
                f"m{i} AS MATERIALIZED (SELECT c, list(f ORDER BY j) AS x FROM (SELECT c, j, CAST(floor(sum(y) / count(*)) AS BIGINT) AS f FROM (SELECT a.c, unnest(v.x) AS y, unnest(range({dim})) AS j FROM v JOIN a{i} a ON a.r = v.r) GROUP BY c, j) GROUP BY c)"
            )
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m{i}.x, c{i}.x) AS x FROM c{i} LEFT JOIN m{i} USING (c))")
    return (
        "WITH " + ",\n ".join(parts) + f"""
SELECT v.vec_id, CAST(a.c AS INT) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(z.x, ',')) AS centroid_sha256
FROM v JOIN a{rounds} a ON a.r = v.r JOIN c{rounds} z ON z.c = a.c"""
    )
