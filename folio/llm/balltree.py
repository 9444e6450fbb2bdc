"""Metric trees over the integer vectors of one part of a table, and the table that holds them.

A vector's component x becomes the integer floor(256 x), and all that is decided is decided on these integers. Each
task builds trees over at most ``TREE_CELLS`` components of its own rows: a node has the run of rows below it, their
number, their integer sum, and the radius of the ball around their mean. A node is parted at the median along the
line through two far rows, so trees are balanced by count, whatever repeats. With labels, a node of several labels is
parted between labels first. A tree is one row of a table, so no tree is ever gathered from more than one task.

Floating point serves for bounds only, widened by what rounding can add; what is returned comes from integers. Whole
numbers stay exact in products of doubles while a row's products stay below 2^53; beyond that 64-bit products are taken.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import ship, written

#: Components of all the vectors of one tree; 4096 vectors of 64 components.
TREE_CELLS = 1 << 18
#: Rows of a leaf at most, but for those with one and the same vector.
LEAF = 32
#: A component's integer is below this; squares, sums of 64 of them and hundredfold products then fit in a long.
MOST = 1 << 24
SCHEMA = (
    "dim int, ids array<bigint>, labels array<bigint>, vectors binary, start array<int>, stop array<int>, below array<int>, radius array<double>, totals binary"
)


def usable(vector: str = "embedding", dim: int | None = None) -> Column:
    """Whether a vector is there, with no component null or not finite, and of ``dim`` components if that is given."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False))
    return whole if dim is None else whole & (F.size(vector) == dim)


def integers(x: np.ndarray) -> np.ndarray:
    out = np.floor(x.astype(np.float64) * 256)
    if np.abs(out).max(initial=0) >= MOST:
        raise ValueError(f"a vector has a component of {MOST // 256} or more: its products would not fit in a long")
    return out.astype(np.int64)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact product of whole numbers (rows of a by rows of b), as 64-bit integers."""
    if a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


@dataclass
class Tree:
    """``below[n]`` is the first of a node's two children, which follow one another, or -1 in a leaf."""

    vectors: np.ndarray
    ids: list
    labels: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    below: np.ndarray
    radius: np.ndarray
    totals: np.ndarray
    center: np.ndarray = field(init=False)

    def __post_init__(self):
        self.center = self.totals / np.maximum(self.stop - self.start, 1)[:, None]

    @property
    def counts(self) -> np.ndarray:
        return self.stop - self.start

    def row(self) -> dict:
        return {
            "dim": self.vectors.shape[1], "ids": self.ids, "labels": self.labels.tolist(), "vectors": self.vectors.astype("<i4").tobytes(), "start": self.start.tolist(), "stop": self.stop.tolist(),
            "below": self.below.tolist(), "radius": self.radius.tolist(), "totals": self.totals.astype("<i8").tobytes(),
        }

    @classmethod
    def of_row(cls, r: dict) -> Tree:
        start = np.array(r["start"], np.int64)
        vectors = np.frombuffer(r["vectors"], "<i4").astype(np.int64).reshape(len(r["ids"]), r["dim"])
        totals = np.frombuffer(r["totals"], "<i8").reshape(len(start), r["dim"])
        return cls(vectors, r["ids"], np.array(r["labels"], np.int64), start, np.array(r["stop"], np.int64), np.array(r["below"], np.int64), np.array(r["radius"]), totals)


def halves(x: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, int] | None:
    """An order of the rows and where to part them; None where they are not to be parted."""
    n = len(x)
    if n > LEAF and labels.min() != labels.max():
        order = np.argsort(labels, kind="stable")
        edges = np.flatnonzero(np.diff(labels[order])) + 1
        return order, int(edges[np.argmin(np.abs(edges - n // 2))])
    if n <= LEAF:
        return None
    far = x[np.argmax(((x - x.mean(0)) ** 2).sum(1))]
    away = ((x - far) ** 2).sum(1)
    if not away.any():
        return None
    order = np.argsort(x @ (x[np.argmax(away)] - far), kind="stable")
    return order, n // 2


def built(vectors: np.ndarray, ids: list, labels: np.ndarray) -> Tree:
    order, floats = np.arange(len(vectors)), vectors.astype(np.float64)
    nodes, todo = [[0, len(vectors), -1]], [0]
    while todo:
        k = todo.pop()
        start, stop, _ = nodes[k]
        mine = order[start:stop]
        parted = halves(floats[mine], labels[mine]) if len(mine) else None
        if parted:
            order[start:stop] = mine[parted[0]]
            nodes[k][2] = len(nodes)
            todo += [len(nodes), len(nodes) + 1]
            nodes += [[start, start + parted[1], -1], [start + parted[1], stop, -1]]
    start, stop, below = np.array(nodes, np.int64).T
    vectors, floats = vectors[order], floats[order]
    sums = np.concatenate([np.zeros((1, vectors.shape[1]), np.int64), np.cumsum(vectors, 0)])
    totals = sums[stop] - sums[start]
    center = totals / np.maximum(stop - start, 1)[:, None]
    radius = np.array([np.sqrt(((floats[a:b] - c) ** 2).sum(1).max(initial=0)) for a, b, c in zip(start, stop, center, strict=True)])
    return Tree(vectors, [ids[i] for i in order], labels[order], start, stop, below, radius * (1 + 1e-9), totals)


def forest(rows: DataFrame, name: str) -> DataFrame:
    """Trees over the rows of (vec_id, label, embedding), a tree a row, written in the shared folder."""
    ship(rows.sparkSession)

    def build(batches):
        kept: dict[int, list] = {}

        def trees(dim):
            ids, labels, vectors = zip(*kept.pop(dim), strict=True)
            ids, labels, vectors = [i for part in ids for i in part], np.concatenate(labels), np.concatenate(vectors)
            most = max(1, TREE_CELLS // max(1, dim))
            for k in range(0, len(ids), most):
                yield pa.RecordBatch.from_pylist([built(vectors[k : k + most], ids[k : k + most], labels[k : k + most]).row()], schema=ARROW)

        for b in batches:
            sizes = np.asarray(b.column("embedding").value_lengths())
            ids, labels = b.column("vec_id").to_pylist(), np.array(b.column("label").to_numpy(zero_copy_only=False), np.int64)
            flat, edge = integers(np.asarray(b.column("embedding").flatten(), np.float64)), np.concatenate([[0], np.cumsum(sizes)])
            for dim in map(int, np.unique(sizes)):
                at = np.flatnonzero(sizes == dim)
                kept.setdefault(dim, []).append(([ids[i] for i in at], labels[at], flat[edge[at][:, None] + np.arange(dim)]))
            if sum(len(i) * max(1, dim) for dim, parts in kept.items() for i, _, _ in parts) >= TREE_CELLS:
                for dim in list(kept):
                    yield from trees(dim)
        for dim in list(kept):
            yield from trees(dim)

    ARROW = pa.schema([
        ("dim", pa.int32()), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("vectors", pa.binary()), ("start", pa.list_(pa.int32())), ("stop", pa.list_(pa.int32())),
        ("below", pa.list_(pa.int32())), ("radius", pa.list_(pa.float64())), ("totals", pa.binary()),
    ])
    return written(rows.select("vec_id", F.col("label").cast("long"), "embedding").mapInArrow(build, SCHEMA), name)


def trees_of(batches):
    """The trees of record batches of ``forest``, one after another."""
    for b in batches:
        for k in range(b.num_rows):
            yield Tree.of_row(b.slice(k, 1).to_pylist()[0])
