"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is its own vector (for words known from training) beside the mean vector of its character trigrams
(for any word). Windows of ``WINDOW`` words that overlap by half are read by gated recurrent units in both
directions; attention pools a window's states to one, from which comes its score. A document's score is that of its
highest window, and all windows of the whole text are scored. A label belongs to a document: in training, all windows of a document
with label 0 are such, and of one with label 1 the window that the network itself scores highest.

The model is fitted on at most ``MOST_POSITIVE`` and ``MOST_NEGATIVE`` labelled documents and ``MOST_BYTES`` of their texts, the first by a hash of doc_id; nothing
else is bounded by a number of rows. Labels, languages, sources and ids are no inputs of a score.

Defined cases: a null or blank text is a window without words and gets the network's score of that; a null label is no
label; of contradicting labels of a document the highest counts; with labels of one class or none, every score is the
share of label 1 (0 without labels); repeated rows get a row each; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from folio.llm.common import ship, table, text_or_empty
from folio.llm.tokens import drop_encoders, in_portions

WINDOW, STRIDE = 32, 16
WORD_DIM, CHAR_DIM, HIDDEN = 8, 6, 8
TRIGRAMS = 1024
MOST_WORDS = 8192
MOST_POSITIVE, MOST_NEGATIVE = 800, 1600
#: Bytes of their texts; one text for each id, that of the least hash, and none above this by itself.
MOST_BYTES = 64 << 20
EPOCHS = 24
#: Epochs in which the odds of words choose the windows of documents with label 1.
LED = 6
THRESHOLD = 0.3
#: Different words that a worker remembers at most.
MOST_KNOWN = 120_000
SEED = 7

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def bare(word: str) -> str:
    """A word in small letters without the signs around it."""
    return _EDGE.sub("", word) or word


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def trigrams(words: list[str], at_once: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character trigrams of all words, one after another, and where each word's begin (and the end)."""
    parts = [_trigrams(words[k : k + at_once]) for k in range(0, len(words), at_once)]
    counts = np.concatenate([np.zeros(1, np.int64), *(n for _, n in parts)])
    return np.concatenate([np.zeros(0, np.int16), *(c for c, _ in parts)]), np.cumsum(counts)


def _trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.fromiter((len(w) for w in words), np.int64, len(words))
    begin = np.concatenate([[0], np.cumsum(sizes + 2)])
    data = np.concatenate([data, np.zeros(2, np.uint64)])
    code = data[:-2] * np.uint64(0x9E3779B97F4A7C15) + data[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + data[2:] * np.uint64(0x165667B19E3779F9)
    code = (code >> np.uint64(40)).astype(np.int64) % TRIGRAMS
    keep = np.ones(len(code), bool)
    keep[begin[1:] - 1] = False
    keep[(begin[1:] - 2)[sizes > 0]] = False
    return code[keep].astype(np.int16), np.maximum(sizes, 1)


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, number of words) of all windows of texts that lie one behind another; an empty text has one without words."""
    n = 1 + np.maximum(0, -(-(lengths - WINDOW) // STRIDE))
    text = np.repeat(np.arange(len(lengths)), n)
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    first = (np.cumsum(lengths) - lengths)[text] + k * STRIDE
    return np.stack([first, np.minimum(WINDOW, lengths[text] - k * STRIDE)], 1), text


class Network:
    """Parameters and passes. Word 0 is any that is not in the vocabulary; row -1 of a batch's inputs is no word."""

    def __init__(self, vocabulary: list[str], odds: np.ndarray, rng: np.random.Generator):
        self.words = {w: i + 1 for i, w in enumerate(vocabulary)}
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        small = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        self.p = {"word": (rng.normal(0, 0.1, (len(vocabulary) + 1, WORD_DIM))).astype(np.float32), "char": rng.normal(0, 0.3, (TRIGRAMS, CHAR_DIM)).astype(np.float32)}
        self.p["word"][1:, 0] += odds
        for way in "fb":
            self.p |= {f"w{way}": small(d, 3 * h), f"u{way}": small(h, 3 * h), f"c{way}": np.zeros(3 * h, np.float32)}
        self.p |= {"a": small(2 * h), "o": small(2 * h), "bias": np.full(1, -2.0, np.float32)}
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        self.steps = 0

    def inputs(self, ids: np.ndarray, codes: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The input vectors of different words from their ids and trigrams."""
        out = np.zeros((len(ids), WORD_DIM + CHAR_DIM), np.float32)
        for k in range(0, len(ids), 20_000):
            edge = begin[k : k + 20_001]
            out[k : k + 20_000, WORD_DIM:] = np.add.reduceat(self.p["char"][codes[edge[0] : edge[-1]]], edge[:-1] - edge[0], axis=0) / np.diff(edge)[:, None]
        out[:, :WORD_DIM] = self.p["word"][ids]
        return out

    def one_way(self, way: str, x: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        """States of all places; x: projected inputs of different words, at: (batch, place) rows of x."""
        u, h3 = self.p[f"u{way}"], HIDDEN
        n, places = at.shape
        state, out = np.zeros((n, h3), np.float32), np.empty((places, n, h3), np.float32)
        for t in range(places) if way == "f" else range(places - 1, -1, -1):
            p, q, m = x[at[:, t]], state @ u, mask[:, t : t + 1]
            zr = sigmoid(p[:, : 2 * h3] + q[:, : 2 * h3])
            z, r = zr[:, :h3], zr[:, h3:]
            c = np.tanh(p[:, 2 * h3 :] + r * q[:, 2 * h3 :])
            new = state + m * (1 - z) * (c - state)
            if keep is not None:
                keep.append((t, state, z, r, c, q[:, 2 * h3 :], m))
            state = out[t] = new
        return out

    def forward(self, x: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows. x: input vectors of different words, the last one for no word."""
        tapes = {"f": [], "b": []} if keep is not None else {"f": None, "b": None}
        states = np.concatenate([self.one_way(w, x @ self.p[f"w{w}"] + self.p[f"c{w}"], at, mask, tapes[w]) for w in "fb"], 2)
        e = states @ self.p["a"] + np.where(mask.T > 0, 0, -30).astype(np.float32)
        e = np.exp(e - e.max(0))
        weight = e / e.sum(0) * (mask.T > 0)
        pooled = (weight[:, :, None] * states).sum(0)
        if keep is not None:
            keep.update(states=states, weight=weight, pooled=pooled, tapes=tapes)
        return pooled @ self.p["o"] + self.p["bias"]

    def scores(self, x: np.ndarray, at: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """As forward, over many windows: the inputs are projected once for each different word."""
        projected = {w: x @ self.p[f"w{w}"] + self.p[f"c{w}"] for w in "fb"}
        out = np.empty(len(at), np.float32)
        for k in range(0, len(at), 4096):
            a, m = at[k : k + 4096], mask[k : k + 4096]
            states = np.concatenate([self.one_way(w, projected[w], a, m, None) for w in "fb"], 2)
            e = states @ self.p["a"] + np.where(m.T > 0, 0, -30).astype(np.float32)
            e = np.exp(e - e.max(0))
            weight = e / e.sum(0) * (m.T > 0)
            out[k : k + 4096] = (weight[:, :, None] * states).sum(0) @ self.p["o"] + self.p["bias"]
        return sigmoid(out)

    def learn(self, ids, codes, begin, at, mask, labels, weight, rate: float) -> float:
        """One step of Adam on a batch of windows; returns the loss."""
        h, p, keep = HIDDEN, self.p, {}
        x = np.concatenate([self.inputs(ids, codes, begin), np.zeros((1, WORD_DIM + CHAR_DIM), np.float32)])
        score = sigmoid(self.forward(x, at, mask, keep))
        loss = float(-(weight * (labels * np.log(score + 1e-7) + (1 - labels) * np.log(1 - score + 1e-7))).sum() / weight.sum())
        g = {k: np.zeros_like(v) for k, v in p.items()}
        d = (weight * (score - labels) / weight.sum()).astype(np.float32)
        g["bias"][0], g["o"] = d.sum(), keep["pooled"].T @ d
        d_pooled = d[:, None] * p["o"]
        states, w = keep["states"], keep["weight"]
        d_w = (states * d_pooled).sum(2)
        d_e = w * (d_w - (w * d_w).sum(0))
        g["a"] = np.einsum("tn,tnd->d", d_e, states)
        d_states = w[:, :, None] * d_pooled + d_e[:, :, None] * p["a"]
        d_x = np.zeros_like(x)
        for i, way in enumerate("fb"):
            u, d_p = p[f"u{way}"], np.zeros((len(x), 3 * h), np.float32)
            d_h = np.zeros((len(at), h), np.float32)
            for t, before, z, r, c, qn, m in reversed(keep["tapes"][way]):
                d_h = d_h + d_states[t][:, i * h : (i + 1) * h]
                d_z, d_c = d_h * m * (before - c), d_h * m * (1 - z)
                d_pn = d_c * (1 - c * c)
                d_pz, d_pr = d_z * z * (1 - z), d_pn * qn * r * (1 - r)
                d_q = np.concatenate([d_pz, d_pr, d_pn * r], 1)
                g[f"u{way}"] += before.T @ d_q
                np.add.at(d_p, at[:, t], np.concatenate([d_pz, d_pr, d_pn], 1))
                d_h = d_h * (1 - m * (1 - z)) + d_q @ u.T
            d_p[-1] = 0
            g[f"w{way}"], g[f"c{way}"] = x.T @ d_p, d_p.sum(0)
            d_x += d_p @ p[f"w{way}"].T
        np.add.at(g["word"], ids, d_x[:-1, :WORD_DIM])
        size = np.diff(begin)
        np.add.at(g["char"], codes, np.repeat(d_x[:-1, WORD_DIM:] / size[:, None], size, axis=0))
        self.steps += 1
        for k, v in p.items():
            a, b = self.moments[k]
            a += 0.1 * (g[k] - a)
            b += 0.001 * (g[k] ** 2 - b)
            v -= rate * (a / (1 - 0.9**self.steps)) / (np.sqrt(b / (1 - 0.999**self.steps)) + 1e-7)
        return loss


class Reader:
    """Words of texts as rows of input vectors; remembers words up to a bound."""

    def __init__(self, network: Network):
        self.network = network
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.x = np.zeros((0, WORD_DIM + CHAR_DIM), np.float32)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(rows of self.x, words in each text)."""
        split = [t.lower().split() for t in texts]
        if len(self.known) > MOST_KNOWN:
            self.forget()
        new = list({w for s in split for w in s}.difference(self.known))
        if new:
            plain = [bare(w) for w in new]
            ids = np.fromiter((self.network.words.get(w, 0) for w in plain), np.int64, len(new))
            self.x = np.concatenate([self.x, self.network.inputs(ids, *trigrams(plain))])
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        lengths = np.fromiter(map(len, split), np.int64, len(split))
        get = self.known.__getitem__
        return np.fromiter((get(w) for s in split for w in s), np.int64, int(lengths.sum())), lengths


def framed(rows: np.ndarray, spans: np.ndarray, nothing: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of each window side by side, and which are words."""
    place = np.arange(WINDOW)
    mask = place < spans[:, 1:2]
    at = np.where(mask, spans[:, :1] + place, 0)
    return np.where(mask, rows[at] if len(rows) else nothing, nothing), mask.astype(np.float32)


def score_texts(network: Network, reader: Reader, texts) -> np.ndarray:
    out = []
    for _, run in in_portions(texts, 2 << 20):
        rows, lengths = reader(run)
        spans, text = windows(lengths)
        x = np.concatenate([reader.x, np.zeros((1, WORD_DIM + CHAR_DIM), np.float32)])
        best = np.zeros(len(run), np.float32)
        for k in range(0, len(spans), 1 << 15):
            at, mask = framed(rows, spans[k : k + (1 << 15)], len(x) - 1)
            np.maximum.at(best, text[k : k + (1 << 15)], network.scores(x, at, mask))
        out.append(best)
    return np.concatenate(out) if out else np.zeros(0, np.float32)


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = SEED) -> Network | float:
    """A network, or the share of label 1 where there are not both labels."""
    labels_ = np.array(labels, np.float32)
    if not 0 < labels_.sum() < len(labels_):
        return float(labels_.mean()) if len(labels_) else 0.0
    rng = np.random.default_rng(seed)
    row: dict[str, int] = {}
    parts = [np.fromiter((row.setdefault(bare(w), len(row)) for w in t.lower().split()), np.int32) for t in texts]
    different = list(row)
    row.clear()
    # documents of each label that have a word
    seen = [np.bincount(np.concatenate([np.zeros(0, np.int32), *(np.unique(p) for p, y in zip(parts, labels, strict=True) if y == c)]), minlength=len(different)) for c in (0, 1)]
    both = seen[0] + seen[1]
    top = np.argsort(-both, kind="stable")[:MOST_WORDS]
    top = top[both[top] >= 4]
    total = [float((labels_ == c).sum()) for c in (0, 1)]
    odds = np.log((seen[1][top] + 0.5) / (total[1] + 1)) - np.log((seen[0][top] + 0.5) / (total[0] + 1))
    # few documents say little: the odds are shrunk by their number
    odds = (odds * both[top] / (both[top] + 8) / 2).astype(np.float32)
    network = Network([different[k] for k in top], odds, rng)
    rows = np.concatenate([np.zeros(0, np.int32), *parts])
    ids = np.zeros(len(different), np.int64)
    ids[top] = np.arange(1, len(top) + 1)
    codes, begin = trigrams(different)
    spans, text = windows(np.array([len(p) for p in parts], np.int64))
    positive, negative = np.flatnonzero(labels_[text] == 1), np.flatnonzero(labels_[text] == 0)
    for epoch in range(epochs):
        x = np.concatenate([network.inputs(ids, codes, begin), np.zeros((1, WORD_DIM + CHAR_DIM), np.float32)])
        at, mask = framed(rows, spans[positive], len(x) - 1)
        # at first the network can't tell which window has earned the label; the words' odds can
        score = network.scores(x, at, mask) if epoch >= LED else np.concatenate([[-9], odds, [-9]])[np.append(ids, -1)[at]].max(1)
        order = positive[np.lexsort((score, text[positive]))]
        top = order[np.append(text[order[1:]] != text[order[:-1]], True)]
        some = rng.permutation(negative)[: max(3 * len(top), 1024)]
        # besides random ones, the windows that are most like label 1
        hard = rng.permutation(negative)[:4096]
        hard = hard[np.argsort(-network.scores(x, *framed(rows, spans[hard], len(x) - 1)))[: len(top) // 2]]
        batch = rng.permutation(np.concatenate([top, some, hard]))
        for k in range(0, len(batch), 256):
            b = batch[k : k + 256]
            at, mask = framed(rows, spans[b], len(different))
            used, at = np.unique(at, return_inverse=True)
            at = at.reshape(mask.shape)
            last = used[-1] == len(different)
            if last:
                used = used[:-1]
            sizes = np.diff(begin)[used]
            edge = np.concatenate([[0], np.cumsum(sizes)])
            take = np.repeat(begin[used] - edge[:-1], sizes) + np.arange(int(edge[-1]))
            y = labels_[text[b]]
            network.learn(ids[used], codes[take], edge, at, mask, y, np.ones(len(b), np.float32), 0.02 * (0.5 if epoch > epochs // 2 else 1))
    return network


def labelled(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[int]]:
    """The bounded sample of labelled rows outside of the held-out part."""
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit(SEED))
    chosen = None
    for c, most in ((1, MOST_POSITIVE), (0, MOST_NEGATIVE)):
        part = marks.where(F.col("toxic") == c).orderBy(order, "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")
    one = rows.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    size, before = F.octet_length("text"), Window.orderBy(order, "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    # the least hashes first, until the bytes are reached; the window has the sizes of the chosen ids only
    within = one.select("doc_id", F.coalesce(F.sum(size).over(before), F.lit(0)).alias("_before")).where(F.col("_before") < MOST_BYTES).select("doc_id")
    found = one.where(size <= MOST_BYTES).join(F.broadcast(within), "doc_id", "left_semi").orderBy("doc_id", "text").toPandas()
    return found["text"].tolist(), found["toxic"].astype(int).tolist()


def scored(docs: DataFrame, model: Network | float) -> DataFrame:
    """The rows of ``docs`` with ``score``."""
    ship(docs.sparkSession)
    columns = [c for c in docs.columns if c != "score"]
    docs = docs.select(*columns)
    if isinstance(model, float):
        return docs.withColumn("score", F.lit(model))
    state = (model.words, model.p)

    def run(batches):
        drop_encoders()
        network = Network.__new__(Network)
        network.words, network.p = state
        reader = Reader(network)
        for b in batches:
            score = score_texts(network, reader, b.column("text").to_pylist()).astype(float)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score, pa.float64())], names=[*b.schema.names, "score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, held_out, score and predicted of each document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = train(*labelled(docs, table(spark, folder, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return scored(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
