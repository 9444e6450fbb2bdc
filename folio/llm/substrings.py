"""Removal of repeated byte strings in whole texts, by a hash-compared suffix sort.

Every string of ``LENGTH`` bytes that also starts earlier (in a document before, or in the same one) is covered. A whole
corpus of suffixes isn't sorted, only those at anchors: of each string the 32-byte gram (or grams) of least hash is an
anchor, so equal strings have theirs at the same place. Steps, each dealt by hash into groups of bounded bytes:

1. anchors of each text; those whose gram is seen once anywhere are left out;
2. the others' contexts, all bytes of strings that hold the anchor, are gathered by gram; equal contexts are one;
3. in each gram's group the texts right of the anchor and left of it (read backwards) are suffix-sorted. The pieces
   that agree over the right number of bytes on both sides hold the same string, and all but its first are covered;
4. a document's covered spans are joined and what remains is hashed.

Equal grams of a batch are one row before the shuffle, and equal contexts are one before theirs, so a passage that very
many documents share isn't gathered as often as it stands; what is gathered at its edges are the different contexts.

Defined cases: a null text is empty; texts shorter than ``LENGTH`` bytes lose nothing; rows with a null ``doc_id`` come
before all, in the order of their texts' hashes; rows of one ``doc_id`` follow each other in the order of their texts; a
``doc_id`` below -2^62 is an error; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import quantile, ship, table, text_or_empty, written
from folio.llm.suffixes import suffix_order
from folio.llm.textbytes import BYTE, Texts, mixed, powers
from folio.llm.tokens import drop_encoders, in_portions

LENGTH, GRAM = 100, 32
LEFT = LENGTH - GRAM
#: Bytes of text whose anchors or contexts are gathered in one group, on average.
GROUP_BYTES = 4 << 20
#: Where ids begin; null ones have numbers below, by their texts.
LEAST_ID = -(1 << 62)


def sliding(x: np.ndarray, width: int, f: np.ufunc, fill: int) -> np.ndarray:
    """f over each ``width`` values in a row: as many as values, less width - 1."""
    n = len(x)
    padded = np.full(-(-n // width) * width, fill, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = f.accumulate(blocks, axis=1).reshape(-1)
    behind = f.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return f(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(places, gram hashes) of the anchors of all texts."""
    n = len(t.bytes) - GRAM + 1
    if len(t.bytes) <= LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = t.sums()
    h = mixed((sums[GRAM:] - sums[:n]) * powers(len(t.bytes), True)[:n])
    end = np.repeat(t.edge[1:] - 1, t.sizes + 1)[:n]
    at = np.arange(n)
    whole = at + GRAM <= end
    most = np.uint64(0xFFFFFFFFFFFFFFFF)
    h[~whole] = most
    least = sliding(h, LEFT + 1, np.minimum, int(most))
    least[at[: len(least)] + LENGTH > end[: len(least)]] = 0
    reach = sliding(np.concatenate([np.zeros(LEFT, np.uint64), least, np.zeros(LEFT, np.uint64)]), LEFT + 1, np.maximum, 0)
    places = np.flatnonzero(whole & (reach[:n] == h))
    return places, h[places]


def dealt(group: np.ndarray, groups: int, columns: dict[str, np.ndarray]) -> pd.DataFrame:
    """One row for each group, with the bytes of its part of each column."""
    order = np.argsort(group, kind="stable")
    edge = np.searchsorted(group[order], np.arange(groups + 1))
    full = np.flatnonzero(np.diff(edge))
    out = {"group": full.astype(np.int64)}
    for name, x in columns.items():
        x = x[order]
        out[name] = [x[edge[g] : edge[g + 1]].tobytes() for g in full]
    return pd.DataFrame(out)


def gathered(f: pd.DataFrame, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(f[name]), kind)


def repeated_anchors(docs: DataFrame, groups: int) -> DataFrame:
    """(group, docs, places): the anchors whose gram is there more than once, by group of documents."""

    def find(frames):
        drop_encoders()
        for f in frames:
            ids = f["doc_id"].to_numpy(np.int64)
            for first, run in in_portions(f["text"], 2 << 20):
                t = Texts(run, words=False)
                at, gram = anchors(t)
                text = np.searchsorted(t.edge, at, "right") - 1
                doc, place = ids[first + text], (at - t.edge[text]).astype(np.int32)
                # of equal grams one asks for all, and says that it isn't alone; the others are surely repeated
                order = np.argsort(gram, kind="stable")
                g = gram[order]
                new = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.zeros(0, bool)
                again = np.concatenate([~new[1:], [False]]) if len(g) else new
                sign = np.zeros(len(g), np.uint8)
                sign[order] = np.where(~new, 2, again)
                where = np.where(sign == 2, mixed(gram + at.astype(np.uint64)), gram) % np.uint64(groups)
                yield dealt(where.astype(np.int64), groups, {"grams": gram, "docs": doc, "places": place, "signs": sign})

    def keep(f):
        gram, doc, place, sign = (gathered(f, n, k) for n, k in (("grams", np.uint64), ("docs", np.int64), ("places", np.int32), ("signs", np.uint8)))
        ask = sign < 2
        ordered = np.sort(gram[ask])
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        at = np.minimum(np.searchsorted(twice, gram), max(len(twice) - 1, 0))
        hit = (sign > 0) | ((twice[at] == gram) if len(twice) else False)
        return dealt(document_group(doc[hit], groups), groups, {"docs": doc[hit], "places": place[hit]})

    found = docs.mapInPandas(find, "group long, grams binary, docs binary, places binary, signs binary")
    return found.groupBy("group").applyInPandas(keep, "group long, docs binary, places binary")


def document_group(doc: np.ndarray, groups: int) -> np.ndarray:
    return (mixed(doc.astype(np.int64).view(np.uint64)) % np.uint64(groups)).astype(np.int64)


def packed(data: bytes) -> bytes:
    return zstandard.compress(data, 3)


def unpacked(blobs) -> bytes:
    return b"".join(map(zstandard.decompress, blobs))


def documents_by_group(docs: DataFrame, groups: int) -> DataFrame:
    """By group of documents: ids, sizes and compressed bytes of texts."""

    def run(frames):
        for f in frames:
            ids = f["doc_id"].to_numpy(np.int64)
            raw = [x.encode("utf-8", "surrogatepass") for x in f["text"]]
            sizes = np.fromiter(map(len, raw), np.int64, len(raw))
            group = document_group(ids, groups)
            out = dealt(group, groups, {"ids": ids, "sizes": sizes})
            order = np.argsort(group, kind="stable")
            edge = np.searchsorted(group[order], [*out["group"], groups])
            yield out.assign(texts=[packed(b"".join(raw[i] for i in order[a:b])) for a, b in zip(edge[:-1], edge[1:], strict=True)])

    return docs.mapInPandas(run, "group long, ids binary, sizes binary, texts binary")


TEXTS = ["ids", "sizes", "texts"]


def beside_texts(texts: DataFrame, more: DataFrame, names: list[str]) -> DataFrame:
    """Texts and, in rows without them, the blobs of the same group."""
    none = lambda some: [F.lit(None).cast("binary").alias(n) for n in some]
    return texts.select("group", *TEXTS, *none(names)).unionAll(more.select("group", *none(TEXTS), *names))


def parted(f: pd.DataFrame) -> tuple[np.ndarray, list[bytes], np.ndarray, pd.DataFrame]:
    """(ids, texts, which text of its id) in order, and the other rows."""
    with_texts = f["texts"].notna().to_numpy()
    rows = f[with_texts]
    ids, sizes, data = gathered(rows, "ids", np.int64), gathered(rows, "sizes", np.int64), unpacked(rows["texts"])
    ends = np.cumsum(sizes)
    raw = [data[b - n : b] for b, n in zip(ends, sizes, strict=True)]
    order = sorted(range(len(raw)), key=lambda i: (ids[i], raw[i]))
    ids, raw = ids[order], [raw[i] for i in order]
    new = np.concatenate([[True], ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, bool)
    nth = np.arange(len(ids)) - np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0)) if len(ids) else np.zeros(0, np.int64)
    return ids, raw, nth.astype(np.int32), f[~with_texts]


def contexts(texts: DataFrame, repeated: DataFrame, groups: int) -> DataFrame:
    """By group of grams: each different context of a group of documents, and spans that are surely covered."""

    def run(f):
        ids, raw, nth, rest = parted(f)
        if not len(ids) or not len(rest):
            return pd.DataFrame({"group": np.zeros(0, np.int64), **{n: [] for n in NAMES}})
        t = Texts(raw, words=False)
        doc, place = gathered(rest, "docs", np.int64), gathered(rest, "places", np.int32).astype(np.int64)
        # an anchor belongs to every text of its id that is long enough; one more anchor does no harm
        # rows of one id have each named its anchors, so each is taken once before it goes to all of them
        order = np.lexsort((place, doc))
        doc, place = doc[order], place[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])
        doc, place = doc[new], place[new]
        low, high = np.searchsorted(ids, doc, "left"), np.searchsorted(ids, doc, "right")
        n = high - low
        row = np.repeat(low, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        place = np.repeat(place, n)
        fits = place + GRAM <= t.sizes[row]
        row, place = row[fits], place[fits]
        order = np.lexsort((place, row))
        row, place = row[order], place[order]
        at = t.edge[row] + place
        left, right = np.minimum(place, LEFT), np.minimum(t.sizes[row] - place, LENGTH)
        long_enough = left + right >= LENGTH
        row, place, at, left, right = (x[long_enough] for x in (row, place, at, left, right))
        sums = t.sums()
        inverse = powers(len(t.bytes), True)
        gram = mixed((sums[at + GRAM] - sums[at]) * inverse[at])
        whole = mixed((sums[at + right] - sums[at - left]) * inverse[at - left])
        other = mixed(whole + mixed(gram + (left * 256 + right).astype(np.uint64)))
        first = first_of(whole, other, t.bytes, at - left, left + right)
        group = (gram % np.uint64(groups)).astype(np.int64)
        later = np.flatnonzero(~first)
        sure = dealt(document_group(ids[row[later]], groups), groups, {"docs": ids[row[later]], "nths": nth[row[later]], "begins": (place - left)[later].astype(np.int32), "ends": (place + right)[later].astype(np.int32)})
        keep = np.flatnonzero(first)
        row, place, at, left, right, group = (x[keep] for x in (row, place, at, left, right, group))
        order = np.argsort(group, kind="stable")
        edge = np.searchsorted(group[order], np.arange(groups + 1))
        out = []
        for g in np.flatnonzero(np.diff(edge)):
            k = order[edge[g] : edge[g + 1]]
            size = left[k] + right[k]
            take = np.repeat(at[k] - left[k] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            out.append((int(g), packed(t.bytes[take].tobytes()), left[k].astype(np.int32).tobytes(), right[k].astype(np.int32).tobytes(), ids[row[k]].tobytes(), nth[row[k]].tobytes(), place[k].astype(np.int32).tobytes(), None, None))
        made = pd.DataFrame(out, columns=["group", *NAMES])
        return pd.concat([made, sure.assign(bytes=None, lefts=None, rights=None, places=None)[["group", *NAMES]]], ignore_index=True)

    rows = beside_texts(texts, repeated, ["docs", "places"])
    return rows.groupBy("group").applyInPandas(run, "group long, " + ", ".join(f"{n} binary" for n in NAMES))


NAMES = ["bytes", "lefts", "rights", "docs", "nths", "places", "begins", "ends"]


def first_of(key: np.ndarray, other: np.ndarray, data: np.ndarray, at: np.ndarray, size: np.ndarray, at_once: int = 50_000) -> np.ndarray:
    """Which pieces (size bytes of data from at) are the first of their bytes. Hashes (key, other) name those that may be the same, their bytes decide."""
    order = np.lexsort((other, key))
    out = np.ones(len(key), bool)
    if not len(key):
        return out
    new = np.concatenate([[True], (key[order[1:]] != key[order[:-1]]) | (other[order[1:]] != other[order[:-1]])])
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    later = np.flatnonzero(~new)
    for k in range(0, len(later), at_once):
        i, f = order[later[k : k + at_once]], first[later[k : k + at_once]]
        alike = size[i] == size[f]
        i, f = i[alike], f[alike]
        n = size[i]
        edge = np.cumsum(n) - n
        step = np.arange(int(n.sum())) - np.repeat(edge, n)
        different = data[np.repeat(at[i], n) + step] != data[np.repeat(at[f], n) + step]
        out[i] = np.add.reduceat(different, edge) > 0 if len(i) else False
    return out


def covered(data: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which, begin, end): contexts, given in order, with a span from and to bytes beside the anchor, covered by earlier ones."""
    size = left + right
    at = np.cumsum(size) - size + left
    sums = gram_numbers(data, at)
    right_order, right_common = suffix_order(data, at, right, LENGTH, sums)
    back = np.ascontiguousarray(data[::-1])
    left_order, left_common = suffix_order(back, len(data) - at, left, LENGTH, sums)
    n = len(at)
    low, high = np.full(n, LENGTH, np.int64), np.full(n, -1, np.int64)
    groups_left = np.concatenate([[True], sums[left_order][1:] != sums[left_order][:-1]]) if n else np.zeros(0, bool)
    rank_right, rank_left = np.empty(n, np.int64), np.empty(n, np.int64)
    for k in range(LEFT + 1):
        rank_right[right_order] = np.cumsum(right_common < LENGTH - k)
        rank_left[left_order] = np.cumsum((left_common < k) | groups_left)
        valid = np.flatnonzero((left >= k) & (right >= LENGTH - k))
        key = rank_right[valid] * (n + 1) + rank_left[valid]
        order = np.argsort(key, kind="stable")
        again = valid[order[1:][key[order[1:]] == key[order[:-1]]]]
        low[again] = np.minimum(low[again], k)
        high[again] = np.maximum(high[again], k)
    which = np.flatnonzero(high >= 0)
    return which, -high[which], LENGTH - low[which]


def gram_numbers(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A number for each gram: its hash."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[data] * powers(len(data))[: len(data)], dtype=np.uint64)])
    return mixed((sums[at + GRAM] - sums[at]) * powers(len(data), True)[at])


def spans(found: DataFrame, groups: int) -> DataFrame:
    """By group of documents: the covered spans."""
    names = ["docs", "nths", "begins", "ends"]

    def run(f):
        is_span = f["bytes"].isna().to_numpy()
        out = [f[is_span][["group", *names]]]
        f = f[~is_span]
        if len(f):
            data, left, right = np.frombuffer(unpacked(f["bytes"]), np.uint8), gathered(f, "lefts", np.int32).astype(np.int64), gathered(f, "rights", np.int32).astype(np.int64)
            doc, nth, place = gathered(f, "docs", np.int64), gathered(f, "nths", np.int32), gathered(f, "places", np.int32).astype(np.int64)
            order = np.lexsort((place, nth, doc))
            size = left + right
            begin = np.cumsum(size) - size
            take = np.repeat(begin[order] - np.cumsum(size[order]) + size[order], size[order]) + np.arange(int(size.sum()))
            data, left, right, doc, nth, place, size = data[take], left[order], right[order], doc[order], nth[order], place[order], size[order]
            # contexts that are equal and came from different groups of documents
            at = np.cumsum(size) - size
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(np.arange(256, dtype=np.uint64) + np.uint64(9))[data] * powers(len(data))[: len(data)], dtype=np.uint64)])
            whole = mixed((sums[at + size] - sums[at]) * powers(len(data), True)[at])
            gram = gram_numbers(data, at + left)
            first = first_of(whole, mixed(gram + (left * 256 + right).astype(np.uint64)), data, at, size)
            again = np.flatnonzero(~first)
            groups_of = lambda k: document_group(doc[k], groups)
            out.append(dealt(groups_of(again), groups, {"docs": doc[again], "nths": nth[again], "begins": (place - left)[again].astype(np.int32), "ends": (place + right)[again].astype(np.int32)}))
            # of the rest, grams with one context have nothing to cover
            kept = np.flatnonzero(first)
            g = gram[kept]
            values, counts = np.unique(g, return_counts=True)
            kept = kept[counts[np.searchsorted(values, g)] > 1]
            size_, at_ = size[kept], at[kept]
            take = np.repeat(at_ - np.cumsum(size_) + size_, size_) + np.arange(int(size_.sum()))
            which, low, high = covered(data[take], left[kept], right[kept])
            k = kept[which]
            out.append(dealt(groups_of(k), groups, {"docs": doc[k], "nths": nth[k], "begins": (place[k] + low).astype(np.int32), "ends": (place[k] + high).astype(np.int32)}))
        return pd.concat(out, ignore_index=True)

    return found.groupBy("group").applyInPandas(run, "group long, " + ", ".join(f"{n} binary" for n in names))


def remaining(texts: DataFrame, spans_: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes' spans joined."""

    def run(f):
        ids, raw, nth, rest = parted(f)
        doc, which = (gathered(rest, n, k) for n, k in (("docs", np.int64), ("nths", np.int32)))
        begin, end = gathered(rest, "begins", np.int32).astype(np.int64), gathered(rest, "ends", np.int32).astype(np.int64)
        row = np.searchsorted(ids, doc, "left") + which
        order = np.lexsort((begin, row))
        row, begin, end = row[order], begin[order], end[order]
        edge = np.searchsorted(row, np.arange(len(ids) + 1))
        out = []
        for i, data in enumerate(raw):
            kept, removed, runs, until = hashlib.sha256(), 0, 0, 0
            low = high = -1
            for b, e in zip(begin[edge[i] : edge[i + 1]], end[edge[i] : edge[i + 1]], strict=True):
                if b > high:
                    if high >= 0:
                        kept.update(data[until:low])
                        removed, runs, until = removed + high - low, runs + 1, high
                    low, high = int(b), int(e)
                else:
                    high = max(high, int(e))
            if high >= 0:
                kept.update(data[until:low])
                removed, runs, until = removed + high - low, runs + 1, high
            kept.update(data[until:])
            out.append((ids[i], len(data), removed, runs, kept.hexdigest()))
        return pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = beside_texts(texts, spans_, ["docs", "nths", "begins", "ends"])
    return rows.groupBy("group").applyInPandas(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row."""
    ship(docs.sparkSession)
    of_text = F.xxhash64(text_or_empty()).bitwiseAND(F.lit(-LEAST_ID - 1)) + F.lit(2 * LEAST_ID)
    nulls = F.count_if(F.col("doc_id").isNull()).alias("nulls")
    facts = docs.agg(F.sum(F.octet_length("text")).alias("total"), F.min("doc_id").alias("least"), nulls).first()
    if facts["nulls"] and facts["least"] is not None and facts["least"] < LEAST_ID:
        raise ValueError(f"rows without doc_id beside a doc_id below {LEAST_ID}: there is no number left for them")
    docs = docs.select(F.coalesce("doc_id", of_text).alias("doc_id"), text_or_empty().alias("text"))
    groups = quantile(facts["total"] or 0, GROUP_BYTES)
    repeated = written(repeated_anchors(docs, groups), "anchors")
    texts = documents_by_group(docs, groups)
    found = spans(contexts(texts, repeated, groups), groups)
    out = remaining(texts, written(found, "spans"))
    return out.withColumn("doc_id", F.when(F.col("doc_id") >= LEAST_ID, F.col("doc_id"))) if facts["nulls"] else out


def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(table(spark, folder, "documents"))
