"""Tokens of byte-pair encoding: texts are cut into words by a pattern, and a word's bytes are merged pair by pair, the pair of lowest rank first.

Spark cuts the words of a text, and a task merges each different word of a batch of texts once, most of them once for all of its batches; words are
never dealt out. Ranks come from a vocabulary file (a line for each token: base64 and rank), which is a parameter; they are some tens of thousands, whatever the corpus.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: fixed value: how texts are cut into words before merging
WORDS = r"(?U)'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

#: How many words of how many bytes at most a task knows the tokens of; it begins anew beyond that.
MOST_KNOWN, LONGEST_KNOWN = 200_000, 100


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def token_count(word: bytes, ranks: dict[bytes, int]) -> int:
    """The number of tokens of a word; in n log n steps, so that very long words end too."""
    if word in ranks or len(word) < 2:
        return min(1, len(word))
    n = len(word)
    # parts of the word, each by where it begins, with the part before and after
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    end = list(range(1, n + 1))
    alive = [True] * n
    queue = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(queue)
    count = n
    while queue:
        _, i, stop = heapq.heappop(queue)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue  # one of the two has been merged since
        alive[j] = False
        after[i], end[i] = after[j], stop
        count -= 1
        if after[i] < n:
            before[after[i]] = i
        for a in (before[i], i):
            b = after[a] if a >= 0 else n
            if a >= 0 and b < n and (r := ranks.get(word[a : end[b]])) is not None:
                heapq.heappush(queue, (r, a, end[b]))
    return count


def token_counts(texts: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(key, tokens) of each row's text; 0 for an empty or null text."""
    ranks = ranks_of(path)
    known: dict[bytes, int] = {}

    def counted(word: bytes) -> int:
        n = known.get(word)
        if n is None:
            n = token_count(word, ranks)
            if len(known) >= MOST_KNOWN:
                known.clear()
            if len(word) <= LONGEST_KNOWN:
                known[word] = n
        return n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(1)
            coded = words.flatten().dictionary_encode()
            each = np.array([counted(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()], np.int64)
            ends = np.cumsum(np.concatenate([[0], pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)]))
            sums = np.concatenate([[0], np.cumsum(each[coded.indices.to_numpy(zero_copy_only=False)])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums[ends[1:]] - sums[ends[:-1]], pa.int64())], names=[key, "tokens"])

    words = texts.select(key, F.regexp_extract_all(text, F.lit(WORDS), F.lit(0)).alias("_words"))
    return words.mapInArrow(run, f"`{key}` {dict(texts.dtypes)[key]}, tokens long")
