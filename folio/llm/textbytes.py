"""Texts of a batch as one array of bytes, with its words and their hashes, without a loop over words.

Hashes are polynomials modulo 2^64 over a random 64-bit number for each byte value, read off running sums, then mixed.
"""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.default_rng(0x5EED)
#: A number for each byte value.
BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


#: Powers that are kept; more are made when needed.
_KEPT_POWERS = 1 << 21


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE (or its inverse) to the powers from 0 to n."""
    if len(_powers[inverse]) > n:
        return _powers[inverse]
    step = np.full(max(n + 1, _KEPT_POWERS), _INVERSE if inverse else BASE, np.uint64)
    step[0] = 1
    out = np.multiply.accumulate(step)
    if len(out) == _KEPT_POWERS:
        _powers[inverse] = out
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Texts:
    """bytes: all texts (or their bytes), each followed by a line end; edge: where each begins, and the end of all."""

    def __init__(self, texts: list, lower: bool = False, words: bool = True):
        raw = [t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass") for t in texts]
        self.bytes = np.frombuffer(b"\n".join([*raw, b""]) if raw else b"", np.uint8)
        if lower:
            self.bytes = _LOWER[self.bytes]
        self.sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        self.edge = np.concatenate([[0], np.cumsum(self.sizes + 1)])
        if words:
            self._find_words(len(raw))

    def _find_words(self, n: int) -> None:
        space = np.concatenate([[True], _SPACE[self.bytes]])
        change = np.flatnonzero(space[1:] != space[:-1])
        #: Where words begin and end; a word never crosses texts.
        self.begin, self.end = change[::2], change[1::2]
        self.text = np.searchsorted(self.edge, self.begin, "right") - 1
        self.n_words = np.bincount(self.text, minlength=n).astype(np.int64)
        self.word_edge = np.concatenate([[0], np.cumsum(self.n_words)])

    def sums(self) -> np.ndarray:
        """Running sums whose differences are hashes of spans, times a power of BASE."""
        values = BYTE[self.bytes] * powers(len(self.bytes))[: len(self.bytes)]
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])

    def span_hashes(self, begin: np.ndarray, end: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
        sums = self.sums() if sums is None else sums
        return mixed((sums[end] - sums[begin]) * powers(len(self.bytes), True)[begin])

    def word_hashes(self) -> np.ndarray:
        return self.span_hashes(self.begin, self.end)

    def total(self, flags: np.ndarray) -> np.ndarray:
        """How many flags, one for each byte, each text has."""
        run = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return run[self.edge[1:]] - run[self.edge[:-1]]


def runs_of(hashes: np.ndarray, words: int) -> np.ndarray:
    """A hash of each run of so many in a row: as many as hashes, less words - 1."""
    out = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for k in range(words):
        out = out * BASE + hashes[k : k + len(out)]
    return mixed(out)


def shingles(texts: Texts, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, edges): for each text the sorted, different hashes of its runs of ``words`` words.

    A text with fewer words has one, of all its words; a text without words none.
    """
    h = texts.word_hashes()
    n = texts.n_words
    all_runs = runs_of(h, words)
    count = np.where(n >= words, n - words + 1, 0)
    whose = np.repeat(np.arange(len(n)), count)
    take = np.repeat(texts.word_edge[:-1] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
    found = all_runs[take]
    short = np.flatnonzero((n > 0) & (n < words))
    extra = []
    for i in short:
        x = np.uint64(n[i])
        with np.errstate(over="ignore"):
            for w in h[texts.word_edge[i] : texts.word_edge[i + 1]]:
                x = x * BASE + w
        extra.append(x)
    if extra:
        found = np.concatenate([found, mixed(np.array(extra, np.uint64))])
        whose = np.concatenate([whose, short])
    order = np.lexsort((found, whose))
    found, whose = found[order], whose[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (whose[1:] != whose[:-1])
    found, whose = found[new], whose[new]
    return found, np.concatenate([[0], np.cumsum(np.bincount(whose, minlength=len(n)))])
