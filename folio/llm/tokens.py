"""Token ids of whole texts by the tokenizers library, in executors.

Ids are those of the library's own call: where a text has the string of a special token, that token's id stands
(``special=False`` takes it for ordinary text). Special tokens are cut out first, as the library does, and what is
between them is encoded part by part. Encoding a part is encoding its chunks, if the chunks are cut where no pre-token
of the vocabulary can reach across. Texts repeat their chunks a lot, so the ids of a chunk are looked up after its first
time. ``tests/llm`` compares with the library's own encoding of whole texts.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
from itertools import chain

import numpy as np

#: Chunks in one of the two generations that a worker keeps.
MOST_CHUNKS = 230_000
#: White space as the byte-level vocabulary's own pattern has it.
_WHITE_SET = frozenset(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_WHITE = "".join(sorted(_WHITE_SET))
_RUNS = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
#: A comma or full stop that is not a pre-token's beginning. Patterns begin with the rare signs, which are found fast.
_IN_RUN = re.compile(r"[.,](?<=(?:[^\w \n]|_)[.,])")
#: That, also behind a space, and white space behind a line end.
_NOT_SHORT = re.compile(r"[.,\n](?:(?<=[\W_][.,])|(?<=\n)\s)")


def by_space(text: str) -> list[str]:
    """Keys for vocabularies of small letters that drop white space. A key is its chunk.

    A space or a line end is never inside a pre-token. In Latin-1, small letters can be made here as the vocabulary
    makes them, and a comma or full stop behind a letter or digit begins a pre-token.
    """
    try:
        text.encode("latin-1")
        text = text.lower()
        if not _IN_RUN.search(text):
            text = text.replace(",", " ,").replace(".", " .")
    except UnicodeEncodeError:  # other signs: small letters may join or come apart
        pass
    return text.replace("\n", " ").split(" ")


def by_run(text: str) -> list[str]:
    """Keys for byte-level vocabularies: a run of other than white space with the space before it, or white space.

    In ordinary texts keys are short: a word stands for itself with a space before it, unless it begins with a line end,
    a comma or a full stop; behind a zero stands a chunk as it is.
    """
    if "\0" in text or "  " in text or " \n" in text or _NOT_SHORT.search(text):
        return ["\0" + c for c in _RUNS.findall(text)]
    out = text.replace(",", " ,").replace(".", " .").replace("\n", " \n \0").split(" ")
    out[0] = "\0" + out[0]
    return out


def _chunk_of_run(key: str) -> str:
    return key[1:] if key[:1] == "\0" else key if key[:1] in ("\n", ",", ".") and key else " " + key


#: For each cut: the mark, the chunks that it is not used with, what stands between chunks, and the chunk of a key.
MARKS = {
    "by_space": ("7", lambda c: not c or "7" in c or not c.isprintable(), " 7 ", lambda key: key),
    "by_run": ("\n", lambda c: not c or not c.isprintable() or c[0] in _WHITE_SET and (len(c) < 2 or c[0] != " " or c[1] in _WHITE_SET), "\n", _chunk_of_run),
}


#: For each cut: keys of Latin letters, with signs behind or not, and what stands before the letters. Each of the two parts is
#: one pre-token, which the vocabulary's model can take as it is; a zero in front says that nothing stands before.
SIMPLE = {"by_space": (re.compile("()([a-zß-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)"), ""), "by_run": (re.compile("(\0?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)"), "Ġ")}
#: The sign of each byte in byte-level vocabularies: printable bytes are themselves, the others follow from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SIGNS = {b: 256 + i for i, b in enumerate(sorted(set(range(256)).difference(_PRINTABLE)))}


#: Begins the key of a special token; keys of chunks never begin with a space.
SPECIAL = " "


class Numbers(dict):
    """Numbers for keys; a new key gets the next one and is noted."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self.new.append(key)
        self[key] = n = len(self)
        return n


class Encoder:
    """Ids of texts: one array of all ids and one of the lengths.

    Lookups are kept in two generations: when the young one is full it becomes the old one, and only what is asked
    for again is taken over from there. So common chunks stay and the memory has a bound.
    """

    def __init__(self, path: str, cut, special: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder() if special else {}
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("added tokens that reach beyond their own string are not supported")
        self.special = {t.content: i for i, t in added.items()}
        self.at_special = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")")
        # chunks have no special tokens left, and small letters must not make any
        self.tokenizer.encode_special_tokens = True
        self.cut = cut
        self.old = ({}, np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32))
        self.renew()

    def renew(self) -> None:
        self.known = Numbers()
        self.start = np.zeros(1 << 16, np.int64)
        self.length = np.zeros(1 << 16, np.int32)
        self.flat = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def keys(self, text: str) -> list[str]:
        """The keys of a text's chunks and special tokens, in order."""
        if not any(t in text for t in self.special):
            return self.cut(text)
        out: list[str] = []
        for i, part in enumerate(self.at_special.split(text)):
            if i % 2:
                out.append(SPECIAL + part)
            elif part:
                out += self.cut(part)
        return out

    def learn(self, keys: list[str]) -> None:
        """Ids of new keys, which have the last numbers. Plain words go to the vocabulary's model one by one."""
        first = len(self.known) - len(keys)
        while len(self.known) > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        known, start, length, flat = self.old
        had = np.fromiter((known.get(k, -1) for k in keys), np.int64, len(keys))
        again = np.flatnonzero(had >= 0)
        if len(again):
            n = length[had[again]].astype(np.int64)
            ends = np.cumsum(n)
            self.put(first + again, flat[np.repeat(start[had[again]] - ends + n, n) + np.arange(int(ends[-1]))], n)
        fresh = np.flatnonzero(had < 0)
        keys = [keys[i] for i in fresh]
        simple, before = SIMPLE[self.cut.__name__]
        tokenize, fits = self.tokenizer.model.tokenize, simple.fullmatch
        plain = [fits(k) for k in keys]
        parts = iter(self.learn_rest([k for k, p in zip(keys, plain, strict=True) if not p and k[:1] != SPECIAL]))
        found = []
        for k, p in zip(keys, plain, strict=True):
            if k[:1] == SPECIAL:
                found.append([self.special[k[1:]]])
                continue
            if p is None:
                found.append(next(parts))
                continue
            bare, letters, signs = p.groups()
            letters = letters if letters.isascii() else letters.encode().decode("latin-1").translate(_SIGNS)
            ids = [x.id for x in tokenize(letters if bare else before + letters)]
            found.append(ids + [x.id for x in tokenize(signs)] if signs else ids)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        self.put(first + fresh, np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths)

    def learn_rest(self, keys: list[str]) -> list[list[int]]:
        """Many chunks are encoded as one text, between marks that are pre-tokens of their own in any surroundings."""
        out: list[list[int]] = []
        mark, odd, between, chunk = MARKS[self.cut.__name__]
        sign = self.tokenizer.encode(mark, add_special_tokens=False).ids
        for at in range(0, len(keys), 10_000):
            some = [chunk(k) for k in keys[at : at + 10_000]]
            apart = [i for i, c in enumerate(some) if odd(c)]
            plain = list(some)
            for i in apart:
                plain[i] = "a"
            ids = self.tokenizer.encode_batch_fast([between.join(["", *plain, ""])], add_special_tokens=False)[0].ids
            marks = [i for i, x in enumerate(ids) if x == sign[0]]
            if len(sign) != 1 or len(marks) != len(some) + 1:
                apart, parts = range(len(some)), [[]] * len(some)
            else:
                parts = [ids[a + 1 : b] for a, b in zip(marks[:-1], marks[1:], strict=True)]
            for i, e in zip(apart, self.tokenizer.encode_batch_fast([some[i] for i in apart], add_special_tokens=False), strict=True):
                parts[i] = e.ids
            out += parts
        return out

    def put(self, numbers: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.start[numbers] = self.used + np.cumsum(lengths) - lengths
        self.length[numbers] = lengths
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cut = [self.keys(t) for t in texts]
        if len(self.known) > MOST_CHUNKS:
            self.old = (self.known, self.start, self.length, self.flat)
            self.renew()
        n = np.fromiter(map(len, cut), np.int64, len(cut))
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int64, int(n.sum()))
        if self.known.new:
            self.learn(self.known.new)
            self.known.new = []
        lengths = self.length[at].astype(np.int64)
        ends = np.cumsum(lengths)
        ids = self.flat[np.repeat(self.start[at] - ends + lengths, lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]
        ends = np.concatenate([[0], ends])
        edge = np.concatenate([[0], np.cumsum(n)])
        return ids, ends[edge[1:]] - ends[edge[:-1]]


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, cut, special: bool = True) -> Encoder:
    """One for each vocabulary and worker."""
    key = (path, cut.__name__, special)
    if key not in _encoders:
        _encoders[key] = Encoder(path, cut, special)
    return _encoders[key]


def drop_encoders() -> None:
    """Free what a worker has kept; operators that don't tokenize call it, as workers are used again."""
    if _encoders:
        _encoders.clear()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # give freed memory back where the C library can
            ctypes.CDLL("libc.so.6").malloc_trim(0)


def in_portions(texts, most: int = 4 << 20):
    """Runs of texts of about so many characters: (first, texts)."""
    first, size, run = 0, 0, []
    for i, t in enumerate(texts):
        run.append(t or "")
        size += len(run[-1])
        if size >= most:
            yield first, run
            first, size, run = i + 1, 0, []
    if run:
        yield first, run


def documents_ids(texts, path: str, cut, end: int, special: bool = True):
    """For each text its ids with ``end`` behind them, as an unsigned 32-bit array."""
    encode = encoder(path, cut, special)
    for _, run in in_portions(texts, 2 << 20):
        ids, lengths = encode(run)
        edge = np.concatenate([[0], np.cumsum(lengths)])
        for i in range(len(run)):
            out = np.empty(lengths[i] + 1, "<u4")
            out[:-1] = ids[edge[i] : edge[i + 1]]
            out[-1] = end
            yield out
