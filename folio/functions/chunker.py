"""Sentences and speech-sized chunks of a text.

A chunker carries state from sentence to sentence, which column expressions can't, so it runs in batches of texts.
Sentences are word ranges, chunks are ranges of sentences; text is cut out only at the end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from folio.functions.fixed import ABBREVIATIONS, PLAIN_ABBREVIATIONS
from folio.functions.text import HEADING_CLOSES, HEADING_OPENS

_SHORT = tuple(a.lower() for a in ABBREVIATIONS)
_PLAIN_SHORT = frozenset(PLAIN_ABBREVIATIONS)
_END = re.compile(r"[.!?]\Z")
HEADING = re.compile(f"{HEADING_OPENS}(.*?){HEADING_CLOSES}")
#: Rows and letters that a task gives out at once, so that it never holds what a batch of texts makes.
ROWS_AT_ONCE, LETTERS_AT_ONCE = 5000, 1 << 20


@dataclass
class Chunk:
    words: list[str]
    kind: str = "text"


def ends_short(words: list[str]) -> bool:
    """Whether the last words, as letters, end in an abbreviation."""
    return " ".join(words[-4:]).lower().endswith(_SHORT)


def is_plain_short(words: list[str]) -> bool:
    """Whether the last word, without its closing signs, is just an abbreviation, capitals and all."""
    return words[-1].rstrip(".!?") in _PLAIN_SHORT


def sentences(words: list[str], short=ends_short) -> Iterator[list[str]]:
    """Runs of words up to a closing sign; an abbreviation before a small letter doesn't close."""
    begin = 0
    for i, word in enumerate(words):
        if not _END.search(word):
            continue
        small = i + 1 < len(words) and "a" <= words[i + 1][0] <= "z"
        if small and short(words[max(begin, i - 3) : i + 1]):
            continue
        yield words[begin : i + 1]
        begin = i + 1
    if begin < len(words):
        yield words[begin:]


def filled(parts: Iterator[list[str]], least: int, most: int) -> Iterator[Chunk]:
    """Chunks of whole sentences: one is full at ``least`` words, and closed before it would pass ``most``."""
    held: list[str] = []
    for part in parts:
        if held and len(held) + len(part) > most:
            yield Chunk(held)
            held = []
        held = held + part
        if len(held) >= least:
            yield Chunk(held)
            held = []
    if held:
        yield Chunk(held)


def joined(chunks: list[Chunk], most: int, small: int = 10, tiny: int = 5) -> list[Chunk]:
    """Small chunks go to the next one or else the one before where there is room; tiny ones go in any case."""
    out: list[Chunk] = []
    queue = list(reversed(chunks))
    while queue:
        here = queue.pop()
        n = len(here.words)
        if here.kind == "header" or n >= small:
            out.append(here)
            continue
        room = most + 5 if n <= tiny else most
        after = queue[-1] if queue and queue[-1].kind != "header" else None
        before = out[-1] if out and out[-1].kind != "header" else None
        if after and n + len(after.words) <= room:
            out.append(Chunk(here.words + queue.pop().words))
        elif before and n + len(before.words) <= room:
            before.words = before.words + here.words
        elif n <= tiny and after:
            out.append(Chunk(here.words + queue.pop().words))
        elif n <= tiny and before:
            before.words = before.words + here.words
        else:
            out.append(here)
    return out


def chunked(text: str | None, least: int = 5, most: int = 15, plain: bool = False) -> list[Chunk]:
    """The chunks of a text with marked headings; an empty text has none. Plain: no headings, no joining, fewer abbreviations."""
    if plain:
        return list(filled(sentences((text or "").split(), is_plain_short), least, most))
    raw: list[Chunk] = []
    pieces = HEADING.split(text or "")
    for i, piece in enumerate(pieces):
        words = piece.split()
        if i % 2:
            raw.append(Chunk(words, "header"))
        elif words:
            raw.extend(filled(sentences(words), least, most))
    return joined(raw, most)


def in_pieces(rows: Iterator[tuple], text: int) -> Iterator[list[tuple]]:
    """Rows in lists of ``ROWS_AT_ONCE`` rows or ``LETTERS_AT_ONCE`` letters in the column ``text`` at most, but for a row that is longer."""
    held, letters = [], 0
    for row in rows:
        n = len(row[text])
        if held and (len(held) >= ROWS_AT_ONCE or letters + n > LETTERS_AT_ONCE):
            yield held
            held, letters = [], 0
        held.append(row)
        letters += n
    if held:
        yield held


def texts_of(batches: Iterator[pa.RecordBatch], key: str, text: str) -> Iterator[tuple]:
    """(key, text) one by one, as a batch of many texts as Python's own would be several times its size."""
    for batch in batches:
        for k, t in zip(batch.column(key), batch.column(text), strict=True):
            yield k.as_py(), t.as_py()


def by_text(texts: DataFrame, key: str, text: str, rows, columns: dict[str, str]) -> DataFrame:
    """``rows(key, text)`` of each text, as a table of these columns, of which one is ``text``."""
    names = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = (row for k, t in texts_of(batches, key, text) for row in rows(k, t))
        for piece in in_pieces(made, names.index("text")):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*piece, strict=True), kinds, strict=True)], schema=kinds)

    ddl = ", ".join(f"{c} {t}" for c, t in columns.items())
    kinds = to_arrow_schema(texts.sparkSession.createDataFrame([], ddl).schema)
    return texts.select(key, text).mapInArrow(run, ddl)


def chunk_table(texts: DataFrame, key: str, text: str, least: int = 5, most: int = 15, plain: bool = False) -> DataFrame:
    """(key, chunk_index, type, text, word_count, start_word, end_word) of each chunk."""

    def rows(k, t):
        at = 0
        for i, c in enumerate(chunked(t, least, most, plain)):
            yield k, i, c.kind, " ".join(c.words), len(c.words), at, at + len(c.words) - 1
            at += len(c.words)

    columns = {key: dict(texts.dtypes)[key], "chunk_index": "int", "type": "string", "text": "string", "word_count": "int", "start_word": "int", "end_word": "int"}
    return by_text(texts, key, text, rows, columns)
