"""SQL of the sentence splitters and chunkers: sentence ends by the word after, cuts by running word counts, and what follows from cut to cut by recursion."""

from __future__ import annotations

from folio.functions.fixed import ABBREVIATIONS, PLAIN_ABBREVIATIONS

LEAST, MOST, SMALL, TINY = 5, 15, 10, 5
#: All words of a document as a list, for cutting out texts.
ALL_WORDS = r"ws AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM documents)"
#: Words with their places; all in one piece.
PLAIN_WORDS = "words AS (SELECT doc_id, 0 AS piece, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w FROM ws)"
#: Words of lines with their places in the document; a heading is a piece of its own, and so is what stands between two.
HEADED_WORDS = """hl AS (SELECT d.doc_id, d.line, ws, heading, sum(CASE WHEN heading THEN 1 ELSE 0 END) OVER (PARTITION BY d.doc_id ORDER BY d.line ROWS UNBOUNDED PRECEDING) AS before FROM d JOIN h USING (doc_id, line) WHERE t <> ''),
 words AS (SELECT doc_id, piece, row_number() OVER (PARTITION BY doc_id ORDER BY line, j) AS i, w FROM (SELECT doc_id, line, 2 * before - CASE WHEN heading THEN 1 ELSE 0 END AS piece, unnest(range(len(ws))) AS j, unnest(ws) AS w FROM hl))"""
LISTED = "ws AS (SELECT doc_id, list(w ORDER BY i) AS ws FROM words GROUP BY doc_id)"


def short_word(plain: bool) -> str:
    if plain:
        return f"regexp_replace(w, '[.!?]+$', '') IN ({', '.join(repr(a) for a in PLAIN_ABBREVIATIONS)})"
    return "(" + " OR ".join(f"ends_with(lower(w), '{a.lower()}')" for a in ABBREVIATIONS) + ")"


def sentences(plain: bool) -> str:
    """sent(doc_id, piece, s, n, lo, hi): sentences of ``words``, with their first and last word's place."""
    return f"""ends AS (SELECT doc_id, piece, i, w, regexp_matches(w, '[.!?]$') AND NOT coalesce(regexp_matches(lead(w) OVER (PARTITION BY doc_id, piece ORDER BY i), '^[a-z]') AND {short_word(plain)}, false) AS e FROM words),
 numbered AS (SELECT doc_id, piece, i, w, sum(CASE WHEN e THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, piece ORDER BY i ROWS UNBOUNDED PRECEDING) - CASE WHEN e THEN 1 ELSE 0 END AS s FROM ends),
 sent AS (SELECT doc_id, piece, s, count(*) AS n, min(i) AS lo, max(i) AS hi FROM numbered GROUP BY ALL)"""


def cuts(most: int | None = MOST) -> str:
    """cut(doc_id, piece, s, nxt): the sentences with which chunks begin, and the sentence after each chunk."""
    after = "".join(
        f" WHEN lead(cum, {k}) OVER p - before >= {LEAST} THEN s + {k + 1}" + (f" - CASE WHEN lead(cum, {k}) OVER p - before > {most} THEN 1 ELSE 0 END" if most and k else "") for k in range(LEAST)
    )
    return f"""run AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, piece ORDER BY s) AS cum, sum(n) OVER (PARTITION BY doc_id, piece ORDER BY s) - n AS before, max(s) OVER (PARTITION BY doc_id, piece) AS final FROM sent),
 nexts AS MATERIALIZED (SELECT doc_id, piece, s, CASE{after} ELSE final + 1 END AS nxt FROM run WINDOW p AS (PARTITION BY doc_id, piece ORDER BY s)),
 cut AS (SELECT * FROM nexts WHERE s = 0 UNION ALL SELECT n.* FROM cut c JOIN nexts n ON n.doc_id = c.doc_id AND n.piece = c.piece AND n.s = c.nxt)"""


CHUNK_COLUMNS = "CAST(hi - lo + 1 AS INT) AS word_count, CAST(lo - 1 AS INT) AS start_word, CAST(hi - 1 AS INT) AS end_word"
RANGES = "ranges AS (SELECT c.doc_id, c.piece, a.lo, b.hi FROM cut c JOIN sent a ON a.doc_id = c.doc_id AND a.piece = c.piece AND a.s = c.s JOIN sent b ON b.doc_id = c.doc_id AND b.piece = c.piece AND b.s = c.nxt - 1)"

X01 = f"WITH {ALL_WORDS}, {PLAIN_WORDS}, {sentences(False)} SELECT doc_id, CAST(s AS INT) AS nth, CAST(lo - 1 AS INT) AS start, CAST(n AS INT) AS words, array_to_string(ws[lo:hi], ' ') AS text FROM sent JOIN ws USING (doc_id)"

X21 = (
    f"WITH RECURSIVE {ALL_WORDS}, {PLAIN_WORDS}, {sentences(True)}, {cuts()}, {RANGES} "
    f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY lo) - 1 AS INT) AS chunk_index, 'text' AS type, array_to_string(ws[lo:hi], ' ') AS text, {CHUNK_COLUMNS} FROM ranges JOIN ws USING (doc_id)"
)


def x02(before: str) -> str:
    """``before``: the SQL of lines and headings, (lines, h, d).

    A heading is one chunk. ``step`` goes from chunk to chunk: its group, and the group's words and whether it is a heading.
    """
    return f"""WITH RECURSIVE {before}, {HEADED_WORDS}, {LISTED}, {sentences(False)}, {cuts()}, {RANGES},
 raw AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY lo) AS i, lo, hi, hi - lo + 1 AS n, h, lead(CASE WHEN NOT h THEN hi - lo + 1 END) OVER (PARTITION BY doc_id ORDER BY lo) AS after
   FROM (SELECT doc_id, lo, hi, false AS h FROM ranges WHERE piece % 2 = 0 UNION ALL SELECT doc_id, min(i), max(i), true FROM words WHERE piece % 2 = 1 GROUP BY doc_id, piece)),
 judged AS (SELECT r.doc_id, 1::BIGINT AS i, 0::BIGINT AS took, 0::BIGINT AS g, NULL::BIGINT AS gn FROM (SELECT DISTINCT doc_id FROM raw) r
  UNION ALL SELECT x.doc_id, x.i + CASE x.verdict WHEN 'next' THEN 2 ELSE 1 END, CASE x.verdict WHEN 'next' THEN 2 ELSE 1 END, CASE x.verdict WHEN 'before' THEN x.g ELSE x.g + 1 END,
    CASE WHEN x.h THEN NULL WHEN x.verdict = 'next' THEN x.n + x.after WHEN x.verdict = 'before' THEN x.gn + x.n ELSE x.n END
  FROM (SELECT j.doc_id, j.g, j.gn, r.i, r.n, r.h, r.after, CASE WHEN r.h OR r.n >= {SMALL} THEN 'own' WHEN r.n + r.after <= {MOST} + CASE WHEN r.n <= {TINY} THEN 5 ELSE 0 END THEN 'next'
     WHEN r.n + j.gn <= {MOST} + CASE WHEN r.n <= {TINY} THEN 5 ELSE 0 END THEN 'before' WHEN r.n <= {TINY} AND r.after IS NOT NULL THEN 'next' WHEN r.n <= {TINY} AND j.gn IS NOT NULL THEN 'before' ELSE 'own' END AS verdict
   FROM judged j JOIN raw r ON r.doc_id = j.doc_id AND r.i = j.i) x),
 groups AS (SELECT j.doc_id, j.g, min(a.lo) AS lo, max(b.hi) AS hi, bool_or(a.h) AS h FROM judged j JOIN raw a ON a.doc_id = j.doc_id AND a.i = j.i - j.took JOIN raw b ON b.doc_id = j.doc_id AND b.i = j.i - 1 WHERE j.took > 0 GROUP BY ALL)
SELECT doc_id, CAST(g - 1 AS INT) AS chunk_index, CASE WHEN h THEN 'header' ELSE 'text' END AS type, array_to_string(ws[lo:hi], ' ') AS text, {CHUNK_COLUMNS} FROM groups JOIN ws USING (doc_id)"""


X22 = rf"""WITH RECURSIVE parts AS (SELECT doc_id, unnest(range(len(p))) AS j, unnest(p) AS part FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?]+[.!?]') AS p FROM documents)),
 counted AS (SELECT doc_id, j, trim(part, E' \t\n\r\f\v') AS part, len(list_filter(regexp_split_to_array(part, '\s+'), lambda x: x <> '')) AS n FROM parts),
 sent AS (SELECT doc_id, 0 AS piece, row_number() OVER (PARTITION BY doc_id ORDER BY j) - 1 AS s, part, n FROM counted WHERE n > 0), {cuts(None)},
 listed AS (SELECT doc_id, list(part ORDER BY s) AS p FROM sent GROUP BY doc_id)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INT) AS nth, array_to_string(p[s + 1:nxt], ' ') AS text FROM cut JOIN listed USING (doc_id)"""
