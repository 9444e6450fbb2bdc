"""The queries of the operators for training data, and the SQL of those that SQL can express."""

from __future__ import annotations

from folio.llm import centroids, negatives
from folio.llm.centroids import op11_centroids
from folio.llm.fingerprints import op7_fingerprints
from folio.llm.maintext import op13_main_text
from folio.llm.mixing import op3_mixing
from folio.llm.neardup import op2_minhash
from folio.llm.negatives import op12_hard_negatives
from folio.llm.packing import op1_packing
from folio.llm.quality import op10_quality
from folio.llm.secrets import op5_secrets
from folio.llm.sharding import op4_sharding
from folio.llm.substrings import op6_suffix_dedup
from folio.llm.tokenfile import op8_token_file
from folio.llm.toxicity import op9_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_packing, op2_minhash, op3_mixing, op4_sharding, op5_secrets, op6_suffix_dedup, op7_fingerprints, op8_token_file, op9_toxicity, op10_quality, op11_centroids, op12_hard_negatives, op13_main_text,
    )
}
#: SQL has no tokenizers, networks, forests, parsers of markup or Spark's hashes; the other queries are tested against brute force.
ORACLES: dict[str, str] = {
    "op2_minhash": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id > b.doc_id GROUP BY ALL),
 links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
 pairs_ AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
 reach(id, other) AS (SELECT a, b FROM pairs_ UNION SELECT r.id, e.b FROM reach r JOIN pairs_ e ON r.other = e.a),
 c AS (SELECT id, min(other) AS least FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(c.least, d.doc_id)) AS component_id, d.doc_id <= coalesce(c.least, d.doc_id) AS kept FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.id = d.doc_id""",
    "op11_centroids": centroids.oracle_sql(),
    "op12_hard_negatives": negatives.ORACLE,
}
