"""DuckDB SQL for the queries of this subpackage that SQL can express."""

# The key of a line is stripped of blanks and lower-cased; only its last document keeps a shared line.
OP2 = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), shared AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT k.*, s.last IS NOT NULL AND k.doc_id <> s.last AS dropped FROM k LEFT JOIN shared s USING (key)
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN dropped THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

# Snapshots are compared as whole texts: a conversation is left out if a longer one begins with it.
OP10 = """
WITH c AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn) AS text
  FROM conversations GROUP BY conv_id
), p AS (
  SELECT conv_id, turn,
         string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '')
           OVER (PARTITION BY conv_id ORDER BY turn) AS prefix,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations
)
SELECT min(conv_id) AS conv_id, CAST(0 AS BIGINT) AS part, n_turns, count(*) AS copies, text
FROM c
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.place < p.n AND p.place = c.n_turns AND p.prefix = c.text)
GROUP BY n_turns, text
"""

# Every phrase of up to five words is counted; parts of a cut are looked up among all of them.
OP11 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, [x for x in regexp_split_to_array(piece, '[ \t]+') if x <> ''] AS ws FROM pieces
), totals AS (
  SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang
), starts AS (
  SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w
), spans AS (
  SELECT lang, ws, i, unnest(range(1, least(5, len(ws) - i + 1) + 1)) AS k FROM starts
), f AS (
  SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase, count(*) AS f FROM spans GROUP BY ALL HAVING count(*) >= 100
), c AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1
), inner_ AS (
  SELECT lang, array_to_string(ws[i : i + s - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, k, ws, a, s, unnest(range(1, k - s + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS s FROM c))
  GROUP BY ALL
), cuts AS (
  SELECT c.lang, c.phrase, c.a, t.n, x.cut, l.f AS l, r.f AS r,
         CAST(1000 * CAST(c.a AS HUGEINT) * t.n // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) x
  JOIN c ON c.lang = x.lang AND c.phrase = x.phrase
  JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(x.ws[1 : x.cut], ' ')
  JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(x.ws[x.cut + 1 : x.k], ' ')
  JOIN totals t ON t.lang = x.lang
), scored AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank, s.phrase, a, l, r, n, score
FROM scored s LEFT JOIN inner_ i ON i.lang = s.lang AND i.phrase = s.phrase
WHERE i.longer IS NULL OR i.longer < a
QUALIFY rank <= 2000
"""


def _whole_vectors(scale: int, columns: str) -> str:
    return f"""
v AS (
  SELECT vec_id, {columns} [floor({scale} * CAST(x AS DOUBLE)) for x in embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
)"""


OP12 = f"""
WITH {_whole_vectors(1024, "")}, pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM pairs QUALIFY rank <= 10
"""

OP13 = f"""
WITH {_whole_vectors(256, "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,")}, pairs AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
  WHERE a.label IS NOT NULL AND c.label IS NOT NULL
), positives AS (
  SELECT * FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.other_id AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id) AS INTEGER) AS rank,
       n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same AND 100 * n.score BETWEEN 30 * p.score AND 90 * p.score
QUALIFY rank <= 10
"""

ORACLES = {"op2_line_dedup": OP2, "op10_chat": OP10, "op11_collocations": OP11, "op12_top_k": OP12, "op13_hard_negatives": OP13}
