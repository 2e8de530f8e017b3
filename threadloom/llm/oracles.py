"""DuckDB SQL for the operators of this subpackage that SQL can express."""

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{n_chars}", "text")) + ")"

#: CRC-32 by its table, trees and proofs by recursion over levels.
MERKLE = f"""
WITH RECURSIVE
bits AS (
  SELECT i, 0 AS k, i::BIGINT AS c FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) FROM bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
crc AS (
  SELECT DISTINCT doc_id AS id, doc_id::VARCHAR AS s, 0 AS k, 4294967295::BIGINT AS c FROM documents WHERE doc_id IS NOT NULL
  UNION ALL SELECT id, s, k + 1, xor(c >> 8, t[xor(c & 255, ascii(s[k + 1])) + 1]) FROM crc, crc_table WHERE k < length(s)),
marks AS (SELECT id, xor(c, 4294967295) % 7 = 0 AS marked FROM crc WHERE k = length(s)),
leaves AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, '') AS tree,
    {_LEAF.format(n_chars="n_chars")} AS leaf,
    CASE WHEN marked THEN {_LEAF.format(n_chars="(n_chars + 1)")} ELSE {_LEAF.format(n_chars="n_chars")} END AS own
  FROM documents d LEFT JOIN marks ON marks.id = d.doc_id),
places AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
nodes AS (
  SELECT tree, 0 AS lvl, pos, leaf AS h, n FROM places
  UNION ALL SELECT tree, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM nodes WHERE n > 1 GROUP BY tree, lvl, pos // 2, n),
subroots AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper AS (
  SELECT 0 AS lvl, pos, subroot AS h, n FROM subroots
  UNION ALL SELECT lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM upper WHERE n > 1 GROUP BY lvl, pos // 2, n),
walk AS (
  SELECT rid, tree, 0 AS lvl, pos, n, own AS h, '' AS proof FROM places
  UNION ALL SELECT w.rid, w.tree, w.lvl + 1, w.pos // 2, (w.n + 1) // 2,
    sha256(CASE WHEN s.h IS NULL THEN w.h WHEN w.pos % 2 = 1 THEN s.h || w.h ELSE w.h || s.h END), w.proof || coalesce(s.h, '')
  FROM walk w LEFT JOIN nodes s ON s.tree = w.tree AND s.lvl = w.lvl AND s.pos = xor(w.pos, 1) WHERE w.n > 1),
climb AS (
  SELECT rid, 0 AS lvl, s.pos, s.n, w.h, proof FROM walk w JOIN subroots s USING (tree) WHERE w.n = 1
  UNION ALL SELECT w.rid, w.lvl + 1, w.pos // 2, (w.n + 1) // 2,
    sha256(CASE WHEN s.h IS NULL THEN w.h WHEN w.pos % 2 = 1 THEN s.h || w.h ELSE w.h || s.h END), w.proof || coalesce(s.h, '')
  FROM climb w LEFT JOIN upper s ON s.lvl = w.lvl AND s.pos = xor(w.pos, 1) WHERE w.n > 1)
SELECT doc_id, leaf, subroot, u.h AS root, sha256(c.proof) AS proof_sha256, c.h AS folded_root, c.h = u.h AS verified
FROM leaves JOIN subroots USING (tree) JOIN climb c USING (rid) JOIN upper u ON u.n = 1 WHERE c.n = 1
"""

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

LEXICAL = f"""
WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
totals AS (SELECT count(*) AS docs, sum(len(terms)) AS words FROM texts WHERE len(terms) > 0),
tfs AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(terms) AS term FROM texts) GROUP BY rid, term),
asked AS (SELECT row_number() OVER () AS qid, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark)),
query_terms AS (SELECT DISTINCT qid, unnest({_TERMS}) AS term FROM asked WHERE text IS NOT NULL),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tfs GROUP BY term), totals),
lengths AS (SELECT rid, doc_id, 50 + (50 * len(terms) * docs) // words AS m FROM texts, totals),
scored AS (
  SELECT qid, rid, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM query_terms JOIN tfs USING (term) JOIN weights USING (term) JOIN lengths USING (rid) GROUP BY qid, rid)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank, doc_id, score
  FROM scored JOIN asked USING (qid) JOIN lengths USING (rid) WHERE score > 0)
WHERE rank <= 50
"""
