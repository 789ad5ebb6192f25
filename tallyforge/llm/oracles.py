"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _low(text: str) -> str:
    return f"translate({text}, '{_UPPER}', '{_LOWER}')"


#: Turns in order: digests by concatenation; formatted length from the template and its escapes.
_OP2 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(role) + length(text) + len(regexp_extract_all(text,
    '<\\*\|im_start\|>|<\\*\|im_end\|>|<\\*\|endoftext\|>|<\\*s>|<\\*/s>|\[\\*INST\]|\[\\*/INST\]|<\\*<SYS>>|<\\*</SYS>>')) + 24 AS chars FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

#: Shared shingles of every pair by an inverted join; components by reachability.
_OP4 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_low("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN [w[1]] WHEN len(w) = 0 THEN [] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS k FROM d
), n AS (
  SELECT doc_id, count(*) AS n_shingles FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n_shingles + y.n_shingles - shared)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT doc_id AS node, doc_id AS reach FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach
)
SELECT d.doc_id, coalesce(n_shingles, 0) AS n_shingles, min(reach) AS component_id, d.doc_id = min(reach) AS kept
FROM d JOIN r ON node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n_shingles
"""

#: Lines: split, key by stripping and lower-casing A-Z, count documents, drop frequent keys.
_OP6 = rf"""
WITH l AS (
  SELECT doc_id, generate_subscripts(p, 1) AS k, unnest(p) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)
), keyed AS (
  SELECT doc_id, k, line, {_low("regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')")} AS key FROM l
), hot AS (
  SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT doc_id, k, line, key IN (SELECT key FROM hot) AS drop_it FROM keyed
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE drop_it) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT drop_it), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

#: Windows of both sides as texts, joined by length and text; hit words by position.
_OP7 = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_low("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({_low("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), g AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) AS gram FROM b WHERE len(w) > 0
), lengths AS (
  SELECT DISTINCT m FROM g
), p AS (
  SELECT doc_id, m, unnest(range(1, len(w) - m + 2)) AS i, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS gram FROM d, lengths WHERE len(w) >= m
), h AS (
  SELECT doc_id, p.m, i, item_id FROM p JOIN g ON p.m = g.m AND p.gram = g.gram
), words AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS pos FROM h) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids FROM h GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

#: Scores of all documents that share a term with an item, by an inverted join.
_OP12 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_low("text")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL
), s AS (
  SELECT count(*) AS docs, sum(len(w)) AS terms FROM d WHERE len(w) > 0
), q AS (
  SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all({_low("text")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE text IS NOT NULL) GROUP BY ALL
), p AS (
  SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, len(w) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, s GROUP BY term, docs
), scores AS (
  SELECT item_id, row, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // CAST(terms AS BIGINT))))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN weights USING (term), s GROUP BY item_id, row, doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""

#: Levels by recursion over runs of three, sources first and then their roots; crc32 bit by bit; folding up each proof.
_OP13 = r"""
WITH RECURSIVE fields AS (
  SELECT doc_id, coalesce('=' || source, '') AS grp, text, concat(
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
    coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS head,
    xor(CAST(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
      lambda a, b: CASE WHEN xor(a, b) % 2 = 1 THEN xor(xor(a, b) // 2, 3988292384) ELSE xor(a, b) // 2 END) AS BIGINT), 4294967295) AS crc
  FROM documents
), leaf AS (
  SELECT doc_id, grp, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN crc % 2 = 0 THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) END AS offered
  FROM fields
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaf
), tree AS (
  SELECT grp, 0 AS level, pos, leaf AS digest, count(*) OVER (PARTITION BY grp) AS n FROM placed
  UNION ALL
  SELECT grp, level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (max(n) + 2) // 3 FROM tree WHERE n > 1 GROUP BY grp, level, pos // 3
), subroots AS (
  SELECT grp, level AS depth, digest AS subroot, row_number() OVER (ORDER BY grp) - 1 AS place, count(*) OVER () AS m FROM tree WHERE n = 1
), top AS (
  SELECT 0 AS level, place AS pos, subroot AS digest, m AS n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (max(n) + 2) // 3 FROM top WHERE n > 1 GROUP BY level, pos // 3
), siblings AS (
  SELECT p.grp, p.pos AS leaf_pos, t.level AS step, coalesce(string_agg(s.digest, '' ORDER BY s.pos) FILTER (WHERE s.pos < t.pos), '') AS l, coalesce(string_agg(s.digest, '' ORDER BY s.pos) FILTER (WHERE s.pos > t.pos), '') AS r
  FROM placed p JOIN tree t ON t.grp = p.grp AND t.n > 1 AND t.pos = p.pos // CAST(3 ** t.level AS BIGINT) JOIN tree s ON s.grp = t.grp AND s.level = t.level AND s.pos // 3 = t.pos // 3 GROUP BY ALL
  UNION ALL
  SELECT p.grp, p.pos, u.depth + t.level, coalesce(string_agg(s.digest, '' ORDER BY s.pos) FILTER (WHERE s.pos < t.pos), ''), coalesce(string_agg(s.digest, '' ORDER BY s.pos) FILTER (WHERE s.pos > t.pos), '')
  FROM placed p JOIN subroots u ON u.grp = p.grp JOIN top t ON t.n > 1 AND t.pos = u.place // CAST(3 ** t.level AS BIGINT) JOIN top s ON s.level = t.level AND s.pos // 3 = t.pos // 3 GROUP BY p.grp, p.pos, u.depth, t.level
), folded AS (
  SELECT grp, pos, 0 AS step, coalesce(offered, leaf) AS digest FROM placed
  UNION ALL
  SELECT f.grp, f.pos, f.step + 1, sha256(s.l || f.digest || s.r) FROM folded f JOIN siblings s ON s.grp = f.grp AND s.leaf_pos = f.pos AND s.step = f.step
), last AS (
  SELECT grp, pos, max_by(digest, step) AS folded_root FROM folded GROUP BY grp, pos
), proofs AS (
  SELECT grp, leaf_pos, sha256(string_agg(l || r, '' ORDER BY step)) AS proof_sha256 FROM siblings GROUP BY grp, leaf_pos
)
SELECT p.doc_id, p.leaf, u.subroot, t.digest AS root, coalesce(q.proof_sha256, sha256('')) AS proof_sha256, f.folded_root, f.folded_root = t.digest AS verified
FROM placed p JOIN subroots u ON u.grp = p.grp JOIN top t ON t.n = 1 JOIN last f ON f.grp = p.grp AND f.pos = p.pos LEFT JOIN proofs q ON q.grp = p.grp AND q.leaf_pos = p.pos
"""

ORACLES: dict[str, str] = {"op2_chat_format": _OP2, "op4_near_dedup": _OP4, "op6_line_dedup": _OP6, "op7_decontamination": _OP7, "op12_ranked_search": _OP12, "op13_merkle_manifest": _OP13}
