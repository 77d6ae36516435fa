"""DuckDB SQL of the queries that SQL can express, straight from their definitions."""

from __future__ import annotations

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_WORDS = rf"regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

REPEATED_BYTES = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT doc_id, i, substr(h, 2 * i - 1, 100) AS k FROM (SELECT doc_id, h, unnest(range(1, len(h) // 2 - 48)) AS i FROM d)),
f AS (SELECT k, min(doc_id) AS least FROM g GROUP BY k HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM g JOIN f USING (k) WHERE least < doc_id),
n AS (SELECT doc_id, count(*) AS removed, count(*) FILTER (WHERE before IS DISTINCT FROM p - 1) AS spans
  FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM gone) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * p - 1, 2), '' ORDER BY p) AS h FROM (SELECT doc_id, h, unnest(range(1, len(h) // 2 + 1)) AS p FROM d JOIN n USING (doc_id)) a
  ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, (len(d.h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN removed IS NULL THEN d.h ELSE coalesce(kept.h, '') END)) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)"""

REPEATED_WORDS = f"""
WITH d AS (SELECT doc_id, {_SPACED.format("coalesce(text, '')")} AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d)),
f AS (SELECT k, min(doc_id) AS least FROM g GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN f USING (k) WHERE least < doc_id),
n AS (SELECT doc_id, count(*) AS removed FROM gone GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS t FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM d) a ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPACED.format(f"coalesce({_LOWER}, '')")} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE 100 * c >= 80 * (p.n + q.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, m.c = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY a) m USING (doc_id)"""

CONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
i AS (SELECT item_id, {_WORDS} AS ws, least(len({_WORDS}), 13) AS size FROM benchmark),
iw AS (SELECT DISTINCT item_id, size, array_to_string(ws[p:p + size - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(ws) - size + 2)) AS p FROM i WHERE size > 0)),
z AS (SELECT DISTINCT size FROM iw),
dw AS (SELECT doc_id, size, p, array_to_string(ws[p:p + size - 1], ' ') AS k FROM (SELECT doc_id, ws, size, unnest(range(1, greatest(len(ws) - size + 2, 1))) AS p FROM d, z)),
o AS (SELECT doc_id, p, dw.size, item_id FROM dw JOIN iw ON dw.size = iw.size AND dw.k = iw.k),
h AS (SELECT doc_id, count(DISTINCT w) AS n FROM (SELECT doc_id, unnest(range(p, p + size)) AS w FROM o) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM o) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""

QUALITY = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 2], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
f AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM f) GROUP BY doc_id),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines, length(t) - length(regexp_replace(t, '\\p{L}+', '', 'g')) AS n_letters,
  length(t) - length(regexp_replace(t, '[A-Z]+', '', 'g')) AS n_capitals FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (word_chars < 3 * n_words)::BIGINT + 8 * (word_chars > 10 * n_words)::BIGINT
  + 16 * (10 * n_symbols > n_words)::BIGINT + 32 * (10 * n_dup_lines > 3 * n_lines)::BIGINT + 64 * (10 * n_letters < 7 * word_chars)::BIGINT
  + 128 * (2 * n_capitals > word_chars)::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed = 0 AS kept, failed FROM b"""

#: Bytes of the id's digits through the crc32 register, a bit at a time.
_CRC = ("xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)), "
        "lambda r, c: list_reduce([xor(r, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))")
_PART = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_PART.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"

MERKLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, {_LEAF.format("text")} AS leaf, {_LEAF.format("replace(text, chr(10), '')")} AS cut, {_CRC} AS crc FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
t AS (SELECT source, 0 AS lvl, i, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM p
  UNION ALL SELECT source, any_value(lvl) + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 2) // 3) FROM t WHERE n > 1 GROUP BY source, i // 3),
s AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, lvl AS height FROM t WHERE n = 1),
u AS (SELECT 0 AS lvl, i, subroot AS h, count(*) OVER () AS n FROM s
  UNION ALL SELECT any_value(lvl) + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 2) // 3) FROM u WHERE n > 1 GROUP BY i // 3),
e AS (SELECT source, lvl, i // 3 AS run, i % 3 AS slot, h FROM t WHERE n > 1
  UNION ALL SELECT s.source, height + u.lvl, u.i // 3, u.i % 3, u.h FROM s JOIN u ON u.n > 1 AND u.i // 3 = s.i // (3 ** (u.lvl + 1))::BIGINT),
own AS (SELECT p.doc_id, p.source, p.i, s.i AS place, height, lvl FROM p JOIN s ON p.source IS NOT DISTINCT FROM s.source, LATERAL (SELECT unnest(range((SELECT height + max(lvl) FROM u))) AS lvl)),
way AS (SELECT doc_id, source, lvl, CASE WHEN lvl < height THEN i // (3 ** lvl)::BIGINT ELSE place // (3 ** (lvl - height))::BIGINT END AS node FROM own),
x AS (SELECT doc_id, way.lvl, node % 3 AS own, slot, h FROM way JOIN e ON way.source IS NOT DISTINCT FROM e.source AND way.lvl = e.lvl AND way.node // 3 = e.run),
proof AS (SELECT doc_id, string_agg(h, '' ORDER BY lvl, slot) FILTER (slot <> own) AS sibs FROM x GROUP BY doc_id),
sides AS (SELECT doc_id, lvl, coalesce(string_agg(h, '' ORDER BY slot) FILTER (slot < own), '') AS l, coalesce(string_agg(h, '' ORDER BY slot) FILTER (slot > own), '') AS r
  FROM x GROUP BY doc_id, lvl),
f AS (SELECT doc_id, 0 AS lvl, CASE WHEN crc % 2 = 0 THEN cut ELSE leaf END AS h FROM d
  UNION ALL SELECT f.doc_id, f.lvl + 1, sha256(l || h || r) FROM f JOIN sides USING (doc_id, lvl))
SELECT p.doc_id, leaf, subroot, (SELECT h FROM u WHERE n = 1) AS root, sha256(coalesce(sibs, '')) AS proof_sha256, z.h AS folded_root, z.h = (SELECT h FROM u WHERE n = 1) AS verified
FROM p JOIN s ON p.source IS NOT DISTINCT FROM s.source LEFT JOIN proof USING (doc_id) JOIN (SELECT doc_id, max_by(h, lvl) AS h FROM f GROUP BY doc_id) z USING (doc_id)"""
