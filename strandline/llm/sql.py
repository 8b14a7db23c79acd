"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .licenses import BREAKS, CONTAINED, DROPPED, SHINGLE, TEMPLATES, WINDOW
from .mixing import DRAWS


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _plain(text: str) -> str:
    """Words of a text as licenses are compared."""
    return f"list_filter(string_split(replace(translate(lower(coalesce({text}, '')), {_text(BREAKS)}, {_text(' ' * len(BREAKS))}), {_text(DROPPED)}, ''), ' '), lambda w: w <> '')"


def _shingles(words: str) -> str:
    return f"list_transform(range(1, greatest(len({words}) - {SHINGLE - 2}, 1)), lambda i: array_to_string({words}[i:i + {SHINGLE - 1}], ' '))"

WORDS = r"[^\x20\x09-\x0D]+"

OP1 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""

OP3 = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORDS}')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), r AS (
  SELECT source, source_size, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source COLLATE C ASC NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM s
), l AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM r) - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER o AS k
  FROM r WINDOW o AS (ORDER BY cap / w, source ASC NULLS LAST)
), t AS (
  SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, k) FROM l WHERE level * w <= cap) * w, cap)) AS target FROM l
), m AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, floor(rate) + CASE WHEN ('0x' || substring(md5('mix-1-' || (k // 4) || ':' || coalesce(doc_id::VARCHAR, 'null')), (k % 4 * 8 + 1)::BIGINT, 8))::BIGINT
                                    / 4294967296.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END AS copies
  FROM m, range({DRAWS}) r(k)
), b AS (
  SELECT source, arg_min(k, [miss, k]) AS k FROM (SELECT source, k, abs(sum(size * copies) - any_value(target)) AS miss FROM c GROUP BY source, k) GROUP BY source
)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken FROM c JOIN b ON c.source IS NOT DISTINCT FROM b.source AND c.k = b.k
"""

OP7 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN octet_length(encode(h)) >= 1000 AND page_id <> max(page_id) OVER w THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN octet_length(encode(h)) >= 1000 AND page_id <> max(page_id) OVER w THEN max(page_id) OVER w END AS refers_to
FROM p WINDOW w AS (PARTITION BY h)
"""


OP6 = f"""
WITH d AS (SELECT doc_id, {_plain("text")} AS ws FROM documents),
n AS (SELECT license, {_plain("words")} AS ws FROM (VALUES {", ".join(f"({_text(k)}, {_text(v)})" for k, v in TEMPLATES.items())}) v(license, words)),
t AS (SELECT DISTINCT license, unnest({_shingles("ws")}) AS s FROM n),
z AS (SELECT license, count(*) AS size FROM t GROUP BY license),
p AS (SELECT doc_id, unnest({_shingles("ws")}) AS s, unnest(range(greatest(len(ws) - {SHINGLE - 1}, 0))) AS pos FROM d),
m AS (SELECT doc_id, license, size, s, pos FROM p JOIN t USING (s) JOIN z USING (license)),
w AS (SELECT doc_id, license, size, (pos // size - back) * size AS place, s FROM m, range({WINDOW}) r(back) WHERE pos // size >= back),
c AS (SELECT doc_id, license, place, count(DISTINCT s) / any_value(size)::DOUBLE AS share FROM w GROUP BY doc_id, license, place)
SELECT doc_id, license, max(share) AS containment, arg_min(place, [-share, place])::BIGINT AS first_shingle FROM c WHERE share >= {CONTAINED} GROUP BY doc_id, license
"""

OP9 = """
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
p AS (SELECT doc_id, unnest(range(len(ls) - 1)) AS place, unnest(list_transform(range(1, len(ls)), lambda i: ls[i] || chr(10) || ls[i + 1])) AS k FROM l),
f AS (SELECT k, min([doc_id, place]) AS first FROM p GROUP BY k HAVING count(*) > 1),
g AS (SELECT DISTINCT doc_id, place + r.ahead AS i FROM p JOIN f USING (k), range(2) r(ahead) WHERE NOT (doc_id = first[1] AND place < first[2] + 2)),
o AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE before IS NULL OR before < i - 1) AS runs
      FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM g) GROUP BY doc_id),
e AS (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM l),
c AS (SELECT e.doc_id, string_agg(line, chr(10) ORDER BY e.i) FILTER (WHERE g.i IS NULL) AS clean FROM e LEFT JOIN g ON g.doc_id = e.doc_id AND g.i = e.i GROUP BY e.doc_id)
SELECT l.doc_id, len(ls)::BIGINT AS n_lines, coalesce(n, 0)::BIGINT AS n_removed_lines, coalesce(runs, 0)::BIGINT AS n_removed_chunks, sha256(coalesce(clean, '')) AS clean_sha256
FROM l JOIN c USING (doc_id) LEFT JOIN o USING (doc_id)
"""


#: Runs of ASCII letters and digits and of anything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

OP11 = f"""
WITH t AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS ws FROM documents),
z AS (SELECT count(*) AS n, sum(len(ws))::BIGINT AS l FROM t WHERE len(ws) > 0),
q AS (SELECT item_id, list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS ws FROM benchmark),
a AS (SELECT item_id, unnest(ws) AS w FROM q),
p AS (SELECT row, doc_id, w, count(*) AS tf, any_value(m) AS m FROM (SELECT row, doc_id, unnest(ws) AS w, 10 + 90 * len(ws) * z.n // z.l AS m FROM t, z WHERE len(ws) > 0) WHERE w IN (SELECT w FROM a) GROUP BY row, doc_id, w),
f AS (SELECT w, floor(1000 * ln((2 * any_value(z.n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p, z GROUP BY w),
s AS (SELECT item_id, row, doc_id, sum(weight * (1000000000 * tf // (1000 * tf + 8 * m)))::BIGINT AS score FROM a JOIN p USING (w) JOIN f USING (w) GROUP BY item_id, row, doc_id)
SELECT item_id, row_number() OVER o::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) QUALIFY rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1, "op3_mixing": OP3, "op6_licenses": OP6, "op7_warc": OP7, "op9_line_dedup": OP9, "op11_lexical_search": OP11}
