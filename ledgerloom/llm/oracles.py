"""DuckDB SQL for the operators that SQL can express over whole tables."""

from __future__ import annotations

from ledgerloom.llm import phrases, spelling, url_filter

#: Cosines of all pairs of a label in double precision, and components by closure of the links.
EMBEDDINGS = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
good AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND NOT list_contains(list_transform(e, lambda x: x IS NULL OR isnan(x) OR isinf(x)), true)
  AND list_contains(list_transform(e, lambda x: x <> 0), true)),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
part AS (SELECT a AS vec_id, min(b) AS least FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a)
SELECT v.vec_id, coalesce(n_links, 0) AS n_links, least(v.vec_id, coalesce(part.least, v.vec_id)) AS component_id, v.vec_id = least(v.vec_id, coalesce(part.least, v.vec_id)) AS kept
FROM v LEFT JOIN n USING (vec_id) LEFT JOIN part USING (vec_id)"""

#: Every 100-byte string by its place; the removed starts are merged where they are at most 100 bytes apart.
REPEATS = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, i, md5(h[2 * i + 1:2 * i + 200]) AS k FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS i FROM b WHERE len(h) >= 200)),
r AS (SELECT doc_id, i FROM s QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
g AS (SELECT doc_id, i, lag(i) OVER w AS before, lead(i) OVER w AS after FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT doc_id, sum(least(100, coalesce(after - i, 100))) AS n_removed, count(*) FILTER (before IS NULL OR i - before > 100) AS n_spans FROM g GROUP BY doc_id),
e AS (SELECT doc_id, i AS begin, NULL AS finish FROM g WHERE before IS NULL OR i - before > 100 UNION ALL SELECT doc_id, NULL, i + 100 FROM g WHERE after IS NULL OR after - i > 100),
p AS (SELECT doc_id, coalesce(finish, 0) AS lo, lead(coalesce(begin, finish)) OVER (PARTITION BY doc_id ORDER BY coalesce(begin, finish), begin NULLS FIRST) AS hi, begin FROM (SELECT * FROM e UNION ALL SELECT DISTINCT doc_id, NULL, 0 FROM e)),
kept AS (SELECT p.doc_id, string_agg(h[2 * lo + 1:2 * coalesce(hi, len(h) // 2)], '' ORDER BY lo) AS h FROM p JOIN b ON b.doc_id = p.doc_id WHERE begin IS NULL GROUP BY p.doc_id)
SELECT b.doc_id, len(b.h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.h, b.h))) AS kept_sha256
FROM b LEFT JOIN n USING (doc_id) LEFT JOIN kept ON kept.doc_id = b.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_near_dedup": EMBEDDINGS, "op3_suffix_array_dedup": REPEATS, "op8_url_filter": url_filter.oracle(), "op11_spelling_variants": spelling.oracle(), "op12_phrase_collocations": phrases.oracle()}
