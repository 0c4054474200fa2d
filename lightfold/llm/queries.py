"""The queries of this subpackage, by name. SQL is given where it can express one on whole tables."""

from __future__ import annotations

from .codes import op13_codes
from .embedding import op2_embedding
from .exact import op12_exact
from .html import op7_html
from .importance import op11_importance
from .packing import op1_packing
from .pieces import op6_pieces
from .pii import op9_pii
from .quality import op8_quality_rules
from .sharding import op5_sharding
from .simhash import op4_simhash
from .suffix import op10_suffix
from .toxicity import op3_toxicity

QUERIES = {
    "op1_packing": op1_packing,
    "op2_embedding": op2_embedding,
    "op3_toxicity": op3_toxicity,
    "op4_simhash": op4_simhash,
    "op5_sharding": op5_sharding,
    "op6_pieces": op6_pieces,
    "op7_html": op7_html,
    "op8_quality_rules": op8_quality_rules,
    "op9_pii": op9_pii,
    "op10_suffix": op10_suffix,
    "op11_importance": op11_importance,
    "op12_exact": op12_exact,
    "op13_codes": op13_codes,
}

#: Links by cosine over all pairs of vectors, components by recursion.
_EMBEDDING = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), l AS MATERIALIZED (SELECT a.vec_id AS i, b.vec_id AS j FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS i, vec_id AS j FROM v UNION SELECT r.i, l.j FROM r JOIN l ON r.j = l.i), n AS (SELECT i, count(*) AS c FROM l GROUP BY i), m AS (SELECT i, min(j) AS component_id FROM r GROUP BY i)
SELECT m.i AS vec_id, coalesce(c, 0) AS n_links, component_id, m.i = component_id AS kept FROM m LEFT JOIN n USING (i)"""

#: Owners of all 50-byte windows, removed runs as gaps and islands, kept bytes joined again.
_SUFFIX = """WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, md5(b[i + 1 : i + 50]) AS s FROM d, unnest(range(greatest(n - 49, 0))) u(i)),
o AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
f AS (SELECT doc_id, i FROM w JOIN o USING (s) WHERE least < doc_id),
g AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 1 ELSE 0 END AS cut FROM f),
h AS (SELECT doc_id, i, sum(cut) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM g),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM h GROUP BY doc_id, k),
keep AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS z FROM spans UNION ALL SELECT d.doc_id, coalesce(max(s.z), 0), any_value(n) FROM d LEFT JOIN spans s USING (doc_id) GROUP BY d.doc_id),
kept AS (SELECT doc_id, string_agg(hex(b[keep.a + 1 : keep.z]), '' ORDER BY keep.a) FILTER (keep.z > keep.a) AS h FROM keep JOIN d USING (doc_id) GROUP BY doc_id),
tot AS (SELECT doc_id, sum(z - a)::BIGINT AS r, count(*) AS c FROM spans GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(r, 0) AS n_removed, coalesce(c, 0) AS n_spans, sha256(unhex(coalesce(h, ''))) AS kept_sha256 FROM d JOIN kept USING (doc_id) LEFT JOIN tot USING (doc_id)"""

#: CRC-32 of each different word bit by bit, counts of its buckets, gains, weights and ranks.
_IMPORTANCE = r"""WITH RECURSIVE bits AS (SELECT i, 0 AS k, i::BIGINT AS v FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
a AS (SELECT w, count(*) AS n FROM (SELECT unnest(words) AS w FROM d) GROUP BY w),
b AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark) GROUP BY w),
names AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM a UNION SELECT w FROM b)),
hashed AS (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: ((strpos('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', x[2 * i + 2]) - 1)::BIGINT)), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS bucket FROM names, crc),
held AS (SELECT r.i AS bucket, coalesce(s, 0) AS s, coalesce(t, 0) AS t FROM range(10000) r(i) LEFT JOIN (SELECT bucket, sum(n) AS s FROM hashed JOIN a USING (w) GROUP BY bucket) x ON x.bucket = r.i LEFT JOIN (SELECT bucket, sum(n) AS t FROM hashed JOIN b USING (w) GROUP BY bucket) y ON y.bucket = r.i),
gain AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS g FROM held),
per AS (SELECT w, g FROM hashed JOIN gain USING (bucket)),
f AS (SELECT doc_id, count(*) AS n, sum(g)::BIGINT AS weight FROM (SELECT doc_id, unnest(words) AS w FROM d) JOIN per USING (w) GROUP BY doc_id),
s AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN f USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS k, count(*) OVER () AS n FROM s WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN k <= 10 * n // 100 THEN k END AS rank FROM s LEFT JOIN r USING (doc_id)"""

#: Equal texts are those with one normalised text.
_EXACT = r"""WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
w AS (SELECT doc_id, t, first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM w"""

#: Two rounds of assigning and averaging as joins of parts and entries.
_CODES = """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, p.i AS p, q[p.i * w + 1 : p.i * w + w] AS x FROM (SELECT *, len(q) // 16 AS w FROM v), range(16) p(i)),
b0 AS MATERIALIZED (SELECT p, e, x AS c FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v) JOIN parts USING (vec_id) WHERE e < 64),
a0 AS MATERIALIZED (SELECT vec_id, p, any_value(x) AS x, arg_min(e, (d, e)) AS e FROM (SELECT vec_id, p, x, e, list_sum(list_transform(range(len(x)), lambda i: (x[i + 1] - c[i + 1]) ** 2))::BIGINT AS d FROM parts JOIN b0 USING (p)) GROUP BY vec_id, p),
m0 AS (SELECT p, e, i.i AS i, floor(sum(x[i.i + 1])::DOUBLE / count(*))::BIGINT AS m FROM a0, LATERAL (SELECT unnest(range(len(x))) AS i) i GROUP BY ALL),
b1 AS MATERIALIZED (SELECT b0.p, b0.e, coalesce(n.c, b0.c) AS c FROM b0 LEFT JOIN (SELECT p, e, list(m ORDER BY i) AS c FROM m0 GROUP BY p, e) n USING (p, e)),
a1 AS MATERIALIZED (SELECT vec_id, p, any_value(x) AS x, arg_min(e, (d, e)) AS e FROM (SELECT vec_id, p, x, e, list_sum(list_transform(range(len(x)), lambda i: (x[i + 1] - c[i + 1]) ** 2))::BIGINT AS d FROM parts JOIN b1 USING (p)) GROUP BY vec_id, p),
m1 AS (SELECT p, e, i.i AS i, floor(sum(x[i.i + 1])::DOUBLE / count(*))::BIGINT AS m FROM a1, LATERAL (SELECT unnest(range(len(x))) AS i) i GROUP BY ALL),
b2 AS MATERIALIZED (SELECT b1.p, b1.e, coalesce(n.c, b1.c) AS c FROM b1 LEFT JOIN (SELECT p, e, list(m ORDER BY i) AS c FROM m1 GROUP BY p, e) n USING (p, e)),
a2 AS (SELECT vec_id, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT vec_id, p, e, list_sum(list_transform(range(len(x)), lambda i: (x[i + 1] - c[i + 1]) ** 2))::BIGINT AS d FROM parts JOIN b2 USING (p)) GROUP BY vec_id, p),
r AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b2) AS codebooks_sha256 FROM r JOIN v USING (vec_id)"""

ORACLES: dict[str, str] = {"op2_embedding": _EMBEDDING, "op10_suffix": _SUFFIX, "op11_importance": _IMPORTANCE, "op12_exact": _EXACT, "op13_codes": _CODES}
