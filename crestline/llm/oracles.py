"""DuckDB SQL for the corpus queries that SQL can express: plain, quadratic where need be, for small tables."""

from __future__ import annotations

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_TOKENS = "regexp_extract_all(" + _LOWER + r", '[^\x20\x09-\x0D]+')"

_END = "chr(13) || chr(10)"
_RECORD = f"""'WARC/1.0' || {_END} || 'WARC-Type: {{0}}' || {_END} || 'WARC-Target-URI: ' || u || {_END} || 'WARC-Record-ID: <' || id{{1}} || '>' || {_END}
  || 'Content-Type: text/html' || {_END} || 'Content-Length: ' || strlen(b) || {_END} || {_END} || b || {_END} || {_END}"""

WARC_FIXITY = f"""WITH p AS (SELECT page_id, coalesce(url, '') AS u, coalesce(html, '') AS b, coalesce(left(md5(page_id::VARCHAR), 2), '') AS m,
  'urn:sha1:' || sha1(coalesce(page_id::VARCHAR, '') || coalesce(url, '') || coalesce(html, '')) AS id FROM pages),
r AS (SELECT page_id, m, id, {_RECORD.format("resource", "")} AS rec, {_RECORD.format("revisit", " || ':revisit'")} AS rev FROM p),
o AS (SELECT *, row_number() OVER (ORDER BY page_id NULLS FIRST, sha256(rec)) - 1 AS k FROM r),
c AS (SELECT *, CASE WHEN m = '0d' THEN rec || '~' WHEN m LIKE '0%' AND m <> '0e' THEN left(rec, length(rec) - 1) || '~' ELSE rec END AS alt FROM o WHERE m <> '0f'),
w AS (SELECT 1 AS side, k // 1024 AS archive, 2 * k AS place, page_id, id, rec FROM o
  UNION ALL SELECT 2, k // 1024, 2 * k, page_id, id, alt FROM c UNION ALL SELECT 2, k // 1024, 2 * k + 1, page_id, id || ':revisit', rev FROM c WHERE m = '0e'),
l AS (SELECT side, archive, page_id, id, sha256(rec) AS hash, strlen(rec) AS length, coalesce(sum(strlen(rec)) OVER (PARTITION BY side, archive ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off,
  row_number() OVER (PARTITION BY side, archive, id ORDER BY place) AS nth FROM w),
x AS (SELECT * FROM l WHERE side = 1), y AS (SELECT * FROM l WHERE side = 2)
SELECT CASE WHEN x.id IS NULL THEN y.page_id ELSE x.page_id END AS page_id, archive, coalesce(x.off, y.off) AS "offset", coalesce(x.length, y.length) AS length,
  CASE WHEN y.hash IS NULL THEN 'missing' WHEN x.hash IS NULL THEN 'extra' ELSE 'changed' END AS status, x.hash AS hash_one, y.hash AS hash_other
FROM x FULL JOIN y USING (archive, id, nth) WHERE x.hash IS DISTINCT FROM y.hash"""

DECONTAMINATION = f"""WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS k FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT doc_id, k, n, item FROM dw JOIN bw USING (n, win)),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS pos FROM h) GROUP BY 1),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN p USING (doc_id) LEFT JOIN i USING (doc_id)"""

NEAR_DEDUP = f"""WITH RECURSIVE d AS (SELECT doc_id, {_TOKENS.format("coalesce(text, '')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM d WHERE len(w) > 0)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id JOIN c p ON p.doc_id = a.doc_id JOIN c q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))),
r AS (SELECT doc_id, doc_id AS o FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.o),
m AS (SELECT doc_id, min(o) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN c ON c.doc_id = d.doc_id JOIN m ON m.doc_id = d.doc_id"""

_NEAREST = """a{0} AS MATERIALIZED (SELECT vec_id, e, min({{'d': list_sum(list_transform(list_zip(v.e, c.m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 'c': c.c}}) AS z FROM v, c{0} c GROUP BY vec_id, e)"""
_MOVED = """s{0} AS (SELECT z.c AS c, i, sum(e[i])::HUGEINT AS s, count(*) AS n FROM a{0}, range(1, 65) r(i) GROUP BY ALL),
c{1} AS MATERIALIZED (SELECT c.c, coalesce(x.m, c.m) AS m FROM c{0} c LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS m FROM s{0} GROUP BY c) x ON x.c = c.c)"""

CENTROIDS = f"""WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, e AS m FROM (SELECT sha256('2:' || vec_id) AS h, e FROM v ORDER BY h LIMIT 40)),
{", ".join(f"{_NEAREST.format(k)}, {_MOVED.format(k, k + 1)}" for k in range(5))}, {_NEAREST.format(5)}
SELECT vec_id, z.c::INTEGER AS cluster, z.d::BIGINT AS distance, sum(z.d) OVER (PARTITION BY z.c)::BIGINT AS cluster_inertia, sum(z.d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a5 JOIN c5 c ON c.c = z.c"""

_TERMS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

RANKED_SEARCH = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS.format("coalesce(text, '')")} AS w FROM documents),
s AS (SELECT count(*)::BIGINT AS nd, sum(len(w))::BIGINT AS nw FROM d WHERE len(w) > 0),
tf AS (SELECT r, doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, len(w)::BIGINT AS n, unnest(w) AS t FROM d) GROUP BY ALL),
q AS (SELECT DISTINCT item_id, unnest({_TERMS.format("coalesce(text, '')")}) AS t FROM benchmark),
wt AS (SELECT t, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS wt FROM tf, s GROUP BY t, nd),
x AS (SELECT item_id, r, doc_id, sum(wt * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * nd) // nw))))::BIGINT AS score FROM q JOIN tf USING (t) JOIN wt USING (t), s GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM x WHERE score > 0) WHERE rank <= 10"""
