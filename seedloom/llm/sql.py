"""DuckDB SQL for the queries of this package that SQL can express."""

WORDS = r"'[^\x20\x09-\x0D]+'"

EXACT_DEDUP = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents),
     g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256
FROM d JOIN g USING (h)
"""

MIXING = rf"""
WITH RECURSIVE
d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {WORDS}))::BIGINT AS size,
             md5(doc_id::VARCHAR) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r
      FROM d GROUP BY source),
w AS (SELECT source, source_size, [3, 1, 2][(r % 3 + 1)::INT] AS weight,
             1.5::DOUBLE * sum(source_size) OVER () AS budget FROM s),
o AS (SELECT *, sum(2 * source_size) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)
                  - 2 * source_size AS before,
             sum(weight) OVER (ORDER BY source_size::DOUBLE / weight DESC, source DESC NULLS FIRST ROWS UNBOUNDED PRECEDING) AS open
      FROM w),
lv AS (SELECT max((budget - before::DOUBLE) / open::DOUBLE) AS level FROM o),
t AS (SELECT source, source_size, budget, least(2.0::DOUBLE * source_size, level * weight)::DOUBLE AS target FROM w, lv),
c AS (SELECT d.*, source_size, target, budget,
             sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING)::DOUBLE AS upto
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, coalesce(CASE WHEN target > 0 THEN (e * source_size + upto) / target END, 0) AS finish
      FROM c, (VALUES (0), (1)) AS v(e)),
f AS (SELECT *, sum(size) OVER (ORDER BY finish, k, doc_id, size ROWS UNBOUNDED PRECEDING) <= budget AS inside FROM q)
SELECT doc_id, size, source_size, target, sum(CASE WHEN inside THEN size ELSE 0 END)::BIGINT AS taken
FROM f GROUP BY doc_id, size, source_size, target
"""

WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(encode(coalesce(html, ''))) AS h FROM pages),
q AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes,
             array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1) FOR i IN range(32)], '') AS payload_digest,
             min(page_id) OVER (PARTITION BY b) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM q
"""

#: Suffixes of two labels, as in ``url_filter``.
TWO = "('ac.uk', 'co.in', 'co.jp', 'co.kr', 'co.nz', 'co.uk', 'co.za', 'com.ar', 'com.au', 'com.br', 'com.cn', 'com.mx', 'com.tr', 'com.tw', 'gov.uk', 'ne.jp', 'net.au', 'or.jp', 'org.au', 'org.uk')"

URL_FILTER = rf"""
WITH a AS (SELECT page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
p AS (SELECT *, TRY_CAST(nullif(regexp_extract(path, '/([0-9]{{1,18}})[^/]*/?$', 1), '') AS BIGINT) AS item,
    regexp_extract(host, '([^.]*[.])?[^.]*$') IN {TWO} AS two,
    CASE WHEN two THEN regexp_extract(host, '([^.]*[.])?[^.]*$') ELSE regexp_extract(host, '([^.]*)$', 1) END AS suffix,
    CASE WHEN two THEN regexp_extract(host, '([^.]*[.]){{0,2}}[^.]*$') ELSE regexp_extract(host, '([^.]*[.])?[^.]*$') END AS domain FROM a),
l AS (SELECT doc_id, max((quality = 0 OR toxic = 1)::INT) AS bad FROM labels WHERE (quality = 0 OR toxic = 1) IS NOT NULL GROUP BY doc_id),
h AS (SELECT host, any_value(suffix) AS suffix, any_value(domain) AS domain, count(bad) AS n, coalesce(sum(bad), 0) AS bad
      FROM p LEFT JOIN l ON p.item = l.doc_id GROUP BY host),
g AS (SELECT (sum(bad) + 0.5::DOUBLE) / (sum(n) + 1.0::DOUBLE) AS mean FROM h),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(mean) AS mean FROM h, g GROUP BY suffix),
sk AS (SELECT 1 / least(greatest(coalesce(sum(n * power(bad / n - mean, 2) - mean * (1 - mean)) / nullif(sum((n - 1) * mean * (1 - mean)), 0), 0.001), 0.001), 0.5) - 1 AS k
       FROM s0 WHERE n > 0),
s AS (SELECT suffix, (bad + k * mean) / (n + k) AS rate FROM s0, sk),
d0 AS (SELECT h.suffix, domain, sum(n) AS n, sum(bad) AS bad, any_value(rate) AS mean FROM h JOIN s USING (suffix) GROUP BY h.suffix, domain),
dk AS (SELECT 1 / least(greatest(coalesce(sum(n * power(bad / n - mean, 2) - mean * (1 - mean)) / nullif(sum((n - 1) * mean * (1 - mean)), 0), 0.001), 0.001), 0.5) - 1 AS k
       FROM d0 WHERE n > 0),
d AS (SELECT domain, (bad + k * mean) / (n + k) AS rate FROM d0, dk),
h0 AS (SELECT host, h.n, h.bad, rate AS mean FROM h JOIN d USING (domain)),
hk AS (SELECT 1 / least(greatest(coalesce(sum(n * power(bad / n - mean, 2) - mean * (1 - mean)) / nullif(sum((n - 1) * mean * (1 - mean)), 0), 0.001), 0.001), 0.5) - 1 AS k
       FROM h0 WHERE n > 0),
r AS (SELECT host, (bad + k * mean) / (n + k) AS rate, n, k FROM h0, hk),
v AS (SELECT host, rate, rate - 1.645::DOUBLE * sqrt(rate * (1 - rate) / (n + k + 1)) AS bound FROM r),
rules(rule, rh, rp, what) AS (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
    ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
m AS (SELECT page_id, host, path, max({{'n': length(rule), 'rule': rule, 'what': what}}) AS best
      FROM p LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id, host, path)
SELECT page_id, m.host, path, CASE WHEN best.n IS NOT NULL THEN best.rule END AS rule,
       coalesce(best.what, CASE WHEN bound > 0.5 THEN 'block' ELSE 'allow' END) AS verdict, round(rate, 6) AS rate, round(bound, 6) AS bound
FROM m JOIN v ON m.host = v.host
"""

#: CRC-32 of each distinct word, byte by byte and bit by bit: the polynomial is a fixed value.
CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, [('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT FOR i IN range(octet_length(encode(w)))]),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""

IMPORTANCE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
dw AS (SELECT doc_id, unnest(ws) AS w FROM d),
dn AS (SELECT w, count(*) AS n FROM dw GROUP BY w),
bn AS (SELECT w, count(*) AS n FROM (SELECT unnest(ws) AS w FROM b) GROUP BY w),
h AS (SELECT w, {CRC32} % 10000 AS k FROM (SELECT w FROM dn UNION SELECT w FROM bn)),
s AS (SELECT k, sum(n) AS n FROM dn JOIN h USING (w) GROUP BY k),
t AS (SELECT k, sum(n) AS n FROM bn JOIN h USING (w) GROUP BY k),
g AS (SELECT k, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s)::DOUBLE + 10000)
          / ((s.n + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0)::DOUBLE + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (k)),
m AS (SELECT doc_id, sum(gain)::DOUBLE AS total, count(*) AS n FROM dw JOIN h USING (w) JOIN g USING (k) GROUP BY doc_id),
f AS (SELECT d.doc_id, len(ws)::BIGINT AS n_features, CASE WHEN len(ws) = 0 THEN 0 ELSE floor(total / n)::BIGINT END AS weight,
          ('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT AS hash FROM d LEFT JOIN m ON d.doc_id = m.doc_id),
c AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((hash::DOUBLE + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM f),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM c WHERE n_features >= 20)
SELECT c.doc_id, n_features, weight, score, CASE WHEN rank <= 10 * (SELECT count(*) FROM r) // 100 THEN rank END AS rank
FROM c LEFT JOIN r ON c.doc_id = r.doc_id
"""

DIVERGENCE = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
o AS (SELECT lang, source, doc_id, unnest(ts) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM o GROUP BY ALL HAVING count(DISTINCT doc_id) >= 10),
lt AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY ALL),
gt AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
          1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(gt.total, 0) + 2 * v) AS p, 1 + (1000000000::HUGEINT * (k.n + 2)) // (lt.total + 2 * v) AS q
      FROM g JOIN k ON g.lang = k.lang JOIN lt ON g.lang = lt.lang LEFT JOIN gt ON g.lang = gt.lang AND g.source = gt.source
      LEFT JOIN c ON g.lang = c.lang AND g.source = c.source AND k.term = c.term),
pr AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)), 0)::BIGINT AS value
       FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
       LEFT JOIN p x ON a.lang = x.lang AND a.source = x.source LEFT JOIN p y ON b.lang = y.lang AND b.source = y.source AND x.term = y.term
       GROUP BY ALL),
te AS (SELECT lang, source, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q),
every AS (SELECT lang, source, 'pair' AS part, item, value FROM pr UNION ALL SELECT lang, source, 'term', item, value FROM te)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM every QUALIFY part = 'pair' OR rank <= 10
"""

ORACLES = {
    "op6_mixing": MIXING,
    "op7_exact_dedup": EXACT_DEDUP,
    "op8_warc": WARC,
    "op10_url_filter": URL_FILTER,
    "op11_importance": IMPORTANCE,
    "op12_divergence": DIVERGENCE,
}
