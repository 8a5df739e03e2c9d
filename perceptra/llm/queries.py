"""The queries of this package and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import divergence, exact_dedup, minhash, mixing, packing, periodic, quality, sharding, suffix_dedup, token_counts, toxicity, url_filters, warc
from .common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.archive_pages(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = url_filters.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return rows.select("page_id", "host", "path", "rule", "verdict")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic.with_tails(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return periodic.digests(periodic.periodic_runs(docs))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_warc, op3_mixing, op4_packing, op5_sharding, op6_minhash, op7_suffix_dedup, op8_url_filters, op9_exact_dedup, op10_quality,
        op11_periodic_runs, op12_source_divergence, op13_toxicity,
    )
}

OP2_SQL = r"""
WITH h AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
d AS (SELECT page_id, payload_bytes, x, array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform([15, 10, 5, 0], lambda s:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, CAST(5*g + 1 AS BIGINT), 5))::BIGINT >> s) & 31), 1)), '')), '') AS payload_digest FROM h),
f AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS first, row_number() OVER (PARTITION BY x ORDER BY page_id NULLS LAST) AS place FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN place > 1 THEN first END AS refers_to FROM f
"""

OP3_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM sizes GROUP BY source),
c AS (SELECT *, source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM s),
l AS (
  SELECT *, row_number() OVER o AS rank,
         (total - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM c WINDOW o AS (ORDER BY cap / w, source NULLS FIRST)),
t AS (
  SELECT source, source_size,
         least(cap, w * (SELECT arg_min(level, rank) FROM l WHERE level * w <= cap)) AS target FROM l),
k AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS times FROM t),
by_hash AS (
  SELECT z.source, h, sum(size)::BIGINT AS here, sum(sum(size)) OVER (PARTITION BY z.source ORDER BY h) AS run,
         any_value(k.target - k.times * k.source_size) AS rest
  FROM sizes z JOIN k ON z.source IS NOT DISTINCT FROM k.source GROUP BY z.source, h),
cut AS (
  SELECT source, arg_min(CASE WHEN 2 * (rest - run + here) > here THEN h + 1 ELSE h END, h) AS below
  FROM by_hash WHERE run > rest GROUP BY source)
SELECT z.doc_id, z.size, k.source_size, k.target,
       (z.size * least(2, k.times + CASE WHEN cut.below IS NULL OR z.h < cut.below THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sizes z JOIN k ON z.source IS NOT DISTINCT FROM k.source
LEFT JOIN cut ON z.source IS NOT DISTINCT FROM cut.source
"""

OP5_SQL = r"""
WITH RECURSIVE bit(n, k, c) AS (
  SELECT n, 0, n FROM range(256) r(n) UNION ALL
  SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bit WHERE k < 8),
crc AS (SELECT list(c ORDER BY n) AS step FROM bit WHERE k = 8),
d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
h AS (
  SELECT doc_id, strlen(body) + 1 AS size, ('0x' || substr(md5(body), 1, 15))::BIGINT AS h,
         xor(4294967295, list_reduce(list_transform(range(strlen(body)), lambda i: ('0x' || substr(x, 2*i + 1, 2))::BIGINT), lambda a, b: xor(a >> 8, step[(xor(a, b) & 255) + 1]), 4294967295)) AS text_crc32
  FROM (SELECT *, hex(encode(body)) AS x FROM d), crc),
r AS (
  SELECT *, (h % 4096)::INT AS vslot, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/' || text_crc32 || '/' || size), 1, 15))::BIGINT AS deal FROM h),
slots AS (SELECT vslot, sum(size) AS bytes FROM r GROUP BY vslot),
heavy AS (SELECT vslot, bytes, mean / 8 AS part FROM slots, (SELECT sum(bytes) / 16::DOUBLE AS mean FROM slots) WHERE bytes > mean),
hot AS (SELECT r.vslot, h, ceil(sum(size) / any_value(part))::INT AS keys FROM r JOIN heavy USING (vslot) GROUP BY r.vslot, h HAVING sum(size) > any_value(part)),
placed AS (
  SELECT r.*, CASE WHEN keys IS NULL THEN -1 ELSE h END AS hot_text,
         (CASE WHEN keys IS NULL THEN (h // 4096) % coalesce(ceil(heavy.bytes / heavy.part)::BIGINT, 1) ELSE deal % keys END)::INT AS part
  FROM r LEFT JOIN heavy USING (vslot) LEFT JOIN hot USING (vslot, h)),
units AS (SELECT vslot, hot_text, part, sum(size)::BIGINT AS bytes, row_number() OVER (ORDER BY sum(size) DESC, vslot DESC, hot_text DESC, part DESC) AS i FROM placed GROUP BY vslot, hot_text, part),
fold(i, loads, shard) AS (
  SELECT 0::BIGINT, list_transform(range(16), lambda x: 0::BIGINT), NULL::BIGINT UNION ALL
  SELECT u.i, list_transform(range(16), lambda x: f.loads[x + 1] + CASE WHEN x + 1 = list_position(f.loads, list_min(f.loads)) THEN u.bytes ELSE 0 END), list_position(f.loads, list_min(f.loads)) - 1
  FROM fold f JOIN units u ON u.i = f.i + 1)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard::INT AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY vslot, hot_text, part, deal, doc_id NULLS LAST, text_crc32, size) - 1 AS slot, NULL::INT AS grown_shard
FROM placed JOIN units USING (vslot, hot_text, part) JOIN fold USING (i)
"""

OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(list_slice(w, i, i + 4), ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100*c >= 75*(x.n + y.n - c)),
ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(a, b) AS (SELECT a, b FROM ways UNION SELECT r.a, w.b FROM reach r JOIN ways w ON r.b = w.a),
low AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(low.c, d.doc_id) AS component_id, coalesce(low.c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN low ON low.a = d.doc_id
"""

OP7_SQL = r"""
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
part AS (SELECT doc_id, 500*c AS base, substr(h, 1000*c + 1, 1098) AS h, least(500, n - 49 - 500*c) AS m FROM (SELECT *, unnest(range((n - 49 + 499)//500)) AS c FROM b WHERE n >= 50)),
pos AS (SELECT doc_id, base + p AS p, substr(h, 2*p + 1, 100) AS s FROM (SELECT *, unnest(range(m)) AS p FROM part)),
low AS (SELECT s, min(doc_id) AS m FROM pos GROUP BY s),
hit AS (SELECT doc_id, p FROM pos JOIN low USING (s) WHERE m < doc_id),
edge AS (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM hit),
run AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM edge),
gone AS (SELECT doc_id, min(p) AS lo, max(p) + 50 AS hi FROM run GROUP BY doc_id, k),
stays AS (
  SELECT b.doc_id, x.lo, x.hi FROM b JOIN (
    SELECT doc_id, coalesce(lag(hi) OVER w, 0) AS lo, lo AS hi FROM gone WINDOW w AS (PARTITION BY doc_id ORDER BY lo)
    UNION ALL SELECT doc_id, max(hi), NULL FROM gone GROUP BY doc_id) x ON x.doc_id = b.doc_id),
kept AS (SELECT s.doc_id, string_agg(substr(h, 2*s.lo + 1, 2*(coalesce(s.hi, n) - s.lo)), '' ORDER BY s.lo) AS k FROM stays s JOIN b ON b.doc_id = s.doc_id GROUP BY s.doc_id),
sums AS (SELECT doc_id, CAST(sum(hi - lo) AS BIGINT) AS removed, count(*) AS spans FROM gone GROUP BY doc_id)
SELECT b.doc_id, n AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM b LEFT JOIN kept ON kept.doc_id = b.doc_id LEFT JOIN sums ON sums.doc_id = b.doc_id
"""

OP8_SQL = r"""
WITH RECURSIVE rules(verdict, host, path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
tags AS (
  SELECT url AS a, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM pages
  WHERE url IS NOT NULL AND regexp_matches(html, '(?i)\bcanonical\b|http-equiv')),
targets AS (
  SELECT a, CASE WHEN regexp_matches(tag, '(?is)\brel\s*=\s*["'']?canonical\b') THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
                 WHEN regexp_matches(tag, '(?is)\bhttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(tag, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1) END AS b FROM tags),
edges AS (
  SELECT DISTINCT a, b FROM (
    SELECT a, CASE WHEN starts_with(b, '//') THEN regexp_extract(a, '(?s)^(.*?:)//', 1) || b
                   WHEN starts_with(b, '/') THEN regexp_extract(a, '(?s)^(.*?://[^/?#]*)', 1) || b ELSE b END AS b FROM targets)
  WHERE b LIKE '%://%' AND a <> b),
ways AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges),
reach(a, b) AS (SELECT a, a FROM ways UNION SELECT r.a, w.b FROM reach r JOIN ways w ON r.b = w.a),
urls AS (SELECT url FROM pages UNION SELECT b FROM reach),
parts AS (
  SELECT url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM urls),
own AS (
  SELECT p.url, p.host, p.path, r.host || r.path AS rule, r.verdict FROM parts p LEFT JOIN rules r
    ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  QUALIFY row_number() OVER (PARTITION BY p.url ORDER BY length(r.host || r.path) DESC NULLS LAST, r.verdict) = 1),
spread AS (
  SELECT r.a AS url, bool_or(o.verdict = 'block') AS blocked, bool_or(o.verdict = 'allow') AS allowed FROM reach r JOIN own o ON o.url = r.b GROUP BY r.a)
SELECT p.page_id, o.host, o.path, o.rule,
       coalesce(o.verdict, CASE WHEN coalesce(s.blocked, false) AND NOT coalesce(s.allowed, false) THEN 'block' ELSE 'allow' END) AS verdict
FROM pages p JOIN own o ON p.url IS NOT DISTINCT FROM o.url LEFT JOIN spread s ON s.url = p.url
"""

OP9_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS cps, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
w AS (
  SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY cps DESC, doc_id NULLS LAST) AS place,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY cps DESC, doc_id NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM w
"""

OP11_SQL = r"""
WITH RECURSIVE bit(n, k, c) AS (
  SELECT n, 0, n FROM range(256) r(n) UNION ALL
  SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bit WHERE k < 8),
crc AS (SELECT list(c ORDER BY n) AS step FROM bit WHERE k = 8),
d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         xor(4294967295, list_reduce(list_transform(range(length(CAST(doc_id AS VARCHAR))), lambda i: ord(substr(CAST(doc_id AS VARCHAR), CAST(i + 1 AS BIGINT), 1))::BIGINT),
             lambda a, b: xor(a >> 8, step[(xor(a, b) & 255) + 1]), 4294967295)) AS h FROM documents, crc),
g AS (SELECT *, len(w) AS n, h // 10 AS g FROM d),
a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE n END AS a, 1 + (n - g % greatest(n, 1)) // (3 + g % 8) AS p FROM g),
tok AS (
  SELECT doc_id, n, i, w[(CASE WHEN i < a THEN i ELSE a + (i - a) % p END) + 1] AS w FROM (SELECT *, unnest(range(n)) AS i FROM a)),
pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM tok x JOIN tok y ON x.doc_id = y.doc_id AND x.w = y.w AND x.i < y.i AND 4 * (y.i - x.i) <= x.n),
isl AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM pairs),
reps AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS len FROM isl GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (
  SELECT * FROM reps r WHERE NOT EXISTS (
    SELECT 1 FROM reps o WHERE o.doc_id = r.doc_id AND o.q < r.q AND r.q % o.q = 0 AND o.s <= r.s AND o.s + o.len >= r.s + r.len)),
best AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines,
         arg_max({'s': s, 'len': len, 'q': q}, (len, -s, -q)) AS b FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS kept FROM tok t WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = t.doc_id AND gone.i = t.i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.s::BIGINT AS start, b.len::BIGINT AS length, b.q::BIGINT AS period, (1000 * b.len // b.q)::BIGINT AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN best ON best.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (
  SELECT *, 1 + 1000000000::HUGEINT * (n + 2) // (sum(n) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source)) AS p FROM f),
l AS (
  SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(n) + 2) // (sum(sum(n)) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang)) AS q FROM c GROUP BY lang, term),
pair AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
term AS (SELECT p.lang, source, p.term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN l ON l.lang = p.lang AND l.term = p.term WHERE n > 0 AND p > q),
parts AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
    LEFT JOIN pair ON pair.lang = x.lang AND pair.source = x.source AND pair.item = y.source
  UNION ALL SELECT lang, source, 'term', item, value FROM term)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM parts QUALIFY part = 'pair' OR rank <= 10
"""

ORACLES = {
    "op2_warc": OP2_SQL,
    "op3_mixing": OP3_SQL,
    "op5_sharding": OP5_SQL,
    "op6_minhash": OP6_SQL,
    "op7_suffix_dedup": OP7_SQL,
    "op8_url_filters": OP8_SQL,
    "op9_exact_dedup": OP9_SQL,
    "op11_periodic_runs": OP11_SQL,
    "op12_source_divergence": OP12_SQL,
}
