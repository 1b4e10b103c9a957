"""The registered queries of the training-data operators, and their SQL where SQL can say the same.

Each query reads its whole table, hands it to its operator and derives the
columns of its contract from what the operator returns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phredloom.llm import decontaminate, divergence, html_extract, importance, mixing, near_dedup, packing, pii, quality, suffix_dedup, token_count, topk, warc
from phredloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs.select("doc_id", packing.word_tokens(F.col("text")).alias("n")), "doc_id", "n")


OP3_SQL = r"""
WITH RECURSIVE r AS (SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) AS BIGINT) AS n_tokens FROM documents),
h AS (SELECT n_tokens AS len, row_number() OVER (ORDER BY n_tokens) AS j, sum(count(*)) OVER (ORDER BY n_tokens) AS c, sum(n_tokens * count(*)) OVER (ORDER BY n_tokens) AS s FROM r GROUP BY n_tokens),
e AS (SELECT j, len, c, s FROM h UNION ALL SELECT 0, 0, 0, 0),
best AS (
  SELECT 0 AS layer, CAST(0 AS BIGINT) AS j, CAST(0 AS HUGEINT) AS cost, CAST(NULL AS BIGINT) AS i
  UNION ALL
  SELECT b.layer + 1, y.j, min(b.cost + y.len * (y.c - x.c) - (y.s - x.s)), arg_min(x.j, struct_pack(v := b.cost + y.len * (y.c - x.c) - (y.s - x.s), i := x.j))
  FROM best b JOIN e x ON x.j = b.j JOIN e y ON y.j > x.j
  WHERE b.layer < least(16, (SELECT max(j) FROM e)) GROUP BY b.layer, y.j),
walk AS (
  SELECT layer, j, i FROM best WHERE layer = least(16, (SELECT max(j) FROM e)) AND j = (SELECT max(j) FROM e)
  UNION ALL SELECT b.layer, b.j, b.i FROM walk w JOIN best b ON b.layer = w.layer - 1 AND b.j = w.i WHERE w.layer > 1),
k AS (SELECT CAST(w.layer - 1 AS INTEGER) AS bucket, a.len AS low, z.len AS bucket_len, CAST(greatest(1, 16384 // greatest(1, z.len)) AS BIGINT) AS capacity FROM walk w JOIN e a ON a.j = w.i JOIN e z ON z.j = w.j),
p AS (SELECT r.doc_id, r.n_tokens, k.bucket, k.bucket_len, k.capacity, row_number() OVER (PARTITION BY k.bucket ORDER BY r.n_tokens, r.doc_id) - 1 AS place
  FROM r JOIN k ON r.n_tokens <= k.bucket_len AND (r.n_tokens > k.low OR k.bucket = 0))
SELECT doc_id, n_tokens, bucket, bucket_len, capacity, CAST(place // capacity AS BIGINT) AS batch_no, CAST(place % capacity AS BIGINT) AS slot, bucket_len - n_tokens AS padding FROM p
"""


def op4_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_count.piece_vocabulary(token_count.default_vocabulary_path())
    return token_count.count_tokens(table(spark, sf_dir, "documents"), pieces)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op7_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.resolve_revisits(warc.records_from_pages(table(spark, sf_dir, "pages")))
    pairs = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws(":", e["key"], e["value"])))
    return out.select("record_id", "url", "status", "response_id", "digest", F.array_join(pairs, ",").alias("headers"))


OP7_SQL = r"""
WITH p AS (
  SELECT page_id, url AS uri, md5(coalesce(html, '')) AS digest,
    regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare
  FROM pages),
parts AS (
  SELECT page_id, digest,
    regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), ':(80|443)$', ''), '^www\.', '') AS host,
    regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
      lambda x: x <> '' AND lower(split_part(x, '=', 1)) NOT IN ('fbclid','gclid','ref','utm_campaign','utm_content','utm_medium','utm_source','utm_term'))), '&') AS query
  FROM p),
c AS (
  SELECT page_id, digest, host || path || CASE WHEN query = '' THEN '' ELSE '?' || query END AS url,
    1704067200 + page_id * 60 AS full_ts, 1704067200 + page_id * 60 + 365 * 86400 AS ask_ts
  FROM parts),
j AS (
  SELECT a.page_id, a.url, b.page_id AS other, b.digest AS other_digest, a.digest,
    row_number() OVER (PARTITION BY a.page_id ORDER BY b.full_ts DESC, b.page_id DESC) AS rn
  FROM c a LEFT JOIN c b ON a.url = b.url AND b.full_ts < a.ask_ts),
s AS (
  SELECT *, CASE WHEN other IS NULL THEN 'orphan'
      WHEN page_id % 7 = 0 THEN CASE WHEN page_id % 28 = other % 28 THEN 'resolved' ELSE 'mismatch' END
      WHEN page_id % 5 <> 0 AND digest = other_digest THEN 'resolved' ELSE 'mismatch' END AS status
  FROM j WHERE rn = 1)
SELECT page_id * 2 + 1 AS record_id, url, status,
  CASE WHEN status = 'resolved' THEN other * 2 END AS response_id,
  CASE WHEN status = 'resolved' THEN other_digest END AS digest,
  CASE WHEN status = 'resolved' THEN 'content-encoding:gzip,content-type:text/html,expires:never,server:edge-2' END AS headers
FROM s
"""


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove(table(spark, sf_dir, "documents"), with_text=True)


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS x FROM documents),
n AS (SELECT r, doc_id, x, octet_length(x) AS n FROM d),
w AS (SELECT r, i, md5(x[i + 1 : i + 400]) AS h FROM (SELECT r, x, unnest(range(0, n - 399)) AS i FROM n)),
m AS (SELECT r, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
g AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS span
  FROM (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 400 THEN 0 ELSE 1 END AS new FROM m)),
s AS (SELECT r, min(i) AS a, max(i) + 400 AS b FROM g GROUP BY r, span),
p AS (SELECT r, a, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS x0, a AS x1 FROM s
  UNION ALL SELECT n.r, n.n, coalesce(max(s.b), 0), n.n FROM n LEFT JOIN s ON n.r = s.r GROUP BY n.r, n.n),
k AS (SELECT p.r, p.a, hex(n.x[p.x0 + 1 : p.x1]) AS piece FROM p JOIN n ON p.r = n.r WHERE p.x1 > p.x0),
t AS (SELECT r, string_agg(piece, '' ORDER BY a) AS kept,
    string_agg(regexp_replace(regexp_replace(piece, '^([89AB].)+', ''), '^((?:..)*)(?:[CD].|E.(?:[89AB].)?|F.(?:[89AB].){0,2})$', '\1'), '' ORDER BY a) AS chars
  FROM k GROUP BY r),
c AS (SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed FROM s GROUP BY r)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_bytes, CAST(coalesce(c.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(c.n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(t.kept, ''))) AS kept_sha256, decode(unhex(coalesce(t.chars, ''))) AS text
FROM n LEFT JOIN t ON n.r = t.r LEFT JOIN c ON n.r = c.r
"""


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.link(table(spark, sf_dir, "documents"), words=4, percent=80)


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
g AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(list_slice(ws, i, i + 3), ' ')) END) AS s
  FROM w),
e AS (SELECT doc_id, unnest(s) AS x FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN g ga ON ga.doc_id = a JOIN g gb ON gb.doc_id = b WHERE 100 * n >= 80 * (len(ga.s) + len(gb.s) - n)),
t AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT t.b, r.root FROM r JOIN t ON r.doc_id = t.a),
m AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY 1)
SELECT g.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, g.doc_id = component_id AS kept FROM g JOIN m ON g.doc_id = m.doc_id
"""


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# The checksum of a word is worked out byte by byte from a table of 256 remainders, which is made bit by bit.
OP11_SQL = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws,
    row_number() OVER () AS r FROM documents),
k AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
c AS (SELECT r, unnest(ws) AS w FROM d),
u AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM c UNION SELECT w FROM k)),
y AS (SELECT w, list_transform(range(1, len(h) + 1, 2), lambda i: CAST(('0x' || h[i : i + 1]) AS BIGINT)) AS bytes FROM u),
b AS (SELECT w, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, crc.t[xor(c, x) % 256 + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM y, crc),
s AS (SELECT bucket, count(*) AS n FROM c JOIN b USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM k JOIN b USING (w) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM s) + 10000) AS DOUBLE)
    / CAST((s.n + 1) * ((SELECT coalesce(sum(n), 0) FROM t) + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
m AS (SELECT r, sum(gain) AS weight FROM c JOIN b USING (w) JOIN g USING (bucket) GROUP BY r),
z AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) AS h FROM d LEFT JOIN m USING (r)),
o AS (SELECT doc_id, n_features, weight, CAST(weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM z),
p AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS place, count(*) OVER () AS n FROM o WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= n * 10 // 100 THEN CAST(place AS BIGINT) END AS rank FROM p
UNION ALL SELECT doc_id, n_features, weight, score, NULL FROM o WHERE n_features < 20
"""


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT r, lang, source, unnest(ws) AS term FROM d),
k AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(n) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM w JOIN k USING (lang, term) GROUP BY lang, source, term),
t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 1) // (coalesce(t.total, 0) + v.v) AS p,
    1 + 1000000000 * (k.n + 1) // (v.n + v.v) AS q
  FROM g JOIN k ON g.lang = k.lang JOIN v ON g.lang = v.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN t ON t.lang = g.lang AND t.source = g.source),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM o)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200
"""


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(*mixing.mix(table(spark, sf_dir, "documents"), weights=[5, 2, 1]))


# Equal rows stand in parts of 1,000; the order of a source's stream is that of md5.
OP13_SQL = r"""
WITH r AS (SELECT source, doc_id, md5(coalesce(text, '')) AS digest, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) AS BIGINT) AS size FROM documents),
e AS (SELECT *, (row_number() OVER (PARTITION BY source, doc_id, digest) - 1) AS copy FROM r),
z AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM r GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS weight, 2 * source_size AS cap FROM z),
c AS (SELECT *, cap / weight AS ratio, CAST(sum(cap) OVER o AS DOUBLE) AS caps, sum(weight) OVER o AS weights, CAST(sum(source_size) OVER () AS DOUBLE) AS all_size, sum(weight) OVER () AS all_weight
  FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, (all_size * 150 / 100.0::DOUBLE - caps + cap) / (all_weight - weights + weight) AS factor FROM c),
l AS (SELECT max(factor) AS level FROM f WHERE factor <= ratio),
t AS (SELECT source, source_size, CASE WHEN level IS NULL OR ratio <= level THEN CAST(cap AS DOUBLE) ELSE weight * level END AS target FROM f, l),
s AS (SELECT e.doc_id, e.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS want,
    sum(e.size) OVER (PARTITION BY e.source ORDER BY md5(concat_ws(':', '2024', coalesce(CAST(e.doc_id AS VARCHAR), ''), e.digest, CAST(e.copy // 1000 AS VARCHAR))), e.copy ROWS UNBOUNDED PRECEDING) - e.size AS pos
  FROM e JOIN t ON e.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(greatest(0, least(pos + size, want) - pos) + greatest(0, least(source_size + pos + size, want) - (source_size + pos)) AS BIGINT) AS taken FROM s
"""


def queries() -> dict[str, Query]:
    own = globals()
    return {name: own[name] for name in sorted(own) if name.startswith("op") and "_" in name and callable(own[name])}


def oracle_sql() -> dict[str, str]:
    return {"op3_packing": OP3_SQL, "op7_revisits": OP7_SQL, "op8_suffix_dedup": OP8_SQL, "op9_topk": OP9_SQL, "op10_near_dedup": OP10_SQL, "op11_importance": OP11_SQL, "op12_divergence": OP12_SQL, "op13_mixing": OP13_SQL}
