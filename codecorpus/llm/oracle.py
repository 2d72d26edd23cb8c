"""DuckDB SQL for the operators that SQL can express."""

MIXING = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, 3 * source_size AS cap, (sum(source_size) OVER ()
      - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(weight) OVER (ORDER BY 3 * source_size / weight, source
                 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources),
targets AS (
  SELECT source, source_size, (weight - 2) * 0.5::DOUBLE AS a,
         least(cap::DOUBLE, max(level) OVER () * weight) AS target
  FROM levels),
placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.a, round(t.target)::BIGINT AS demand,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY h, doc_id
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT - d.size AS start
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       least(size, greatest(0, demand - start)) + least(size, greatest(0, demand - start - source_size))
         + least(size, greatest(0, demand - start - 2 * source_size)) AS taken,
       CASE WHEN size > 0 AND start < demand THEN round(2 * (start::DOUBLE / demand)
         / ((1 - a) + sqrt((1 - a) * (1 - a) + 4 * a * (start::DOUBLE / demand))), 9) END AS first_position
FROM placed
"""

EXACT_DEDUP = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""

SHARDING = """
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, sha256(coalesce(text, '')) AS text_sha256,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
levels AS (
  SELECT d.*, depth, h >> (60 - depth)::INT AS prefix FROM d, range(0, 61) r(depth)),
loads AS (
  SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs, min(h) = max(h) AS same
  FROM levels GROUP BY depth, prefix),
leaf AS (
  SELECT l.doc_id, l.n_bytes, l.text_sha256, min(l.depth) AS shard_depth, arg_min(l.prefix, l.depth) AS prefix
  FROM levels l JOIN loads b ON l.depth = b.depth AND l.prefix = b.prefix
  WHERE b.shard_bytes <= 4194304 OR b.same GROUP BY ALL)
SELECT leaf.doc_id, leaf.n_bytes, leaf.text_sha256, leaf.shard_depth::INT AS shard_depth, b.shard_bytes, b.shard_docs,
       'b' || CASE WHEN leaf.shard_depth = 0 THEN '' ELSE right(repeat('0', 60) || bin(leaf.prefix), leaf.shard_depth::INT) END AS shard
FROM leaf JOIN loads b ON leaf.shard_depth = b.depth AND leaf.prefix = b.prefix
"""

WARC = """
WITH d AS (SELECT page_id, coalesce(html, '') AS p, sha1(coalesce(html, '')) AS h FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY p) AS keep FROM d)
SELECT page_id, strlen(p)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((('0x' || substr(h, (5 * (i // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = keep THEN NULL ELSE keep END AS refers_to
FROM k
"""

_ALNUM = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

RESAMPLE = f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
b AS (SELECT {_ALNUM} AS w FROM benchmark),
crc_table AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))
              ORDER BY i) AS t
  FROM range(256) r(i)),
words AS (SELECT DISTINCT word FROM (SELECT unnest(w) AS word FROM d UNION ALL SELECT unnest(w) FROM b)),
hexed AS (SELECT word, hex(encode(word)) AS x FROM words),
bucketed AS (
  SELECT word, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(strlen(word)),
                   lambda i: ('0x' || substr(x, (2 * i + 1)::INT, 2))::BIGINT)),
                 lambda c, byte: xor(c >> 8, t[(xor(c, byte) & 255) + 1])), 4294967295) AS crc
  FROM hexed, crc_table),
of_word AS (SELECT word, crc % 10000 AS bucket FROM bucketed),
dw AS (SELECT doc_id, unnest(w) AS word FROM d),
raw AS (SELECT bucket, count(*) AS s FROM dw JOIN of_word USING (word) GROUP BY bucket),
target AS (SELECT bucket, count(*) AS t FROM (SELECT unnest(w) AS word FROM b) JOIN of_word USING (word) GROUP BY bucket),
totals AS (SELECT (SELECT coalesce(sum(s), 0) FROM raw)::DOUBLE AS s_all, (SELECT coalesce(sum(t), 0) FROM target)::DOUBLE AS t_all),
gains AS (
  SELECT i AS bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000))
                                      / ((coalesce(s, 0) + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain
  FROM range(10000) r(i) LEFT JOIN raw ON raw.bucket = i LEFT JOIN target ON target.bucket = i, totals),
weighed AS (
  SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS total
  FROM dw JOIN of_word USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_features,
         coalesce(CASE WHEN total % n < 0 THEN (total - total % n) // n - 1 ELSE (total - total % n) // n END, 0)::BIGINT AS weight,
         floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS noise
  FROM d LEFT JOIN weighed USING (doc_id)),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS rank, count(*) OVER () AS n
  FROM scored WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, weight + noise AS score, r.rank
FROM scored s LEFT JOIN ranked r ON r.doc_id = s.doc_id AND r.rank <= 10 * r.n // 100
"""

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
b AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
g AS (
  SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS gram
  FROM (SELECT item_id, w, least(len(w), 10) AS l, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
p AS (
  SELECT doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') AS gram
  FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM g) WHERE len(w) >= l)),
h AS (SELECT p.doc_id, p.i, p.l, g.item_id FROM p JOIN g USING (l, gram)),
hit AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + l)) AS pos FROM (SELECT DISTINCT doc_id, i, l FROM h)) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ORACLE = {
    "op2_exact_dedup": EXACT_DEDUP,
    "op4_mixing": MIXING,
    "op8_sharding": SHARDING,
    "op10_warc": WARC,
    "op11_resample": RESAMPLE,
    "op12_decontaminate": DECONTAMINATION,
}
