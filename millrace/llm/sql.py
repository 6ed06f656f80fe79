"""DuckDB SQL for the results of the queries that SQL can express over whole tables."""

from __future__ import annotations

_BLANK = "' ' || chr(9) || chr(13) || chr(11) || chr(12)"
_ASCII = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

LINE_DEDUP = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text FROM documents),
l AS (SELECT r, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
k AS (SELECT *, trim(line, {_BLANK}) AS key FROM l),
pages AS (SELECT source, count(*) AS n FROM d GROUP BY source),
boilerplate AS (
  SELECT source, key FROM (SELECT DISTINCT r, source, key FROM k WHERE key <> '') JOIN pages USING (source)
  GROUP BY source, key, n HAVING count(*) >= 5 AND count(*) > CAST(0.08 AS DOUBLE) * n),
kept AS (
  SELECT r, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE b.key IS NULL) AS text, count(b.key) AS n
  FROM k LEFT JOIN boilerplate b ON b.source = k.source AND b.key = k.key GROUP BY r)
SELECT doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(kept.text, '') END AS text,
       coalesce(n, 0) AS n_dropped_lines
FROM d LEFT JOIN kept USING (r)"""


def _url_filter() -> str:
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/")]
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    return f"""
WITH RECURSIVE rules(verdict, h, p) AS (VALUES {values}),
u AS (SELECT row_number() OVER () AS r, page_id, html,
        translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), {_ASCII}) AS host,
        coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path FROM pages),
best AS (SELECT r, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict FROM u JOIN rules
         ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r),
m AS (SELECT u.*, rule, verdict FROM u LEFT JOIN best USING (r)),
hosts AS (SELECT host, count(*) AS n, count(*) FILTER (WHERE verdict = 'allow') AS a, count(*) FILTER (WHERE verdict = 'block') AS b
          FROM m WHERE host <> '' GROUP BY host),
seeds AS (SELECT 'trust' AS kind, host FROM hosts WHERE a > 0.5 * n UNION ALL SELECT 'distrust', host FROM hosts WHERE b > 0.5 * n),
s0 AS (SELECT kind, host, 1000000000000000 // count(*) OVER (PARTITION BY kind) AS score FROM seeds),
links AS (SELECT source, target, count(*) AS weight FROM (
    SELECT host AS source, translate(unnest(regexp_extract_all(html, '<a\\s[^>]*?href\\s*=\\s*["'']?(?:https?:)?//([^/?#"''\\s>]+)', 1, 'i')), {_ASCII}) AS target
    FROM m) WHERE source <> '' AND source <> target GROUP BY source, target),
both_ways AS (SELECT 'trust' AS kind, source AS host, target, weight FROM links
              UNION ALL SELECT 'distrust', target, source, weight FROM links),
e AS (SELECT *, sum(weight) OVER (PARTITION BY kind, host) AS total FROM both_ways),
s AS (
  SELECT 0 AS round, kind, host, score FROM s0
  UNION ALL
  SELECT round, kind, host, CAST(sum(score) AS BIGINT) FROM (
    SELECT round + 1 AS round, e.kind, e.target AS host, floor(CAST(score AS DOUBLE) * CAST(0.85 AS DOUBLE) * weight / total) AS score
    FROM e JOIN s USING (kind, host) WHERE round < 100
    UNION ALL SELECT round, kind, host, floor(CAST(score AS DOUBLE) * (1 - CAST(0.85 AS DOUBLE)))
    FROM s0, (SELECT DISTINCT round + 1 AS round FROM s WHERE round < 100) WHERE (SELECT count(*) FROM links) > 0)
  GROUP BY round, kind, host),
ends AS (SELECT kind, host, score FROM s WHERE round = (SELECT max(round) FROM s)),
bad AS (SELECT host FROM ends GROUP BY host
        HAVING coalesce(sum(score) FILTER (WHERE kind = 'distrust'), 0) > coalesce(sum(score) FILTER (WHERE kind = 'trust'), 0))
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict
FROM m"""


URL_FILTER = _url_filter()

DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
             coalesce(regexp_extract_all(translate(text, {_ASCII}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, {_ASCII}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, n, w[i:i + n - 1] AS g
        FROM (SELECT *, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
places AS (SELECT r, n, i, w[i:i + n - 1] AS g
           FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win))),
hits AS (SELECT r, n, i, item_id FROM places JOIN win USING (n, g)),
hit_words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
hit_items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
              FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), {_ASCII}), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT r, unnest(CASE len(w) WHEN 0 THEN [] WHEN 1 THEN w
        ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
common AS (SELECT a.r AS x, b.r AS y, count(*) AS k FROM s a JOIN s b USING (g) GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN n nx ON nx.r = x JOIN n ny ON ny.r = y WHERE 100 * k >= 80 * (nx.n + ny.n - k)),
reach AS (SELECT r, r AS t FROM d UNION SELECT reach.r, y FROM reach JOIN links ON t = x),
least AS (SELECT reach.r, min(doc_id) AS component_id FROM reach JOIN d ON d.r = t GROUP BY reach.r)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM d LEFT JOIN n USING (r) JOIN least USING (r)"""

QUALITY = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
             list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT r, i, w[i:i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c >= 2),
repeats AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 3)) AS p FROM again) GROUP BY r),
m AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '[\x20\x09-\x0D]', '', 'g') <> '') AS lines FROM d),
q AS (SELECT *, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat FROM m LEFT JOIN repeats USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat AS n_repeat_words,
       n_words < 50 OR 100 * n_repeat > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat > 50 * n_words OR n_words > 1000000 OR word_chars < 2 * n_words
            OR word_chars > 15 * n_words OR 10 * n_symbols > n_words OR 100 * n_dup_lines > 30 * n_lines) AS kept
FROM q"""


def _vector_compression(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    def nearest(name: str, book: str) -> str:
        return f"""
{name} AS (
  SELECT r, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
    SELECT x.r, x.p, b.e, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
    FROM x JOIN {book} b USING (p)) GROUP BY r, p)"""

    def better(name: str, before: str, codes: str) -> str:
        return f"""
{name} AS (
  SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM {before} b LEFT JOIN (
    SELECT p, e, list(CAST(floor((s - (s % n + n) % n) / n) AS BIGINT) ORDER BY i) AS v FROM (
      SELECT p, c.e, i, CAST(sum(x.v[i]) AS BIGINT) AS s, count(*) AS n
      FROM x JOIN {codes} c USING (r, p), (SELECT unnest(range(1, {64 // parts + 1})) AS i) GROUP BY p, c.e, i)
    GROUP BY p, e) m USING (p, e))"""

    steps = []
    for k in range(rounds):
        steps += [nearest(f"c{k}", f"b{k}"), better(f"b{k + 1}", f"b{k}", f"c{k}")]
    steps.append(nearest("c", f"b{rounds}"))
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label,
         list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS MATERIALIZED (
  SELECT r, p, list_slice(v, p * {64 // parts} + 1, (p + 1) * {64 // parts}) AS v
  FROM kept, (SELECT unnest(range({parts})) AS p)),
b0 AS (SELECT p, r AS e, v FROM x WHERE r < {entries}),{",".join(steps)},
coded AS (
  SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM c GROUP BY r),
book AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (r), book"""


VECTOR_COMPRESSION = _vector_compression()

EARLIER_PASSAGES = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (
  SELECT r, doc_id, i, b[i : i + 49] AS s
  FROM (SELECT r, doc_id, b, unnest(range(1, octet_length(b) - 48)) AS i FROM d WHERE octet_length(b) >= 50)),
first_in AS (SELECT s, min(doc_id) AS first_id FROM w GROUP BY s HAVING min(doc_id) < max(doc_id) OR count(*) > 1),
hit AS (SELECT r, i FROM w JOIN first_in USING (s) WHERE first_id < doc_id OR (doc_id IS NULL AND first_id IS NOT NULL)),
island AS (
  SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS k FROM (
    SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 50 THEN 0 ELSE 1 END AS fresh FROM hit)),
span AS (SELECT r, k, min(i) AS a, max(i) + 50 AS z FROM island GROUP BY r, k),
per AS (SELECT r, count(*) AS n_spans, sum(z - a) AS n_removed, list(a ORDER BY a) AS starts, list(z ORDER BY a) AS ends FROM span GROUP BY r)
SELECT doc_id, octet_length(b) AS n_bytes, coalesce(CAST(n_removed AS BIGINT), 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(CASE WHEN n_spans IS NULL THEN b ELSE unhex(list_aggregate(list_transform(
         list_zip(list_prepend(1, ends), list_append(starts, octet_length(b) + 1)),
         lambda p: hex(b[p[1] : p[2] - 1])), 'string_agg', '')) END) AS kept_sha256
FROM d LEFT JOIN per USING (r)"""
