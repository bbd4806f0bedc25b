"""DuckDB SQL for the queries whose results SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op4_url_pattern_rules"] = r"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages),
r(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fit AS (
  SELECT DISTINCT p.host, p.path, r.host || r.path AS rule, r.verdict
  FROM (SELECT DISTINCT host, path FROM p) p JOIN r
    ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  QUALIFY row_number() OVER (PARTITION BY p.host, p.path ORDER BY length(r.host || r.path) DESC) = 1)
SELECT p.page_id, p.host, p.path, fit.rule,
  coalesce(fit.verdict, CASE WHEN regexp_matches(p.host,
    '(^|\.)(ads|adult|casino|cheap-pills|porn|tracker|warez)(-[^./]*)?\.') THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN fit ON p.host = fit.host AND p.path = fit.path
"""

_WORDS = r"""
w AS (SELECT doc_id, coalesce(source, NULL) AS source, coalesce(text, '') AS text,
    list_filter(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents)"""

ORACLES["op5_host_rules"] = (
    "WITH" + _WORDS + r""",
g AS (SELECT doc_id, i, words[i:i+4] AS win
      FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 4)) AS i FROM w WHERE len(words) >= 5)),
d AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM d, (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, w.source, len(words)::BIGINT AS n_words,
        coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id LEFT JOIN l ON l.doc_id = w.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS bad FROM b WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT avg(bad / n) AS mean, var_pop(bad / n) AS var FROM h),
s AS (SELECT mean, CASE WHEN var > 0 AND mean * (1 - mean) / var - 1 > 0 THEN mean * (1 - mean) / var - 1 ELSE 1 END AS size FROM p),
v AS (SELECT source, (bad + mean * size) / (n + size) > 0.5 AS failing FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(failing, false) AS kept
FROM b LEFT JOIN v USING (source)
"""
)

ORACLES["op7_line_bitmaps"] = r"""
WITH l AS (
  SELECT doc_id, i, lines[i] AS line,
    translate(trim(lines[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, lines, unnest(generate_series(1, len(lines))) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
k AS (SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT l.*, k.key IS NOT NULL AND l.doc_id <> k.last AS gone FROM l LEFT JOIN k ON l.key = k.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

ORACLES["op9_suffix_automaton"] = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
win AS (SELECT DISTINCT item_id, n, words[i:i+n-1] AS win FROM (
    SELECT item_id, words, least(13, len(words)) AS n, unnest(generate_series(1, len(words) - least(13, len(words)) + 1)) AS i
    FROM bw WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, words, n, unnest(generate_series(1, len(words) - n + 1)) AS i FROM dw, sizes WHERE len(words) >= n),
place AS (SELECT doc_id, n, i, words[i:i+n-1] AS win FROM pos),
hit AS (SELECT place.doc_id, place.i, place.n, win.item_id FROM place JOIN win ON place.n = win.n AND place.win = win.win),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items
       FROM hit GROUP BY doc_id)
SELECT dw.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM dw LEFT JOIN cov ON cov.doc_id = dw.doc_id LEFT JOIN it ON it.doc_id = dw.doc_id
"""


def _crc32(text: str) -> str:
    """SQL for the unsigned crc32 of a text's UTF-8: bit by bit over the hexadecimal digits of its bytes."""
    byte = f"('0x' || substr(hex(encode({text})), (k // 8) * 2 + 1, 2))::BIGINT"
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, generate_series(0, 8 * octet_length(encode({text})) - 1)), lambda v, k:
    CASE WHEN (CASE WHEN k % 8 = 0 THEN xor(v, {byte}) ELSE v END) % 2 = 1
      THEN xor((CASE WHEN k % 8 = 0 THEN xor(v, {byte}) ELSE v END) >> 1, 3988292384::BIGINT)
      ELSE (CASE WHEN k % 8 = 0 THEN xor(v, {byte}) ELSE v END) >> 1 END), 4294967295::BIGINT)"""


ORACLES["op12_periodic_runs"] = (
    r"""
WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
h AS (SELECT doc_id, """
    + _crc32("doc_id::VARCHAR")
    + r""" AS h FROM documents),
a AS (SELECT t.doc_id, words, len(words) AS n, h % 10 = 0 AND len(words) > 0 AS looped, h // 10 AS g FROM t JOIN h ON t.doc_id = h.doc_id),
b AS (SELECT *, CASE WHEN looped THEN g % n ELSE n END AS a FROM a),
w AS (SELECT doc_id, n, CASE WHEN looped THEN list_transform(generate_series(0, n - 1),
        lambda i: words[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1]) ELSE words END AS words FROM b),
p AS (SELECT doc_id, n, i, words[i + 1] AS word, hash(words[i + 1:i + 5]) AS win
      FROM (SELECT *, unnest(generate_series(0, n - 1)) AS i FROM w WHERE n > 0)),
-- every run has five words in a row that match those one period before them
m AS (SELECT y.doc_id, y.i, y.i - x.i AS lag FROM p x JOIN p y ON x.doc_id = y.doc_id AND x.win = y.win AND x.i < y.i
      WHERE 4 * (y.i - x.i) <= y.n AND y.i + 5 <= y.n),
s AS (SELECT doc_id, lag, min(i) - lag AS start, count(*) + 4 + lag AS length
      FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, lag ORDER BY i) AS isle FROM m) GROUP BY doc_id, lag, isle),
r AS (SELECT doc_id, start, length, min(lag) AS period FROM s WHERE length >= greatest(6, 4 * lag) GROUP BY ALL),
d AS (SELECT DISTINCT doc_id, unnest(generate_series(start + period, start + length - 1)) AS i FROM r),
k AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.i) AS text FROM p ANTI JOIN d ON p.doc_id = d.doc_id AND p.i = d.i GROUP BY p.doc_id),
l AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
      FROM r GROUP BY doc_id),
top AS (SELECT doc_id, start, length, period FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) = 1)
SELECT a.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, top.start::BIGINT AS start, top.length::BIGINT AS length, top.period::BIGINT AS period,
  (1000 * top.length // top.period)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM a LEFT JOIN l ON l.doc_id = a.doc_id LEFT JOIN top ON top.doc_id = a.doc_id LEFT JOIN k ON k.doc_id = a.doc_id
"""
)

ORACLES["op13_spelling_variants"] = (
    r"""
WITH RECURSIVE o AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS word FROM documents)
  WHERE length(word) >= 5 GROUP BY ALL),
h AS (SELECT word, n, """
    + _crc32("doc_id || ':' || word")
    + r""" AS h FROM o),
c AS (SELECT CASE WHEN h % 97 = 0 THEN substr(word, 1, (h % length(word))::BIGINT) || substr(word, (h % length(word))::BIGINT + 2) ELSE word END AS word, n
      FROM h),
v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM c WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
x AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less
      FROM (SELECT word, n, unnest(generate_series(1, length(word))) AS i FROM v)),
near AS MATERIALIZED (
  SELECT a.word, b.word AS other, b.n AS other_n FROM x a JOIN x b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT v.word, x.word, x.n FROM x JOIN v ON x.less = v.word
  UNION SELECT x.word, v.word, v.n FROM x JOIN v ON x.less = v.word),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS most FROM near GROUP BY word),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN most >= 2 * v.n THEN most END::BIGINT AS form_n,
        CASE WHEN most >= 2 * v.n THEN (SELECT min(other) FROM near WHERE near.word = v.word AND near.other_n = best.most) END AS form
      FROM v LEFT JOIN best ON v.word = best.word),
up AS (SELECT word, word AS root FROM f UNION ALL SELECT up.word, f.form FROM up JOIN f ON f.word = up.root WHERE f.form IS NOT NULL),
root AS (SELECT up.word, up.root FROM up JOIN f ON f.word = up.root WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN root ON root.word = f.word
"""
)
