"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

WORDS = "regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP2 = f"""
WITH d AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS.format('text')} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, len(x) AS n, x[1] AS head, x FROM (
    SELECT item, w[i:i + least(13, len(w)) - 1] AS x
    FROM b, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS t(i) WHERE len(w) > 0)
),
heads AS (SELECT DISTINCT head, n FROM bw),
starts AS (
  SELECT doc_id, pos, word FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d)
  WHERE word IN (SELECT head FROM heads)
),
grams AS (
  SELECT s.doc_id, s.pos, h.n, d.w[s.pos:s.pos + h.n - 1] AS x
  FROM starts s JOIN heads h ON h.head = s.word JOIN d ON d.doc_id = s.doc_id
),
found AS (SELECT DISTINCT g.doc_id, g.pos, g.n, bw.item FROM grams g JOIN bw ON bw.x = g.x),
hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(pos, pos + n - 1)) AS p FROM found) GROUP BY doc_id
),
items AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM found GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
  (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w)) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP6 = """
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
"""

_ASSIGN = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"


def _spans(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    return f"""
SELECT doc_id, {rank} AS rank, '{kind}' AS kind, word, p0 AS start, p0 + length(word) AS stop FROM (
  SELECT doc_id, word, tested, CAST(sum(length(gap)) OVER (PARTITION BY doc_id ORDER BY i)
    + sum(length(word)) OVER (PARTITION BY doc_id ORDER BY i) - length(word) AS BIGINT) AS p0
  FROM (SELECT doc_id, unnest(m) AS word, unnest(t) AS tested, unnest(g[1:len(m)]) AS gap, generate_subscripts(m, 1) AS i FROM (
    SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', {group}) AS t,
      string_split_regex(text, '{pattern}') AS g FROM d) WHERE len(m) > 0)
) WHERE length(tested) >= {least}"""


def _entropy(rank: int, kind: str, pattern: str, bits: float) -> str:
    code = "lower(word)" if kind == "ent_hex" else "word"
    return f"""
SELECT doc_id, {rank} AS rank, '{kind}' AS kind, start + min(i) - 1 AS start, start + max(i) - 1 + 20 AS stop FROM (
  SELECT doc_id, start, i, list_aggregate(string_split(substring({code}, CAST(i AS INT), 20), ''), 'entropy') AS e
  FROM (SELECT doc_id, start, word, unnest(generate_series(1, length(word) - 19)) AS i FROM ({_spans(rank, kind, pattern, 0, 20)})
    WHERE NOT (regexp_matches(word, '^[^0-9]*$') OR regexp_matches(word, '^[0-9_+/=-]*$')
      OR regexp_matches(word, '^[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}$')
      OR regexp_matches(word, '^[A-Za-z]+([-_/][A-Za-z]+)*([-_/]?[0-9]{{1,4}})?$')))
) WHERE e >= {bits} GROUP BY doc_id, start"""


OP7 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
base AS ({_spans(0, 'assign', _ASSIGN, 1, 6)} UNION ALL {_spans(1, 'access', 'AKIA[A-Z0-9]+', 0, 20)} UNION ALL {_spans(2, 'hex', '[0-9a-f]+', 0, 24)}),
spans AS (
  SELECT doc_id, rank, kind, start, stop FROM base
  UNION ALL {_entropy(3, 'ent_hex', '[0-9A-Fa-f]{20,}', 2.9501)}
  UNION ALL {_entropy(4, 'ent_b64', '[A-Za-z0-9+/_=-]{20,}', 3.6501)}
),
found AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3), '') AS b,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS s
  FROM spans GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(b, '')) AS base_sha256, coalesce(s, '') AS spans
FROM d LEFT JOIN found USING (doc_id)
"""



def crc_table() -> list[int]:
    """The remainders of all bytes under the reversed polynomial of crc32."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


_BYTES = "list_transform(generate_series(1, strlen({0})), lambda i: CAST(('0x' || hex(encode({0}))[2 * i - 1:2 * i]) AS BIGINT))"
OP12 = f"""
WITH crc AS (SELECT {crc_table()}::BIGINT[] AS t),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
said AS (SELECT run, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS s, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
h AS (SELECT run, n, xor(list_reduce(list_concat([4294967295], {_BYTES.format('s')}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM said, crc),
w AS (SELECT CASE WHEN h % 31 = 0 THEN substring(run, 1, CAST(h % length(run) AS INT)) || substring(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
k AS (SELECT word, n, 0 AS i, word AS key FROM v UNION ALL SELECT word, n, i, substring(word, 1, CAST(i AS INT) - 1) || substring(word, CAST(i AS INT) + 1) FROM v, unnest(generate_series(1, length(word))) AS g(i)),
near AS (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS m FROM k a JOIN k b ON a.key = b.key AND a.word <> b.word WHERE length(a.word) <> length(b.word) OR a.i = b.i),
best AS (SELECT word, any_value(n) AS n, count(*) AS n_near, max(m) AS top, min(other) FILTER (m = mx) AS other FROM (SELECT *, max(m) OVER (PARTITION BY word) AS mx FROM near) GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * v.n THEN other END AS form, CASE WHEN top >= 10 * v.n THEN top END AS form_n FROM v LEFT JOIN best USING (word)),
{', '.join(f"r{i} AS (SELECT r.word, coalesce(f.form, r.root) AS root FROM r{i - 1} r LEFT JOIN f ON f.word = r.root)" if i else "r0 AS (SELECT word, word AS root FROM f)" for i in range(20))}
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN r19 USING (word)
"""


def _vector_rounds(rounds: int) -> str:
    """Assignments and codebooks of the rounds, then the last assignment."""
    out = []
    for k in range(rounds + 1):
        out.append(f"""
a{k} AS (SELECT vec_id, label, p, x, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
  SELECT s.*, b.e, coalesce(list_sum(list_transform(range(1, len(s.x) + 1), lambda i: (s.x[i] - b.x[i]) * (s.x[i] - b.x[i]))), 0) AS d FROM s JOIN b{k} b USING (p)) GROUP BY vec_id, label, p, x)""")
        if k < rounds:
            out.append(f"""
m{k} AS (SELECT p, e, list(m ORDER BY i) AS x FROM (SELECT p, e, i, CAST(floor(sum(y) / count(*)) AS BIGINT) AS m FROM (
  SELECT p, e, CAST(unnest(x) AS DOUBLE) AS y, generate_subscripts(x, 1) AS i FROM a{k}) GROUP BY p, e, i) GROUP BY p, e),
b{k + 1} AS (SELECT p, e, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN m{k} m USING (p, e))""")
    return ",".join(out)


OP13 = f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT vec_id, label, p, v[p * (len(v) // 8) + 1:(p + 1) * (len(v) // 8)] AS x FROM v, range(8) AS g(p)),
b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM s WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 16)),
{_vector_rounds(6)},
c AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a6 GROUP BY vec_id, label),
books AS (SELECT sha256(coalesce(string_agg(y, ',' ORDER BY p, e), '')) AS codebooks_sha256 FROM (SELECT p, e, array_to_string(x, ',') AS y FROM b6))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c, books
"""

ORACLES = {"op2_decontaminate": OP2, "op6_exact_dedup": OP6, "op7_secret_scan": OP7, "op12_spelling": OP12, "op13_vector_codes": OP13}
