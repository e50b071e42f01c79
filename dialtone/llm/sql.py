"""SQL of the queries that SQL can express, in DuckDB's dialect, written apart from the operators."""

from __future__ import annotations

_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
# kind, pattern, the group whose length counts, its least length
_KINDS = (
    ("assign", _ASSIGN, 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]{24,}", 0, 1),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1), ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1), ("google", "AIza[A-Za-z0-9_-]{35}", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 1),
)
_MATCHES = "\n  UNION ALL ".join(
    f"SELECT path, '{kind}' AS kind, {at} AS kind_at, {least} AS least, string_split_regex(t, '{pattern}') AS gaps, "
    f"regexp_extract_all(t, '{pattern}', 0) AS hits, regexp_extract_all(t, '{pattern}', {group}) AS counted FROM d "
    f"WHERE regexp_matches(t, '{pattern}')"
    for at, (kind, pattern, group, least) in enumerate(_KINDS)
)
SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS path, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({_MATCHES}),
e AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM m),
s AS (
  SELECT path, kind, kind_at, length(counted[i]) >= least AS kept,
    list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS start,
    length(hits[i]) AS size
  FROM e),
p AS (SELECT path, kind, kind_at, CAST(start AS BIGINT) AS start, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + size AS BIGINT) AS place FROM s WHERE kept),
g AS (
  SELECT path, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b, count(*) FILTER (kind = 'hex') AS c,
    string_agg(place, ',' ORDER BY start, kind_at) FILTER (kind_at < 3) AS base, string_agg(place, ',' ORDER BY start, kind_at) AS spans
  FROM p GROUP BY path)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(t) AS blob
FROM d LEFT JOIN g USING (path)
"""

MIXING = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS ord FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][place % 3 + 1] AS DOUBLE) AS weight, [0.5::DOUBLE, -0.5::DOUBLE, 0.25::DOUBLE][place % 3 + 1] AS slope, source_size * 2.0::DOUBLE AS cap FROM t),
l AS (
  SELECT *, row_number() OVER f AS nth,
    ((SELECT sum(source_size) FROM t) * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW f AS (ORDER BY cap / weight, place)),
v AS (SELECT *, least(cap, coalesce((SELECT level FROM l WHERE level * weight <= cap ORDER BY nth LIMIT 1), 'inf'::DOUBLE) * weight) AS target FROM l),
z AS (SELECT sum(target * (1.0::DOUBLE - slope)) AS linear, sum(target * slope) AS square FROM v),
o AS (
  SELECT d.*, source_size, target, slope, sum(size) OVER (PARTITION BY d.source ORDER BY ord, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before
  FROM d JOIN v ON d.source IS NOT DISTINCT FROM v.source),
p AS (
  SELECT *, greatest(0, least(size, floor(target) - before)) AS first_words,
    greatest(0, least(size, floor(target) - before - source_size)) AS repeat_words FROM o),
x AS (
  SELECT *, CASE WHEN slope = 0 THEN before / target ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * (before / target)) - (1 - slope)) / (2 * slope) END AS t1,
    CASE WHEN slope = 0 THEN (before + source_size) / target ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * ((before + source_size) / target)) - (1 - slope)) / (2 * slope) END AS t2
  FROM p WHERE target > 0
  UNION ALL BY NAME SELECT *, NULL AS t1, NULL AS t2 FROM p WHERE NOT target > 0)
SELECT doc_id, size, source_size, target, CAST(first_words + repeat_words AS BIGINT) AS taken,
  CASE WHEN first_words > 0 THEN round(linear * t1 + square * t1 * t1, 3) END AS position,
  CASE WHEN repeat_words > 0 THEN round(linear * t2 + square * t2 * t2, 3) END AS repeat_position
FROM x, z
"""

# name, text of each licence template, as the operator lists them
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: str) -> str:
    return f"regexp_extract_all(translate({text}, '{_UPPER}', '{_LOWER}'), '{_WORD}')"


def _licences(phrases: tuple[tuple[str, str], ...], templates: tuple[tuple[str, str], ...], threshold: float) -> str:
    """Every block against every template, without any filter."""
    listed = lambda rows: ", ".join(f"('{label}', '{text}')" for label, text in rows)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS nr, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT nr, doc_id, t, {_words('t')} AS words FROM d),
p AS (SELECT label, string_split(phrase, ' ') AS parts FROM (VALUES {listed([(b, a) for a, b in phrases])}) v(label, phrase)),
i AS (SELECT nr, words, unnest(range(1, len(words) + 1)) AS i FROM w),
f AS (SELECT nr, label, i - 1 AS start FROM i JOIN p ON words[i] = parts[1] AND words[i:i + len(parts) - 1] = parts),
b AS (SELECT nr, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, list(DISTINCT label) AS base FROM f GROUP BY nr),
l AS (SELECT label, list_distinct({_words('notice')}) AS parts FROM (VALUES {listed(templates)}) v(label, notice)),
k AS (
  SELECT nr, unnest(string_split(t, chr(10))) AS block FROM d
  UNION ALL SELECT nr, unnest(string_split_regex(t, '\n(?:[\x20\x09\x0B-\x0D]*\n)+')) FROM d),
m AS (
  SELECT nr, label, len(list_intersect(parts, words)) / CAST(len(parts) AS DOUBLE) AS share
  FROM (SELECT nr, list_distinct({_words('block')}) AS words FROM k) JOIN l ON list_has_any(words, parts)
  WHERE len(list_intersect(parts, words)) >= {threshold} * len(parts) - 1e-9),
g AS (SELECT nr, max(share) AS share, list(DISTINCT label) AS found FROM m GROUP BY nr)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word,
  CAST(last_word AS BIGINT) AS last_word, array_to_string(list_sort(coalesce(base, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(coalesce(base, []) || coalesce(found, []))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM w LEFT JOIN b USING (nr) LEFT JOIN g USING (nr)
"""


NEAREST = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""

NEAR_COPIES = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) BETWEEN 1 AND 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS shingle FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
k AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
l AS (SELECT x, y FROM k UNION ALL SELECT y, x FROM k),
r AS (SELECT doc_id AS node, doc_id AS seen FROM d UNION SELECT l.y, r.seen FROM r JOIN l ON l.x = r.node)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(seen) AS component_id FROM r GROUP BY 1) USING (doc_id)
"""

EXACT_COPIES = r"""
WITH d AS (
  SELECT row_number() OVER () AS nr, doc_id, length(coalesce(text, '')) AS n_chars,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS content FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY content) AS group_size,
  row_number() OVER w = 1 AS kept, sha256(content) AS text_sha256, n_chars
FROM d WINDOW w AS (PARTITION BY content ORDER BY n_chars DESC, doc_id NULLS LAST, nr)
"""


def oracles() -> dict[str, str]:
    from dialtone.llm.license_scans import PHRASES, TEMPLATES, THRESHOLD

    return {
        "op1_license_scans": _licences(PHRASES, TEMPLATES, THRESHOLD), "op2_secret_scans": SECRETS, "op3_pivot_search": NEAREST,
        "op6_source_mixing": MIXING, "op8_ngram_jaccard_join": NEAR_COPIES,
        "op11_exact_dedup": EXACT_COPIES,
    }
