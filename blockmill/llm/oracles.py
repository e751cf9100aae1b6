"""DuckDB SQL for the queries that SQL can express."""

_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

op7_mix_sources = rf"""
WITH d AS (SELECT doc_id, source, {_WORDS} AS size, md5('7:' || coalesce(doc_id::VARCHAR, md5(text), '')) AS k FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s),
r AS (SELECT *, source_size * 2 AS cap, source_size * 2 / weight AS ratio, 1.5 * sum(source_size) OVER () AS total FROM w),
f AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
  sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM r),
l AS (SELECT arg_min((total - capped) / open, ratio) AS level FROM f WHERE (total - capped) / open <= ratio),
t AS (SELECT source, source_size::BIGINT AS source_size, least(level * weight, cap) AS target FROM f, l),
b AS (SELECT d.*, source_size, target, floor(target)::BIGINT AS budget,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, source,
  CASE WHEN source_size > 0 THEN budget // source_size * size + greatest(0, least(size, budget % source_size - before)) ELSE 0 END::BIGINT AS taken
FROM b
"""

op9_jaccard_components = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * common >= 90 * (x.n + y.n - common)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, least(w.doc_id, min(r.b))::BIGINT AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN r ON w.doc_id = r.a GROUP BY w.doc_id
"""


def _license_sql() -> str:
    """The scan of licenses.py over every text, without ruling any out."""
    from blockmill.llm.licenses import BASE, NOTICES, WORDS, _index

    words, idf = _index()
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    postings = ", ".join(f"({n}, '{w}', {p}, {idf[w]!r}::DOUBLE)" for n, ws in enumerate(words) for p, w in enumerate(ws) if w in idf)
    at = lambda n, key: next(i for i in range(len(words[n])) if words[n][i : i + len(key)] == key)
    facts = ", ".join(f"({n}, '{label}', {quoted(key.split())}, {at(n, key.split())}, {sum(idf.get(w, 0.0) for w in words[n])!r}::DOUBLE)" for n, (label, key, _) in enumerate(NOTICES))
    base = ", ".join(f"({quoted(phrase.split())}, '{label}')" for phrase, label in BASE)
    return rf"""
WITH postings(notice, word, place, idf) AS (VALUES {postings}),
facts(notice, label, phrase, phrase_at, total) AS (VALUES {facts}),
base(phrase, label) AS (VALUES {base}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS ws FROM documents),
w AS (SELECT r, unnest(range(len(ws))) AS pos, unnest(ws) AS word FROM d),
b AS (SELECT w.r, pos, label FROM w JOIN d USING (r) JOIN base ON word = phrase[1] AND ws[pos + 1:pos + len(phrase)] = phrase),
n AS (SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS base FROM b GROUP BY r),
p AS (SELECT r, notice, pos - place AS shift, sum(idf) AS weight FROM w JOIN postings USING (word) GROUP BY ALL),
f AS (SELECT p.r, label, weight / total AS share FROM p JOIN facts USING (notice) JOIN d USING (r)
  WHERE shift + phrase_at >= 0 AND ws[shift + phrase_at + 1:shift + phrase_at + len(phrase)] = phrase),
g AS (SELECT r, list(DISTINCT label) AS found, least(1.0, max(share)) AS score FROM f GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(found, [])))), ','), '') AS labels,
  round(greatest(coalesce(score, 0.0), CASE WHEN n_base > 0 THEN 0.5 ELSE 0.0 END), 6)::DOUBLE AS score
FROM d LEFT JOIN n USING (r) LEFT JOIN g USING (r)
"""


op8_license_scan = _license_sql()
