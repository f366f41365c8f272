"""DuckDB statements of the operators that SQL can express, by brute force:
every template against every document, without bands, hashes or broadcasts."""

from __future__ import annotations

from prefscan.llm import divergence, licences, templates, vectorcodes


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def licence_scan() -> str:
    rows = ", ".join(f"({_text(k)}, {_text(v)})" for k, v in licences.TEMPLATES.items())
    words = r"string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ')"
    n = licences.SHINGLE
    grams = f"unnest(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(list_slice(w, i, i + {n - 1}), ' ')))"
    return f"""
WITH templates(licence, text) AS (VALUES {rows}),
tw AS (SELECT licence, {words} AS w FROM templates),
ts AS (SELECT DISTINCT licence, s FROM (SELECT licence, {grams} AS s FROM tw)),
totals AS (SELECT licence, count(*) AS shingles FROM ts GROUP BY licence),
dw AS (SELECT doc_id, {words} AS w FROM documents),
ds AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, {grams} AS s FROM dw)),
found AS (SELECT doc_id, licence, count(*) AS matched FROM ds JOIN ts USING (s) GROUP BY ALL)
SELECT doc_id, licence, matched, shingles, round(matched / shingles, 6) AS containment
FROM found JOIN totals USING (licence) WHERE matched / shingles >= {licences.THRESHOLD}
"""


def decontamination() -> str:
    units = ", ".join(map(_text, templates.UNITS))
    n, least = templates.WINDOW, templates.THRESHOLD

    def side(name: str, key: str, table: str) -> str:
        return rf"""
{name}_parts AS (
  SELECT {key}, i - 1 AS pos, regexp_extract(parts[i], '^[^\p{{L}}\p{{N}}]*') AS sep,
         regexp_extract(parts[i], '[\p{{L}}\p{{N}}]+$') AS word, regexp_matches(parts[i - 1], '(^|[^\p{{L}}\p{{N}}])\p{{N}}[\p{{L}}\p{{N}}]*$') AS after_number
  FROM (SELECT {key}, regexp_extract_all(coalesce(text, ''), '[^\p{{L}}\p{{N}}]*[\p{{L}}\p{{N}}]+') AS parts FROM {table}),
       LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i)),
{name}_words AS (
  SELECT {key}, pos, lower(word) AS word, CASE
    WHEN regexp_matches(word, '^\p{{N}}') THEN '0'
    WHEN pos > 0 AND after_number AND sep = ' ' AND lower(word) IN ({units}) THEN '0u'
    WHEN pos > 0 AND length(sep) BETWEEN 1 AND 3 AND NOT regexp_matches(sep, '[.!?:\n]')
         AND regexp_matches(word, '^\p{{Lu}}') THEN '0n'
    ELSE lower(word) END AS c
  FROM {name}_parts),
{name}_lists AS (SELECT {key}, list(c ORDER BY pos) AS w FROM {name}_words GROUP BY {key}),
{name}_windows AS (
  SELECT {key}, i - 1 AS pos, array_to_string(list_slice(w, i, i + {n - 1}), ' ')
         || CASE WHEN len(w) < {n} THEN '|' ELSE '' END AS h
  FROM {name}_lists, LATERAL (SELECT unnest(range(1, greatest(len(w) - {n} + 1, 1) + 1)) AS i))"""
    return f"""
WITH {side("b", "item_id", "benchmark")},
{side("d", "doc_id", "documents")},
totals AS (SELECT item_id, count(DISTINCT h) AS windows FROM b_windows GROUP BY item_id),
hits AS (SELECT DISTINCT doc_id, item_id, h, d.pos - b.pos AS shift FROM d_windows d JOIN b_windows b USING (h)),
found AS (
  SELECT doc_id, item_id, matched, windows, matched / windows AS containment
  FROM (SELECT doc_id, item_id, count(DISTINCT h) AS matched FROM hits GROUP BY ALL) JOIN totals USING (item_id)
  WHERE matched / windows >= {least}),
best AS (
  SELECT doc_id, item_id, shift FROM (SELECT doc_id, item_id, shift, count(*) AS n FROM hits GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n DESC, shift) = 1),
pairs AS (
  SELECT doc_id, item_id, b.word AS mine, d.word AS theirs, count(*) AS n
  FROM found JOIN best USING (doc_id, item_id) JOIN b_words b USING (item_id)
  LEFT JOIN d_words d ON d.doc_id = found.doc_id AND d.pos = b.pos + best.shift
  WHERE b.c LIKE '0%' GROUP BY ALL),
agree AS (
  SELECT doc_id, item_id, sum(n)::BIGINT AS slots, sum(most)::BIGINT AS agreeing FROM (
    SELECT doc_id, item_id, mine, sum(n) AS n, max(CASE WHEN theirs IS NULL THEN 0 ELSE n END) AS most
    FROM pairs GROUP BY ALL) GROUP BY ALL)
SELECT doc_id, item_id, matched, windows, round(containment, 6) AS containment, coalesce(slots, 0) AS slots,
       coalesce(agreeing, 0) AS agreeing, round(coalesce(agreeing / slots, 1.0), 6) AS consistency
FROM found LEFT JOIN agree USING (doc_id, item_id) WHERE coalesce(agreeing / slots, 1.0) >= {least}
"""


def vector_codes() -> str:
    """Lloyd rounds one by one, every part against every entry."""
    parts, entries, scale = vectorcodes.PARTS, vectorcodes.ENTRIES, vectorcodes.SCALE

    def assigned(r: int) -> str:
        return f"""
far{r} AS MATERIALIZED (
  SELECT id, p, e, sum((v - c) * (v - c))::HUGEINT AS d FROM comps JOIN book{r} USING (p, i) GROUP BY id, p, e),
near{r} AS MATERIALIZED (
  SELECT id, p, min(d * {entries} + e) % {entries} AS e, min(d) AS d FROM far{r} GROUP BY id, p)"""

    def moved(r: int) -> str:
        return f"""
sums{r} AS (SELECT p, e, i, sum(v)::HUGEINT AS s, count(*) AS n FROM near{r} JOIN comps USING (id, p) GROUP BY p, e, i),
book{r + 1} AS MATERIALIZED (
  SELECT p, e, i, CASE WHEN s.n IS NULL THEN c ELSE (s.s - (s.s % s.n + s.n) % s.n) // s.n END::BIGINT AS c
  FROM book{r} LEFT JOIN sums{r} s USING (p, e, i))"""
    rounds = ",".join(assigned(r) + "," + moved(r) for r in range(vectorcodes.ROUNDS))
    last = vectorcodes.ROUNDS
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, label, len(embedding) // {parts} AS width,
         list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
comps AS MATERIALIZED (
  SELECT id, (j - 1) // width AS p, (j - 1) % width AS i, v
  FROM (SELECT id, width, unnest(range(1, len(q) + 1)) AS j, unnest(q) AS v FROM kept)),
book0 AS MATERIALIZED (SELECT p, id - 1 AS e, i, v AS c FROM comps WHERE id <= {entries}),{rounds},{assigned(last)},
words AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM book{last}),
codes AS (
  SELECT id, string_agg(lpad(lower(to_hex(e::BIGINT)), 2, '0'), '' ORDER BY p) AS code, sum(d)::BIGINT AS error
  FROM near{last} GROUP BY id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM codes JOIN kept USING (id), words
"""


def source_divergence() -> str:
    """Every term of a language against every group and every pair of its sources."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
words AS (SELECT id, lang, source, unnest(words) AS term FROM docs),
kept AS MATERIALIZED (
  SELECT lang, term, count(*) AS total FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= {divergence.MIN_DOCS}),
langs AS MATERIALIZED (
  SELECT lang, coalesce(sum(total), 0)::HUGEINT AS lang_n, count(total)::HUGEINT AS v
  FROM (SELECT DISTINCT lang FROM docs) LEFT JOIN kept USING (lang) GROUP BY lang),
held AS (SELECT lang, source, term, count(*) AS c FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, source, sum(c) AS n FROM held GROUP BY ALL),
groups AS MATERIALIZED (
  SELECT lang, source, coalesce(n, 0)::HUGEINT AS n, lang_n, v
  FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN sizes USING (lang, source) JOIN langs USING (lang)),
dense AS MATERIALIZED (
  SELECT lang, source, term, coalesce(c, 0) AS c, 1 + 1000000000 * (coalesce(c, 0) + 2)::HUGEINT // (n + 2 * v) AS p,
         1 + 1000000000 * (total + 2)::HUGEINT // (lang_n + 2 * v) AS q
  FROM groups JOIN kept USING (lang) LEFT JOIN held USING (lang, source, term)),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value
  FROM dense WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value,
       (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
QUALIFY part = 'pair' OR rank <= {divergence.TOP}
"""
