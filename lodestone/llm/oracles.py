"""SQL of the registered queries that SQL can express, for DuckDB over the whole tables."""

from __future__ import annotations

WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATE = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS} AS words FROM benchmark),
windows AS (
    SELECT DISTINCT item, least(len(words), 10) AS size, unnest(list_transform(range(1, greatest(len(words) - 9, 1) + 1), lambda p: array_to_string(words[p:p + 9], ' '))) AS win
    FROM items WHERE len(words) > 0),
docs AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS words FROM documents),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
    SELECT r, size, unnest(range(1, len(words) - size + 2)) AS p, unnest(list_transform(range(1, len(words) - size + 2), lambda p: array_to_string(words[p:p + size - 1], ' '))) AS win
    FROM docs, sizes WHERE len(words) >= size),
met AS (SELECT r, p, size, item FROM places JOIN windows USING (size, win)),
hits AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + size)) AS q FROM met) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM met WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN named USING (r)"""

JACCARD = r"""
WITH RECURSIVE docs AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
    FROM documents),
sets AS (
    SELECT r, doc_id, list_distinct(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda p: array_to_string(words[p:p + 4], ' '))
        WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingles
    FROM docs),
held AS (SELECT r, len(shingles) AS n, unnest(shingles) AS shingle FROM sets),
links AS (
    SELECT a.r AS one, b.r AS other FROM held a JOIN held b ON a.shingle = b.shingle AND a.r <> b.r
    GROUP BY a.r, b.r HAVING 100 * count(*) >= 75 * (max(a.n) + max(b.n) - count(*))),
reach AS (SELECT r, r AS at FROM docs UNION SELECT reach.r, links.other FROM reach JOIN links ON reach.at = links.one),
named AS (SELECT reach.r, min(docs.doc_id) AS component_id FROM reach JOIN docs ON docs.r = reach.at GROUP BY reach.r)
SELECT doc_id, len(shingles) AS n_shingles, component_id FROM sets JOIN named USING (r)"""

LINES = """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT r, doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS p FROM docs),
keyed AS (
    SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
shared AS (SELECT k, min(doc_id) AS keeper FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT r, doc_id, p, line, keeper IS NOT NULL AND doc_id IS DISTINCT FROM keeper AS gone FROM keyed LEFT JOIN shared USING (k))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r"""

INTERACTION = r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
words AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM texts),
marked AS (
    SELECT doc_id, part, concat(
        CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END,
        CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END,
        CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END, CASE WHEN doc_id > least THEN 'E' ELSE '' END) AS mask
    FROM words),
known AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
masks AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM marked LEFT JOIN known USING (doc_id) GROUP BY part, mask),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
    SELECT concat(a.x, b.x, c.x, d.x, e.x) AS filter_order FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
gone AS (SELECT part, filter_order, mask, n, good, toxic, list_min(list_transform(string_split(mask, ''), lambda f: strpos(filter_order, f))) AS place FROM masks, orders),
steps AS (
    SELECT part, filter_order, step, substr(filter_order, step, 1) AS f,
        sum(CASE WHEN mask = '' OR place > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask <> '' AND place = step THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN mask <> '' AND place < step AND strpos(mask, substr(filter_order, step, 1)) > 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN mask = substr(filter_order, step, 1) THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN mask <> '' AND place = step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask <> '' AND place = step THEN toxic ELSE 0 END) AS toxic_lost
    FROM gone, (SELECT unnest([1, 2, 3, 4, 5]) AS step) GROUP BY part, filter_order, step)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
    CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM steps"""


def _codes(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Each round's assignment and new codebook as two further tables."""
    steps = []
    for t in range(rounds + 1):
        steps.append(f"""
near{t} AS (
    SELECT r, part, entry, d FROM (SELECT r, part, entry, sum((c.v - b.v) * (c.v - b.v)) AS d FROM cells c JOIN book{t} b USING (part, place) GROUP BY r, part, entry)
    QUALIFY row_number() OVER (PARTITION BY r, part ORDER BY d, entry) = 1)""")
        if t < rounds:
            steps.append(f"""
mean{t} AS (SELECT part, entry, place, sum(v) AS s, count(*) AS n FROM near{t} JOIN cells USING (r, part) GROUP BY part, entry, place),
book{t + 1} AS (SELECT part, entry, place, CASE WHEN n IS NULL THEN v ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS v FROM book{t} LEFT JOIN mean{t} USING (part, entry, place))""")
    return f"""
WITH kept AS (
    SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS r, vec_id, label, embedding AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
width AS (SELECT (max(len(e)) + {parts - 1}) // {parts} AS w FROM kept),
flat AS (SELECT r, unnest(e) AS x, unnest(range(len(e))) AS i FROM kept),
cells AS (SELECT r, i // w AS part, i % w AS place, CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT) AS v FROM flat, width),
book0 AS (SELECT part, r AS entry, place, v FROM cells WHERE r < {entries}),{",".join(steps)},
coded AS (SELECT r, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, place)) FROM book{rounds}) AS codebooks_sha256
FROM kept JOIN coded USING (r)"""


VECTOR_CODES = _codes()
