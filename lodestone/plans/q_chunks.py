"""Queries of chunk records, compound words, stems and hashed vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import chunking as C
from lodestone.functions import text as X
from lodestone.operators import compounds as K
from lodestone.plans.registry import Tables, query

_DICT = "SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM benchmark) WHERE length(w) BETWEEN 3 AND 6"
_HALF = "SELECT {k}, x AS a, substr({s}, i + 1) AS rest FROM (SELECT {k}, {s}, i, unnest(CASE WHEN substr({s}, i, 1) = 's' AND i > 3 THEN [substr({s}, 1, i), substr({s}, 1, i - 1)] ELSE [substr({s}, 1, i)] END) AS x FROM (SELECT {k}, {s}, unnest(range(3, length({s}) - 2)) AS i FROM {f} WHERE length({s}) >= 6))"
_SPLITS = f"""WITH d AS ({_DICT}), t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS word FROM conversations), h AS (SELECT word, a, rest FROM ({_HALF.format(k='word', s='word', f='t')}) WHERE a IN (FROM d)),
    two AS (SELECT word, [a, rest] AS parts FROM h WHERE rest IN (FROM d)), g AS (SELECT word, first, a AS b, rest AS c FROM ({_HALF.format(k='word, first', s='r', f='(SELECT word, a AS first, rest AS r FROM h)')})), three AS (SELECT word, [first, b, c] AS parts FROM g WHERE b IN (FROM d) AND c IN (FROM d)),
    s AS (SELECT word, parts, length(array_to_string(parts, '')) / len(parts) - 0.5 * len(parts) AS score FROM (FROM two UNION ALL FROM three)) SELECT word, array_to_string(parts, '+') AS parts, score FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY score DESC, len(parts), length(parts[1]) DESC, array_to_string(parts, ' ') DESC) AS rn FROM s WHERE score > 0) WHERE rn = 1"""


def _splits(t: Tables):
    words = t("conversations").select(F.explode(X.tokens("text")).alias("word"))
    entries = t("benchmark").select(F.explode(X.tokens("text", 3)).alias("entry")).where(F.length("entry") <= 6)
    return K.split_compounds(words, entries)


@query("i20_compound_splits", f"SELECT word, parts, round(score, 6) AS score FROM ({_SPLITS})")
def _(t: Tables):
    return _splits(t).select("word", F.array_join("parts", "+").alias("parts"), F.round("score", 6).alias("score"))


@query("i24_expanded_text", f"SELECT conv_id, CAST(sum(1 + CASE WHEN parts IS NULL THEN 0 ELSE len(string_split(parts, '+')) END) AS BIGINT) AS tokens FROM (SELECT conv_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS word FROM conversations) LEFT JOIN ({_SPLITS}) USING (word) GROUP BY conv_id")
def _(t: Tables):
    tokens = t("conversations").select("conv_id", "turn", F.posexplode(X.tokens("text")).alias("p", "word")).select("conv_id", F.struct("turn", "p").alias("pos"), "word")
    return K.expanded_tokens(tokens, _splits(t), "conv_id").select("conv_id", F.size("tokens").cast("long").alias("tokens"))


@query("i28_sentence_chunks")
def _(t: Tables):
    return C.sentence_chunks(t("documents"), "doc_id")


_STARTS = "SELECT doc_id, source, text, unnest(range(0, CASE WHEN length(text) <= 1000 THEN 1 ELSE CAST(ceil((length(text) - 1000) / 900.0) AS BIGINT) * 900 + 1 END, 900)) AS s FROM documents"


@query("j25_context_chunks", f"SELECT doc_id, md5(string_agg('[CONTEXT] ' || source || ' [TEXT] ' || c, chr(10) ORDER BY s)) AS h FROM (SELECT doc_id, source, s, trim(substr(text, s + 1, 1000), ' ') AS c FROM ({_STARTS})) WHERE c <> '' GROUP BY doc_id")
def _(t: Tables):
    chunks = X.chunks("text", 1000, 100)
    lines = F.transform(chunks, lambda c: C.with_context(F.col("source"), c))
    return t("documents").select("doc_id", lines.alias("l")).where(F.size("l") > 0).select("doc_id", F.md5(F.array_join("l", "\n")).alias("h"))


@query("j28_chunk_records", f"WITH c AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS pos, c FROM (SELECT doc_id, s, trim(substr(text, s + 1, 1000), ' ') AS c FROM ({_STARTS})) WHERE c <> '') SELECT doc_id, pos, greatest(1, length(c) // 4) AS tokens, 'chunk_' || doc_id || '_' || pos || '_' || substr(sha256(lower(trim(regexp_replace(c, '\\s+', ' ', 'g'), ' '))), 1, 12) AS chunk_id FROM c")
def _(t: Tables):
    return C.chunk_records(t("documents"), "doc_id", "text", 1000, 100).select("doc_id", F.col("pos").cast("long").alias("pos"), "tokens", "chunk_id")


@query("j08_stems", "SELECT s AS stem, count(*) AS n FROM (SELECT CASE WHEN length(w) >= 6 THEN regexp_replace(w, '(ingly|edly|ing|ed|ly|es|s)$', '') ELSE w END AS s FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM benchmark)) GROUP BY s")
def _(t: Tables):
    words = t("benchmark").select(F.explode(X.tokens("text")).alias("w"))
    return words.groupBy(C.stem("w").alias("stem")).agg(F.count("*").alias("n"))


@query("l01_hashed_vectors", "SELECT item_id, d AS dim, count(*) AS n FROM (SELECT item_id, CAST('0x' || substr(md5(w), 1, 6) AS BIGINT) % 64 AS d FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM benchmark)) GROUP BY 1, 2")
def _(t: Tables):
    dims = t("benchmark").select("item_id", F.explode(C.hashed_terms(X.tokens("text"), 64)).alias("dim"))
    return dims.groupBy("item_id", F.col("dim").cast("long").alias("dim")).agg(F.count("*").alias("n"))
