"""Queries of the retrieval strategies over hashed vectors and the stored index."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import fusion as P
from lodestone.operators import rewriting as W
from lodestone.plans.q_dialogue import questions
from lodestone.plans.q_index import _index
from lodestone.plans.q_retrieval import _BM25, _TOK
from lodestone.plans.registry import Tables, query
from lodestone.storage import materialize

K = 10


def _corpus(t: Tables):
    """Vectors of all documents, their language as the collection."""
    return materialize(P.hashed_vectors(t("documents"), "doc_id", None, keep=["lang"], text="text"), "vectors")


def _embedded(variants):
    """query_id, set_idx and query_vector of (query_id, set_idx, query)."""
    held = variants.select(F.struct("query_id", "set_idx").alias("k"), X.tokens("query").alias("tokens"))
    return P.hashed_vectors(held, "k", "tokens").select("k.query_id", "k.set_idx", F.col("embedding").alias("query_vector"))


def _items(t: Tables):
    """Each item as a query: its text, its ten first keywords, and its paraphrase."""
    base = t("benchmark").withColumn("lexical", F.array_join(F.slice(X.keywords("text"), 1, 10), " "))
    return base.select(F.col("item_id").alias("query_id"), F.posexplode(X.expanded_queries("text", "lexical")).alias("set_idx", "query"))


_STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)
_VARIANTS = f"""w AS (SELECT item_id AS query_id, text, list_filter({_TOK}, lambda x: length(x) >= 3 AND x NOT IN ({_STOP})) AS l FROM benchmark), u AS (SELECT query_id, text, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM w),
    f AS (SELECT query_id, [text, array_to_string(l[1:10], ' '), array_to_string(l[1:5], ' ')] AS a FROM u), g AS (SELECT query_id, list_filter(a, lambda x, i: x <> '' AND list_position(a, x) = i) AS a FROM f),
    v AS (SELECT query_id, unnest(range(len(a))) AS set_idx, unnest(a) AS text FROM g)"""
_DENSE = f"""{_VARIANTS}, dim AS (SELECT doc_id, d, count(*) AS c FROM (SELECT doc_id, CAST('0x' || substr(md5(unnest({_TOK})), 1, 6) AS BIGINT) % 64 AS d FROM documents) GROUP BY 1, 2),
    qd AS (SELECT query_id, set_idx, d, count(*) AS c FROM (SELECT query_id, set_idx, CAST('0x' || substr(md5(unnest({_TOK})), 1, 6) AS BIGINT) % 64 AS d FROM v) GROUP BY 1, 2, 3),
    n AS (SELECT doc_id, lang, coalesce((SELECT sum(c * c) FROM dim WHERE dim.doc_id = documents.doc_id), 0) AS s FROM documents), m AS (SELECT query_id, set_idx, coalesce((SELECT sum(c * c) FROM qd WHERE qd.query_id = v.query_id AND qd.set_idx = v.set_idx), 0) AS s FROM v),
    dot AS (SELECT query_id, set_idx, doc_id, sum(qd.c * dim.c) AS p FROM qd JOIN dim USING (d) GROUP BY 1, 2, 3),
    dist AS (SELECT m.query_id, m.set_idx, n.doc_id, n.lang, m.s + n.s - 2 * coalesce(p, 0) AS distance FROM m CROSS JOIN n LEFT JOIN dot ON dot.query_id = m.query_id AND dot.set_idx = m.set_idx AND dot.doc_id = n.doc_id),
    cut AS (SELECT *, row_number() OVER (PARTITION BY query_id, set_idx, lang ORDER BY distance, doc_id) AS r FROM dist), lists AS (SELECT query_id, set_idx, doc_id, distance, row_number() OVER (PARTITION BY query_id, set_idx ORDER BY distance, doc_id) AS rank FROM cut WHERE r <= {K})"""


@query("j03a_parallel", f"WITH {_DENSE} SELECT query_id, doc_id, round(1 / (1 + distance), 8) AS score, rank FROM lists WHERE set_idx = 0 AND rank <= {K}")
def _(t: Tables):
    found = P.search("parallel", _corpus(t), "lang", None, _embedded(_items(t)), None, K)
    return found.select("query_id", "doc_id", F.round("score", 8).alias("score"), F.col("rank").cast("long").alias("rank"))


_FUSED = f"""WITH {_DENSE}, lex AS (SELECT query_id, 99 AS set_idx, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, doc_id) AS rank FROM ({_BM25})),
    every AS (SELECT query_id, set_idx, doc_id, rank FROM lists UNION ALL SELECT query_id, set_idx, doc_id, rank FROM lex WHERE rank <= {2 * K}),
    fused AS (SELECT query_id, doc_id, round(sum(CASE WHEN set_idx = 99 THEN 1.5 ELSE 1 END / CAST(30 + rank AS DOUBLE)), 10) AS score, min(set_idx * 100000 + rank) AS first, count(*) AS appearances, bool_or(set_idx = 99) AS lexical FROM every GROUP BY 1, 2)"""


@query("j04_rag_fusion", f"{_FUSED} SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, doc_id) AS rank FROM fused) WHERE rank <= {K}")
def _(t: Tables):
    asked = t("benchmark").select(F.col("item_id").alias("query_id"), X.tokens("text").alias("terms"))
    found = P.search("rag_fusion", _corpus(t), "lang", _index(t), _embedded(_items(t)), asked, K)
    return found.select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query("e17b_fusion_gain", f"WITH {_DENSE}, o AS (SELECT query_id, doc_id, count(DISTINCT set_idx) AS n, max(CAST(set_idx = 0 AS INT)) AS f FROM lists GROUP BY 1, 2) SELECT query_id, CAST(sum(f) AS BIGINT) AS before, count(*) AS after, count(*) FILTER (n > 1) AS overlap, round((count(*) - sum(f)) * 1.0 / sum(f), 6) AS gain FROM o GROUP BY 1")
def _(t: Tables):
    m = P.fusion_metrics(P.dense_lists(_corpus(t), _embedded(_items(t)), K, "lang"))
    return m.select("query_id", F.col("before").cast("long").alias("before"), "after", "overlap", F.round("gain", 6).alias("gain"))


def _asked_turns(t: Tables):
    """The user turns of every conversation whose id is divisible by 100, rewritten with their whole history."""
    mine = questions(t).where("conv_id % 100 = 0")
    done = W.rewritten(mine, text="q").where("role = 'user'")
    return done.withColumn("query_id", F.col("conv_id") * 1000 + F.col("turn"))


@query("j03b_rewrite")
def _(t: Tables):
    """Turns in their expanded standalone form; the rewriting is tested against a loop, the search has SQL in j03a."""
    asked = _asked_turns(t).select("query_id", F.lit(0).alias("set_idx"), F.col("expanded").alias("query"))
    return P.search("rewrite", _corpus(t), "lang", None, _embedded(asked), None, K).select("query_id", "doc_id", F.round("score", 8).alias("score"), "rank")


@query("j04b_rag_fusion_of_turns")
def _(t: Tables):
    """Rewriting, variants, vectors, lexical index and fusion of conversation turns in one plan."""
    turns = _asked_turns(t).withColumn("v", W.variants("expanded", "lexical", "entities"))
    variants = turns.select("query_id", F.posexplode("v").alias("set_idx", "x")).select("query_id", "set_idx", F.col("x.query").alias("query"))
    asked = turns.select("query_id", X.tokens(X.falsy("lexical", "expanded")).alias("terms"))
    found = P.search("rag_fusion", _corpus(t), "lang", _index(t), _embedded(variants), asked, K)
    return found.select("query_id", "doc_id", "score", "rank")


@query("j03d_adaptive")
def _(t: Tables):
    """Items by as many variants as their confidence asks for."""
    found = P.search("adaptive", _corpus(t), "lang", None, _embedded(_items(t)), None, K)
    return found.select("query_id", "doc_id", "score", "rank", "strategy")
