"""Queries of the stored indexes: inverted index with block-max pruning, cells of vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import cells as C
from lodestone.operators import compounds as K
from lodestone.operators import inverted as V
from lodestone.operators import retrieval as R
from lodestone.plans.q_chunks import _SPLITS
from lodestone.plans.q_retrieval import _BM25, _PAIRS, _TOK, _queries
from lodestone.plans.registry import Tables, query


def _asked(t: Tables):
    return t("benchmark").select(F.col("item_id").alias("query_id"), X.tokens("text").alias("terms"))


def _sizes(t: Tables) -> tuple[int, int]:
    """Documents, and those that have a text."""
    return tuple(t("documents").agg(F.count("*"), F.count("text")).first())


def _index(t: Tables) -> V.InvertedIndex:
    return V.index_texts(t("documents"), *_sizes(t))


@query("b22b_stored_postings", f"SELECT term, count(*) AS df, CAST(sum(n) AS BIGINT) AS cf FROM (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({_TOK}) AS term FROM documents) GROUP BY 1, 2) GROUP BY 1")
def _(t: Tables):
    """Document and corpus frequencies as the stored index gives them, the former also by its postings."""
    index = _index(t)
    held = index.blocks().groupBy("term").agg(F.sum(F.size("postings")).alias("held"))
    return index.terms().join(held, "term").where("held = df").select("term", "df", "cf")


@query("j07b_stored_index_top10", f"SELECT query_id, doc_id, bm25 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, doc_id) AS rank FROM ({_BM25})) WHERE rank <= 10")
def _(t: Tables):
    index = _index(t)
    return V.search(index, _asked(t), 10).select("query_id", "doc_id", "bm25")


_ALL_SPLITS = _SPLITS.replace("FROM conversations", "FROM (SELECT text FROM documents UNION ALL SELECT text FROM benchmark)")
_EXPANDED = f"""WITH sp AS (SELECT word AS term, string_split(parts, '+') AS parts FROM ({_ALL_SPLITS})), d AS (SELECT doc_id, unnest({_TOK}) AS term FROM documents), x AS (FROM d UNION ALL SELECT doc_id, unnest(parts) AS term FROM d JOIN sp USING (term)),
    s AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM x) * 1.0 / (SELECT count(*) FROM documents) AS avgdl), l AS (SELECT doc_id, count(*) AS dl FROM x GROUP BY 1),
    a AS (SELECT item_id AS query_id, unnest({_TOK}) AS term FROM benchmark), q AS (SELECT DISTINCT query_id, term FROM (FROM a UNION ALL SELECT query_id, unnest(parts) AS term FROM a JOIN sp USING (term))),
    h AS (SELECT term, doc_id, count(*) AS tf FROM x WHERE term IN (SELECT term FROM q) GROUP BY 1, 2), f AS (SELECT term, count(*) AS df FROM h GROUP BY 1)
    SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS bm25 FROM q JOIN f USING (term) JOIN h USING (term) JOIN l USING (doc_id), s GROUP BY 1, 2"""


@query("j09_compound_index_top10", f"SELECT query_id, doc_id, bm25 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, doc_id) AS rank FROM ({_EXPANDED})) WHERE rank <= 10")
def _(t: Tables):
    """Texts and queries with the parts of their compounds, in the index and in the search."""
    docs, asked = t("documents"), _asked(t)
    entries = t("benchmark").select(F.explode(X.tokens("text", 3)).alias("entry")).where(F.length("entry") <= 6)
    # a compound has six characters at least
    words = V.different_words(docs, least=6).unionByName(asked.select(F.explode("terms").alias("word")))
    splits = V.materialize(K.split_compounds(words, entries), "splits")
    index = V.index_texts(docs, docs.count(), more=V.compound_parts(docs, splits))
    more = asked.select("query_id", F.explode("terms").alias("term"))
    parts = splits.select(F.col("word").alias("term"), "parts")
    terms = more.unionByName(more.join(parts, "term").select("query_id", F.explode("parts").alias("term"))).groupBy("query_id").agg(F.collect_set("term").alias("terms"))
    return V.search(index, terms, 10).select("query_id", "doc_id", "bm25")


def _vectors(t: Tables):
    rows = t("embeddings")
    cells = C.fit(rows)
    return C.in_cells(rows, cells, keep=["label"]), cells, _queries(t)


@query("j01b_cell_knn")
def _(t: Tables):
    """Approximate: no SQL; its recall is j01c, and its distances are exact."""
    placed, cells, asked = _vectors(t)
    near = C.nearest_in_cells(placed, cells, asked, 10)
    return near.select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round(R.similarity(), 6).alias("score"))


@query("j01c_cell_recall", "SELECT count(*) AS queries, TRUE AS enough FROM embeddings WHERE vec_id % 100 = 0")
def _(t: Tables):
    """Whether the cells find nine in ten of the exact search's neighbours."""
    placed, cells, asked = _vectors(t)
    found = C.nearest_in_cells(placed, cells, asked, 10).select("query_id", "vec_id", F.lit(1).alias("hit"))
    exact = R.nearest(t("embeddings"), asked, 10).select("query_id", "vec_id")
    met = exact.join(found, ["query_id", "vec_id"], "left")
    return met.agg(F.count_distinct("query_id").alias("queries"), (F.sum(F.coalesce("hit", F.lit(0))) >= 0.9 * F.count("*")).alias("enough"))


@query("j02c_cell_collections", f"SELECT query_id, vec_id, label, rank, round(1 / (1 + distance), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY distance, vec_id) AS rank FROM ({_PAIRS})) WHERE rank <= 5")
def _(t: Tables):
    """With all cells probed the search is the exact one of j02, by collection."""
    placed, cells, asked = _vectors(t)
    near = C.nearest_in_cells(placed, cells, asked, 5, probes=len(cells.centres), group="label")
    return near.select("query_id", "vec_id", "label", F.col("rank").cast("long").alias("rank"), F.round(R.similarity(), 6).alias("score"))
