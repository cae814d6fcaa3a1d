"""Retrieval strategies over a batch of queries as one plan, with (query, variant) as its unit.

A query is rewritten and expanded to variants; all variants of all queries are
embedded and searched together, by collection; the lexical form is searched in
the inverted index; weighted reciprocal ranks merge the lists of each query.
Nothing loops over queries: a variant is a row, a list is the rows of
(query, set), and fusion is one grouping.

Strategies: ``parallel`` searches the query as it is, ``rewrite`` its expanded
standalone form, ``rag_fusion`` all variants and the lexical index, ``adaptive``
takes steps of more variants and more results until a query's confidence is
enough.  ``legacy`` is refused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.words import text_columns, text_parts, token_columns, words_of
from lodestone.operators import inverted as V
from lodestone.operators import retrieval as R
from lodestone.operators import strategies as S
from lodestone.storage import bounded_batches, materialize

#: Constant of the reciprocal ranks, and weight of the lexical list.
RRF_K, LEXICAL_WEIGHT = 30.0, 1.5
#: Number of the lexical list among a query's lists; variants come before it.
LEXICAL_SET = 99
STRATEGIES = ("parallel", "rewrite", "rag_fusion", "adaptive")


def hashed_vectors(df: DataFrame, key: str, tokens: str | None, dims: int = 64, keep: list[str] | None = None, text: str | None = None) -> DataFrame:
    """``df``'s key, kept columns and ``embedding``: how often words of each hash class stand in the tokens, or in the text.

    The stand-in for an embedding model; any table of vectors can take its place.
    """
    lean = bounded_batches(df.select(key, *(text_columns(text) if tokens is None else token_columns(tokens)), *(keep or [])))
    kinds = dict(lean.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in text_parts(batches, 1, 2):
            length, flat = words_of(b.column(1), b.column(2))
            coded = flat.dictionary_encode()
            held = coded.dictionary.to_pylist()
            new = [w for w in held if w not in known]
            digests = np.frombuffer(b"".join(hashlib.md5(w.encode()).digest() for w in new), np.uint8).reshape(-1, 16).astype(np.int64)
            known.update(zip(new, ((digests[:, 0] << 16 | digests[:, 1] << 8 | digests[:, 2]) % dims).tolist(), strict=True))
            of = np.fromiter(map(known.__getitem__, held), np.int64, len(held))
            if len(known) > 100_000:
                known.clear()
            at = np.repeat(np.arange(len(b)), length) * dims + (of[coded.indices.to_numpy(zero_copy_only=False)] if len(of) else 0)
            counted = np.bincount(at.astype(np.int64), minlength=len(b) * dims).astype(np.float32)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1) * dims, pa.int32()), pa.array(counted))
            yield pa.RecordBatch.from_arrays([b.column(0), vectors, *b.columns[3:]], names=[key, "embedding", *(keep or [])])

    return lean.mapInArrow(run, f"{key} {kinds[key]}, embedding array<float>" + "".join(f", {c} {kinds[c]}" for c in keep or []))


def dense_lists(vectors: DataFrame, variants: DataFrame, k: int, group: str, did: str = "doc_id", qid: str = "query_id", most_sets: int = 8) -> DataFrame:
    """(qid, set_idx, did, distance, rank): k nearest of each collection for every variant, merged by distance.

    ``variants`` has qid, set_idx and query_vector; qid must be a whole number.
    """
    asked = variants.select((F.col(qid) * most_sets + F.col("set_idx")).alias("v"), F.col("query_vector").alias("query"))
    near = R.nearest(vectors, asked, k, vec="embedding", vid=did, qid="v", groups=[group])
    ranked = R.top_k(near.drop("rank"), ["v"], [F.col("distance"), F.col(did)], 1 << 30)
    return ranked.select(F.floor(F.col("v") / most_sets).alias(qid), F.pmod("v", F.lit(most_sets)).cast("int").alias("set_idx"), did, "distance", "rank")


def lexical_lists(index: V.InvertedIndex, queries: DataFrame, k: int, did: str = "doc_id", qid: str = "query_id", terms: str = "terms") -> DataFrame:
    """(qid, set_idx, did, distance, rank) of the lexical index; it has no distance."""
    found = V.search(index, queries, k, qid, did, terms)
    return found.select(qid, F.lit(LEXICAL_SET).alias("set_idx"), did, F.lit(None).cast("double").alias("distance"), "rank")


def fuse(lists: DataFrame, k: int, did: str = "doc_id", qid: str = "query_id", rrf_k: float = RRF_K, lexical_weight: float = LEXICAL_WEIGHT) -> DataFrame:
    """The k best of each query by weighted reciprocal ranks, with what found them; ties to what is first in the first list."""
    weight = F.when(F.col("set_idx") == LEXICAL_SET, lexical_weight).otherwise(1.0)
    tagged = lists.withColumn("tag", F.when(F.col("set_idx") == LEXICAL_SET, "bm25").otherwise(F.concat(F.lit("dense_q"), "set_idx")))
    fused = R.reciprocal_rank_fusion(tagged, qid, did, "set_idx", "rank", rrf_k, weight, "tag").withColumn("score", F.round("rrf_score", 10))
    return R.top_k(fused, [qid], [F.desc("score"), F.col("first_set"), F.col("first_rank"), F.col(did)], k)


def fusion_metrics(lists: DataFrame, did: str = "doc_id", qid: str = "query_id") -> DataFrame:
    """Per query over its dense lists: documents of the first, of all, in several, and the gain of fusion."""
    dense = lists.where(F.col("set_idx") != LEXICAL_SET).groupBy(qid, did).agg(F.count_distinct("set_idx").alias("n"), F.max((F.col("set_idx") == 0).cast("int")).alias("first"))
    out = dense.groupBy(qid).agg(F.sum("first").alias("before"), F.count("*").alias("after"), F.sum((F.col("n") > 1).cast("long")).alias("overlap"))
    gain = F.when(F.col("before") > 0, (F.col("after") - F.col("before")) / F.col("before")).otherwise(0.0)
    return out.withColumn("overlap_ratio", F.col("overlap") / F.col("after")).withColumn("gain", gain)


def first_list(lists: DataFrame, k: int, did: str = "doc_id", qid: str = "query_id") -> DataFrame:
    """The k first of each query's list, with the score of their distance."""
    return lists.where((F.col("set_idx") == 0) & (F.col("rank") <= k)).select(qid, did, R.similarity().alias("score"), "rank")


def search(strategy: str, vectors: DataFrame, group: str, index: V.InvertedIndex | None, variants: DataFrame, lexical: DataFrame | None, k: int, confidence: Column | None = None, did: str = "doc_id", qid: str = "query_id") -> DataFrame:
    """(qid, did, score, rank, strategy) of every query under a strategy.

    variants: qid, set_idx and query_vector; for ``parallel`` and ``rewrite``
    the caller gives the form of set 0.  lexical: qid and terms, searched for
    2 k results.  confidence: an aggregate over a query's fused rows, for
    ``adaptive``.
    """
    if strategy not in STRATEGIES:
        raise NotImplementedError(f"strategy {strategy} is not implemented; there are {', '.join(STRATEGIES)}")
    if strategy in ("parallel", "rewrite"):
        found = first_list(dense_lists(vectors, variants.where("set_idx = 0"), k, group, did, qid), k, did, qid)
        return found.select(qid, did, "score", "rank", F.lit(strategy).alias("strategy"))
    lists = dense_lists(vectors, variants, k, group, did, qid)
    if strategy == "adaptive":
        steps = S.escalate(materialize(lists, "lists"), qid, did, "set_idx", "rank", k, confidence if confidence is not None else F.max("score") * (RRF_K + 1) / 3)
        return steps.select(qid, did, "score", "rank", F.concat(F.lit("adaptive_"), "step").alias("strategy"))
    if index is not None and lexical is not None:
        lists = lists.unionByName(lexical_lists(index, lexical, 2 * k, did, qid))
    return fuse(lists, k, did, qid).select(qid, did, "score", "rank", F.lit(strategy).alias("strategy"))
