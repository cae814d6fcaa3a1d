"""Ranked retrieval: k-nearest neighbours, BM25, rank fusion, tiers, routing, confidence.

Everything takes a batch of queries as a table, so a thousand queries are one
plan; per-query loops become groupings by query_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.storage import bounded_batches, parts

#: Weights of the confidence signals, the penalty for near duplicates, and the tiers' least scores.
CONFIDENCE_WEIGHTS = {"top_score": 0.20, "margin": 0.10, "coverage": 0.25, "lexical": 0.20, "diversity": 0.10, "fusion_gain": 0.15}
NEAR_DUPLICATE_PENALTY = 0.20
TIER_LIMITS = (("high", 0.7), ("medium", 0.5), ("low", 0.3))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, vec: str = "embedding", vid: str = "vec_id", qid: str = "query_id", qvec: str = "query", metric: str = "l2sq", groups: list[str] | None = None, block_bytes: int = 64 << 20) -> DataFrame:
    """The k nearest vectors of each query (and group): exact, by one pass over the vectors for a block of queries.

    Queries travel in blocks of at most ``block_bytes``; each task keeps its k
    best of every query before anything is shuffled.  Ties go to the smaller id.
    metric: l2sq, cosine or ip (smaller is nearer).
    """
    groups = groups or []
    spark = vectors.sparkSession
    lean = bounded_batches(vectors.select(F.col(vid).cast("long").alias(vid), vec, *groups).where(F.col(vec).isNotNull() & F.col(vid).isNotNull()))
    kinds = {f.name: f.dataType.simpleString() for f in lean.schema.fields}
    shape = f"{qid} long, {vid} long, distance double" + "".join(f", {g} {kinds[g]}" for g in groups)

    def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
        if metric == "l2sq":
            d = np.zeros((len(q), len(x)))
            for a, c in zip(q.T, x.T, strict=True):  # by dimension: differences never cancel, and no array has three sides
                d += (a[:, None] - c[None, :]) ** 2
            return d
        if metric == "cosine":
            return 1 - (q @ x.T) / np.maximum(np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :], 1e-300)
        return 1 - q @ x.T

    def search(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            # of whole numbers, one product gives exact distances at a tenth of the work
            left = np.hstack([-2 * q, (q * q).sum(axis=1)[:, None], np.ones((len(q), 1))]) if metric == "l2sq" and _whole(q) else None
            best: dict[tuple, _Best] = {}
            for b in batches:
                if not len(b):
                    continue
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(b), -1)
                right = np.hstack([x, np.ones((len(x), 1)), (x * x).sum(axis=1)[:, None]]) if left is not None and _whole(x) else None
                own = b.column(0).to_numpy()
                names = list(zip(*(b.column(2 + i).to_pylist() for i in range(len(groups))), strict=True)) if groups else [()] * len(b)
                step = max(1, (1 << 21) // len(q))  # at most 16 MB of distances at a time
                places: dict[tuple, list[int]] = {}
                for i, name in enumerate(names):
                    places.setdefault(name, []).append(i)
                for name, every in places.items():
                    held = best.setdefault(name, _Best(len(q), k))
                    for lo in range(0, len(every), step):
                        at = np.array(every[lo : lo + step])
                        held.add(distances(q, x[at]) if right is None else left @ right[at].T, own[at])
            for name, held in best.items():
                row, d, i = held.rows()
                extra = [pa.array([v] * len(row), b.schema.field(2 + g).type) for g, v in enumerate(name)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(i), pa.array(d), *extra], names=[qid, vid, "distance", *groups])

        return run

    out = None
    for block in _query_blocks(queries.select(F.col(qid).cast("long").alias(qid), qvec), qid, qvec, block_bytes):
        part = lean.mapInArrow(search(spark.sparkContext.broadcast(block)), shape)  # at most block_bytes
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], shape)
    return top_k(out, [qid, *groups], [F.col("distance"), F.col(vid)], k)


def _whole(x: np.ndarray) -> bool:
    """Whether all values are whole, and small and few enough for sums of their products to be exact in any order."""
    return x.shape[1] <= 1 << 12 and bool((np.abs(x) <= 1 << 19).all() and (x == np.rint(x)).all())


class _Best:
    """The k nearest of each query among the rows seen so far; ties go to the smaller id.

    A row farther than a query's k-th nearest is dropped by one comparison, so
    only what may stay is ordered.
    """

    def __init__(self, n: int, k: int):
        self.k, self.limit = k, np.full(n, np.inf)
        self.row, self.distance, self.id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_waiting = 0

    def add(self, d: np.ndarray, ids: np.ndarray) -> None:
        far = d > self.limit[:, None]
        if d.shape[1] > self.k and d.size - np.count_nonzero(far) > 2 * self.k * len(d):  # the first rows: no query has a limit yet
            far |= d > np.partition(d, self.k - 1, axis=1)[:, self.k - 1, None]
        row, at = np.nonzero(~far)
        self.waiting.append((row, d[row, at], ids[at]))
        self.n_waiting += len(row)
        if self.n_waiting > self.k * len(self.limit):
            self.settle()

    def settle(self) -> None:
        row, d, i = (np.concatenate(x) for x in zip((self.row, self.distance, self.id), *self.waiting, strict=True))
        order = np.lexsort((i, d, row))
        nth = np.arange(len(order)) - np.searchsorted(row[order], row[order], "left")
        last = order[nth == self.k - 1]
        self.limit[row[last]] = np.where(np.isnan(d[last]), np.inf, d[last])
        order = order[nth < self.k]
        self.row, self.distance, self.id, self.waiting, self.n_waiting = row[order], d[order], i[order], [], 0

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.settle()
        return self.row, self.distance, self.id


def _query_blocks(queries: DataFrame, qid: str, qvec: str, block_bytes: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ids: list[int] = []
    rows: list[list[float]] = []
    for r in queries.where(F.col(qvec).isNotNull()).toLocalIterator():
        ids.append(r[qid])
        rows.append(r[qvec])
        if 8 * len(rows) * len(rows[0]) >= block_bytes:
            yield np.array(ids), np.array(rows, np.float64)
            ids, rows = [], []
    if ids:
        yield np.array(ids), np.array(rows, np.float64)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key in ``order``, numbered from 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def similarity(distance: Column | str = "distance") -> Column:
    """Score of a distance, in (0, 1]."""
    return 1.0 / (1.0 + (F.col(distance) if isinstance(distance, str) else distance))


def best_per_id(df: DataFrame, keys: list[str], score: str, order: list[Column]) -> DataFrame:
    """One row a key: the highest score, then the first in ``order``.  An aggregate, combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct((-F.col(score)).alias("_s"), *order)).alias("_r"))
    return picked.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def reciprocal_rank_fusion(lists: DataFrame, qid: str, did: str, set_idx: str, rank: str, k: float = 60.0, weight: Column | None = None, tag: str | None = None) -> DataFrame:
    """Fused score of every document of every query: the sum of weight / (k + rank) over its lists.

    first_set and first_rank tell where the document stands first, which breaks ties.
    """
    share = (weight if weight is not None else F.lit(1.0)) / (F.lit(float(k)) + F.col(rank))
    more = [F.array_sort(F.collect_set(tag)).alias("retrievers")] if tag else []
    first = F.min(F.struct(set_idx, rank))
    return lists.groupBy(qid, did).agg(F.sum(share).alias("rrf_score"), F.count("*").alias("appearances"), first[set_idx].alias("first_set"), first[rank].alias("first_rank"), *more)


def with_tier(df: DataFrame, key: str, tiers: dict[str, int], default: int = 3) -> DataFrame:
    """``df`` with the source tier of ``key``; a few literal cases, no join."""
    case = None
    for name, tier in tiers.items():
        case = F.when(F.col(key) == name, tier) if case is None else case.when(F.col(key) == name, tier)
    return df.withColumn("tier", case.otherwise(default) if case is not None else F.lit(default))


def threshold_with_fallback(df: DataFrame, keys: list[str], score: str, rank: str, threshold: float, fallback: int = 3) -> DataFrame:
    """Rows at or above the threshold; for keys without any, the first few by rank."""
    any_good = F.max((F.col(score) >= threshold).cast("int")).over(Window.partitionBy(*keys))
    return df.withColumn("_g", any_good).where((F.col(score) >= threshold) | ((F.col("_g") == 0) & (F.col(rank) <= fallback))).drop("_g")


def postings(documents: DataFrame, did: str, tokens: str) -> tuple[DataFrame, DataFrame]:
    """(term, did, tf) and (did, dl) of tokenised documents."""
    lengths = documents.select(did, F.size(tokens).alias("dl"))
    terms = documents.select(did, F.explode(tokens).alias("term")).groupBy("term", did).agg(F.count("*").alias("tf"))
    return terms, lengths


def corpus_statistics(documents: DataFrame, tokens: str) -> DataFrame:
    """One row: n_docs and avgdl."""
    return documents.agg(F.count("*").alias("n_docs"), F.avg(F.size(tokens)).alias("avgdl"))


def term_weights(documents: DataFrame, queries: DataFrame, stats: DataFrame, tokens: str, qid: str, terms: str) -> DataFrame:
    """(qid, term, idf) of the query terms that some document has.

    idf = ln(1 + (N - df + 0.5) / (df + 0.5)), counted over all documents.
    """
    wanted = queries.select(qid, F.explode(F.array_distinct(terms)).alias("term")).distinct()
    held = documents.select(F.explode(F.array_distinct(tokens)).alias("term")).join(wanted.select("term").distinct(), "term", "left_semi")
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return wanted.join(df, "term").join(F.broadcast(stats)).select(qid, "term", idf.alias("idf"))  # one row of statistics


def bm25(documents: DataFrame, queries: DataFrame, did: str = "doc_id", tokens: str = "tokens", qid: str = "query_id", terms: str = "terms", k1: float = 1.2, b: float = 0.75, only: DataFrame | None = None) -> DataFrame:
    """BM25 score of every document that has a term of a query; for the best few of each query see ``bm25_top_k``.

    Documents are cut to the query terms by a semi-join before they are counted,
    so postings of other terms are never built.  ``only`` (a table of ids) cuts
    them further; frequencies and lengths are those of all documents.
    """
    stats = corpus_statistics(documents, tokens)
    weights = term_weights(documents, queries, stats, tokens, qid, terms)
    base = documents.select(did, tokens, F.size(tokens).alias("dl"))
    if only is not None:
        base = base.join(only, did, "left_semi")
    hits = base.select(did, "dl", F.explode(tokens).alias("term")).join(weights.select("term").distinct(), "term", "left_semi").groupBy("term", did).agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return weights.join(hits, "term").join(F.broadcast(stats)).groupBy(qid, did).agg(F.sum(part).alias("bm25"))  # one row of statistics


def bm25_top_k(documents: DataFrame, queries: DataFrame, k: int, did: str = "doc_id", tokens: str = "tokens", qid: str = "query_id", terms: str = "terms", k1: float = 1.2, b: float = 0.75, digits: int = 6, block_bytes: int = 16 << 20, shared: bool = False) -> DataFrame:
    """The k best documents of each query by BM25 rounded to ``digits``, ties to the smaller id: exact, ranked from 1.

    shared: the number of the query's terms that a document has, in place of BM25.

    Queries travel in blocks of at most ``block_bytes`` of terms, each one pass
    over the documents; a task keeps its k best of every query, so pairs of
    query and document are never shuffled.  Each row of ``documents`` is a
    document; rows without an id are left out, but counted.
    """
    spark = documents.sparkSession
    n_docs, avgdl = corpus_statistics(documents, tokens).first()
    counted = spark.range(1).select(F.lit(n_docs).alias("n_docs"))
    weights = term_weights(documents, queries, counted, tokens, qid, terms)
    shape = f"{qid} {queries.schema[qid].dataType.simpleString()}, {did} long, bm25 double"
    lean = bounded_batches(documents.where(F.col(did).isNotNull()).select(F.col(did).cast("long").alias(did), tokens))

    def search(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, words, idf, ends, asking = block.value
            words = pa.array(words, pa.string())
            best = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)  # query, score, id
            step = max(1, (1 << 21) // len(names))  # at most 16 MB of scores at a time
            for batch in parts(batches, 1):
                for lo in range(0, len(batch), step):
                    part = batch.slice(lo, step)
                    n, ids = len(part), part.column(0).to_numpy()
                    length = pc.fill_null(pc.list_value_length(part.column(1)), 0).to_numpy().astype(np.int64)
                    at = pc.fill_null(pc.index_in(part.column(1).flatten(), value_set=words), -1).to_numpy().astype(np.int64)
                    posting, tf = np.unique((at * n + np.repeat(np.arange(n), length))[at >= 0], return_counts=True)
                    term, doc = posting // n, posting % n
                    weight = np.ones(len(term)) if shared else idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[doc] / avgdl))
                    scores = np.zeros((len(names), n))
                    cuts = np.flatnonzero(np.diff(term, prepend=-1, append=-1)).tolist()
                    for x, y in zip(cuts, cuts[1:]):
                        w = term[x]
                        scores[np.ix_(asking[ends[w] : ends[w + 1]], doc[x:y])] += weight[x:y]
                    hit = scores > 0  # every idf is above zero
                    scores = np.floor(scores * 10**digits + 0.5) / 10**digits
                    if n > k:
                        hit &= scores >= np.partition(scores, n - k, axis=1)[:, n - k, None]
                    q, d = np.nonzero(hit)
                    q, s, i = np.concatenate([best[0], q]), np.concatenate([best[1], scores[q, d]]), np.concatenate([best[2], ids[d]])
                    order = np.lexsort((i, -s, q))
                    first = np.searchsorted(q[order], q[order], "left")
                    order = order[np.arange(len(order)) - first < k]
                    best = q[order], s[order], i[order]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(best[0])), pa.array(best[2]), pa.array(best[1])], names=[qid, did, "bm25"])

        return run

    out = None
    for block in _term_blocks(weights, qid, block_bytes):
        part = lean.mapInArrow(search(spark.sparkContext.broadcast(block)), shape)  # at most block_bytes of terms
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], shape)
    return top_k(out, [qid], [F.desc("bm25"), F.col(did)], k)


def _term_blocks(weights: DataFrame, qid: str, block_bytes: int) -> Iterator[tuple[pa.Array, list[str], np.ndarray, np.ndarray, np.ndarray]]:
    """Query ids, terms, their idf, and the queries of each term end to end with the places where they begin."""

    def block(rows):
        idf = {w: v for r in rows for w, v in r["held"]}
        place = {w: i for i, w in enumerate(idf)}
        pairs = np.array([(place[w], q) for q, r in enumerate(rows) for w, _ in r["held"]])
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        return pa.array([r[qid] for r in rows]), list(idf), np.array(list(idf.values())), np.searchsorted(pairs[:, 0], np.arange(len(idf) + 1)), pairs[:, 1]

    rows, held = [], 0
    for r in weights.groupBy(qid).agg(F.collect_list(F.struct("term", "idf")).alias("held")).toLocalIterator():  # a row holds one query's terms
        rows.append(r)
        held += sum(len(w.encode()) + 16 for w, _ in r["held"])
        if held >= block_bytes:
            yield block(rows)
            rows, held = [], 0
    if rows:
        yield block(rows)


def confidence(ranked: DataFrame, qid: str, score: str, rank: str, text: str, title: str, must: Column, words: Column, gain: Column | None = None) -> DataFrame:
    """Confidence signals of each query over its first 10 results, and their weighted sum.

    ``must`` and ``words`` (arrays, one value a query) are sought in the joined
    texts; near duplicates share the first 50 characters of their titles and are
    counted against all results.
    """
    head = F.col(rank) <= 10
    seen = F.row_number().over(Window.partitionBy(qid, F.substring(F.lower(F.trim(title)), 1, 50)).orderBy(rank))
    marked = ranked.withColumn("_again", (head & (seen > 1)).cast("int")).withColumn("_must", must).withColumn("_words", words).withColumn("_gain", gain if gain is not None else F.lit(0.0))
    one = marked.groupBy(qid).agg(
        F.count("*").alias("n"), F.max(F.when(F.col(rank) == 1, F.col(score))).alias("top_score"), F.max(F.when(F.col(rank) == 2, F.col(score))).alias("_second"),
        (F.max(F.when(head, F.col(score))) - F.min(F.when(head, F.col(score)))).alias("_range"),
        F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(head, F.struct(rank, text)))), lambda x: x[text]), " ")).alias("_text"),
        F.sum("_again").alias("_dups"), F.first("_must").alias("_must"), F.first("_words").alias("_words"), F.max("_gain").alias("fusion_gain"),
    )
    share = lambda a: F.when(F.size(a) > 0, F.size(F.filter(a, lambda x: F.contains(F.col("_text"), F.lower(x)))) / F.size(a)).otherwise(F.lit(1.0))
    signals = one.select(
        qid, "n", "top_score", F.when((F.col("n") > 1) & (F.col("_range") > 0), (F.col("top_score") - F.col("_second")) / F.col("_range")).otherwise(0.0).alias("margin"),
        share("_must").alias("coverage"), share("_words").alias("lexical"), (F.col("_dups") / F.col("n")).alias("near_dup_ratio"), "fusion_gain",
    ).withColumn("diversity", 1 - F.col("near_dup_ratio"))
    total = sum((F.lit(w) * F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0)) for c, w in CONFIDENCE_WEIGHTS.items()), F.lit(0.0))
    overall = F.least(F.greatest(total - F.lit(NEAR_DUPLICATE_PENALTY) * F.col("near_dup_ratio"), F.lit(0.0)), F.lit(1.0))
    return signals.withColumn("confidence", overall).withColumn("tier", tier_label(F.col("confidence")))


def tier_label(score: Column) -> Column:
    case = None
    for name, least in TIER_LIMITS:
        case = F.when(score >= least, name) if case is None else case.when(score >= least, name)
    return case.otherwise("very_low")


def escalation_reasons(**checks: tuple[Column, str]) -> Column:
    """The texts of the checks that hold, joined."""
    return F.array_join(F.array_compact(F.array(*(F.when(c, F.lit(s)) for c, s in checks.values()))), "; ")


def two_pass(ranked: DataFrame, qid: str, collection: str, score: str, order: str, primary: Column, secondary: Column, budget: Column, k: int, tiers: dict[str, int], least: float = 0.30) -> DataFrame:
    """First pass from primary collections, second within a budget; least score; tier, then score; k.

    primary, secondary: boolean columns of a row; budget: rows of the second pass.
    """
    both = ranked.withColumn("_p", F.when(primary, 1).when(secondary, 2)).where("_p IS NOT NULL")
    nth = F.row_number().over(Window.partitionBy(qid, "_p").orderBy(F.desc(score), F.col(order)))
    cut = both.withColumn("_n", nth).where((F.col("_p") == 1) | (F.col("_n") <= budget)).where(F.col(score) >= least)
    return top_k(with_tier(cut, collection, tiers), [qid], [F.col("tier"), F.desc(score), F.col(order)], k).drop("_n").withColumnRenamed("_p", "pass")
