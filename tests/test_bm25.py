"""The blocked top k of BM25 against a plain calculation: ties, repeated rows, nulls, empty tables, many blocks and batches."""

import math
import random
from collections import Counter

import pytest

from lodestone.operators import retrieval as R

DOCS, ASKED = "doc_id long, tokens array<string>", "query_id string, terms array<string>"


def plain(docs, asked, k):
    n, avgdl = len(docs), sum(len(t) for _, t in docs if t is not None) / max(1, sum(t is not None for _, t in docs))
    df = Counter(w for _, t in docs for w in set(t or []))
    terms = {}
    for q, ws in asked:
        terms.setdefault(q, set()).update(w for w in ws or [] if df[w])
    out = {}
    for q, ws in terms.items():
        rows = []
        for i, t in docs:
            tf = Counter(t or [])
            if i is not None and any(tf[w] for w in ws):
                s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(t) / avgdl)) for w in ws if tf[w])
                rows.append((-math.floor(s * 1e6 + 0.5) / 1e6, i))
        out |= {(q, r): (i, s) for r, (s, i) in enumerate(sorted(rows)[:k], 1)}
    return out


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["ö", "the"]
    docs = [(i, [words[min(int(rng.expovariate(0.1)), 61)] for _ in range(rng.randrange(0, 40))]) for i in range(300)]
    docs += [(1000 + i, ["the", "w1", "w2"]) for i in range(20)] + [(None, ["w1", "w1"]), (2000, None), (2001, [])]
    asked = [(f"q{i}", rng.sample(words, rng.randrange(0, 9))) for i in range(25)] + [("same", ["w1", "the", "w1"]), ("same", ["w2"]), ("none", ["absent"]), ("null", None)]
    return docs, asked


@pytest.mark.parametrize("k,block_bytes", [(1, 1), (10, 200), (1000, 1 << 20)])
def test_top_k_equals_plain(spark, k, block_bytes):
    docs, asked = corpus()
    got = R.bm25_top_k(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(asked, ASKED), k, block_bytes=block_bytes).collect()
    expected = plain(docs, asked, k)
    assert len(got) == len(expected)
    for r in got:
        i, s = expected[r.query_id, r["rank"]]
        assert r.doc_id == i and r.bm25 == pytest.approx(-s, abs=1.1e-6)


def test_empty_tables(spark):
    docs, asked = corpus()
    no_docs, no_asked = spark.createDataFrame([], DOCS), spark.createDataFrame([], ASKED)
    assert R.bm25_top_k(no_docs, spark.createDataFrame(asked, ASKED), 5).count() == 0
    assert R.bm25_top_k(spark.createDataFrame(docs, DOCS), no_asked, 5).count() == 0


def test_only_keeps_the_statistics_of_all(spark):
    docs, asked = corpus()
    d, q = spark.createDataFrame(docs, DOCS).where("doc_id IS NOT NULL"), spark.createDataFrame(asked, ASKED)
    few = spark.createDataFrame([(i,) for i in range(0, 300, 7)], "doc_id long")
    whole = {(r.query_id, r.doc_id): r.bm25 for r in R.bm25(d, q).collect() if r.doc_id < 300 and r.doc_id % 7 == 0}
    part = {(r.query_id, r.doc_id): r.bm25 for r in R.bm25(d, q, only=few).collect()}
    assert part.keys() == whole.keys()
    assert all(part[x] == pytest.approx(whole[x]) for x in part)
