"""Strategies of retrieval: fusion against a loop, dispatch, vectors."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import fusion as P

TOKENS = [["a", "b", "a"], [], None, ["c"] * 5, ["a", "c", "d"], ["b"]]


def vector(tokens):
    out = np.zeros(64)
    for w in tokens or []:
        out[int(hashlib.md5(w.encode()).hexdigest()[:6], 16) % 64] += 1
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.createDataFrame([(i, t, "xy"[i % 2]) for i, t in enumerate(TOKENS)], "doc_id long, tokens array<string>, lang string")
    return P.hashed_vectors(docs, "doc_id", "tokens", keep=["lang"])


def test_vectors(corpus):
    got = {r.doc_id: r.embedding for r in corpus.collect()}
    assert all((np.array(got[i]) == vector(t)).all() for i, t in enumerate(TOKENS))


def asked(spark, texts):
    rows = [(q, s, vector(t.split()).tolist()) for q, s, t in texts]
    return spark.createDataFrame(rows, "query_id long, set_idx int, query_vector array<float>")


def test_strategies(spark, corpus):
    variants = asked(spark, [(7, 0, "a b"), (7, 1, "c"), (9, 0, "c")])
    got = P.search("parallel", corpus, "lang", None, variants, None, 2).collect()
    for q, text in ((7, "a b"), (9, "c")):
        near = lambda group: sorted((((vector(text.split()) - vector(t)) ** 2).sum(), i) for i, t in enumerate(TOKENS) if "xy"[i % 2] == group)[:2]  # noqa: E731, B023
        want = sorted(near("x") + near("y"))[:2]
        assert [(r.doc_id, round(r.score, 9)) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [(i, round(1 / (1 + d), 9)) for d, i in want]
    for name in ("legacy", "LEGACY", "other"):
        with pytest.raises(NotImplementedError):
            P.search(name, corpus, "lang", None, variants, None, 2)
    steps = {(r.query_id, r.strategy) for r in P.search("adaptive", corpus, "lang", None, variants, None, 2, confidence=F.when(F.max("score") > 1 / 31.5, 1.0).otherwise(0.0)).collect()}
    assert all(s.startswith("adaptive_") for _, s in steps) and {q for q, _ in steps} == {7, 9}
    assert P.search("rag_fusion", corpus, "lang", None, variants.limit(0), None, 2).count() == 0


def test_fusion_equals_a_loop(spark):
    rng = random.Random(2)
    lists = {(q, s): rng.sample(range(30), rng.randint(1, 12)) for q in range(6) for s in (0, 1, 2, 99) if rng.random() < 0.8 or s == 0}
    rows = [(q, s, d, 1.0, r) for (q, s), ids in lists.items() for r, d in enumerate(ids, 1)]
    df = spark.createDataFrame(rows, "query_id long, set_idx int, doc_id long, distance double, rank int")
    got = {}
    for r in sorted(P.fuse(df, 8).collect(), key=lambda r: r.rank):
        got.setdefault(r.query_id, []).append((r.doc_id, r.score, sorted(r.retrievers)))
    for q in range(6):
        score, first, by = {}, {}, {}
        for s in (0, 1, 2, 99):
            for r, d in enumerate(lists.get((q, s), []), 1):
                score[d] = score.get(d, 0) + (1.5 if s == 99 else 1) / (30 + r)
                first.setdefault(d, (s, r))
                by.setdefault(d, set()).add("bm25" if s == 99 else f"dense_q{s}")
        want = sorted(score, key=lambda d: (-round(score[d], 10), first[d]))[:8]
        assert [(d, sorted(by[d])) for d in want] == [(d, t) for d, _, t in got[q]]
    m = {r.query_id: r for r in P.fusion_metrics(df).collect()}
    for q in range(6):
        dense = [set(lists.get((q, s), [])) for s in (0, 1, 2)]
        every = set().union(*dense)
        assert (m[q].before, m[q].after, m[q].overlap) == (len(dense[0]), len(every), sum(sum(d in s for s in dense) > 1 for d in every))
