"""The nearest of many queries: whole numbers by one product, and only what may stay is ordered."""

import numpy as np
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import fusion as P
from lodestone.operators import retrieval as R


def plain(d, ids, k):
    return [(r, i, x) for r in range(len(d)) for x, i in sorted(zip(d[r].tolist(), ids.tolist(), strict=True))[:k]]


def test_best_rows_are_those_of_a_full_order(monkeypatch):
    rng = np.random.default_rng(3)
    d, ids = rng.integers(0, 12, (7, 900)).astype(float), rng.permutation(900)
    ordered, lexsort = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: ordered.append(len(keys[0])) or lexsort(keys))
    best = R._Best(7, 5)
    for lo in range(0, 900, 90):
        best.add(d[:, lo : lo + 90], ids[lo : lo + 90])
    row, x, i = best.rows()
    assert list(zip(row.tolist(), i.tolist(), x.tolist(), strict=True)) == plain(d, ids, 5)
    assert sum(ordered) < d.size / 2  # before, every distance was ordered


def test_unknown_distances_come_last():
    d = np.array([[np.nan, 3.0, np.nan, 1.0], [np.nan, np.nan, np.nan, np.nan]])
    best = R._Best(2, 3)
    best.add(d[:, :3], np.array([1, 2, 3]))
    best.settle()
    best.add(d[:, 3:], np.array([4]))
    row, _, i = best.rows()
    assert list(zip(row.tolist(), i.tolist(), strict=True)) == [(0, 4), (0, 2), (0, 1), (1, 1), (1, 2), (1, 3)]


def test_whole_and_broken_numbers_give_exact_distances(spark):
    rng = np.random.default_rng(4)
    for scale in (1.0, 0.37, 1e9):  # by one product, by dimension, and whole but large
        x = np.floor(rng.integers(0, 40, (300, 6)).astype(float)) * scale
        x = x.astype(np.float32).astype(float)
        rows = spark.createDataFrame([(i, v.tolist(), "ab"[i % 2]) for i, v in enumerate(x)], "vec_id long, embedding array<float>, g string")
        asked = rows.where("vec_id < 9").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
        got = sorted((r.query_id, r.g, r["rank"], r.vec_id, r.distance) for r in R.nearest(rows, asked, 4, groups=["g"]).collect())
        want = []
        for q in range(9):
            d = np.zeros(300)
            for c in range(6):
                d += (x[q, c] - x[:, c]) ** 2
            for g in range(2):
                want += [(q, "ab"[g], n + 1, i, v) for n, (v, i) in enumerate(sorted((d[i], i) for i in range(g, 300, 2))[:4])]
        assert got == sorted(want)
    assert R._whole(np.ones((2, 3))) and not R._whole(np.full((1, 1), 2.0**20)) and not R._whole(np.array([[np.nan]])) and not R._whole(np.array([[0.5]]))


def test_vectors_of_texts_are_those_of_their_words(spark):
    docs = spark.createDataFrame([(1, "a b a Straße", "x"), (2, None, "y"), (3, "", None), (4, "İ 中文 b", "x")], "doc_id long, text string, lang string")
    by_text = P.hashed_vectors(docs, "doc_id", None, keep=["lang"], text="text")
    by_words = P.hashed_vectors(docs.withColumn("tokens", X.tokens("text")), "doc_id", "tokens", keep=["lang"])
    assert sorted(map(str, by_text.collect())) == sorted(map(str, by_words.collect())) and by_text.count() == 4
