"""Stored indexes: what a search reads, results against plain search, awkward rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import cells as C
from lodestone.operators import inverted as V
from lodestone.operators import retrieval as R

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def counted(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", X.tokens("text").alias("tokens"))
    return docs, V.build(V.term_counts(docs), docs.count(), docs_per_interval=4)


def test_search_equals_the_plain_one_and_rules_blocks_out(spark, counted):
    docs, index = counted
    rare = [r.term for r in index.terms().where("df = 1").orderBy("term").limit(3).collect()]
    often = [r.term for r in index.terms().orderBy(F.desc("df"), "term").limit(3).collect()]
    asked = spark.createDataFrame([(1, rare + often[:1]), (2, often), (3, ["not in any text"]), (4, []), (5, rare[:1])], "query_id long, terms array<string>")
    for probe in (1, 4):
        got = {tuple(r) for r in V.search(index, asked, 5, probe=probe).select("query_id", "doc_id", "bm25", "rank").collect()}
        assert got == {tuple(r) for r in R.bm25_top_k(docs, asked, 5).select("query_id", "doc_id", "bm25", "rank").collect()}
    wanted = V.weights(index, asked)
    every = V.bounds(index, wanted).where("query_id = 1")
    best = V.search(index, asked, 1).where("query_id = 1").first()["bm25"]
    assert 0 < every.where(F.col("bound") >= best).count() < every.count() / 2
    one = asked.where("query_id = 5")
    held = V.needed_blocks(index, V.weights(index, one))
    assert "PartitionFilters: [bucket" in held._jdf.queryExecution().toString().replace("isnotnull(bucket), ", "") or held.select("bucket").distinct().count() == 1
    again = V.InvertedIndex.open(spark, index.path)
    assert (again.n_docs, again.avgdl) == (index.n_docs, index.avgdl)


def test_bounds_hold(spark, counted):
    _, index = counted
    asked = spark.createDataFrame([(1, [r.term for r in index.terms().orderBy(F.desc("df"), "term").limit(8).collect()])], "query_id long, terms array<string>")
    wanted = V.weights(index, asked)
    bounds = V.bounds(index, wanted)
    intervals = max(1, -(-index.n_docs // 4))
    scored = V.scores(index, wanted, bounds).withColumn("interval", F.pmod(F.xxhash64("doc_id"), F.lit(intervals)))
    assert scored.join(bounds, ["query_id", "interval"]).where("bm25 > bound + 1e-6").count() == 0


def test_index_of_awkward_rows(spark):
    rows = [(1, ["a", "b", "a"]), (2, None), (3, []), (None, ["a", "c"]), (4, ["c"])]
    docs = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    index = V.build(V.term_counts(docs), 5, 4)
    asked = spark.createDataFrame([(7, ["a", "c", "zz"])], "query_id long, terms array<string>")
    got = {tuple(r) for r in V.search(index, asked, 10).select("doc_id", "bm25").collect()}
    assert got == {tuple(r) for r in R.bm25_top_k(docs, asked, 10).select("doc_id", "bm25").collect()} and {i for i, _ in got} == {1, 4}
    assert V.search(V.build(V.term_counts(docs.limit(0)), 0), asked, 10).count() == 0


def test_compounds_lengthen_only_texts_that_have_them(spark):
    docs = spark.createDataFrame([(1, ["sunflower", "sunflower", "sun"]), (2, ["sun"])], "doc_id long, tokens array<string>")
    splits = spark.createDataFrame([("sunflower", ["sun", "flower"])], "word string, parts array<string>")
    got = {(r.doc_id, r.term): (r.tf, r.dl) for r in V.with_compounds(V.term_counts(docs), splits).collect()}
    assert got == {(1, "sunflower"): (2, 7), (1, "sun"): (3, 7), (1, "flower"): (2, 7), (2, "sun"): (1, 1)}


def clustered(spark, n=3000, dims=8):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, dims)) * 3
    x = centres[rng.integers(0, 20, n)] + rng.normal(size=(n, dims)) * 0.3
    return spark.createDataFrame([(i, v.tolist(), int(i % 3)) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")


def test_few_cells_of_clustered_vectors_suffice(spark):
    rows = clustered(spark)
    cells = C.fit(rows)
    assert cells.probes < len(cells.centres) / 4
    placed = C.in_cells(rows, cells, keep=["label"])
    assert placed.count() == rows.count()
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    exact = {tuple(r) for r in R.nearest(rows, asked, 10).select("query_id", "vec_id").collect()}
    found = {tuple(r) for r in C.nearest_in_cells(placed, cells, asked, 10).select("query_id", "vec_id").collect()}
    assert len(exact & found) >= 0.9 * len(exact)
    by_group = lambda df: {tuple(r) for r in df.select("query_id", "label", "vec_id", "rank").collect()}
    assert by_group(C.nearest_in_cells(placed, cells, asked, 3, probes=len(cells.centres), group="label")) == by_group(R.nearest(rows, asked, 3, groups=["label"]))


def test_cells_of_awkward_rows(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0], 1), (2, [0.0, 0.0], None), (3, None, 1), (None, [1.0, 1.0], 1)], "vec_id long, embedding array<float>, label int")
    cells = C.fit(rows)
    asked = spark.createDataFrame([(9, [0.0, 0.1]), (8, None)], "query_id long, query array<float>")
    got = C.nearest_in_cells(C.in_cells(rows, cells), cells, asked, 5)
    assert [tuple(r) for r in got.select("query_id", "vec_id", "rank").orderBy("rank").collect()] == [(9, 1, 1), (9, 2, 2)]
    assert C.fit(rows.limit(0)).centres.size == 0
