"""What a task of Python holds at a time, and what is never shuffled."""

import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.operators import inverted as V
from lodestone.operators import retrieval as R
from lodestone.storage import PART_MEMBERS, parts


def test_parts_of_long_rows():
    long = ["w"] * (PART_MEMBERS - 1)
    b = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array([long, ["a"], long, None, long, [], ["b"] * 5], pa.list_(pa.string()))], names=["id", "tokens"])
    got = list(parts([b, b.slice(0, 0)], 1))
    assert sum(len(x) for x in got) == 7 and pa.Table.from_batches(got)["id"].to_pylist() == list(range(7))
    assert max(sum(len(t or []) for t in x["tokens"].to_pylist()) for x in got) < 2 * PART_MEMBERS and len(got) > 2


def test_search_makes_no_pairs(spark, monkeypatch):
    """Also with ids that are texts, and with rows that share one."""
    docs = spark.range(300).select(F.concat(F.lit("d"), (F.col("id") % 280).cast("string")).alias("doc_id"), F.array(F.lit("all"), F.concat(F.lit("w"), (F.col("id") % 7).cast("string")), F.concat(F.lit("v"), (F.col("id") % 40).cast("string"))).alias("tokens"))
    asked = spark.createDataFrame([(1, ["all", "w1", "v3"]), (2, ["w2"]), (3, ["none"])], "query_id long, terms array<string>")
    index = V.build(V.term_counts(docs), 300, docs_per_interval=8)
    wanted = V.weights(index, asked)
    every = R.top_k(V.scores(index, wanted, V.bounds(index, wanted)), ["query_id"], [F.desc("bm25"), F.col("doc_id")], 6)
    want = {(r.query_id, r.doc_id, round(r.bm25, 6), r["rank"]) for r in every.collect()}
    monkeypatch.setattr(V, "scores", None)
    monkeypatch.setattr(V, "bounds", None)
    got = {(r.query_id, r.doc_id, round(r.bm25, 6), r["rank"]) for r in V.search(index, asked, 6, block_bytes=1).collect()}
    assert got == want and len(want) == 12


def test_shared_terms(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b", "c", "d"]), (3, None), (4, ["x"])], "doc_id long, tokens array<string>")
    asked = spark.createDataFrame([(1, ["a", "a", "b"]), (2, ["c", "d", "b", "z"])], "query_id long, terms array<string>")
    got = sorted((r.query_id, r.doc_id, r.bm25) for r in R.bm25_top_k(docs, asked, 5, shared=True).collect())
    assert got == [(1, 1, 2.0), (1, 2, 1.0), (2, 1, 1.0), (2, 2, 3.0)]


def test_terms_have_both_frequencies(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b"])], "doc_id long, tokens array<string>")
    index = V.build(V.term_counts(docs), 2)
    assert sorted((r.term, r.df, r.cf) for r in index.terms().collect()) == [("a", 1, 2), ("b", 2, 2)]
