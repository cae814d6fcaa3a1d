"""Words found in tasks against the expression, and packs of an index against its counts."""

import pyarrow as pa

from lodestone.functions import text as X
from lodestone.functions import words as W
from lodestone.operators import inverted as V


def test_words_are_those_of_the_expression(spark):
    every = "".join(f"{chr(c)}a{chr(c)}{chr(c)} " for c in [*range(1, 0x250), *range(0x2000, 0x2070)] if c != 0x130)
    texts = [every, "", None, "Straße_9 ÉTÉ—fin…", "İstanbul ΣΑΣ", "naïve 中文 x²", "\n", *(f"{chr(c)}x{chr(c)}" for c in (0, 0xAA, 0xB2, 0xBD, 0x130, 0x1C5, 0x37E, 0x301, 0x660, 0x1F600))]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(2)

    def run(batches):
        for b in W.text_parts(batches, 1, 2):
            n, flat = W.words_of(b.column(1), b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array([0, *n.cumsum().tolist()], pa.int32()), flat)], names=["id", "words"])

    columns = rows.select("id", *W.text_columns("text"))
    assert columns.where("plain IS NOT NULL").count() >= 6 and columns.where("words IS NOT NULL").count() >= 6
    got = {r.id: r.words for r in columns.mapInArrow(run, "id int, words array<string>").collect()}
    assert got == {r.id: r.words or [] for r in rows.select("id", X.tokens("text").alias("words")).collect()}


def test_hashes_do_not_depend_on_neighbours():
    words = [f"w{i}" for i in range(5000)] + ["", "é", "é"]
    a = pa.array(words)
    h = W.hashes(a)
    assert len(set(h.tolist())) == 5002 and h[-1] == h[-2]
    assert W.hashes(a.slice(100, 50)).tolist() == h[100:150].tolist() and W.hashes(pa.array([words[7]])).tolist() == [h[7]]
    assert min(map(V.buckets(a[:5000]).tolist().count, range(V.BUCKETS))) > 30


def test_index_of_texts_is_that_of_counts_in_packs(spark):
    texts = [(i, f"all w{i % 7} v{i % 40} Ärger{i % 3} 中文{i % 2}") for i in range(300)] + [(None, "all w1"), (None, "all"), (400, None), (401, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    asked = spark.createDataFrame([(1, ["all", "w1", "v3"]), (2, ["ärger2", "中文1"]), (3, ["none"])], "query_id long, terms array<string>")
    ours = V.index_texts(docs, 304, 303, docs_per_interval=32)
    counted = V.build(V.term_counts(docs.select("doc_id", X.tokens("text").alias("tokens"))), 304, 303, docs_per_interval=32)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert ours.avgdl == counted.avgdl and rows(ours.terms()) == rows(counted.terms())
    assert rows(V.search(ours, asked, 6)) == rows(V.search(counted, asked, 6)) and V.search(ours, asked, 6).count() == 12
    flat = lambda i: sorted((r.term, r.interval, r.largest, p.id, p.impact) for r in i.blocks().collect() for p in r.postings)
    assert flat(ours) == flat(counted) and None not in {x[3] for x in flat(ours)}
    # a row for each interval and bucket at most, not one for each word of a document
    assert ours.packs().count() <= 10 * (V.BUCKETS + 1) < V.term_counts(docs.select("doc_id", X.tokens("text").alias("tokens"))).count()


def test_parts_of_compounds_are_counted(spark):
    docs = spark.createDataFrame([(1, "sunflower Sunflower sun"), (2, "sun flower"), (3, None)], "doc_id long, text string")
    splits = spark.createDataFrame([("sunflower", ["sun", "flower"])], "word string, parts array<string>")
    more = V.compound_parts(docs, splits)
    assert [tuple(r) for r in more.collect()] == [(1, ["sun", "flower"], [2, 2])]
    index = V.index_texts(docs, 3, more=more)
    assert sorted(map(tuple, index.terms().collect())) == [("flower", 2, 3), ("sun", 2, 4), ("sunflower", 1, 2)] and index.avgdl == 3.0
    assert {r.word for r in V.different_words(docs, least=7).collect()} == {"sunflower"}
    assert V.compound_parts(docs, splits.limit(0)).count() == 0
