"""The pipeline's stages, each judged on its own input."""

import corpus_pipeline as P
from lodestone.llm import decontaminate, jaccard, quality
from lodestone.llm.registry import queries
from lodestone.storage import materialize

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{DIR}/{n}.parquet") for n in ("labels", "benchmark"))
    columns = docs.columns
    tables = [docs]
    for name, stage in P.STAGES:
        tables.append(materialize(stage(spark, tables[-1], DIR), name))
        assert tables[-1].columns == columns or name == "packing"
    ids = [{r.doc_id for r in t.select("doc_id").collect()} for t in tables]
    good = {r.doc_id for r in quality.score_documents(docs, labels).where("predicted = 1").collect()}
    assert ids[1] == good
    assert ids[2] == {r.doc_id for r in jaccard.components(tables[1]).where("doc_id = component_id").collect()}
    assert ids[3] <= ids[2]
    assert ids[4] == {r.doc_id for r in decontaminate.contamination_report(tables[3], bench).where("NOT contaminated").collect()}
    assert ids[5] == ids[4]


def test_one_of_each(spark):
    """Repeated rows, null ids and a shared doc_id, through the Jaccard and the substring stage."""
    text = lambda c: " ".join(f"{c}{i}word" for i in range(60))
    near = text("a") + " tail"
    rows = [(1, text("a")), (1, text("a")), (2, near), (2, text("b")), (None, text("c")), (None, text("c")), (3, text("c")), (None, text("d")), (None, text("d")), (4, ""), (4, ""), (5, ""), (4, " "), (6, None), (6, None), (None, None), (None, None)]
    docs = materialize(spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, place string").repartition(3), "rows")
    kept = materialize(P.keep_distinct(spark, docs, DIR), "kept")
    assert kept.columns == docs.columns
    want = [(1, text("a")), (2, text("b")), (3, text("c")), (None, text("d")), (4, ""), (5, ""), (4, " "), (6, None), (None, None)]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(want, key=repr)
    assert sorted(((r.doc_id, r.text) for r in P.cut_repeats(spark, kept, DIR).collect()), key=repr) == sorted(want, key=repr)


def test_registered():
    names = queries()
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]
