"""Steps that work in the row or in many tasks: JSON ranges, nested content, corrected terms."""

import json
import re

from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.sources import json_ranges as J
from lodestone.sources import records as S


def test_ranges_are_many_tasks(spark, tmp_path):
    """Few bytes name the ranges, but each is a task's work; also beside adaptive joining of partitions."""
    (tmp_path / "a.json").write_text(json.dumps([{"i": i, "t": '\\"x' * 50} for i in range(400)]))
    got = J.record_texts(spark, str(tmp_path), range_bytes=4096)
    assert got.select(F.spark_partition_id()).distinct().count() > 4
    assert [json.loads(r.text)["i"] for r in got.orderBy("range", "pos").collect()] == list(range(400))


def test_last_record_reads_little(tmp_path, monkeypatch):
    path = tmp_path / "a.json"
    path.write_text(json.dumps([{"t": "y" * 1000} for _ in range(2000)]))
    read = []
    monkeypatch.setattr(J, "read_at", lambda f, lo, hi, old=J.read_at: read.append(hi - lo) or old(f, lo, hi))
    with J.opened(str(path)) as f:
        found = list(J.records(f, path.stat().st_size, 0, 1500, False, 0, 1, None))
    assert len(found) == 2 and sum(read) < 100_000


def test_cms_texts_in_the_row(spark):
    doc = {"heading": "h", "body": [{"html": "<b>a</b>  b", "blocks": [{"html": "c", "blocks": [{"html": "d"}]}, {"html": ""}]}, {"html": "e"}]}
    rows = [(1, json.dumps(doc)), (2, json.dumps({"heading": "", "body": []})), (3, json.dumps({"body": [{"blocks": [{"html": "x"}]}]})), (4, "{"), (5, json.dumps(doc))]
    done = S.cms_texts(spark.createDataFrame(rows, "k int, j string"), "k", "j")
    whole = "h\n\na b\n\nc\n\nd\n\ne"
    assert {r.k: r.text for r in done.collect()} == {1: whole, 2: "", 3: "x", 4: "", 5: whole}
    assert "Exchange" not in done._jdf.queryExecution().executedPlan().toString()


def test_corrected_terms_of_odd_letters(spark):
    texts = ["PUL och pul", "perſonuppgiftslagen", "personuppgİftslagen", "personuppgıftslagen", "grundlagens GRUNDLAGEN", "offentlighetslagen pul", None, "", "konsumentombudsmannen (ſekretesslagen)"]
    got = {r.i: r for r in X.correct_terms(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).collect()}
    for i, t in enumerate(texts):
        n, patterns = 0, [rf"(?iu)(?<![\p{{L}}\p{{N}}_]){term}(?![\p{{L}}\p{{N}}_])" for term, _, _ in X.TERM_CORRECTIONS]
        row = spark.createDataFrame([(t,)], "t string")
        for p, (_, to, _) in zip(patterns, X.TERM_CORRECTIONS, strict=True):
            row = row.select(F.coalesce(F.regexp_count("t", F.lit(p)), F.lit(0)).alias("n"), F.regexp_replace("t", p, to).alias("t"))
            r = row.first()
            n, row = n + r.n, spark.createDataFrame([(r.t,)], "t string")
        assert (got[i].text, got[i].n) == (r.t, n), t
    assert set(got[0].asDict()) == {"i", "text", "n", "terms", "confidence"}
    plan = X.correct_terms(spark.createDataFrame([("",)], "text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"(?i)contains\(_low", plan)
