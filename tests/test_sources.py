"""Sources and sinks on small files."""

import json

from pyspark.sql import functions as F

from lodestone.sources import html as H
from lodestone.sources import records as S


def test_polymorphic_json(spark, tmp_path):
    shapes = ([{"id": "a", "n": 1}, {"id": "b"}], {"documents": [{"id": "c", "n": 3}]}, {"results": [{"id": "d"}]}, {"id": "e", "n": 5})
    for i, x in enumerate(shapes):
        (tmp_path / f"f{i}.json").write_text(json.dumps(x, indent=1))
    got = S.read_records(spark, str(tmp_path), "id: string, n: bigint").collect()
    assert sorted((r.id, r.n) for r in got) == [("a", 1), ("b", None), ("c", 3), ("d", None), ("e", 5)]


def test_json_lines_append_once(spark, tmp_path):
    path = str(tmp_path / "articles")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "url long, title string")
    S.save_new_json_lines(rows, path, "url")
    S.save_new_json_lines(rows.unionByName(spark.createDataFrame([(3, "c")], "url long, title string")), path, "url")
    assert sorted(r.url for r in S.read_json_lines(spark, path, "url long, title string").collect()) == [1, 2, 3]


def test_xml_records(spark, tmp_path):
    (tmp_path / "feed.xml").write_text("<rss><channel><item><title>A</title><link>http://x/1</link></item><item><link>http://x/2</link></item></channel></rss>")
    got = S.read_xml(spark, str(tmp_path / "feed.xml"), "item", S.RSS_ITEM).collect()
    assert sorted((r.title or "", r.link) for r in got) == [("", "http://x/2"), ("A", "http://x/1")]
    mods = "<mods><titleInfo><title>T</title></titleInfo><name><namePart>N</namePart></name><originInfo><dateIssued>2020</dateIssued></originInfo></mods>"
    r = spark.createDataFrame([(mods,)], "x string").select(S.from_xml("x", S.MODS_SCHEMA).alias("m")).select("m.titleInfo.title", F.col("m.name")[0]["namePart"][0].alias("who"), "m.originInfo.dateIssued").first()
    assert tuple(r) == ("T", "N", "2020")
    dc = "<dc><title>T</title><creator>A</creator><creator>B</creator><date>1999</date></dc>"
    r = spark.createDataFrame([(dc,)], "x string").select(S.from_xml("x", S.DUBLIN_CORE_SCHEMA).alias("d")).select("d.title", "d.creator").first()
    assert (r.title, r.creator) == ("T", ["A", "B"])


def test_csv_and_collections(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", "y"), (1, "a", "x")], "id long, v string, collection string")
    S.export_csv(df, str(tmp_path / "csv"), "id")
    assert [r.id for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()] == ["1", "2"]
    S.append_collection(df, str(tmp_path / "store"))
    S.append_collection(df, str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store")).where("collection = 'x'").count() == 2


def test_html_text(spark):
    page = "<html><head><title>t</title><style>p{}</style></head><body><nav>m</nav><h1>H</h1><p>a &amp;lt; b</p><script>x()</script><footer>f</footer></body></html>"
    r = spark.createDataFrame([(page, "http://x/y")], "html string, url string").select(H.plain_text("html").alias("t"), H.title("html", "url").alias("h")).first()
    assert (r.t, r.h) == ("t\nH\na &lt; b", "H")
