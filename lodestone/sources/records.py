"""Record files: polymorphic JSON envelopes, JSON lines, XML, and their sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENVELOPES = ("documents", "results", "records", "articles", "questions")


def read_records(spark: SparkSession, path: str, record_schema: str) -> DataFrame:
    """Records of JSON files that hold a list, an envelope with a list, or one object.

    Text is parsed with the given schema, so a file's shape never decides a type.
    """
    text = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    return text.select("file", F.posexplode(record_array("value", record_schema)).alias("pos", "r")).select("file", "pos", "r.*")


def record_array(text, record_schema: str) -> Column:
    """The records in a JSON text of any of the three shapes, as an array."""
    t = F.trim(F.col(text) if isinstance(text, str) else text)
    kind = f"array<struct<{record_schema}>>"
    listed = F.when(t.startswith("["), F.from_json(t, kind))
    inside = F.coalesce(*(F.from_json(F.get_json_object(t, f"$.{e}"), kind) for e in ENVELOPES))
    single = F.array(F.from_json(t, f"struct<{record_schema}>"))
    return F.coalesce(listed, inside, single)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


#: Schemas of the record formats that harvests deliver.
RSS_ITEM = "title string, link string, description string, pubDate string"
MODS_SCHEMA = "titleInfo struct<title string>, name array<struct<namePart array<string>>>, abstract string, originInfo struct<dateIssued string>, identifier array<string>, genre string"
DUBLIN_CORE_SCHEMA = "title string, creator array<string>, description string, date string, identifier array<string>, type string, subject array<string>"


SITEMAP_SCHEMA = "loc string, `news:news` struct<`news:publication_date` string, `news:title` string>"


def from_xml(text, schema: str) -> Column:
    return F.from_xml(text, schema)


#: Fields of a PubMed article.
PUBMED_SCHEMA = """MedlineCitation struct<PMID string, Article struct<ArticleTitle string, Abstract struct<AbstractText array<string>>,
    AuthorList struct<Author array<struct<LastName string, ForeName string, Initials string, CollectiveName string>>>, Journal struct<Title string, JournalIssue struct<PubDate struct<Year string, MedlineDate string>>>>>"""


def pubmed_articles(df: DataFrame, xml: str) -> DataFrame:
    """``df`` with pmid, title, abstract, authors, journal and year of each article instead of its XML; the year may come from a free date."""
    out = df.withColumn("_m", F.from_xml(xml, PUBMED_SCHEMA).MedlineCitation)
    date = F.col("_m.Article.Journal.JournalIssue.PubDate")
    name = lambda a: F.coalesce(F.nullif(F.trim(F.concat_ws(" ", F.coalesce(a.ForeName, a.Initials), a.LastName)), F.lit("")), a.CollectiveName)
    authors = F.coalesce(F.array_compact(F.transform("_m.Article.AuthorList.Author", name)), F.array().cast("array<string>"))
    return out.select(
        *(c for c in df.columns if c != xml), F.col("_m.PMID").alias("pmid"), F.col("_m.Article.ArticleTitle").alias("title"), F.array_join("_m.Article.Abstract.AbstractText", "\n").alias("abstract"),
        authors.alias("authors"), F.col("_m.Article.Journal.Title").alias("journal"), F.coalesce(date.Year, F.nullif(F.regexp_extract(date.MedlineDate, r"\d{4}", 0), F.lit(""))).alias("year"),
    )


def cms_texts(df: DataFrame, key: str, json: str, most_levels: int = 8) -> DataFrame:
    """key and text of nested content: the heading, then every ``html`` of the body's blocks in order, at any depth up to ``most_levels``.

    Tags go, white space becomes one blank, empty blocks give nothing; parts stand apart by an empty line.
    """
    inside = lambda v, path: F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))
    text = lambda v, path: F.try_variant_get(v, F.lit(path), "string")
    # every level is a column of the row, so a text is parsed once and none is shuffled
    out = df.select(key, F.try_parse_json(json).alias("_v"))
    out = out.withColumn("_p", F.array(F.struct(F.array(F.lit(-1)).alias("at"), text(F.col("_v"), "$.heading").alias("t"))))
    out = out.withColumn("_l", F.transform(inside(F.col("_v"), F.lit("$.body")), lambda v, i: F.struct(F.array(i).alias("at"), v.alias("v"))))
    for _ in range(most_levels):
        more = F.transform("_l", lambda x: F.struct(x["at"].alias("at"), text(x["v"], "$.html").alias("t")))
        down = F.flatten(F.transform("_l", lambda x: F.transform(inside(x["v"], F.lit("$.blocks")), lambda v, i: F.struct(F.concat(x["at"], F.array(i)).alias("at"), v.alias("v")))))
        out = out.select(key, F.concat("_p", more).alias("_p"), down.alias("_l"))
    clean = lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, r"<[^>]+>", " "), r"\s+", " "))
    done = F.filter(F.transform(F.array_sort("_p"), lambda p: clean(p["t"])), lambda t: t != "")
    return out.select(key, F.array_join(done, "\n\n").alias("text"))


def save_new_json_lines(new: DataFrame, path: str, key: str) -> None:
    """Append the rows whose key the folder does not have yet, one row a key; a folder that is not there yet is empty."""
    from pyspark.errors import AnalysisException

    spark, kind = new.sparkSession, new.schema[key].dataType.simpleString()
    fresh = new.dropDuplicates([key])
    try:
        have = spark.read.schema(f"`{key}` {kind}").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        fresh = fresh.join(have.distinct(), key, "left_anti")
    fresh.write.mode("append").json(path)


#: Times are written to the microsecond.
_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def export_csv(df: DataFrame, path: str, *order: str) -> None:
    df.orderBy(*order).write.mode("overwrite").option("header", True).option("timestampFormat", _MICROS).option("timestampNTZFormat", _MICROS).csv(path)


def append_collection(df: DataFrame, path: str, collection: str = "collection") -> None:
    """Chunks appended to the store, one folder a collection."""
    df.write.mode("append").partitionBy(collection).parquet(path)
