"""Queries of record normalisation and sinks.  Records of six formats are made of the documents, so the SQL can tell what must come back."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.plans.registry import Tables, query
from lodestone.sources import normalise as N
from lodestone.sources import records as S
from lodestone.sources import sinks as K
from lodestone.storage import new_path

NAMES = tuple(N.FORMATS)
_TITLE = "replace(substr(text, 1, 90), chr(0), '')"


def _json(c):
    """A text as a JSON string."""
    held = F.to_json(F.array(c))
    return F.substr(held, F.lit(2), F.length(held) - 2)


def records(t: Tables):
    """doc_id, format, source_code and record of every document; each fifth has no title."""
    d = t("documents")
    i = F.col("doc_id")
    title = F.when(i % 5 == 4, F.lit("")).otherwise(F.replace(F.substring("text", 1, 90), F.lit("\x00"), F.lit("")))
    number = F.concat(F.lit("oai:x:"), i.cast("string"))
    text, source, lang = _json(title), _json(F.col("source")), _json(F.col("lang"))
    field = lambda name, value: F.concat(F.lit(f'"{name}":'), value)
    abstract = _json(F.concat(F.lit("<p>"), "source", F.lit("</p>")))
    people = {
        "pubmed": F.concat(F.lit('[{"last_name":'), source, F.lit(',"fore_name":'), lang, F.lit('},{"fore_name":"x"},'), lang, F.lit("]")),
        "mods": F.concat(F.lit('[{"name":'), source, F.lit(',"role":"aut"},{"name":"x","role":"edt"},"Lunds universitet",'), lang, F.lit("]")),
        "swepub": F.concat(F.lit("["), _json(F.concat("source", F.lit(" 1950-"))), F.lit(',"Naturvetenskapliga fakulteten",'), lang, F.lit(",7]")),
        "oai_dc": F.concat(F.lit("["), source, F.lit(',{"x":1},'), lang, F.lit("]")),
    }
    case = None
    for k, (name, f) in enumerate(N.FORMATS.items()):
        listed = f.authors == "oai_dc"
        parts = [
            field(f.identifier, _json(number)), field(f.title, F.concat(F.lit("["), text, F.lit("]")) if listed else text), field(f.authors_at, people[f.authors]),
            field(f.abstract, F.concat(F.lit("["), abstract, F.lit("]")) if listed else abstract), field(f.year, F.lit('["x","2004-05"]') if listed else F.lit('"2004-05"') if name == "mods" else F.lit('"2004"')),
            field("type", lang), field("subjects", F.concat(F.lit("["), source, F.lit(",1]"))),
        ]
        body = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
        case = F.when(i % 6 == k, body) if case is None else case.when(i % 6 == k, body)
    return d.select("doc_id", F.element_at(F.array(*(F.lit(n) for n in NAMES)), (i % 6 + 1).cast("int")).alias("format"), F.lit("x").alias("source_code"), case.alias("record"))


_F = "CASE doc_id % 6 " + " ".join(f"WHEN {k} THEN '{{{n}}}'" for k, n in enumerate(NAMES)) + " END"
_IDS = _F.format(**{n: f.prefix for n, f in N.FORMATS.items()})
_AUTHORS = "CASE doc_id % 6 WHEN 0 THEN lang || ' ' || source || '|' || lang ELSE source || '|' || lang END"


@query("i49_normalised_records", f"SELECT doc_id, {_IDS} || CASE WHEN doc_id % 6 = 0 THEN 'oai:x:' ELSE '' END || doc_id AS id, md5({_TITLE}) AS title_md5, {_AUTHORS} AS authors, source AS abstract, '2004' AS year, lang AS genre, source AS subjects FROM documents WHERE doc_id % 5 <> 4 AND {_TITLE} <> ''")
def _(t: Tables):
    got = N.normalised(records(t).withColumnRenamed("doc_id", "key"))
    return got.select(F.col("key").alias("doc_id"), F.col("doc_id").alias("id"), F.md5(F.col("title").cast("binary")).alias("title_md5"), F.array_join("authors", "|").alias("authors"), "abstract", "year", "genre", F.array_join("subjects", "|").alias("subjects"))


@query("i61_years_by_format", f"SELECT format, '2004' AS year, count(*) AS n FROM (SELECT {_F.format(**{n: n for n in NAMES})} AS format FROM documents WHERE doc_id % 5 <> 4 AND {_TITLE} <> '') GROUP BY format")
def _(t: Tables):
    got = N.normalised(records(t).withColumn("kind", F.col("format")).withColumnRenamed("doc_id", "key"))
    return got.groupBy(F.col("kind").alias("format"), "year").agg(F.count("*").alias("n"))


@query("i50_documents_of_two_schemas", f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source || '|' || lang ELSE lang || ' ' || source END AS creators, CASE WHEN doc_id % 2 = 0 THEN 'http://a/' || doc_id ELSE 'http://b/' || doc_id END AS url, 'o' || doc_id AS oai_id FROM documents WHERE doc_id % 7 <> 0 AND {_TITLE} <> ''")
def _(t: Tables):
    d, i = t("documents"), F.col("doc_id").cast("string")
    title = _json(F.replace(F.substring("text", 1, 90), F.lit("\x00"), F.lit("")))
    source, lang = _json(F.col("source")), _json(F.col("lang"))
    status = F.when(F.col("doc_id") % 7 == 0, "deleted").otherwise("ok")
    old = F.concat(F.lit('{"title":'), title, F.lit(',"creators":['), source, F.lit(","), lang, F.lit('],"identifiers":["http://a/'), i, F.lit('"],"oai_id":"o'), i, F.lit('","status":"'), status, F.lit('"}'))
    new = F.concat(F.lit('{"title":'), title, F.lit(',"authors":[{"given":'), lang, F.lit(',"family":'), source, F.lit('}],"identifiers":{"uri":"","url":"http://b/'), i, F.lit('"},"identifier":"o'), i, F.lit('","status":"'), status, F.lit('"}'))
    got = N.documents_of(d.select("doc_id", F.when(F.col("doc_id") % 2 == 0, old).otherwise(new).alias("record")))
    return got.select("doc_id", F.array_join("creators", "|").alias("creators"), "url", "oai_id")



def _plain_title():
    return F.trim(F.substring(F.regexp_replace("text", r"[^\p{L}\p{N} .,]", ""), 1, 60))


_PLAIN = "trim(substr(regexp_replace(text, '[^\\p{L}\\p{N} .,]', '', 'g'), 1, 60), ' ')"


@query("a23_mods_records", f"SELECT doc_id, nullif({_PLAIN}, '') AS title, source || '|' || lang AS names, '19' || (50 + doc_id % 50) AS year FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, NULL, NULL, NULL FROM documents WHERE doc_id % 3 = 0")
def _(t: Tables):
    """MODS records of every document; each third is cut off and parses to nothing."""
    i = F.col("doc_id")
    whole = F.concat(F.lit("<mods><titleInfo><title>"), _plain_title(), F.lit("</title></titleInfo><name><namePart>"), "source", F.lit("</namePart><namePart>"), "lang", F.lit("</namePart></name><originInfo><dateIssued>19"), (50 + i % 50).cast("string"), F.lit("</dateIssued></originInfo></mods>"))
    text = F.when(i % 3 == 0, F.substring(whole, 1, 30)).otherwise(whole)
    got = t("documents").select("doc_id", S.from_xml(text, S.MODS_SCHEMA).alias("m"))
    return got.select("doc_id", F.nullif("m.titleInfo.title", F.lit("")).alias("title"), F.when(F.col("m.name").isNotNull(), F.array_join(F.flatten(F.transform("m.name", lambda n: n.namePart)), "|")).alias("names"), F.col("m.originInfo.dateIssued").alias("year"))


@query("a25_pubmed_articles", f"SELECT doc_id, CAST(doc_id AS VARCHAR) AS pmid, nullif({_PLAIN}, '') AS title, lang || ' ' || source AS authors, CASE WHEN doc_id % 2 = 0 THEN '2004' END AS year FROM documents")
def _(t: Tables):
    i = F.col("doc_id")
    year = F.when(i % 2 == 0, F.lit("<PubDate><Year>2004</Year></PubDate>")).otherwise(F.lit(""))
    text = F.concat(
        F.lit("<PubmedArticle><MedlineCitation><PMID>"), i.cast("string"), F.lit("</PMID><Article><Journal><JournalIssue>"), year, F.lit("</JournalIssue></Journal><ArticleTitle>"), _plain_title(),
        F.lit("</ArticleTitle><AuthorList><Author><LastName>"), "source", F.lit("</LastName><ForeName>"), "lang", F.lit("</ForeName></Author></AuthorList></Article></MedlineCitation></PubmedArticle>"),
    )
    return S.pubmed_articles(t("documents").select("doc_id", text.alias("x")), "x").select("doc_id", "pmid", F.nullif("title", F.lit("")).alias("title"), F.array_join("authors", "|").alias("authors"), "year")


@query("a41_cms_text", f"SELECT doc_id, concat_ws(chr(10) || chr(10), source, nullif(trim(regexp_replace({_PLAIN}, '\\s+', ' ', 'g'), ' '), ''), lang) AS text FROM documents")
def _(t: Tables):
    """Heading and nested body blocks as text, without tags and double blanks."""
    body = F.concat(F.lit('{"heading":'), _json(F.col("source")), F.lit(',"body":[{"type":"p","html":'), _json(F.concat(F.lit("<b>"), _plain_title(), F.lit("</b>"))), F.lit('},{"blocks":[{"html":'), _json(F.concat(F.lit("<i> "), "lang", F.lit("  </i>"))), F.lit("}]}]}"))
    return S.cms_texts(t("documents").select("doc_id", body.alias("j")), "doc_id", "j")


@query("b27_normalised_files", f"SELECT count(*) AS written, count(*) AS read, CAST(ceil(count(*) / 25000.0) AS BIGINT) AS least_files FROM documents WHERE doc_id % 5 <> 4 AND {_TITLE} <> ''")
def _(t: Tables):
    """Normalised records as JSON lines of at most 25,000 rows a file, counted by the sink and read again."""
    rows = N.normalised(records(t).withColumnRenamed("doc_id", "key")).select("key", "title")
    path = new_path(rows.sparkSession, "normalised")
    count = K.write_json_lines(rows, path)
    again = rows.sparkSession.read.schema(rows.schema).json(path)
    files = again.select(F.input_file_name().alias("f")).groupBy("f").agg(F.count("*").alias("n"))
    return files.agg(F.lit(count).cast("long").alias("written"), F.sum("n").cast("long").alias("read"), F.when(F.max("n") <= 25_000, F.ceil(F.sum("n") / 25_000)).cast("long").alias("least_files"))


@query("b16_new_articles", "SELECT page_id, 1 AS n FROM pages")
def _(t: Tables):
    """Half of the pages, then all of them: every page is in the folder once."""
    pages = t("pages").select("page_id", "url")
    path = new_path(pages.sparkSession, "articles")
    for part in (pages.where("page_id % 2 = 0"), pages, pages.unionByName(pages)):
        S.save_new_json_lines(part, path, "page_id")
    return S.read_json_lines(pages.sparkSession, path, "page_id long, url string").groupBy("page_id").agg(F.count("*").cast("int").alias("n"))


@query("b01_collection_append", "SELECT lang AS collection, count(*) * 2 AS n FROM documents GROUP BY lang")
def _(t: Tables):
    docs = t("documents").select("doc_id", "text", F.col("lang").alias("collection"))
    path = new_path(docs.sparkSession, "store")
    for _ in range(2):
        S.append_collection(docs, path)
    return docs.sparkSession.read.parquet(path).groupBy("collection").agg(F.count("*").alias("n"))


@query("b37_error_log", "SELECT CASE WHEN value < 1 THEN 'small' WHEN value > 90 THEN 'large' END AS error, count(*) AS n FROM events WHERE value < 1 OR value > 90 GROUP BY 1")
def _(t: Tables):
    """Rows that fail a check go to the log with their reason, the others on; a batch that comes twice is logged once."""
    events = t("events").withColumn("error", F.when(F.col("value") < 1, "small").when(F.col("value") > 90, "large"))
    path = new_path(events.sparkSession, "ledger")
    for batch in (0, 0):
        K.append_batch(events, batch, path, "error")
    return K.errors_of(events.sparkSession, path, events.schema).groupBy("error").agg(F.count("*").alias("n"))


@query("b17_csv_by_time", "SELECT count(*) AS n, min(ts) AS first, max(ts) AS last FROM events")
def _(t: Tables):
    events = t("events").select("ts", "event_id", "value")
    path = new_path(events.sparkSession, "csv")
    S.export_csv(events, path, "ts", "event_id")
    again = events.sparkSession.read.option("header", True).schema(events.schema).csv(path)
    return again.agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query("a14_json_lines", "SELECT role, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY role")
def _(t: Tables):
    """Turns as JSON lines with blank lines between them, read back."""
    turns = t("conversations")
    path = new_path(turns.sparkSession, "lines")
    turns.select(F.explode(F.array(F.to_json(F.struct("conv_id", "turn", "role", "text")), F.lit(""))).alias("value")).write.text(path)
    again = S.read_json_lines(turns.sparkSession, path, "conv_id long, turn long, role string, text string")
    return again.groupBy("role").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("chars"))
