"""Records of many shapes in one schema, walked as VARIANT values: the field decides nothing, the path does.

A record is a JSON text or a VARIANT; its format names where the identifier,
title, authors, abstract, year and subjects stand.  Authors may be texts or
objects, in one list; each element is looked at on its own, so no schema has to
fit all of them.  Records without an identifier or a title give no row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Format:
    """Where a format keeps what is normalised; ``authors`` names one of the four ways to read them."""

    prefix: str
    identifier: str
    title: str
    authors_at: str
    authors: str
    abstract: str
    year: str


#: The formats, the prefix of their ids, and the fields they use.
FORMATS = {
    "pubmed": Format("pubmed_", "pmid", "title", "authors", "pubmed", "abstract", "pub_year"),
    "mods": Format("gu_", "identifier", "title", "names", "mods", "abstract", "datestamp"),
    "swepub": Format("kth_", "id", "title", "authors", "swepub", "abstract", "year"),
    "swepub_nested": Format("liu_", "oai_identifier", "title", "authors", "swepub", "abstract", "year"),
    "oai_dc": Format("chalmers_", "identifier", "titles", "creators", "oai_dc", "descriptions", "dates"),
    "swepub_lnu": Format("lnu_", "oai_id", "title", "authors", "swepub", "abstract", "year"),
}
#: Parts of names that tell institutions, by way of reading; how many authors and subjects are kept, and how long title and abstract may be.
INSTITUTIONS = {"mods": ("universitet", "skolan", "institution"), "swepub": ("universitet", "skolan", "institution", "fakultet")}
MOST_AUTHORS, MOST_SUBJECTS, TITLE_CHARS, ABSTRACT_CHARS = 20, 20, 1000, 5000


def text_at(v: Column, path: str) -> Column:
    """The text at a path; null for anything but a text."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))


def list_at(v: Column, path: str) -> Column:
    """The elements of the list at a path; empty for anything else."""
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _kind(v: Column) -> Column:
    shape = F.schema_of_variant(v)
    return F.when(shape == "STRING", "text").when(shape.startswith("OBJECT"), "object")


def _institution(name: Column, words: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(F.lower(name), F.lit(w))
    return hit


def authors(v: Column, at: str, how: str) -> Column:
    """Names of at most 20 authors, read as mods, pubmed, swepub or oai_dc."""
    each, string = list_at(v, f"$.{at}"), lambda a: F.try_variant_get(a, "$", "string")
    field = lambda a, f: F.coalesce(F.try_variant_get(a, f"$.{f}", "string"), F.lit(""))
    if how == "mods":
        name = lambda a: F.when((_kind(a) == "object") & (field(a, "role") == "aut"), field(a, "name")).when((_kind(a) == "text") & ~_institution(string(a), INSTITUTIONS["mods"]), string(a))
    elif how == "pubmed":
        first = lambda a: F.coalesce(F.nullif(field(a, "fore_name"), F.lit("")), field(a, "initials"))
        name = lambda a: F.when((_kind(a) == "object") & (field(a, "last_name") != ""), F.trim(F.concat_ws(" ", first(a), field(a, "last_name")))).when(_kind(a) == "text", string(a))
    elif how == "swepub":
        bare = lambda a: F.trim(F.substring_index(string(a), " 19", 1))
        name = lambda a: F.when((_kind(a) == "text") & ~_institution(string(a), INSTITUTIONS["swepub"]), bare(a))
    elif how == "oai_dc":
        name = lambda a: F.when(_kind(a) == "text", string(a))
    else:
        raise ValueError(f"no way of reading authors is called {how}")
    return F.slice(F.array_compact(F.transform(each, name)), 1, MOST_AUTHORS)


def _last_of_id(c: Column) -> Column:
    return F.element_at(F.split(c, ":", -1), -1)


def normalised(df: DataFrame, record: str = "record", format_of: str = "format", source: str = "source_code") -> DataFrame:
    """``df``'s rows with a known format, an identifier and a title, as doc_id, source, title, authors, abstract, year, genre, subjects and raw_identifier behind their own columns but the record."""
    typed = dict(df.dtypes)[record] == "variant"
    rows = df.withColumn("_v", F.col(record) if typed else F.try_parse_json(record))
    v = F.col("_v")

    def of(f: Format) -> Column:
        raw = F.coalesce(F.try_variant_get(v, f"$.{f.identifier}", "string"), F.lit(""))
        listed = f.authors == "oai_dc"
        first = lambda at: F.try_variant_get(v, f"$.{at}[0]", "string")
        title = F.coalesce(first(f.title) if listed else F.try_variant_get(v, f"$.{f.title}", "string"), F.lit(""))
        abstract = first(f.abstract) if listed else F.try_variant_get(v, f"$.{f.abstract}", "string")
        long = F.filter(F.transform(list_at(v, "$.dates"), lambda d: F.when(_kind(d) == "text", F.try_variant_get(d, "$", "string"))), lambda d: F.length(d) >= 4)
        stamp = F.nullif(F.substring(F.try_variant_get(v, f"$.{f.year}", "string"), 1, 4), F.lit(""))
        year = F.substring(F.try_element_at(long, F.lit(1)), 1, 4) if listed else stamp if f.authors == "mods" else F.try_variant_get(v, f"$.{f.year}", "string")
        bare = raw if f.prefix == "pubmed_" else _last_of_id(raw)
        return F.struct(
            F.concat(F.lit(f.prefix), bare).alias("doc_id"), F.concat(F.lit("diva_"), source).alias("source"), F.substring(title, 1, TITLE_CHARS).alias("title"),
            authors(v, f.authors_at, f.authors).alias("authors"), F.substring(F.regexp_replace(abstract, r"<[^>]+>", ""), 1, ABSTRACT_CHARS).alias("abstract"), year.alias("year"),
            F.coalesce(F.nullif(F.try_variant_get(v, "$.genre", "string"), F.lit("")), F.try_variant_get(v, "$.type", "string")).alias("genre"),
            F.slice(F.array_compact(F.transform(list_at(v, "$.subjects"), lambda s: F.when(_kind(s) == "text", F.try_variant_get(s, "$", "string")))), 1, MOST_SUBJECTS).alias("subjects"), raw.alias("raw_identifier"),
        )

    case = None
    for name, f in FORMATS.items():
        case = F.when(F.col(format_of) == name, of(f)) if case is None else case.when(F.col(format_of) == name, of(f))
    own = [c for c in df.columns if c not in (record, format_of, source)]
    out = rows.withColumn("_n", case).where(v.isNotNull()).select(*own, "_n.*")
    return out.where((F.col("title") != "") & ~F.col("doc_id").endswith("_"))


#: How many subjects and creators of a document of either schema are kept.
DOCUMENT_SUBJECTS, DOCUMENT_CREATORS = 10, 5


def documents_of(df: DataFrame, record: str = "record") -> DataFrame:
    """Rows of two document schemas as title, description, creators, date, language, url and oai_id; deleted and untitled ones give none."""
    rows = df.withColumn("_v", F.try_parse_json(record))
    v = F.col("_v")
    text = lambda at: F.try_variant_get(v, f"$.{at}", "string")
    first = lambda *ats: F.coalesce(*(F.nullif(text(at), F.lit("")) for at in ats), F.lit(""))
    plain = lambda a: F.when(_kind(a) == "text", F.try_variant_get(a, "$", "string"))
    named = lambda a: F.coalesce(plain(a), F.when(_kind(a) == "object", F.nullif(F.trim(F.concat_ws(" ", F.try_variant_get(a, "$.given", "string"), F.try_variant_get(a, "$.family", "string"))), F.lit(""))))
    creators = F.slice(F.transform(list_at(v, "$.creators"), plain), 1, DOCUMENT_CREATORS)
    written = F.array_compact(F.transform(F.slice(list_at(v, "$.authors"), 1, DOCUMENT_CREATORS), named))
    ids = F.try_variant_get(v, "$.identifiers", "variant")
    url = F.when(F.schema_of_variant(ids).startswith("ARRAY"), F.try_variant_get(ids, "$[0]", "string")).otherwise(first("identifiers.uri", "identifiers.url"))
    shown = [c for c in df.columns if c != record]
    out = rows.where(v.isNotNull() & ~F.coalesce(text("status") == "deleted", F.lit(False))).select(
        *shown, F.coalesce(text("title"), F.lit("")).alias("title"), first("description", "abstract").alias("description"),
        F.slice(F.array_compact(F.transform(list_at(v, "$.subjects"), plain)), 1, DOCUMENT_SUBJECTS).alias("subjects"),
        F.when(F.size(creators) > 0, F.array_compact(creators)).otherwise(written).alias("creators"), first("date", "date_issued").alias("date"), F.coalesce(text("language"), F.lit("")).alias("language"),
        F.coalesce(url, F.lit("")).alias("url"), first("oai_id", "identifier").alias("oai_id"),
    )
    return out.where(F.col("title") != "")
