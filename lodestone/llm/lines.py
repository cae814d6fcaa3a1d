"""Removal of lines that several documents share, in DataFrame expressions alone.

Method.  Lines are exploded with their places, normalised (white space at both
ends off, A-Z lower-cased) and hashed to 128 bits.  Each hash counts its
distinct documents, combined before every shuffle, and names the smallest one.
Lines whose hash stands in ``least_documents`` or more go, but for those of that
smallest document.  The places of dropped lines travel back to their rows, and
the lines left are joined in order of place.

A line costs one small row (id, place, hash) in two shuffles.  Its text is
shuffled once, with its document, to meet the places.  A line that a third of
all documents share is counted from partial counts; the join that follows is a
plain inner join, which Spark splits at a hot key.

Defined results.  Null and empty texts are one empty line.  Only ``\\n`` ends a
line; a trailing one gives an empty last line.  A document is a doc_id: rows
that repeat an id count as one document and lose or keep a line together.  Null
ids are one document that comes after all others.  A text of any length is one
row; its lines are never held together with those of other documents.  An empty
table gives an empty table.  Further columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import UPPER_AZ
from lodestone.storage import materialize

BLANKS = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    """The lines of a text; null and empty texts have one empty line."""
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """A line as it is compared: without white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER_AZ, UPPER_AZ.lower())


def row_key(text: str) -> list[Column]:
    """A row by its id and text: rows of equal key have equal results."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return [F.xxhash64(t).alias("th"), F.octet_length(t).alias("tn")]


def keyed_lines(documents: DataFrame, least_chars: int, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each line of ``least_chars`` and more: id, its row's key, place and hash."""
    lines = documents.select(F.col(doc).alias("id"), *row_key(text), F.posexplode(lines_of(F.col(text))).alias("at", "line"))
    key = lines.where(F.length("line") >= least_chars).select("id", "th", "tn", "at", line_key(F.col("line")).alias("key"))
    return key.where(F.length("key") >= least_chars).select("id", "th", "tn", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def shared_keys(keyed: DataFrame, least_documents: int) -> DataFrame:
    """Hashes of at least so many different documents, each with the smallest of them."""
    n = F.count_distinct("id") + F.max(F.col("id").isNull().cast("int"))
    counted = keyed.groupBy("h1", "h2").agg(n.alias("n"), F.min("id").alias("keeper"))
    return counted.where(F.col("n") >= least_documents).select("h1", "h2", "keeper")


def without_shared_lines(documents: DataFrame, least_documents: int = 2, least_chars: int = 10, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """own (the row's columns), n_lines, n_dropped and kept (the lines left, joined by ``\\n``) of every row."""
    keyed = materialize(keyed_lines(documents, least_chars, doc, text), "lines")
    shared = materialize(shared_keys(keyed, least_documents), "shared")  # written, so that nothing but exchanges stands under the join
    dropped = keyed.join(shared, ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("keeper")))
    places = dropped.groupBy("id", "th", "tn").agg(F.collect_set("at").alias("gone"))
    rows = documents.select(F.struct("*").alias("own"), F.col(doc).alias("id"), *row_key(text)).alias("r")
    same = F.col("r.id").eqNullSafe(F.col("p.id")) & (F.col("r.th") == F.col("p.th")) & (F.col("r.tn") == F.col("p.tn"))
    met = rows.join(places.alias("p"), same, "left").select("own", "gone", lines_of(F.col("own")[text]).alias("lines"))
    left = F.expr("if(gone IS NULL, lines, transform(array_except(sequence(0, size(lines) - 1), gone), i -> lines[i]))")
    met = met.select("own", F.size("lines").cast("long").alias("n_lines"), left.alias("left"))
    return met.select("own", "n_lines", (F.col("n_lines") - F.size("left")).alias("n_dropped"), F.array_join("left", "\n").alias("kept"))


def drop_shared_lines(documents: DataFrame, least_documents: int = 2, least_chars: int = 10) -> DataFrame:
    """The documents with their shared lines gone, in the columns they came in."""
    done = without_shared_lines(documents, least_documents, least_chars)
    return done.select(*(F.col("kept").alias(c) if c == "text" else F.col("own")[c].alias(c) for c in documents.columns))


def line_report(documents: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the text that is left."""
    done = without_shared_lines(documents.select("doc_id", "text"))
    return done.select("own.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
