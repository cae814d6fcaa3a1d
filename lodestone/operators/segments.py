"""Structured texts to rows: statutes by chapter and paragraph, Markdown by typed blocks.

A text is segmented inside its row by line-anchored splits, so nothing is
shuffled; a text's segments become rows by an explode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as X

#: The line beginnings of a statute's chapters, paragraphs and articles, and where its text begins.
CHAPTER, PARAGRAPH, ARTICLE = r"\d+[a-z]?\s*kap\.", r"\d+[a-z]?\s*§", r"Art\.\s*\d+"
BEGINNING, FIRST_ARTICLE = r"\n\s*(1 kap\.|1 §)", r"(?i)\n\s*(Art\.\s*1)"
#: The statute that is cut by articles.
BY_ARTICLES = "1810:0926"
#: Fields of a statute's first lines and their prefixes.
HEADER_FIELDS = (("sfs_nummer", "SFS nr:"), ("departement", "Departement/myndighet:"), ("utfardad", "Utfärdad:"), ("andrad", "Ändrad:"), ("omtryck", "Omtryck:"))
#: Readable names of statutes by their short ones.
READABLE_NAMES = (
    ("RF", "Regeringsformen"), ("TF", "Tryckfrihetsförordningen"), ("YGL", "Yttrandefrihetsgrundlagen"), ("SO", "Successionsordningen"), ("OSL", "Offentlighets- och sekretesslagen"),
    ("FL", "Förvaltningslagen"), ("KL", "Kommunallagen"), ("RB", "Rättegångsbalken"), ("BrB", "Brottsbalken"), ("URL", "Upphovsrättslagen"), ("AvtL", "Avtalslagen"),
    ("SkL", "Skadeståndslagen"), ("LVU", "Lagen om vård av unga"),
)
#: Words of a section's header, and the question that they make of it (the first names no product here).
SECTION_QUESTIONS = (
    (("arkitektur", "architecture", "struktur", "structure"), "Förklara arkitekturen för %s i systemet"), (("api", "endpoint", "route"), "Hur fungerar %s?"),
    (("workflow", "flöde", "process"), "Beskriv %s processen"), (("config", "konfig", "setting", "parameter"), "Hur konfigurerar jag %s?"),
    (("felsök", "debug", "troubleshoot", "problem"), "Hur felsöker jag %s?"), (("install", "setup", "start", "börja"), "Hur sätter jag upp %s?"),
)
OTHER_QUESTION = "Vad är %s?"
BLANKS = " \t\n\x0b\x0c\r"


def _strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def _pieces(text: Column, start: str, flags: str = "(?md)") -> Column:
    """The parts of a text that begin with a line that begins so; what stands before the first is left out."""
    return F.filter(F.split(text, f"{flags}^(?={start})"), lambda p: p.rlike(f"{flags}\\A(?:{start})"))


def statute_header(text) -> Column:
    """titel, sfs_nummer, departement, utfardad and senast_andrad from a statute's first 20 lines; of repeated fields the last."""
    lines = F.transform(F.slice(F.split(F.coalesce(X._col(text), F.lit("")), "\n", -1), 1, 20), _strip)
    last = lambda prefix: F.try_element_at(F.filter(lines, lambda x: x.startswith(prefix)), F.lit(-1))
    field = {name: _strip(F.replace(last(prefix), F.lit(prefix), F.lit(""))) for name, prefix in HEADER_FIELDS}
    shown = lambda c: F.coalesce(c, F.lit(""))
    first_print = _strip(F.replace(F.try_element_at(F.filter(lines, lambda x: x.startswith("Omtryck:")), F.lit(1)), F.lit("Omtryck:"), F.lit("")))
    return F.struct(
        F.get(lines, F.lit(0)).alias("titel"), shown(field["sfs_nummer"]).alias("sfs_nummer"), shown(field["departement"]).alias("departement"), shown(field["utfardad"]).alias("utfardad"),
        F.coalesce(F.nullif(field["andrad"], F.lit("")), first_print, field["andrad"]).alias("senast_andrad"),
    )


def _clean_id(*parts: Column) -> Column:
    return F.replace(F.replace(F.concat_ws("_", *parts), F.lit(" "), F.lit("_")), F.lit("."), F.lit(""))


def statute_chunks(statutes: DataFrame, key: str, text: str = "text", number: str = "sfs_nummer") -> DataFrame:
    """key, pos, kapitel, kapitel_rubrik, paragraf, text and chunk_id of every paragraph, in order.

    Where a statute has chapters, only what stands in one is cut; its heading is
    the rest of the line.  The statute that has articles is cut by them.  What
    stands before the first chapter or paragraph is left out.
    """
    t, nr = F.coalesce(F.col(text), F.lit("")), F.col(number)
    begin = F.when(nr == BY_ARTICLES, F.regexp_instr(t, F.lit(FIRST_ARTICLE))).otherwise(F.regexp_instr(t, F.lit(BEGINNING)))
    body = F.when(begin > 0, F.expr(f"substring({text}, _b)")).otherwise(t)
    rows = statutes.select(key, text, number, begin.alias("_b")).select(key, number, body.alias("_t"))
    part = lambda chapter, heading: lambda p, pattern: F.struct(chapter.alias("kapitel"), heading.alias("kapitel_rubrik"), _strip(F.regexp_extract(p, f"(?d)\\A(?:{pattern})", 0)).alias("paragraf"), _strip(p).alias("text"))
    none = F.lit(None).cast("string")

    def of_chapter(piece: Column) -> Column:
        head = rf"(?md)\A({CHAPTER})\s*(.*)$"
        rest = F.substr(piece, F.length(F.regexp_extract(piece, head, 0)) + 1)
        make = part(_strip(F.regexp_extract(piece, head, 1)), _strip(F.regexp_extract(piece, head, 2)))
        return F.transform(_pieces(rest, PARAGRAPH), lambda p: make(p, PARAGRAPH))

    chapters = _pieces(F.col("_t"), CHAPTER)
    plain = F.transform(_pieces(F.col("_t"), PARAGRAPH), lambda p: part(none, none)(p, PARAGRAPH))
    articles = F.transform(_pieces(F.col("_t"), ARTICLE, "(?mdi)"), lambda p: part(none, none)(p, f"(?i){ARTICLE}"))
    cut = F.when(F.col(number) == BY_ARTICLES, articles).when(F.size(chapters) > 0, F.flatten(F.transform(chapters, of_chapter))).otherwise(plain)
    out = rows.select(key, number, F.posexplode(cut).alias("pos", "c")).select(key, number, "pos", "c.*")
    return out.select(key, "pos", "kapitel", "kapitel_rubrik", "paragraf", "text", _clean_id(F.col(number), F.col("kapitel"), F.col("paragraf")).alias("chunk_id"))


def statute_records(chunks: DataFrame, number: str, short: str) -> DataFrame:
    """Chunks with the text that is searched, the title that is shown, and a stable id over the text's hash."""
    names = F.create_map(*(F.lit(x) for pair in READABLE_NAMES for x in pair))
    readable = F.try_element_at(names, F.col(short))
    chapter = F.concat_ws(" ", F.nullif("kapitel", F.lit("")), F.when(F.coalesce("kapitel", F.lit("")) != "", F.nullif("kapitel_rubrik", F.lit(""))))
    search = F.concat(F.col(short), F.lit(" "), chapter, F.lit(" "), F.coalesce("paragraf", F.lit("")), F.lit("\n"), F.col("text"))
    shown = F.concat_ws(" ", F.col(short), F.nullif("kapitel", F.lit("")), F.nullif("paragraf", F.lit("")))
    title = F.when(readable.isNotNull(), F.concat(shown, F.lit(" - "), readable)).otherwise(shown)
    return chunks.withColumn("search_text", search).withColumn("title", title).withColumn("stable_id", X.stable_id("sfs", [number, "kapitel", "paragraf"], "text"))


def sections(text) -> Column:
    """(header, body) of headings of level 1 to 3 whose body has more than 50 characters."""
    head = r"#{1,3}[^\S\n]+[^\n]"
    parts = F.filter(_pieces(F.coalesce(X._col(text), F.lit("")), head), lambda p: F.contains(p, F.lit("\n")))
    pairs = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"\A#{1,3}[^\S\n]+([^\n]+)", 1).alias("header"), _strip(F.regexp_replace(p, r"\A[^\n]*\n", "")).alias("body")))
    return F.filter(pairs, lambda s: F.length(s.body) > 50)


def _all(text: Column, pattern: str, *groups: int) -> Column:
    """The groups of every place of a pattern, zipped."""
    return F.arrays_zip(*(F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in groups))


def code_blocks(text) -> Column:
    """(header, body) of fenced code of 50 characters and more: the instruction in the line before it, and the block."""
    # a match begins where a line does, or right behind the block before it
    found = _all(F.coalesce(X._col(text), F.lit("")), r"(?md)(?:^|\G)([^\n]++)\n\n```(\w++)\n([\s\S]+?)\n```", 1, 2, 3)
    last = lambda c: _strip(F.element_at(F.split(_strip(c), ":", -1), -1))
    long = F.filter(found, lambda b: (F.length(b.g3) >= 50) & (last(b.g1) != ""))
    return F.transform(long, lambda b: F.struct(F.concat(F.lit("Visa hur man "), F.lower(last(b.g1))).alias("header"), F.concat(F.lit("```"), b.g2, F.lit("\n"), b.g3, F.lit("\n```")).alias("body")))


def timeline(text) -> Column:
    """(header, body) of dated level-3 headings with more than 100 characters below them."""
    found = _all(F.coalesce(X._col(text), F.lit("")), r"(?s)###\s+(\d{4}-\d{2}-\d{2})\n(.*?)(?=###\s+\d{4}|\z)", 1, 2)
    return F.filter(F.transform(found, lambda b: F.struct(b.g1.alias("header"), _strip(b.g2).alias("body"))), lambda b: F.length(b.body) > 100)


def evidence(text) -> Column:
    """(header, body) of numbered level-3 headings with a bold title and more than 100 characters below them: number and title, body."""
    found = _all(F.coalesce(X._col(text), F.lit("")), r"(?s)###\s+(\d+)\.\s+\*\*(.+?)\*\*.*?\n(.*?)(?=###\s+\d+\.|\z)", 1, 2, 3)
    return F.filter(F.transform(found, lambda b: F.struct(F.concat(F.lit("#"), b.g1, F.lit(": "), b.g2).alias("header"), _strip(b.g3).alias("body"))), lambda b: F.length(b.body) > 100)


KINDS = {"section": sections, "code": code_blocks, "timeline": timeline, "evidence": evidence}


def blocks(df: DataFrame, key: str, text: str = "text", kinds: tuple[str, ...] = tuple(KINDS)) -> DataFrame:
    """key, kind (section, code, timeline, evidence), pos within the kind, header and body of every block of the given kinds."""
    tagged = F.array(*(F.struct(F.lit(k).alias("kind"), KINDS[k](text).alias("held")) for k in kinds))
    each = df.select(key, F.explode(tagged).alias("_k")).select(key, "_k.kind", F.posexplode("_k.held").alias("pos", "b"))
    return each.select(key, "kind", "pos", "b.header", "b.body")


def section_questions(found: DataFrame) -> DataFrame:
    """Blocks of kind section with ``question``; bodies of fewer than 100 characters make none."""
    low, case = F.lower("header"), None
    for words, form in SECTION_QUESTIONS:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        value = F.replace(F.lit(form), F.lit("%s"), F.col("header"))
        case = F.when(hit, value) if case is None else case.when(hit, value)
    return found.where((F.col("kind") == "section") & (F.length("body") >= 100)).withColumn("question", case.otherwise(F.replace(F.lit(OTHER_QUESTION), F.lit("%s"), F.col("header"))))
