"""Answers of models and outlets: grades, structured outputs, payloads, texts to embed, all as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import rules as U

#: How a refusal begins, and the reason of a grade that cannot be read.
REFUSAL, UNREADABLE, NO_REASON = "Tyvärr kan jag inte besvara frågan", "Kunde inte tolka bedömning", "Ingen förklaring given"
#: Fields of a structured answer; the note is internal.
ANSWER = "struct<mode:string,saknas_underlag:boolean,svar:string,kallor:array<string>,fakta_utan_kalla:array<string>,arbetsanteckning:string>"
INTERNAL_NOTE = "arbetsanteckning"
#: Labels of a statistics table's fields, and of its metadata.
TABLE_LABELS = (("id", "Tabell-ID"), ("label", "Rubrik"), ("text", "Text"), ("description", "Beskrivning"), ("updated", "Uppdaterad"), ("category", "Kategori"))
METADATA_LABELS = (("title", "Titel"), ("description", "Metadata-beskrivning"), ("source", "Källa"))
#: Suffix of a broadcaster's titles, and authors where none is named.
RADIO_SUFFIX, DEFAULT_AUTHORS = " | Sveriges Radio", {"sr": "Sveriges Radio", "svt": "SVT"}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sliced_object(text) -> Column:
    """The VARIANT between a text's first and last brace; null without one."""
    return F.try_parse_json(F.nullif(F.regexp_extract(_col(text), r"(?s)\{.*\}", 0), F.lit("")))


def grade(text, threshold: float) -> Column:
    """(relevant, reason, score, confidence) of a grading answer; one that cannot be read is irrelevant with confidence 0."""
    v = sliced_object(text)
    number = F.coalesce(F.try_variant_get(v, "$.score", "double"), F.lit(0.0))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), number))
    above = F.least(F.lit(1.0), (score - threshold) / (1.0 - threshold) + 0.5)
    below = F.least(F.lit(1.0), (threshold - score) / threshold + 0.5)
    read = F.struct(
        (F.coalesce(F.try_variant_get(v, "$.relevant", "boolean"), F.lit(False)) & (score >= threshold)).alias("relevant"), F.coalesce(F.try_variant_get(v, "$.reason", "string"), F.lit(NO_REASON)).alias("reason"),
        score.alias("score"), F.when(score >= threshold, above).otherwise(below).alias("confidence"),
    )
    lost = F.struct(F.lit(False).alias("relevant"), F.lit(UNREADABLE).alias("reason"), F.lit(0.0).alias("score"), F.lit(0.0).alias("confidence"))
    return F.when(v.isNotNull(), read).otherwise(lost)


def answer_errors(text, mode) -> Column:
    """What is wrong with a structured answer in a mode: schema, unsourced, refusal; empty if nothing is."""
    a = F.from_json(_col(text), ANSWER)
    broken = a.isNull() | a.svar.isNull() | a.saknas_underlag.isNull()
    evidence = F.upper(_col(mode)) == "EVIDENCE"
    unsourced = evidence & (F.size(F.coalesce(a.fakta_utan_kalla, F.array().cast("array<string>"))) > 0)
    unrefused = evidence & a.saknas_underlag & ~F.contains(a.svar, F.lit(REFUSAL))
    return F.when(broken, F.array(F.lit("schema"))).otherwise(F.array_compact(F.array(F.when(unsourced, "unsourced"), F.when(unrefused, "refusal"))))


def public_answer(text) -> Column:
    """A structured answer as JSON, without its internal note."""
    return F.to_json(F.from_json(_col(text), ANSWER).dropFields(INTERNAL_NOTE))


def tolerant_json(text, most: int = 500) -> Column:
    """A VARIANT of a JSON text; of one that is cut off its first characters under ``raw``; an empty object for none."""
    t = F.coalesce(_col(text), F.lit(""))
    raw = F.parse_json(F.to_json(F.struct(F.substring(t, 1, most).alias("raw"))))
    return F.when(t == "", F.parse_json(F.lit("{}"))).otherwise(F.coalesce(F.try_parse_json(t), raw))


def table_text(table: dict[str, Column], metadata: dict[str, Column], variables: Column) -> Column:
    """The lines that describe a statistics table: its fields, its metadata's, and the names of its variables; null fields give none."""
    line = lambda label, c: F.when(c.isNotNull(), F.concat(F.lit(f"{label}: "), c.cast("string")))
    fields = [line(label, table[k]) for k, label in TABLE_LABELS if k in table] + [line(label, metadata[k]) for k, label in METADATA_LABELS if k in metadata]
    return F.concat_ws("\n", *fields, F.when(variables.isNotNull(), F.concat(F.lit("Variabler: "), F.array_join(variables, ", "))))


def news_fields(outlet, meta) -> Column:
    """title, description, author and section of an article from its page's metadata (a map), by outlet.

    A broadcaster's title ends in its programme, which becomes the section.
    """
    o, m = _col(outlet), _col(meta)
    get = lambda k: F.try_element_at(m, F.lit(k))
    title, cut = F.coalesce(get("title"), F.lit("")), F.regexp_extract(get("title"), r"(?s)\A(.*) - (.*)\z", 1)
    programme = F.replace(F.regexp_extract(get("title"), r"(?s)\A(.*) - (.*)\z", 2), F.lit(RADIO_SUFFIX), F.lit(""))
    spoken = F.contains(title, F.lit(" - "))
    radio = o == "sr"
    author = F.when(o == "svd", F.coalesce(get("author"), get("article:author"))).otherwise(F.coalesce(get("author"), *(F.when(o == k, v) for k, v in DEFAULT_AUTHORS.items())))
    return F.struct(
        F.when(radio, F.when(spoken, cut).otherwise(title)).otherwise(F.coalesce(get("ogTitle"), title)).alias("title"), F.coalesce(get("ogDescription"), get("description"), F.lit("")).alias("description"),
        author.alias("author"), F.when(radio, F.when(spoken, programme)).otherwise(F.coalesce(get("article:section"), F.when(o == "svd", get("lp:section")))).alias("section"),
    )


def news_text(title, description, section, tags) -> Column:
    """The text of an article that is embedded: title, description, category and its first five tags, whatever there is of them."""
    some = lambda c: F.nullif(_col(c), F.lit(""))
    t = F.slice(_col(tags), 1, 5)
    return F.concat_ws("\n", some(title), some(description), F.when(some(section).isNotNull(), F.concat(F.lit("Kategori: "), section)), F.when(F.size(t) > 0, F.concat(F.lit("Ämnen: "), F.array_join(t, ", "))))


def legal_names(text) -> Column:
    """Legal names of a text in capitals, pattern by pattern, each once."""
    low = F.lower(F.coalesce(_col(text), F.lit("")))
    found = F.flatten(F.array(*(F.regexp_extract_all(low, F.lit(f"(?iU){p}"), F.lit(1)) for p in U.LEGAL_NAME_RULES[1])))
    return F.array_distinct(F.transform(found, F.upper))
