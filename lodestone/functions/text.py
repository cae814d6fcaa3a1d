"""Text expressions: tokens, keywords, entities, chunks, classes, ids and checks.

All are Columns, so they stay in generated code and can be pushed and fused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.rules import SECURITY_RULES, hits

#: Words that carry no meaning of their own.
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "de", "der", "die", "en", "for", "from", "har", "i", "in", "is", "it", "la", "le", "of", "och", "on", "som", "that", "the", "this", "to", "und", "was", "with", "är")
#: Pronouns that need an earlier turn to be understood.
PRONOUNS = ("den", "det", "denna", "detta", "dessa", "he", "it", "she", "that", "they", "this")
#: An edge between an ASCII word character and any other.  What ``\b`` takes for letters differs from engine to engine and from one Java to the next.
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
#: A personal number.
PERSONAL_NUMBER = r"\b(19|20)\d{6}-?\d{4}\b"
DATE_IN_TEXT = r"((?:19|20)\d{2})-(\d{2})-(\d{2})"
WORD = r"[\p{L}\p{N}_]+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text, least: int = 1) -> Column:
    """Words of the lower-case text with at least ``least`` characters."""
    found = F.regexp_extract_all(F.lower(_col(text)), F.lit(WORD), F.lit(0))
    return F.filter(found, lambda w: F.length(w) >= least) if least > 1 else found


def keywords(text, least: int = 3, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Distinct words of some length that are no stop words, in order."""
    return F.array_distinct(F.filter(tokens(text, least), lambda w: ~w.isin(*stopwords)))


def meaningful_tokens(text) -> Column:
    """Distinct words of three characters and more that are no numbers."""
    return F.array_distinct(F.filter(tokens(text, 3), lambda w: ~w.rlike(r"^\d+$")))


def snippet(text, size: int = 1500) -> Column:
    """The first ``size`` characters, with an ellipsis only if something is left out."""
    t = _col(text)
    return F.when(F.length(t) > size, F.concat(F.substring(t, 1, size), F.lit("..."))).otherwise(t)


def token_estimate(text) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(_col(text)) / 4)).cast("long")


def chunk_starts(text, size: int, overlap: int) -> Column:
    """0-based starts of fixed-size chunks: the last is the first that reaches the end."""
    n, step = F.length(_col(text)), size - overlap
    last = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - size) / F.lit(step)).cast("int") * step)
    return F.sequence(F.lit(0), last, F.lit(step))


def chunks(text, size: int, overlap: int) -> Column:
    """Fixed-size chunks with overlap, trimmed, empty ones dropped."""
    t = _col(text)
    return F.filter(F.transform(chunk_starts(text, size, overlap), lambda s: F.trim(F.substring(t, s + 1, F.lit(size)))), lambda c: c != "")


def falsy(*columns) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(_col(c), F.lit("")) for c in columns))


def first_match(text, cases: tuple[tuple[str, str], ...], default: str) -> Column:
    """Label of the first pattern that the text matches."""
    case, t = None, _col(text)
    for pattern, label in cases:
        case = F.when(t.rlike(pattern), label) if case is None else case.when(t.rlike(pattern), label)
    return case.otherwise(default)


def matches(text, patterns: tuple[str, ...]) -> Column:
    """How many of the patterns the text matches."""
    t = _col(text)
    return sum((F.coalesce(t.rlike(p).cast("int"), F.lit(0)) for p in patterns), F.lit(0))


def unsafe_query(text, longest: int = 2000) -> Column:
    """Security patterns, excessive length, or mostly capitals or special characters."""
    t = _col(text)
    n = F.length(t)
    caps = F.length(F.regexp_replace(t, r"[^\p{Lu}]", "")) / n
    special = F.length(F.regexp_replace(t, r"[\p{L}\p{N}\s]", "")) / n
    return (hits(text, SECURITY_RULES) > 0) | (n > longest) | ((n > 50) & ((caps > 0.8) | (special > 0.3)))


def strip_html(text) -> Column:
    return F.trim(F.regexp_replace(_col(text), r"<[^>]+>", ""))


def stable_id(prefix: str, parts: list, text) -> Column:
    """prefix_parts_hash12, the hash taken over lower-case text with single blanks."""
    norm = F.lower(F.trim(F.regexp_replace(_col(text), r"\s+", " ")))
    return F.concat_ws("_", F.lit(prefix), *(_col(p).cast("string") for p in parts), F.substring(F.sha2(norm, 256), 1, 12))


#: Outdated legal terms in the order in which they are corrected: term, its correction, confidence.
TERM_CORRECTIONS = (
    ("datainspektionen", "Integritetsskyddsmyndigheten (IMY)", 0.95),
    ("personuppgiftslagen", "GDPR och Dataskyddslagen (2018:218)", 0.98),
    ("pul", "GDPR och Dataskyddslagen (2018:218)", 0.99),
    ("pressfrihetslagen", "Tryckfrihetsförordningen (TF)", 0.92),
    ("grundlagen", "Regeringsformen (RF)", 0.90),
    ("offentlighetslagen", "Offentlighets- och sekretesslagen (OSL)", 0.93),
    ("sekretesslagen", "Offentlighets- och sekretesslagen (OSL)", 0.94),
    ("barnkonventionen", "Barnkonventionen (SFS 2018:1197)", 0.91),
    ("diskrimineringsombudsmannen", "Diskrimineringsombudsmannen (DO)", 0.88),
    ("jämställdhetsombudsmannen", "Diskrimineringsombudsmannen (DO)", 0.88),
    ("handikappombudsmannen", "Diskrimineringsombudsmannen (DO)", 0.88),
    ("konsumentombudsmannen", "Konsumentverket", 0.85),
    ("konstitutionsutskottet", "Konstitutionsutskottet (KU)", 0.86),
)


def correct_terms(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``text`` corrected term by term, each seeing the output of those before it.

    Adds n (occurrences), terms (different ones) and confidence (their mean, 1 if there are none).
    """
    # as a pattern in any case sees the letters; until something is corrected, a text without a term's letters needs no pattern
    out = df.withColumn("_low", F.lower(F.translate(text, "İıſ", "iis")))
    out = out.withColumns({"n": F.lit(0).cast("long"), "terms": F.lit(0).cast("long"), "confidence": F.lit(0.0)})
    for term, corrected, confidence in TERM_CORRECTIONS:
        pattern = rf"(?iu)(?<![\p{{L}}\p{{N}}_]){term}(?![\p{{L}}\p{{N}}_])"
        near = F.contains("_low", F.lit(term)) | (F.col("n") > 0)
        here = F.when(near, F.regexp_count(text, F.lit(pattern))).otherwise(0)
        out = out.withColumns({
            text: F.when(near, F.regexp_replace(text, pattern, corrected)).otherwise(F.col(text)), "n": F.col("n") + here,
            "terms": F.col("terms") + (here > 0).cast("long"), "confidence": F.col("confidence") + F.when(here > 0, confidence).otherwise(0.0),
        })
    return out.drop("_low").withColumn("confidence", F.when(F.col("terms") > 0, F.col("confidence") / F.col("terms")).otherwise(1.0))


def short_hash(value, size: int = 16) -> Column:
    return F.substring(F.sha2(_col(value), 256), 1, size)


def date_in(text) -> Column:
    """The first YYYY-MM-DD with month 1-12 and day 1-31, else null."""
    t = _col(text)
    part = lambda i: F.regexp_extract(t, DATE_IN_TEXT, i).try_cast("int")
    return F.when(part(2).between(1, 12) & part(3).between(1, 31), F.regexp_extract(t, DATE_IN_TEXT, 0))


def title_of_url(url) -> Column:
    """The last path segment in title case."""
    path = F.regexp_extract(_col(url), r"^[a-z]+://[^/]+(/[^?#]*)", 1)
    return F.initcap(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"[-_]+", " "))


def paraphrase(text) -> Column:
    """A question as a keyword phrase; other texts as their first keywords."""
    t = F.lower(F.trim(_col(text)))
    rules = ((r"^(?:what|which) (?:is|are) (.+)$", "$1 definition"), (r"^how (?:do|does|can) (.+)$", "$1 procedure"), (r"^why (?:is|are|do|does) (.+)$", "$1 reason"))
    case = None
    for pattern, to in rules:
        value = F.regexp_replace(t, pattern, to)
        case = F.when(t.rlike(pattern), value) if case is None else case.when(t.rlike(pattern), value)
    return case.otherwise(F.array_join(F.slice(keywords(text), 1, 5), " "))


def expanded_queries(text, lexical, n: int = 3) -> Column:
    """The query itself, its lexical form and a paraphrase, without repeats."""
    return F.slice(F.array_distinct(F.filter(F.array(_col(text), _col(lexical), paraphrase(text)), lambda q: q.isNotNull() & (q != ""))), 1, n)


def recovered_json(text) -> Column:
    """The JSON object in a model's answer: as it is, without fences, or from the first brace to the last."""
    t = F.trim(_col(text))
    bare = F.trim(F.regexp_replace(F.regexp_replace(t, r"^```(?:json)?\s*", ""), r"\s*```$", ""))
    inner = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    valid = lambda c: F.when(F.try_parse_json(c).isNotNull() & c.startswith("{"), c)
    return F.coalesce(valid(t), valid(bare), valid(inner))


def overlap_share(a: Column, b: Column) -> Column:
    """Share of a's distinct members that b has; 0 for an empty a."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(F.array_distinct(a))).otherwise(F.lit(0.0))
