"""Rules as data: named groups of patterns, compiled into one projection that gives matches, counts and the winner.

A group is a name and its patterns, in order; every pattern is a literal, so
Spark compiles it once a task.  ``matched`` gives the patterns of a group that a
text has, ``hits`` their number; classifications are contests between groups.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Group = tuple[str, tuple[str, ...]]

#: Intent groups in the order in which they are tried, and their patterns.
INTENT_RULES: tuple[Group, ...] = (
    ("smalltalk", (r"^hej\b", r"^hallå\b", r"^god\s+(morgon|dag|kväll)\b", r"\bhur\s+mår\s+(du|ni)\b", r"\bvad\s+är\s+klockan\b", r"^tack\b")),
    ("edge_abbr", (r"\b(RF|TF|YGL|OSL|FL|BrB|RB)\s+\d+[:\s]*\d*\b", r"\bvad\s+står\s+i\s+(RF|TF|YGL|OSL)\s+\d+")),
    ("edge_clar", (r"\bmenar\s+du\b", r"\bvilken\s+(av|mellan)\b")),
    ("parliament_trace", (
        r"\bhur\s+har\s+riksdagen\s+behandlat\b", r"\bhur\s+behandlades\b", r"\bvilket\s+utskott\b", r"\bbetänkande(t|n)?\b", r"\bvotering(en)?\b", r"\bhur\s+röstade\b",
        r"\bproposition(en)?\s+(om|gällande)\b", r"\briksdagsbeslut\b", r"\butskottsbehandling\b",
    )),
    ("policy_arguments", (
        r"\bvilka\s+argument\b", r"\bvad\s+(sa|sade|menade)\s+(partierna|oppositionen|regeringen)\b", r"\bvilka\s+partier\s+(var\s+för|stödde|motsatte)\b",
        r"\bpolitisk(a)?\s+(argument|position|ståndpunkt)\b", r"\bkritik(en)?\s+mot\b",
    )),
    ("research", (
        r"\bvad\s+säger\s+forskningen\b", r"\bevidens\s+(för|om|visar|finns)\b", r"\bstudier\s+(visar|om)\b", r"\bforskningsläge(t)?\b", r"\bmeta-?analys\b",
        r"\bvetenskaplig(a|t)?\s+(stöd|belägg)\b",
    )),
    ("practical", (
        r"\bhur\s+fungerar\b", r"\bhur\s+gör\s+(man|jag)\b", r"\bhur\s+begär\b", r"\bhur\s+överklagar\b", r"\bhur\s+ansöker\b", r"\bhur\s+får\s+(man|jag)\b", r"\bhur\s+kan\s+(man|jag)\b",
        r"\bvilka\s+steg\b", r"\bvad\s+är\s+processen\b", r"\bvad\s+innebär\s+\w*skyldighet", r"\bvad\s+innebär\s+\w*princip", r"\bskillnaden\s+mellan\b", r"\bsteg\s+för\s+steg\b",
        r"\bpraktiskt\b", r"\bi\s+praktiken\b",
    )),
    ("legal_text", (
        r"\bvad\s+säger\b", r"\benligt\s+(RF|TF|YGL|OSL|FL|BrB|RB)", r"\bvad\s+står\s+i\b", r"\b(regeringsformen|tryckfrihetsförordningen|yttrandefrihetsgrundlagen)\b",
        r"\b(offentlighets-?\s*och\s*sekretesslagen|förvaltningslagen|brottsbalken)\b", r"\bvilka\s+(grundläggande\s+)?rättigheter\b", r"\bvilka\s+fri-?\s*och\s*rättigheter\b",
        r"\bgrundag(en|ar|arna)?\b", r"\b\d+\s*kap\.?\s*\d*\s*§\b",
    )),
)

#: Confidence of an intent: what it is without matches, what each adds, at most.
INTENT_CONFIDENCE = {
    "smalltalk": (0.95, 0.0, 0.95), "edge_abbr": (0.90, 0.0, 0.90), "edge_clar": (0.85, 0.0, 0.85), "parliament_trace": (0.70, 0.10, 0.95), "policy_arguments": (0.70, 0.10, 0.95),
    "research": (0.70, 0.10, 0.95), "practical": (0.60, 0.15, 0.95), "legal_text": (0.60, 0.15, 0.95), "unknown": (0.30, 0.0, 0.30),
}

#: Collections of an intent, the first one primary.
INTENT_COLLECTIONS = {
    "smalltalk": (), "edge_abbr": ("sfs_lagtext", "riksdag_documents"), "edge_clar": ("sfs_lagtext", "swedish_gov_docs"),
    "parliament_trace": ("riksdag_documents", "swedish_gov_docs", "sfs_lagtext"), "policy_arguments": ("riksdag_documents", "swedish_gov_docs"),
    "research": ("swedish_gov_docs", "riksdag_documents"), "practical": ("procedural_guides", "sfs_lagtext", "swedish_gov_docs", "riksdag_documents"),
    "legal_text": ("sfs_lagtext", "riksdag_documents", "swedish_gov_docs"), "unknown": ("sfs_lagtext", "riksdag_documents", "swedish_gov_docs"),
}

#: Patterns of unsafe queries and answers.
SECURITY_RULES: Group = ("security", (
    r"(ignore|bypass|override)\s+(instructions|rules|constraints)", r"(forget|pretend|act)\s+(like|as)", r"(reveal|show|display)\s+(system|prompt|instructions)",
    r"(root|admin)\s+(access|password|key)", r"(jailbreak|injection|prompt\s+injection)", r"(code|execute|run)\s+(shell|command|script)",
))

#: Forms of a citation.
CITATION_RULES: Group = ("citation", (r"\[Källa\s+\d+\]", r"\[Source\s+\d+\]", r"\[källa\s+\d+\]", r"\[doc\s+\d+\]"))

#: Patterns of the modes; those of chat stand at the beginning of the query.
MODE_RULES: tuple[Group, ...] = (
    ("chat", (
        r"^(hej|tjena|hallå|hejsan|god\s+(morgon|dag|kväll))[\s!?]*$", r"^(tack|tackar|bra jobbat|fint)[\s!?]*$", r"^(vem är du|vad kan du|hur funkar du)[\s!?]*", r"^(ja|nej|ok|okej|alright)[\s!?]*$",
    )),
    ("evidence", (r"vad säger (lagen|lagstiftningen|rf|gdpr|osl|tf)", r"enligt \d+\s*(kap|§|kapitel)", r"visa (paragrafen|lagtext|källa|citera)\s*", r"(sfs|prop|sou)\s*\d{4}:\d+")),
)

#: Patterns of legal names in earlier turns.
LEGAL_NAME_RULES: Group = ("legal_name", (
    r"(GDPR|gdpr)", r"(OSL|osl|offentlighets.*lagen)", r"(TF|tf|tryckfrihetsförordningen)", r"(RF|rf|regeringsformen)", r"(SFS\s*\d{4}:\d+)", r"(prop\.\s*\d{4}/\d{2,4}:\d+)", r"(SOU\s*\d{4}:\d+)",
    r"(personuppgiftslagen|pul)",
))

LONGEST_QUERY = 2000


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _flags(group: Group) -> str:
    """Patterns ignore case but for those of citations."""
    return "(?U)" if group is CITATION_RULES else "(?iU)"


def matched(text, group: Group) -> Column:
    """The patterns of a group that stand in a text, in order."""
    t = _col(text)
    return F.array_compact(F.array(*(F.when(t.rlike(_flags(group) + p), F.lit(p)) for p in group[1])))


def hits(text, group: Group) -> Column:
    """How many patterns of a group stand in a text."""
    t = _col(text)
    return sum((F.coalesce(t.rlike(_flags(group) + p).cast("int"), F.lit(0)) for p in group[1]), F.lit(0))


def found_texts(text, group: Group) -> Column:
    """What every pattern of a group finds in a text, pattern by pattern."""
    t = F.coalesce(_col(text), F.lit(""))
    return F.flatten(F.array(*(F.regexp_extract_all(t, F.lit(_flags(group) + p), F.lit(0)) for p in group[1])))


def intent_counts(text) -> Column:
    """Hits of every intent group, as a struct."""
    low = F.trim(F.lower(_col(text)))
    return F.struct(*(hits(low, g).alias(g[0]) for g in INTENT_RULES))


def intent(counts) -> Column:
    """(intent, confidence, hits): the first group with a hit; the last two contend by their hits, the first of them winning ties."""
    n = _col(counts)
    case = None
    for name, _ in INTENT_RULES:
        won = n[name] > 0
        if name == "practical":
            won &= n[name] >= n["legal_text"]
        base, each, most = INTENT_CONFIDENCE[name]
        value = F.struct(F.lit(name).alias("intent"), F.least(F.round(F.lit(base) + F.lit(each) * n[name], 6), F.lit(most)).alias("confidence"), n[name].alias("hits"))
        case = F.when(won, value) if case is None else case.when(won, value)
    return case.otherwise(F.struct(F.lit("unknown").alias("intent"), F.lit(INTENT_CONFIDENCE["unknown"][0]).alias("confidence"), F.lit(0).alias("hits")))


def mode(text) -> Column:
    """chat, evidence or assist."""
    low = F.trim(F.lower(F.coalesce(_col(text), F.lit(""))))
    chat, evidence = (hits(low, g) > 0 for g in MODE_RULES)
    return F.when(chat, "chat").when(evidence, "evidence").otherwise("assist")


def unsafe_reason(text) -> Column:
    """Why a query is refused: security, length, shouting or special characters; null if it is not."""
    t = F.coalesce(_col(text), F.lit(""))
    n = F.length(t)
    caps, special = F.length(F.regexp_replace(t, r"[^\p{Lu}]", "")), F.length(F.regexp_replace(t, r"[\p{L}\p{N} ]", ""))
    return (
        F.when(hits(t, SECURITY_RULES) > 0, "security").when(n > LONGEST_QUERY, "length")
        .when((n > 50) & (caps > 0.8 * n), "capitals").when((n > 50) & (special > 0.3 * n), "special")
    )


def violations(text) -> Column:
    """The texts that match a security pattern, pattern by pattern."""
    return found_texts(text, SECURITY_RULES)


def evidence_level(text) -> Column:
    """HIGH for three or more forms of citation in a text, LOW for one, NONE without."""
    n = hits(text, CITATION_RULES)
    return F.when(n >= 3, "HIGH").when(n >= 1, "LOW").otherwise("NONE")


def citation_issues(text) -> Column:
    """Issues of a text's citations: one for each, whose form is never complete, and one for each repeated number."""
    found = found_texts(text, CITATION_RULES)
    numbers = F.transform(found, lambda m: F.regexp_extract(m, r"\d+", 0).cast("decimal(38,0)"))
    return F.size(found) + F.size(numbers) - F.size(F.array_distinct(numbers))


def validated(df, text: str = "text", asked: str = "query", mode_of: str = "mode"):
    """``df`` with an answer's corrected text and verdict.

    Adds refused (why the question is, else null), corrected, corrections
    (terms, and citation issues in evidence mode), confidence (times 0.8 with
    citation issues), evidence, leaks (security matches of a chat answer) and
    status: refused, error, corrected or unchanged.
    """
    from lodestone.functions.text import correct_terms

    out = correct_terms(df.withColumn("_own", F.col(text)), text)
    low = F.lower(mode_of)
    issues = F.when(low == "evidence", citation_issues(text)).otherwise(F.lit(0))
    leaks = F.when(low == "chat", F.size(violations(text))).otherwise(F.lit(0))
    out = out.withColumn("refused", unsafe_reason(asked)).withColumn("corrected", F.col(text)).withColumn("_issues", issues).withColumn("leaks", leaks)
    out = out.withColumn("corrections", F.col("terms") + F.col("_issues")).withColumn("confidence", F.when(F.col("_issues") > 0, F.col("confidence") * 0.8).otherwise(F.col("confidence")))
    out = out.withColumn("evidence", evidence_level("corrected"))
    status = F.when(F.col("refused").isNotNull(), "refused").when(F.col("leaks") > 0, "error").when(F.col("terms") > 0, "corrected").otherwise("unchanged")
    return out.withColumn("status", status).withColumn(text, F.col("_own")).drop("_own", "_issues", "n", "terms")
