"""Queries of statutes and Markdown.  Both are built from the lines of every document, by the SQL alike."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import segments as G
from lodestone.plans.registry import Tables, query

SHORT = ("RF", "TF", "BrB", "XX")
_TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LINES = "string_split(text, chr(10))"
_KEY = f"[{', '.join(repr(s) for s in SHORT)}][doc_id % 4 + 1]"
_NR = "CASE WHEN doc_id % 5 = 4 THEN '1810:0926' ELSE '2000:' || doc_id END"
_BODY = f"""array_to_string(list_transform({_LINES}, lambda l, i: CASE WHEN doc_id % 5 = 4 THEN 'Art. ' || i || ' ' || l WHEN doc_id % 5 < 2 AND i % 4 = 1 THEN (i // 4 + 1) || ' kap. ' || l || chr(10) || i || ' § ' || l ELSE i || ' § ' || l END), chr(10))"""
_STATUTES = f"SELECT doc_id, {_KEY} AS short, {_NR} AS nr, 'Lag ' || source || chr(10) || 'SFS nr: ' || {_NR} || chr(10) || 'Utfärdad: 2001-02-03 ' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'Ändrad: t.o.m. ' ELSE 'Omtryck: ' END || lang || chr(10) || {_BODY} AS s FROM documents"


def statutes(t: Tables):
    """doc_id, short, nr and s: a statute with header lines, with chapters, paragraphs alone, or articles, by the id."""
    kind, i = F.col("doc_id") % 5, None
    lines = F.split("text", "\n", -1)

    def line(x, j):
        n = (j + 1).cast("string")
        plain = F.concat(n, F.lit(" § "), x)
        chapter = F.concat((F.floor((j + 1) / 4) + 1).cast("string"), F.lit(" kap. "), x, F.lit("\n"), plain)
        return F.when(kind == 4, F.concat(F.lit("Art. "), n, F.lit(" "), x)).when((kind < 2) & ((j + 1) % 4 == 1), chapter).otherwise(plain)

    nr = F.when(kind == 4, G.BY_ARTICLES).otherwise(F.concat(F.lit("2000:"), F.col("doc_id").cast("string")))
    short = F.element_at(F.array(*(F.lit(s) for s in SHORT)), (F.col("doc_id") % 4 + 1).cast("int"))
    changed = F.when(F.col("doc_id") % 2 == 0, "Ändrad: t.o.m. ").otherwise("Omtryck: ")
    body = F.array_join(F.transform(lines, line), "\n")
    text = F.concat(F.lit("Lag "), "source", F.lit("\nSFS nr: "), nr, F.lit("\nUtfärdad: 2001-02-03 \n"), changed, "lang", F.lit("\n"), body)
    return t("documents").select("doc_id", short.alias("short"), nr.alias("nr"), text.alias("s"))


@query("i30_statute_headers", f"SELECT doc_id, trim(string_split(s, chr(10))[1], {_TRIM}) AS titel, nr AS sfs_nummer, '2001-02-03' AS utfardad, CASE WHEN doc_id % 2 = 0 THEN 't.o.m. ' || lang ELSE lang END AS senast_andrad FROM ({_STATUTES}) JOIN documents USING (doc_id)")
def _(t: Tables):
    return statutes(t).select("doc_id", G.statute_header("s").alias("h")).select("doc_id", "h.titel", "h.sfs_nummer", "h.utfardad", "h.senast_andrad")


_MARK = lambda text, pattern, flags="g": f"regexp_replace({text}, '(?m)^({pattern})', chr(1) || '\\1', '{flags}')"
_PART = lambda text, pattern, flags="g": f"list_filter(string_split({_MARK(text, pattern, flags)}, chr(1)), lambda p: regexp_matches(p, '^(?:{pattern})'))"
_CH, _PA, _AR = "[0-9]+[a-z]?\\s*kap\\.", "[0-9]+[a-z]?\\s*§", "Art\\.\\s*[0-9]+"
_CUT = f"""WITH s AS (SELECT doc_id, short, nr, s, doc_id % 5 AS kind FROM ({_STATUTES})),
    b AS (SELECT *, CASE WHEN kind = 4 THEN regexp_extract(s, '(?s)\\n\\s*(Art\\.\\s*1.*)$', 1) ELSE regexp_extract(s, '(?s)\\n\\s*((?:1 kap\\.|1 §).*)$', 1) END AS t FROM s),
    c AS (SELECT *, {_PART('t', _CH)} AS ch FROM b),
    k AS (SELECT doc_id, short, nr, unnest(ch) AS p, unnest(range(len(ch))) AS ci FROM c WHERE kind <> 4 AND len(ch) > 0),
    h AS (SELECT *, regexp_extract(p, '^({_CH})', 1) AS kapitel, regexp_extract(p, '(?m)^(?:{_CH})\\s*(.*)$', 1) AS rubrik, regexp_replace(p, '^(?:{_CH})\\s*[^\\n]*', '') AS rest FROM k),
    parts AS (SELECT doc_id, short, nr, ci, kapitel, rubrik, {_PART('rest', _PA)} AS pa FROM h
        UNION ALL SELECT doc_id, short, nr, 0, NULL, NULL, CASE WHEN kind = 4 THEN {_PART('t', _AR)} ELSE {_PART('t', _PA)} END FROM c WHERE kind = 4 OR len(ch) = 0),
    e AS (SELECT doc_id, short, nr, ci, trim(kapitel, {_TRIM}) AS kapitel, trim(rubrik, {_TRIM}) AS rubrik, unnest(pa) AS p, unnest(range(len(pa))) AS pi FROM parts),
    r AS (SELECT doc_id, short, nr, row_number() OVER (PARTITION BY doc_id ORDER BY ci, pi) - 1 AS pos, kapitel, rubrik, trim(regexp_extract(p, '^(?:{_PA}|{_AR})'), {_TRIM}) AS paragraf, trim(p, {_TRIM}) AS text FROM e)"""


@query("i29_statute_chunks", f"{_CUT} SELECT doc_id, pos, kapitel, rubrik, paragraf, md5(text) AS h, replace(replace(concat_ws('_', nr, kapitel, paragraf), ' ', '_'), '.', '') AS chunk_id FROM r")
def _(t: Tables):
    got = G.statute_chunks(statutes(t), "doc_id", "s", "nr")
    return got.select("doc_id", F.col("pos").cast("long").alias("pos"), "kapitel", F.col("kapitel_rubrik").alias("rubrik"), "paragraf", F.md5(F.col("text").cast("binary")).alias("h"), "chunk_id")


_NAMES = " ".join(f"WHEN '{k}' THEN ' - {v}'" for k, v in G.READABLE_NAMES)


@query(
    "j29_statute_records",
    f"""{_CUT} SELECT doc_id, pos, short || coalesce(' ' || kapitel, '') || ' ' || paragraf || CASE short {_NAMES} ELSE '' END AS title, md5(short || ' ' || coalesce(kapitel || CASE WHEN rubrik <> '' THEN ' ' || rubrik ELSE '' END, '') || ' ' || paragraf || chr(10) || text) AS search_md5,
    concat_ws('_', 'sfs', nr, kapitel, paragraf, substr(sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' '))), 1, 12)) AS stable_id FROM r""",
)
def _(t: Tables):
    base = statutes(t)
    chunks = G.statute_chunks(base.withColumn("key", F.struct("doc_id", "short", "nr")), "key", "s", "nr").select("key.*", "pos", "kapitel", "kapitel_rubrik", "paragraf", "text")
    done = G.statute_records(chunks, "nr", "short")
    return done.select("doc_id", F.col("pos").cast("long").alias("pos"), "title", F.md5(F.col("search_text").cast("binary")).alias("search_md5"), "stable_id")


HEADS = ("Arkitektur", "API", "Workflow", "Config", "Debug", "Install", "Annat")
_HEAD = f"[{', '.join(repr(h) for h in HEADS)}]"
_MD = f"""SELECT doc_id, source, array_to_string(list_transform({_LINES}, lambda l, i: CASE i % 9 WHEN 1 THEN '## ' || {_HEAD}[(i // 9) % 7 + 1] || ' ' || source WHEN 3 THEN '### 2020-01-0' || (i % 8 + 1) WHEN 5 THEN 'Gör: ' || source || chr(10) || chr(10) || '```python' || chr(10) || l || chr(10) || '```' WHEN 7 THEN '### ' || i || '. **' || lang || '** x' ELSE l END), chr(10)) AS m FROM documents"""


def notes(t: Tables):
    """doc_id, source and m: Markdown with headings, dates, code and numbered evidence between the lines."""

    def line(x, j):
        i = j + 1
        head = F.concat(F.lit("## "), F.element_at(F.array(*(F.lit(h) for h in HEADS)), (F.floor(i / 9) % 7 + 1).cast("int")), F.lit(" "), "source")
        code = F.concat(F.lit("Gör: "), "source", F.lit("\n\n```python\n"), x, F.lit("\n```"))
        return (
            F.when(i % 9 == 1, head).when(i % 9 == 3, F.concat(F.lit("### 2020-01-0"), (i % 8 + 1).cast("string"))).when(i % 9 == 5, code)
            .when(i % 9 == 7, F.concat(F.lit("### "), i.cast("string"), F.lit(". **"), "lang", F.lit("** x"))).otherwise(x)
        )

    return t("documents").select("doc_id", "source", F.array_join(F.transform(F.split("text", "\n", -1), line), "\n").alias("m"))


def _kind(t: Tables, kind: str):
    got = G.blocks(notes(t), "doc_id", "m", (kind,))
    return got.select("doc_id", F.col("pos").cast("long").alias("pos"), "header", F.md5(F.col("body").cast("binary")).alias("h"))


_EACH = lambda pieces, header, body, more: f"WITH p AS (SELECT doc_id, {pieces} AS ps FROM ({_MD})), e AS (SELECT doc_id, unnest(ps) AS p, unnest(range(len(ps))) AS o FROM p), b AS (SELECT doc_id, o, {header} AS header, trim({body}, {_TRIM}) AS body FROM e), k AS (SELECT * FROM b WHERE {more}) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS pos, header, md5(body) AS h FROM k"
_SECTIONS = f"list_filter(string_split({_MARK('m', '#{1,3}[ \\t]+[^\\n]')}, chr(1)), lambda p: regexp_matches(p, '^#{{1,3}}[ \\t]+[^\\n]') AND contains(p, chr(10)))"


@query("i31b_sections", _EACH(_SECTIONS, "regexp_extract(p, '^#{1,3}[ \\t]+([^\\n]+)', 1)", "regexp_replace(p, '^[^\\n]*\\n', '')", "length(body) > 50"))
def _(t: Tables):
    return _kind(t, "section")


@query("i32_code_examples", _EACH("regexp_extract_all(m, '[^\\n]+\\n\\n```\\w+\\n[\\s\\S]+?\\n```')", "'Visa hur man ' || lower(trim(list_last(string_split(regexp_extract(p, '^([^\\n]+)', 1), ':')), ' '))", "regexp_extract(p, '(?s)(```.*)$', 1)", "length(body) >= 64"))
def _(t: Tables):
    """Code of 50 characters and more: 64 with the fences and the language."""
    return _kind(t, "code")


_SPLIT = lambda mark, test: f"list_filter(string_split(regexp_replace(m, '({mark})', chr(1) || '\\1', 'g'), chr(1)), lambda p: regexp_matches(p, '{test}'))"


@query("i33_timeline", _EACH(_SPLIT("###\\s+[0-9]{4}", "^###\\s+[0-9]{4}-[0-9]{2}-[0-9]{2}\\n"), "regexp_extract(p, '^###\\s+([0-9-]{10})', 1)", "regexp_replace(p, '^[^\\n]*\\n', '')", "length(body) > 100"))
def _(t: Tables):
    return _kind(t, "timeline")


@query("i76_evidence_entries", _EACH(_SPLIT("###\\s+[0-9]+\\.", "^###\\s+[0-9]+\\.\\s+\\*\\*.+?\\*\\*"), "'#' || regexp_extract(p, '^###\\s+([0-9]+)', 1) || ': ' || regexp_extract(p, '\\*\\*(.+?)\\*\\*', 1)", "regexp_replace(p, '^[^\\n]*\\n', '')", "length(body) > 100"))
def _(t: Tables):
    return _kind(t, "evidence")


_ASK = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(header), '{w}')" for w in ws) + " THEN replace('" + form.replace("'", "''") + "', '%s', header)" for ws, form in G.SECTION_QUESTIONS) + f" ELSE replace('{G.OTHER_QUESTION}', '%s', header) END"


@query("i34_section_questions", f"WITH p AS (SELECT doc_id, {_SECTIONS} AS ps FROM ({_MD})), e AS (SELECT doc_id, unnest(ps) AS p FROM p), b AS (SELECT doc_id, regexp_extract(p, '^#{{1,3}}[ \\t]+([^\\n]+)', 1) AS header, trim(regexp_replace(p, '^[^\\n]*\\n', ''), {_TRIM}) AS body FROM e) SELECT {_ASK} AS question, count(*) AS n FROM b WHERE length(body) >= 100 GROUP BY 1")
def _(t: Tables):
    return G.section_questions(G.blocks(notes(t), "doc_id", "m", ("section",))).groupBy("question").agg(F.count("*").alias("n"))
