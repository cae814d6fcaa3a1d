"""Queries of answers, news, chunks by tokens, large JSON files and further plain rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.functions import answers as A
from lodestone.functions import rules as U
from lodestone.functions import text as X
from lodestone.operators import retrieval as R
from lodestone.plans.q_dialogue import _COUNTS, _Q, _CASE, questions
from lodestone.plans.registry import Tables, query
from lodestone.sources import json_ranges as J
from lodestone.sources import records as S
from lodestone.storage import new_path


@query(
    "i69_grades",
    """WITH g AS (SELECT event_id, event_id % 5 = 0 OR event_id % 7 = 0 AS lost, least(1.0, (event_id % 23) / 20.0) AS s FROM events)
    SELECT event_id, NOT lost AND event_id % 2 = 0 AND s >= 0.5 AS relevant, CASE WHEN lost THEN 0 ELSE round(s, 6) END AS score, CASE WHEN lost THEN 0 WHEN s >= 0.5 THEN round(least(1, (s - 0.5) / 0.5 + 0.5), 6) ELSE round(least(1, (0.5 - s) / 0.5 + 0.5), 6) END AS confidence FROM g""",
)
def _(t: Tables):
    """Grading answers between other words; each fifth has no object, each seventh a broken one."""
    i = F.col("event_id")
    whole = F.concat(F.lit('Svar: {"relevant": '), F.when(i % 2 == 0, "true").otherwise("false"), F.lit(', "score": '), ((i % 23) / 20.0).cast("string"), F.lit(', "reason": "r"} slut'))
    text = F.when(i % 5 == 0, F.lit("inget svar")).when(i % 7 == 0, F.replace(whole, F.lit('"reason": "r"'), F.lit('"reason": "r'))).otherwise(whole)
    return t("events").select("event_id", A.grade(text, 0.5).alias("g")).select("event_id", "g.relevant", F.round("g.score", 6).alias("score"), F.round("g.confidence", 6).alias("confidence"))


def _outputs(t: Tables):
    i = F.col("event_id")
    facts = F.when(i % 3 == 0, F.lit('["x"]')).otherwise(F.lit("[]"))
    said = F.when(i % 4 == 0, F.lit(A.REFUSAL)).otherwise(F.lit("Svar"))
    text = F.concat(F.lit('{"mode":"EVIDENCE","saknas_underlag":'), F.when(i % 2 == 0, "true").otherwise("false"), F.lit(',"svar":"'), said, F.lit('","kallor":[],"fakta_utan_kalla":'), facts, F.lit(',"arbetsanteckning":"hemlig"}'))
    text = F.when(i % 11 == 0, F.lit('{"mode":"EVIDENCE"}')).when(i % 13 == 0, F.substring(text, 1, 40)).otherwise(text)
    return t("events").select("event_id", text.alias("text"), F.when(i % 5 == 0, "assist").otherwise("evidence").alias("mode"))


@query(
    "i71_output_errors",
    """SELECT event_id, CASE WHEN event_id % 11 = 0 OR event_id % 13 = 0 THEN 'schema' WHEN event_id % 5 = 0 THEN '' ELSE concat_ws(',', CASE WHEN event_id % 3 = 0 THEN 'unsourced' END, CASE WHEN event_id % 2 = 0 AND event_id % 4 <> 0 THEN 'refusal' END) END AS errors FROM events""",
)
def _(t: Tables):
    return _outputs(t).select("event_id", F.array_join(A.answer_errors("text", "mode"), ",").alias("errors"))


@query("i73_public_answers", "SELECT count(*) AS n, 0 AS leaks FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0")
def _(t: Tables):
    shown = _outputs(t).where(F.size(A.answer_errors("text", F.lit("assist"))) == 0).select(A.public_answer("text").alias("j"))
    return shown.agg(F.count_if(F.contains("j", F.lit("svar"))).alias("n"), F.count_if(F.contains("j", F.lit("hemlig"))).cast("int").alias("leaks"))


@query("i74_tolerant_metadata", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN substr(props, 1, length(props) - 1) END AS raw, CASE WHEN event_id % 3 = 1 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events")
def _(t: Tables):
    """Props of each third are cut off and kept raw; those of another third are empty."""
    text = F.when(F.col("event_id") % 3 == 0, F.expr("substring(props, 1, length(props) - 1)")).when(F.col("event_id") % 3 == 1, F.col("props"))
    v = A.tolerant_json(text)
    return t("events").select("event_id", F.try_variant_get(v, "$.raw", "string").alias("raw"), F.try_variant_get(v, "$.k", "bigint").alias("k"))


@query("i45_statistics_text", "SELECT p_partkey, 'Tabell-ID: ' || p_partkey || chr(10) || 'Rubrik: ' || p_name || chr(10) || 'Kategori: ' || p_type || chr(10) || 'Källa: ' || p_brand || chr(10) || 'Variabler: ' || p_size || ', ' || p_brand AS text FROM part")
def _(t: Tables):
    fields = {"id": F.col("p_partkey"), "label": F.col("p_name"), "text": F.lit(None), "category": F.col("p_type")}
    return t("part").select("p_partkey", A.table_text(fields, {"source": F.col("p_brand")}, F.array(F.col("p_size").cast("string"), F.col("p_brand"))).alias("text"))


_OUTLETS = ("svd", "sr", "dn", "svt")


@query(
    "i51_news_fields",
    f"""SELECT doc_id, o AS outlet, CASE o WHEN 'sr' THEN source ELSE 'og ' || source END AS title, lang AS description, CASE o WHEN 'svd' THEN 'by ' || lang WHEN 'sr' THEN 'Sveriges Radio' WHEN 'svt' THEN 'SVT' END AS author,
    CASE o WHEN 'sr' THEN 'Eko' WHEN 'svd' THEN 'lp' END AS section FROM (SELECT *, [{', '.join(repr(o) for o in _OUTLETS)}][doc_id % 4 + 1] AS o FROM documents)""",
)
def _(t: Tables):
    outlet = F.element_at(F.array(*(F.lit(o) for o in _OUTLETS)), (F.col("doc_id") % 4 + 1).cast("int"))
    title = F.when(outlet == "sr", F.concat("source", F.lit(" - Eko | Sveriges Radio"))).otherwise(F.col("source"))
    meta = F.create_map(F.lit("title"), title, F.lit("ogTitle"), F.concat(F.lit("og "), "source"), F.lit("ogDescription"), F.col("lang"), F.lit("article:author"), F.concat(F.lit("by "), "lang"), F.lit("lp:section"), F.lit("lp"))
    return t("documents").select("doc_id", outlet.alias("outlet"), A.news_fields(outlet, meta).alias("n")).select("doc_id", "outlet", "n.*")


@query("i44b_whole_news_texts", "SELECT doc_id, md5(concat_ws(chr(10), nullif(text, ''), source, 'Kategori: ' || lang, 'Ämnen: a, b, c, d, e')) AS h FROM documents")
def _(t: Tables):
    """Texts of articles as they are embedded; no text is cut."""
    tags = F.array(*(F.lit(x) for x in "abcdef"))
    return t("documents").select("doc_id", F.md5(A.news_text("text", "source", "lang", tags).cast("binary")).alias("h"))


_NAMES = "flatten([" + ", ".join(f"regexp_extract_all(lower(q), '(?i){p}', 1)" for p in U.LEGAL_NAME_RULES[1]) + "])"


@query("i07_legal_names", f"SELECT conv_id, turn, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS names FROM (SELECT conv_id, turn, list_transform({_NAMES}, lambda x: upper(x)) AS l FROM ({_Q}))")
def _(t: Tables):
    return questions(t).select("conv_id", "turn", F.array_join(A.legal_names("q"), ",").alias("names"))


@query("i27_chunks_by_tokens", "SELECT doc_id, count(*) FILTER (c <> '') AS chunks, CAST(coalesce(sum(length(c)), 0) AS BIGINT) AS chars FROM (SELECT doc_id, trim(substr(text, s + 1, 600), ' ') AS c FROM (SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) <= 600 THEN 1 ELSE CAST(ceil((length(text) - 600) / 520.0) AS BIGINT) * 520 + 1 END, 520)) AS s FROM documents)) GROUP BY doc_id")
def _(t: Tables):
    """Chunks of 150 tokens with 20 in common, four characters a token and never under 200."""
    parts = t("documents").select("doc_id", X.chunks("text", max(200, 4 * 150), 4 * 20).alias("c"))
    return parts.select("doc_id", F.size("c").cast("long").alias("chunks"), F.aggregate("c", F.lit(0).cast("long"), lambda s, c: s + F.length(c)).alias("chars"))


@query("c17_sanitised_content", "SELECT doc_id, md5(trim(replace(replace(x, '<script', ''), '</script>', ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS h FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '<script>' || text || '</script> ' ELSE text END AS x FROM documents) WHERE length(x) BETWEEN 1 AND 1000000")
def _(t: Tables):
    x = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("<script>"), "text", F.lit("</script> "))).otherwise(F.col("text"))
    clean = F.btrim(F.replace(F.replace("x", F.lit("<script"), F.lit("")), F.lit("</script>"), F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return t("documents").select("doc_id", x.alias("x")).where(F.length("x").between(1, 1_000_000)).select("doc_id", F.md5(clean.cast("binary")).alias("h"))


@query("a27_news_sitemap", "SELECT page_id, 'https://x/artikel/' || page_id AS url, split_part(url, '/', 3) AS title, '2024-01-01' AS published FROM pages WHERE page_id % 2 = 0")
def _(t: Tables):
    """Entries of a news sitemap; those without an article's address are left out."""
    kind = F.when(F.col("page_id") % 2 == 0, "artikel").otherwise("grupp")
    head = '<url xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:news="http://www.google.com/schemas/sitemap-news/0.9"><loc>https://x/'
    xml = F.concat(F.lit(head), kind, F.lit("/"), F.col("page_id").cast("string"), F.lit("</loc><news:news><news:publication_date>2024-01-01</news:publication_date><news:title>"), F.split_part("url", F.lit("/"), F.lit(3)), F.lit("</news:title></news:news></url>"))
    got = t("pages").select("page_id", S.from_xml(xml, S.SITEMAP_SCHEMA).alias("e")).where(F.contains("e.loc", F.lit("/artikel/")))
    return got.select("page_id", F.col("e.loc").alias("url"), F.coalesce("e.`news:news`.`news:title`", F.lit("")).alias("title"), F.coalesce(F.col("e.`news:news`.`news:publication_date`").cast("string"), F.lit("")).alias("published"))


@query("a07_large_json_array", "SELECT doc_id, lang, md5(text) AS h FROM documents")
def _(t: Tables):
    """All documents as arrays of JSON in files, read back in byte ranges."""
    docs = t("documents")
    lines = docs.select(F.to_json(F.struct("doc_id", "lang", "text")).alias("j"))

    def array(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(["["])], names=["value"])
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x + "," for x in b.column(0).to_pylist()], pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["null]"])], names=["value"])

    path = new_path(docs.sparkSession, "arrays")
    lines.mapInArrow(array, "value string").write.text(path)
    back = J.read_json_records(docs.sparkSession, path, "doc_id long, lang string, text string", range_bytes=1 << 20, files="part-*")
    return back.select("doc_id", "lang", F.md5(F.col("text").cast("binary")).alias("h"))


@query("g03_by_tier", "SELECT event_id, row_number() OVER (ORDER BY CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END, event_id) AS place FROM events WHERE user_id = 1")
def _(t: Tables):
    """One user's rows by tier, otherwise in their order; a top-k report of its first places."""
    rows = R.with_tier(t("events").where("user_id = 1"), "event_type", {"purchase": 1, "signup": 2})
    return R.top_k(rows, ["user_id"], [F.col("tier"), F.col("event_id")], 1 << 30, "place").select("event_id", F.col("place").cast("long").alias("place"))


@query("g12_manifest_order", "SELECT p_partkey, p_name, p_size FROM part ORDER BY p_size DESC, p_name, p_partkey")
def _(t: Tables):
    return t("part").orderBy(F.desc("p_size"), "p_name", "p_partkey").select("p_partkey", "p_name", "p_size")


@query("g20_one_of_each_category", "SELECT DISTINCT event_type, 1 AS n FROM events")
def _(t: Tables):
    """A random row of each category: the one of the smallest hash of its id under a seed."""
    picked = t("events").groupBy("event_type").agg(F.min_by("event_id", F.xxhash64(F.lit(7), "event_id")).alias("event_id"))
    return picked.join(t("events").select("event_id", F.col("event_type").alias("kind")), "event_id").where("kind = event_type").groupBy("event_type").agg(F.count("*").cast("int").alias("n"))


@query("b04_created_documents", "SELECT CASE WHEN doc_id % 3 = 0 THEN 'conflict' ELSE 'created' END AS outcome, count(*) AS n FROM documents GROUP BY 1")
def _(t: Tables):
    """New documents against a store that has each third id: conflicts are told by a join, the others are stamped."""
    new, have = t("documents").select("doc_id"), t("documents").where("doc_id % 3 = 0").select("doc_id", F.lit(True).alias("there"))
    told = new.join(have, "doc_id", "left").select("doc_id", F.when(F.col("there"), "conflict").otherwise("created").alias("outcome"), F.when(F.col("there").isNull(), F.current_timestamp()).alias("created_at"))
    return told.where("(outcome = 'created') = (created_at IS NOT NULL)").groupBy("outcome").agg(F.count("*").alias("n"))


@query("n08_answer_contracts", f"SELECT contract, count(*) AS questions FROM (SELECT CASE intent WHEN 'research' THEN 'Forskningssyntes' WHEN 'legal_text' THEN 'Lagtext' WHEN 'practical' THEN 'Praktisk process' ELSE '' END AS contract FROM (SELECT {_CASE(lambda n: repr(n))} AS intent FROM (SELECT {_COUNTS} FROM ({_Q})))) GROUP BY contract")
def _(t: Tables):
    """The contract that each question's answer must keep, by its intent."""
    contracts = F.create_map(*(F.lit(x) for pair in (("research", "Forskningssyntes"), ("legal_text", "Lagtext"), ("practical", "Praktisk process")) for x in pair))
    got = questions(t).select(F.coalesce(F.try_element_at(contracts, U.intent(U.intent_counts("q")).intent), F.lit("")).alias("contract"))
    return got.groupBy("contract").agg(F.count("*").alias("questions"))


@query("j27_academic_chunks", "SELECT doc_id, pos, source || '#' || pos AS id, substr(source, 1, 500) AS title, lang AS language FROM (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS pos FROM (SELECT doc_id, source, lang, s, trim(substr(text, s + 1, 1000), ' ') AS c FROM (SELECT *, unnest(range(0, CASE WHEN length(text) <= 1000 THEN 1 ELSE CAST(ceil((length(text) - 1000) / 900.0) AS BIGINT) * 900 + 1 END, 900)) AS s FROM documents)) WHERE c <> '')")
def _(t: Tables):
    """Chunks with the payload of their document."""
    parts = t("documents").select("doc_id", "source", "lang", F.posexplode(X.chunks("text", 1000, 100)).alias("pos", "chunk"))
    payload = F.struct(F.substring("source", 1, 500).alias("title"), F.col("lang").alias("language"))
    return parts.select("doc_id", F.col("pos").cast("long").alias("pos"), F.concat_ws("#", "source", F.col("pos").cast("string")).alias("id"), payload.alias("p")).select("doc_id", "pos", "id", "p.*")
