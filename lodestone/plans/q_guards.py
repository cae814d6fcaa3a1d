"""Guards on texts, store states and further scalar functions, each with the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.text import EDGE, PERSONAL_NUMBER
from lodestone.plans.registry import Tables, query

#: Strings that a sanitised input may not hold.
DANGEROUS = ("<script", "javascript:", "onerror=", "onload=")
#: Words that tell of personal matters.
SENSITIVE = ("personnummer", "socialförsäkring", "patientjournal", "diagno", "sjukdom", "vårdnad")
#: Document classes by their words, the first that matches.
CLASSES = (
    ("protokoll", ("protokoll", "sammanträde", "möte")),
    ("beslut", ("beslut", "delegation")),
    ("styrdokument", ("policy", "riktlinje", "styrdokument", "reglemente")),
    ("rapport", ("rapport", "utredning", "granskning")),
    ("upphandling", ("upphandling", "anbud", "förfrågning")),
    ("ekonomi", ("budget", "årsredovisning", "ekonomi")),
)


@query("c16_sanitised_input", "SELECT doc_id, length(text) > 10000 AS refused, CASE WHEN length(text) <= 10000 THEN md5(regexp_replace(replace(replace(replace(replace(text, '<script', ''), 'javascript:', ''), 'onerror=', ''), 'onload=', ''), '^\\s+|\\s+$', '', 'g')) END AS clean_md5 FROM documents")
def _(t: Tables):
    clean = F.col("text")
    for x in DANGEROUS:
        clean = F.replace(clean, F.lit(x), F.lit(""))
    clean = F.regexp_replace(clean, r"^\s+|\s+$", "")
    short = F.length("text") <= 10_000
    return t("documents").select("doc_id", (~short).alias("refused"), F.when(short, F.md5(clean.cast("binary"))).alias("clean_md5"))


@query("c27_structure_leak", "SELECT conv_id, turn, CASE WHEN NOT regexp_matches(text, '^\\s*\\{') THEN md5(text) WHEN role = 'assistant' THEN 'refusal' ELSE 'fallback' END AS answer FROM conversations")
def _(t: Tables):
    leak = F.col("text").rlike(r"^\s*\{")
    return t("conversations").select("conv_id", "turn", F.when(~leak, F.md5(F.col("text").cast("binary"))).when(F.col("role") == "assistant", "refusal").otherwise("fallback").alias("answer"))


@query("c28_sensitive_content", "SELECT doc_id, regexp_matches(text, '" + PERSONAL_NUMBER + "') OR " + " OR ".join(f"contains(lower(text), '{w}')" for w in SENSITIVE) + " AS sensitive FROM documents")
def _(t: Tables):
    found = F.col("text").rlike(PERSONAL_NUMBER.replace(r"\b", EDGE))
    for w in SENSITIVE:
        found = found | F.contains(F.lower("text"), F.lit(w))
    return t("documents").select("doc_id", found.alias("sensitive"))


_HAS = " ".join("WHEN " + " OR ".join(f"contains(x, '{w}')" for w in words) + f" THEN '{name}'" for name, words in CLASSES)


@query("c30_document_class", f"SELECT doc_id, CASE {_HAS} ELSE 'ovrigt' END AS kind FROM (SELECT doc_id, lower(source || ' ' || text) AS x FROM documents)")
def _(t: Tables):
    x, kind = F.lower(F.concat_ws(" ", "source", "text")), F.lit("ovrigt")
    for name, words in reversed(CLASSES):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(x, F.lit(w))
        kind = F.when(hit, name).otherwise(kind)
    return t("documents").select("doc_id", kind.alias("kind"))


_ABSTRACT = "SELECT doc_id, source AS title, regexp_replace(text, '<[^>]+>', '', 'g') AS a FROM documents"


@query("i35_question_answer_rows", f"""WITH d AS (SELECT doc_id, title, md5(a) AS output FROM ({_ABSTRACT}) WHERE length(a) >= 30)
    SELECT doc_id, 'Vad handlar ''' || title || ''' om?' AS instruction, '' AS input, output FROM d
    UNION ALL SELECT doc_id, 'Sammanfatta följande arbete:', title, output FROM d
    UNION ALL SELECT doc_id, 'Beskriv innehållet i detta akademiska arbete:', title, output FROM d""")
def _(t: Tables):
    clean = F.regexp_replace("text", "<[^>]+>", "")
    d = t("documents").select("doc_id", F.col("source").alias("title"), clean.alias("a")).where(F.length("a") >= 30)
    row = lambda question, given: F.struct(question.alias("instruction"), given.alias("input"))
    asked = F.array(
        row(F.concat(F.lit("Vad handlar '"), "title", F.lit("' om?")), F.lit("")),
        row(F.lit("Sammanfatta följande arbete:"), F.col("title")),
        row(F.lit("Beskriv innehållet i detta akademiska arbete:"), F.col("title")),
    )
    return d.select("doc_id", F.md5(F.col("a").cast("binary")).alias("output"), F.explode(asked).alias("x")).select("doc_id", "x.*", "output")


@query("i44_news_embedding_text", "SELECT doc_id, md5(concat_ws(chr(10), source, lang, left(text, 2000))) AS text_md5 FROM documents")
def _(t: Tables):
    return t("documents").select("doc_id", F.md5(F.concat_ws("\n", "source", "lang", F.substring("text", 1, 2000)).cast("binary")).alias("text_md5"))


_SIZES = "SELECT p_partkey, p_size || CASE p_partkey % 5 WHEN 0 THEN ' GB' WHEN 1 THEN ' MB' WHEN 2 THEN 'kb' WHEN 3 THEN ' B' ELSE ' pieces' END AS s FROM part"
_AMOUNT = r"^([\d.]+)\s*(GB|MB|KB|B)"


@query("i53_size_in_bytes", f"SELECT p_partkey, CASE WHEN u = '' THEN 0 ELSE cast(cast(v AS DOUBLE) * CASE u WHEN 'GB' THEN 1000000000 WHEN 'MB' THEN 1000000 WHEN 'KB' THEN 1000 ELSE 1 END AS BIGINT) END AS bytes FROM (SELECT p_partkey, nullif(regexp_extract(s, '(?i){_AMOUNT}', 1), '') AS v, upper(regexp_extract(s, '(?i){_AMOUNT}', 2)) AS u FROM ({_SIZES}))")
def _(t: Tables):
    unit = F.element_at(F.array(*map(F.lit, (" GB", " MB", "kb", " B", " pieces"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    s = F.concat(F.col("p_size").cast("string"), unit)
    u = F.upper(F.regexp_extract(s, "(?i)" + _AMOUNT, 2))
    scale = F.when(u == "GB", 1_000_000_000).when(u == "MB", 1_000_000).when(u == "KB", 1000).otherwise(1)
    return t("part").select("p_partkey", F.when(u == "", F.lit(0).cast("long")).otherwise((F.regexp_extract(s, "(?i)" + _AMOUNT, 1).try_cast("double") * scale).cast("long")).alias("bytes"))


_SIGNALS = "SELECT user_id, count(*) FILTER (event_type = 'click') * 1.0 / count(*) AS overlap, max(value) / 1000 AS top, round(avg(value) / 400, 2) AS confidence, bool_or(event_type = 'purchase') AS entities FROM events GROUP BY user_id"


@query("j19_abstention", f"""SELECT user_id, reason <> '' AS abstain, reason FROM (SELECT user_id, concat_ws('; ', CASE WHEN overlap < 0.05 THEN 'gibberish_query' END, CASE WHEN top = 0 THEN 'no_results' END,
    CASE WHEN confidence < 0.25 THEN 'confidence=' || printf('%.2f', confidence) || '<0.25' END, CASE WHEN NOT entities AND overlap < 0.3 THEN 'no_entities_low_overlap' END) AS reason FROM ({_SIGNALS}))""")
def _(t: Tables):
    share = F.count(F.when(F.col("event_type") == "click", 1)) / F.count("*")
    mean = F.round(F.avg("value") / 400, 9)  # a sum's last digits depend on its order, and must not decide a half
    s = t("events").groupBy("user_id").agg(share.alias("overlap"), (F.max("value") / 1000).alias("top"), F.round(mean, 2).alias("confidence"), F.bool_or(F.col("event_type") == "purchase").alias("entities"))
    low = F.concat(F.lit("confidence="), F.format_string("%.2f", "confidence"), F.lit("<0.25"))
    reasons = F.concat_ws(
        "; ", F.when(F.col("overlap") < 0.05, "gibberish_query"), F.when(F.col("top") == 0, "no_results"),
        F.when(F.col("confidence") < 0.25, low), F.when(~F.col("entities") & (F.col("overlap") < 0.3), "no_entities_low_overlap"),
    )
    return s.select("user_id", (reasons != "").alias("abstain"), reasons.alias("reason"))


@query("g05_by_priority", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority DESC, o_orderkey LIMIT 50")
def _(t: Tables):
    return t("orders").select("o_orderkey", "o_orderpriority").orderBy(F.desc("o_orderpriority"), "o_orderkey").limit(50)


@query("g10_recent_of_a_state", "SELECT event_id, ts FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 10")
def _(t: Tables):
    return t("events").where("event_type = 'purchase'").select("event_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(10)


@query("b14_reset_running", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'O' ELSE o_orderstatus END AS status FROM orders")
def _(t: Tables):
    return t("orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "O").otherwise(F.col("o_orderstatus")).alias("status"))


@query("b29_failed_with_text", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'failed' ELSE o_orderstatus END AS status, CASE WHEN o_totalprice > 300000 THEN left('too dear: ' || o_orderpriority, 500) END AS error FROM orders")
def _(t: Tables):
    failed = F.col("o_totalprice") > 300_000
    return t("orders").select("o_orderkey", F.when(failed, "failed").otherwise(F.col("o_orderstatus")).alias("status"), F.when(failed, F.substring(F.concat(F.lit("too dear: "), "o_orderpriority"), 1, 500)).alias("error"))


@query("b30_completed_with_counters", "SELECT o_orderkey, CASE WHEN count(l_orderkey) = 0 THEN 'skipped' ELSE 'done' END AS status, count(l_orderkey) AS found, coalesce(sum(l_quantity), 0) AS amount FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def _(t: Tables):
    lines = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    found = F.coalesce("n", F.lit(0))
    return t("orders").select("o_orderkey").join(lines, "o_orderkey", "left").select("o_orderkey", F.when(found == 0, "skipped").otherwise("done").alias("status"), found.cast("long").alias("found"), F.coalesce("q", F.lit(0)).alias("amount"))


@query("b31_reset_all", "SELECT o_orderkey, 'pending' AS status, 0 AS found, 0 AS bytes FROM orders")
def _(t: Tables):
    return t("orders").select("o_orderkey", F.lit("pending").alias("status"), F.lit(0).alias("found"), F.lit(0).alias("bytes"))


@query("b32_insert_once_by_url", "WITH old AS (SELECT page_id, url FROM pages WHERE page_id % 3 = 0) SELECT page_id, url FROM old UNION ALL SELECT min(page_id), url FROM pages WHERE page_id % 3 <> 0 AND url NOT IN (SELECT url FROM old WHERE url IS NOT NULL) GROUP BY url")
def _(t: Tables):
    pages = t("pages").select("page_id", "url")
    old = pages.where("page_id % 3 = 0")
    new = pages.where("page_id % 3 <> 0 AND url IS NOT NULL").join(old.select("url"), "url", "left_anti")
    return old.union(new.groupBy("url").agg(F.min("page_id").alias("page_id")).select("page_id", "url"))


@query("b33_idempotent_load", "SELECT o_custkey AS task, 'known' AS status FROM orders GROUP BY 1 UNION ALL SELECT c_custkey, 'pending' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(t: Tables):
    old = t("orders").select(F.col("o_custkey").alias("task")).distinct()
    new = t("customer").select(F.col("c_custkey").alias("task")).join(old, "task", "left_anti")
    return old.withColumn("status", F.lit("known")).union(new.withColumn("status", F.lit("pending")))


@query("b38_add_if_new", "SELECT doc_id, md5(left(text, 50000)) AS text_md5 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t: Tables):
    new = t("documents").join(t("labels").select("doc_id"), "doc_id", "left_anti")
    return new.select("doc_id", F.md5(F.substring("text", 1, 50_000).cast("binary")).alias("text_md5"))
