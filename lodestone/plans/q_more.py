"""Further queries: strategies, guards, parsers and store dataflows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import inventory as I
from lodestone.operators import retrieval as R
from lodestone.operators import strategies as S
from lodestone.plans.q_retrieval import _LISTS, _PAIRS, _lists, _queries
from lodestone.plans.registry import Tables, query

_SETS = "CASE set_id WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 ELSE 4 END"


def _numbered(t: Tables):
    set_idx = F.when(F.col("set_id") == "purchase", 0).when(F.col("set_id") == "signup", 1).when(F.col("set_id") == "click", 2).when(F.col("set_id") == "view", 3).otherwise(4)
    return _lists(t).withColumn("set_idx", set_idx)


def _fused(variants: int, k: int, queries: str) -> str:
    inner = f"SELECT query_id, id, round(sum(1.0 / (60 + rank)), 10) AS score, min((s, rank)) AS first FROM (SELECT *, {_SETS} AS s FROM ({_LISTS})) WHERE s < {variants} AND query_id IN ({queries}) GROUP BY 1, 2"
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, id) AS rank FROM ({inner})) WHERE rank <= {k}"


_ALL = "SELECT user_id FROM events"


@query("j11_fusion_step", f"SELECT query_id, id, rank FROM ({_fused(2, 10, _ALL)})")
def _(t: Tables):
    return S.fusion_step(_numbered(t), "query_id", "id", "set_idx", "rank", 2, 10).select("query_id", "id", F.col("rank").cast("long").alias("rank"))


_C = "round(max(score) * 20, 9)"
_A = f"(SELECT query_id FROM ({_fused(1, 5, _ALL)}) GROUP BY 1 HAVING {_C} >= 0.33)"
_B = f"(SELECT query_id FROM ({_fused(2, 5, _ALL)}) GROUP BY 1 HAVING {_C} >= 0.34)"


@query("j10_adaptive_escalation", f"SELECT query_id, id, rank, 'A' AS step FROM ({_fused(1, 5, _ALL)}) WHERE query_id IN {_A} UNION ALL SELECT query_id, id, rank, 'B' FROM ({_fused(2, 5, _ALL)}) WHERE query_id NOT IN {_A} AND query_id IN {_B} UNION ALL SELECT query_id, id, rank, 'C' FROM ({_fused(5, 10, _ALL)}) WHERE query_id NOT IN {_A} AND query_id NOT IN {_B}")
def _(t: Tables):
    steps = (("A", 1, 1, 0.33), ("B", 2, 1, 0.34), ("C", 5, 2, 0.0))
    got = S.escalate(_numbered(t), "query_id", "id", "set_idx", "rank", 5, F.round(F.max("score") * 20, 9), steps)
    return got.select("query_id", "id", F.col("rank").cast("long").alias("rank"), "step")


@query("j12_escalation_table", "SELECT step, variants, multiplier, count(DISTINCT user_id) AS users FROM (VALUES ('A', 1, 1), ('B', 2, 1), ('C', 3, 2), ('D', 3, 3)) s(step, variants, multiplier) JOIN events ON user_id % 3 + 1 = variants GROUP BY 1, 2, 3")
def _(t: Tables):
    events = t("events")
    steps = F.broadcast(events.sparkSession.createDataFrame([(n, v, m) for n, v, m, _ in S.ESCALATION], "step string, variants int, multiplier int"))  # four rows
    return events.join(steps, F.col("user_id") % 3 + 1 == F.col("variants")).groupBy("step", "variants", "multiplier").agg(F.countDistinct("user_id").alias("users"))


_INTENT = "CASE user_id % 3 WHEN 0 THEN 'law' WHEN 1 THEN 'news' ELSE 'chat' END"
_ROUTES = "(VALUES ('law','primary','purchase',4), ('law','primary','signup',4), ('law','secondary','view',4), ('news','primary','click',6), ('news','secondary','view',6), ('news','secondary','purchase',6)) r(intent, role, collection, budget)"


def _intents(t: Tables):
    intent = F.when(F.col("user_id") % 3 == 0, "law").when(F.col("user_id") % 3 == 1, "news").otherwise("chat")
    return t("events").select("user_id").distinct().select("user_id", intent.alias("intent"))


@query(
    "j21_routed_retrieval",
    f"""WITH b AS (SELECT e.user_id, event_id, event_type, value / 100 AS score, CASE role WHEN 'primary' THEN 1 ELSE 2 END AS pass, budget FROM events e JOIN {_ROUTES} ON {_INTENT} = intent AND event_type = collection),
    n AS (SELECT *, row_number() OVER (PARTITION BY user_id, pass ORDER BY score DESC, event_id) AS nth FROM b), c AS (SELECT *, CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END AS tier FROM n WHERE (pass = 1 OR nth <= budget) AND score >= 0.3)
    SELECT user_id, event_id, pass, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY tier, score DESC, event_id) AS rank FROM c) WHERE rank <= 10""",
)
def _(t: Tables):
    base = t("events").select("user_id", "event_id", "event_type", (F.col("value") / 100).alias("score"))
    got = S.routed(base, _intents(t), "user_id", "event_type", "score", "event_id", 10, {"purchase": 1, "signup": 2})
    return got.select("user_id", "event_id", "pass", F.col("rank").cast("long").alias("rank"))


@query("d12_intent_collections", f"SELECT DISTINCT user_id, {_INTENT} AS intent, role, collection FROM events JOIN {_ROUTES} ON {_INTENT} = intent")
def _(t: Tables):
    routes = F.broadcast(S.routing_table(t("events").sparkSession))  # a few rows
    return _intents(t).join(routes, "intent").select("user_id", "intent", "role", "collection")


@query("j22_fallback_search", f"SELECT query_id, vec_id, round(1 / (1 + distance), 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY distance, vec_id) AS rank FROM ({_PAIRS})) WHERE rank <= 2")
def _(t: Tables):
    return R.nearest(t("embeddings"), _queries(t), 2, groups=["label"]).select("query_id", "vec_id", F.round(R.similarity(), 4).alias("score"))


_COS = "SELECT q.vec_id AS query_id, v.vec_id, 1 - list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS distance FROM embeddings q JOIN embeddings v ON q.vec_id % 100 = 0"


@query("j24_cosine_search", f"SELECT query_id, vec_id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM ({_COS})) WHERE rank <= 10 AND query_id <> vec_id")
def _(t: Tables):
    near = R.nearest(t("embeddings"), _queries(t), 10, metric="cosine").where("query_id <> vec_id")
    return near.select("query_id", "vec_id", F.round("distance", 6).alias("distance"))


@query("d17_similarity_counts", f"SELECT query_id, count(*) AS n, round(min(distance), 6) AS nearest FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM ({_PAIRS} AND q.vec_id <> v.vec_id)) WHERE rank <= 20 GROUP BY 1")
def _(t: Tables):
    near = R.nearest(t("embeddings"), _queries(t), 21).where("query_id <> vec_id").where("rank <= 21")
    cut = R.top_k(near.drop("rank"), ["query_id"], [F.col("distance"), F.col("vec_id")], 20)
    return cut.groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.min("distance"), 6).alias("nearest"))


@query("d14_dictionary_in_text", "SELECT doc_id, CAST(contains(text, 'MIT') AS BIGINT) + CAST(contains(text, 'GNU') AS BIGINT) + CAST(contains(text, 'Apache') AS BIGINT) AS names FROM documents WHERE regexp_matches(text, '\\b(MIT|GNU|Apache)\\b')")
def _(t: Tables):
    found = sum((F.contains("text", F.lit(n)).cast("long") for n in ("MIT", "GNU", "Apache")), F.lit(0).cast("long"))
    return t("documents").where(F.col("text").rlike(f"{X.EDGE}(MIT|GNU|Apache){X.EDGE}")).select("doc_id", found.alias("names"))


@query("i17_expanded_queries", "SELECT item_id, CAST(len(list_distinct([text, array_to_string(list_slice(w, 1, 10), ' '), array_to_string(list_slice(w, 1, 5), ' ')])) AS BIGINT) AS n FROM (SELECT item_id, text, list_filter(t, lambda x, i: list_position(t, x) = i AND length(x) >= 3 AND x NOT IN (" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + ")) AS w FROM (SELECT item_id, text, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS t FROM benchmark))")
def _(t: Tables):
    lexical = F.array_join(F.slice(X.keywords("text"), 1, 10), " ")
    return t("benchmark").withColumn("lexical", lexical).select("item_id", F.size(X.expanded_queries("text", "lexical")).cast("long").alias("n"))


@query("i31_sections", "SELECT conv_id, count(*) AS sections, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations WHERE length(text) > 50 GROUP BY conv_id")
def _(t: Tables):
    joined = t("conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: F.concat(F.lit("# t\n"), F.replace(x.text, F.lit("#"), F.lit("-")))), "\n").alias("doc"))
    part = F.explode(F.filter(F.split("doc", r"(?m)^# t\n"), lambda s: F.length(s) > 0)).alias("s")
    body = F.regexp_replace("s", r"\n$", "")
    return joined.select("conv_id", part).select("conv_id", body.alias("s")).where(F.length("s") > 50).groupBy("conv_id").agg(F.count("*").alias("sections"), F.sum(F.length("s")).alias("chars"))


@query("i39_repeated_citations", "SELECT doc_id, CAST(len(regexp_extract_all(text, '[0-9]+')) - len(list_distinct(regexp_extract_all(text, '[0-9]+'))) AS BIGINT) AS repeats FROM documents WHERE regexp_matches(text, '[0-9]')")
def _(t: Tables):
    found = F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))
    return t("documents").where(F.col("text").rlike("[0-9]")).select("doc_id", (F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("repeats"))


@query("i54_canonical_checksum", """SELECT event_id, substr(sha256('{"type": "' || event_type || '", "user": ' || user_id || '}'), 1, 16) AS checksum FROM events""")
def _(t: Tables):
    return t("events").select("event_id", X.short_hash(F.format_string('{"type": "%s", "user": %d}', "event_type", "user_id")).alias("checksum"))


@query("i62_timestamp_check", "SELECT event_id, TRY_CAST(CASE WHEN event_id % 4 = 0 THEN 'not a date' ELSE CAST(ts AS VARCHAR) END AS TIMESTAMP) IS NOT NULL AS valid FROM events")
def _(t: Tables):
    text = F.when(F.col("event_id") % 4 == 0, "not a date").otherwise(F.col("ts").cast("string"))
    return t("events").select("event_id", text.try_cast("timestamp").isNotNull().alias("valid"))


@query("i70_defaults_from_json", "SELECT event_id, CAST(coalesce(json_extract_string(props, '$.missing'), json_extract_string(props, '$.k'), '0') AS BIGINT) AS v FROM events")
def _(t: Tables):
    r = F.from_json("props", "missing bigint, k bigint")
    return t("events").select("event_id", F.coalesce(r["missing"], r["k"], F.lit(0).cast("long")).alias("v"))


@query("i72_error_list", "SELECT doc_id, concat_ws('; ', CASE WHEN length(text) < 100 THEN 'short' END, CASE WHEN contains(text, '|') THEN 'table' END, CASE WHEN NOT contains(text, '.') THEN 'no sentence' END) AS errors FROM documents")
def _(t: Tables):
    checks = R.escalation_reasons(a=(F.length("text") < 100, "short"), b=(F.contains("text", F.lit("|")), "table"), c=(~F.contains("text", F.lit(".")), "no sentence"))
    return t("documents").select("doc_id", checks.alias("errors"))


@query("i77_year_in_text", "SELECT o_orderkey, regexp_extract('order of ' || strftime(o_orderdate, '%Y'), '(19[7-9][0-9]|20[0-2][0-9])', 1) AS year FROM orders")
def _(t: Tables):
    return t("orders").select("o_orderkey", F.regexp_extract(F.concat(F.lit("order of "), F.date_format("o_orderdate", "yyyy")), "(19[7-9][0-9]|20[0-2][0-9])", 1).alias("year"))


@query("i83_mode_resolution", "SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'auto' END AS mode FROM events")
def _(t: Tables):
    return t("events").select("event_id", F.when(F.col("event_type").isin("click", "view"), F.col("event_type")).otherwise("auto").alias("mode"))


@query("c01_whitelisted_metadata", """SELECT doc_id, left('{"lang":"' || lang || '","source":"' || source || '"}', 5000) AS meta FROM documents""")
def _(t: Tables):
    m = F.create_map(F.lit("lang"), "lang", F.lit("source"), "source", F.lit("secret"), F.lit("x"))
    return t("documents").select("doc_id", F.substring(F.to_json(F.map_filter(m, lambda k, _: k.isin("lang", "source"))), 1, 5000).alias("meta"))


@query("c05_conjunction", "SELECT event_id FROM events WHERE event_type = 'click' AND user_id = 7")
def _(t: Tables):
    where = {"event_type": "click", "user_id": 7}
    df = t("events")
    for k, v in where.items():
        df = df.where(F.col(k) == v)
    return df.select("event_id")


@query("c07_least_score", "SELECT event_id, value FROM events WHERE value / 100 >= 0.30")
def _(t: Tables):
    return t("events").where(F.col("value") / 100 >= 0.30).select("event_id", "value")


@query("c10_url_category", "SELECT page_id, CASE WHEN contains(url, '/en/') THEN 'english' WHEN contains(url, '/de/') THEN 'german' ELSE 'other' END AS category FROM pages")
def _(t: Tables):
    return t("pages").select("page_id", X.first_match("url", (("/en/", "english"), ("/de/", "german")), "other").alias("category"))


@query("c13_source_url_rules", "SELECT page_id FROM pages WHERE regexp_matches(url, CASE WHEN page_id % 2 = 0 THEN '/en/' ELSE '/[a-z]{2}/' END) AND NOT (contains(url, 'cheap') OR contains(url, 'ref='))")
def _(t: Tables):
    rule = F.when(F.col("page_id") % 2 == 0, "/en/").otherwise("/[a-z]{2}/")
    clean = F.forall(F.array(F.lit("cheap"), F.lit("ref=")), lambda x: ~F.contains(F.col("url"), x))
    return t("pages").withColumn("p", rule).where(F.expr("url rlike p") & clean).select("page_id")


@query("c18_name_check", "SELECT c_custkey, regexp_matches(c_name, '^[A-Za-z0-9_-]+$') AS valid FROM customer")
def _(t: Tables):
    return t("customer").select("c_custkey", F.col("c_name").rlike("^[A-Za-z0-9_-]+$").alias("valid"))


@query("c20_fusion_benefit", f"WITH s AS (SELECT DISTINCT query_id, set_id, id FROM ({_LISTS})), n AS (SELECT query_id, count(DISTINCT set_id) AS sets, count(DISTINCT id) AS ids, count(DISTINCT CASE WHEN set_id = 'click' THEN id END) AS first FROM s GROUP BY 1) SELECT query_id, sets >= 2 AND (first = 0 OR (ids - first) * 1.0 / first >= 0.05) AS useful FROM n")
def _(t: Tables):
    n = _lists(t).groupBy("query_id").agg(F.countDistinct("set_id").alias("sets"), F.countDistinct("id").alias("ids"), F.countDistinct(F.when(F.col("set_id") == "click", F.col("id"))).alias("first"))
    return n.select("query_id", ((F.col("sets") >= 2) & ((F.col("first") == 0) | ((F.col("ids") - F.col("first")) / F.greatest("first", F.lit(1)) >= 0.05))).alias("useful"))


@query("c22_must_include", "SELECT conv_id, bool_or(contains(lower(text), 'the')) AND bool_or(contains(lower(text), 'en')) AS covered FROM conversations WHERE turn < 10 GROUP BY conv_id")
def _(t: Tables):
    said = t("conversations").where("turn < 10").groupBy("conv_id").agg(F.collect_list(F.lower("text")).alias("s"))
    covered = F.forall(F.array(F.lit("the"), F.lit("en")), lambda w: F.exists("s", lambda x: F.contains(x, w)))
    return said.select("conv_id", covered.alias("covered"))


@query("c25_sparse_page", "SELECT page_id, length(trim(regexp_replace(html, '<[^>]+>', '', 'g'), ' ')) < 500 AS sparse FROM pages")
def _(t: Tables):
    return t("pages").select("page_id", (F.length(X.strip_html("html")) < 500).alias("sparse"))


@query("c26_truncated_answer", "SELECT conv_id, turn, NOT regexp_matches(text, '[.!?]\\s*$') AS truncated FROM conversations WHERE role = 'assistant'")
def _(t: Tables):
    return t("conversations").where("role = 'assistant'").select("conv_id", "turn", (~F.col("text").rlike(r"[.!?]\s*$")).alias("truncated"))


@query("a10_file_discovery", "SELECT 'documents' AS kind, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'labels', count(*) FROM labels")
def _(t: Tables):
    one = lambda name: t(name).agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n")
    return one("documents").union(one("pages")).union(one("labels"))


@query("a15_unseen_files", "SELECT page_id FROM pages WHERE md5(html) NOT IN (SELECT md5(html) FROM pages WHERE page_id % 4 = 1)")
def _(t: Tables):
    pages = t("pages").select("page_id", F.md5(F.col("html").cast("binary")).alias("h"))
    return I.missing_from(pages, pages.where("page_id % 4 = 1"), ["h"]).select("page_id")


@query("a24_dublin_core", "SELECT p_partkey, p_name AS title, 2 AS creators FROM part")
def _(t: Tables):
    from lodestone.sources import records

    xml = F.concat(F.lit("<dc><title>"), "p_name", F.lit("</title><creator>a</creator><creator>"), "p_brand", F.lit("</creator></dc>"))
    return t("part").select("p_partkey", records.from_xml(xml, records.DUBLIN_CORE_SCHEMA).alias("r")).select("p_partkey", F.col("r.title").alias("title"), F.size("r.creator").alias("creators"))


@query("a32_word_list", "SELECT w AS word, count(*) AS n FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS w FROM part) WHERE length(w) >= 3 AND regexp_matches(w, '^\\p{L}+$') GROUP BY w")
def _(t: Tables):
    return t("part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).where((F.length("word") >= 3) & F.col("word").rlike(r"^\p{L}+$")).groupBy("word").agg(F.count("*").alias("n"))


@query("a38_collection_sample_stats", "SELECT count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs, count(*) AS n FROM documents")
def _(t: Tables):
    return t("documents").agg(F.countDistinct("source").alias("sources"), F.countDistinct("lang").alias("langs"), F.count("*").alias("n"))


@query("a40_attribute_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(t: Tables):
    page = F.concat(F.lit('<div data-json="'), F.replace("props", F.lit('"'), F.lit("&quot;")), F.lit('"></div>'))
    raw = F.replace(F.regexp_extract(page, 'data-json="([^"]*)"', 1), F.lit("&quot;"), F.lit('"'))
    return t("events").select("event_id", F.get_json_object(raw, "$.k").cast("long").alias("k"))


@query("b11_batch_insert_ignore", "SELECT regexp_extract(url, '^[^#?]*', 0) AS url, min(page_id) AS page_id FROM pages WHERE regexp_extract(url, '^[^#?]*', 0) NOT IN (SELECT regexp_extract(url, '^[^#?]*', 0) FROM pages WHERE page_id < 20) GROUP BY 1")
def _(t: Tables):
    rows = t("pages").select(F.regexp_extract("url", "^[^#?]*", 0).alias("url"), "page_id")
    return I.insert_or_ignore(rows.where("page_id < 20"), rows, "url", [F.col("page_id")])


@query("b20_resumed_migration", "SELECT vec_id, len(embedding) AS dims FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 6 = 0)")
def _(t: Tables):
    vectors = t("embeddings").select("vec_id", F.size("embedding").cast("long").alias("dims"))
    return I.missing_from(vectors, vectors.where("vec_id % 6 = 0"), ["vec_id"])


@query("b22_bm25_index", "WITH d AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM d GROUP BY term")
def _(t: Tables):
    terms, _lengths = R.postings(t("documents").select("doc_id", X.tokens("text").alias("tokens")), "doc_id", "tokens")
    return terms.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query("g18_history_newest_first", "SELECT event_id, ts FROM events WHERE user_id = 3 ORDER BY ts DESC, event_id DESC")
def _(t: Tables):
    return t("events").where("user_id = 3").orderBy(F.desc("ts"), F.desc("event_id")).select("event_id", "ts")


@query("g13_rerank_by_overlap", "WITH c AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM conversations), q AS (SELECT conv_id, w AS q FROM c WHERE turn = 0) SELECT conv_id, turn FROM (SELECT c.conv_id, c.turn, row_number() OVER (PARTITION BY c.conv_id ORDER BY round(len(list_intersect(q, w)) * 1.0 / greatest(len(q), 1), 9) DESC, c.turn) AS rn FROM c JOIN q ON c.conv_id = q.conv_id WHERE c.turn > 0) WHERE rn <= 2")
def _(t: Tables):
    c = t("conversations").select("conv_id", "turn", F.array_distinct(X.tokens("text")).alias("w"))
    q = c.where("turn = 0").select("conv_id", F.col("w").alias("q"))
    scored = c.where("turn > 0").join(q, "conv_id").withColumn("s", F.round(F.size(F.array_intersect("q", "w")) / F.greatest(F.size("q"), F.lit(1)), 9))
    return R.top_k(scored, ["conv_id"], [F.desc("s"), F.col("turn")], 2).select("conv_id", "turn")


@query("h04_keyword_overlap", "WITH k AS (SELECT conv_id, role, list_distinct(flatten(list(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')))) AS w FROM conversations GROUP BY 1, 2) SELECT u.conv_id, CAST(len(list_intersect(u.w, a.w)) AS BIGINT) AS shared FROM k u JOIN k a ON u.conv_id = a.conv_id AND u.role = 'user' AND a.role = 'assistant'")
def _(t: Tables):
    w = t("conversations").groupBy("conv_id").pivot("role", ["user", "assistant"]).agg(F.array_distinct(F.flatten(F.collect_list(X.tokens("text")))))
    return w.where("size(user) > 0 AND size(assistant) > 0").select("conv_id", F.size(F.array_intersect("user", "assistant")).cast("long").alias("shared"))


@query("h12_first_three_ignoring_case", "SELECT conv_id, CAST(least(3, count(DISTINCT lower(left(text, 5)))) AS BIGINT) AS n FROM conversations GROUP BY conv_id")
def _(t: Tables):
    words = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.lower(F.substring("text", 1, 5)).alias("w")))), lambda x: x.w)
    return t("conversations").groupBy("conv_id").agg(F.size(F.slice(F.array_distinct(words), 1, 3)).cast("long").alias("n"))


@query("m05_context_recall", "WITH w AS (SELECT conv_id, role, list_distinct(flatten(list(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda x: length(x) >= 4)))) AS w FROM conversations GROUP BY 1, 2) SELECT u.conv_id, round(CASE WHEN len(u.w) > 0 THEN len(list_intersect(u.w, a.w)) * 1.0 / len(u.w) ELSE 0 END, 6) AS recall FROM w u JOIN w a ON u.conv_id = a.conv_id AND u.role = 'user' AND a.role = 'assistant'")
def _(t: Tables):
    side = lambda role: t("conversations").where(F.col("role") == role).groupBy("conv_id").agg(F.array_distinct(F.flatten(F.collect_list(X.tokens("text", 4)))).alias(role))
    return side("user").join(side("assistant"), "conv_id").select("conv_id", F.round(X.overlap_share(F.col("user"), F.col("assistant")), 6).alias("recall"))


@query("k01_truncated_event", "SELECT conv_id, turn, left(text, 200) AS question FROM conversations WHERE role = 'user'")
def _(t: Tables):
    return t("conversations").where("role = 'user'").select("conv_id", "turn", F.substring("text", 1, 200).alias("question"))


@query("k08_resume_position", "SELECT user_id, max(event_id) AS last_index, count(*) AS done FROM events GROUP BY user_id")
def _(t: Tables):
    return t("events").groupBy("user_id").agg(F.max("event_id").alias("last_index"), F.count("*").alias("done"))


@query("f11_first_per_window", "SELECT user_id, event_type, min(ts) AS first_ts, row_number() OVER (PARTITION BY user_id ORDER BY min(ts), event_type) AS nth FROM events GROUP BY 1, 2")
def _(t: Tables):
    g = t("events").groupBy("user_id", "event_type").agg(F.min("ts").alias("first_ts"))
    return g.withColumn("nth", F.row_number().over(Window.partitionBy("user_id").orderBy("first_ts", "event_type")).cast("long"))
