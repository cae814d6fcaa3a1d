"""Queries of ranking, sorting, paging and set operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import inventory as I
from lodestone.operators import retrieval as R
from lodestone.plans.registry import Tables, query


@query("f01_rank_in_list", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events")
def _(t: Tables):
    return t("events").select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")).cast("long").alias("rank"))


@query("f02_first_occurrence", "SELECT user_id, min_by(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def _(t: Tables):
    return I.first_of_key(t("events").select("user_id", "event_type", "ts", "event_id"), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type")


@query("f03_best_score_per_id", "SELECT user_id, event_type, max(value) AS value, arg_min(event_id, (-value, event_id)) AS event_id FROM events GROUP BY 1, 2")
def _(t: Tables):
    return R.best_per_id(t("events").select("user_id", "event_type", "value", "event_id"), ["user_id", "event_type"], "value", [F.col("event_id")])


@query("f04_margin", "WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events) SELECT user_id, round(CASE WHEN max(value) FILTER (rn <= 10) > min(value) FILTER (rn <= 10) THEN (max(value) FILTER (rn = 1) - max(value) FILTER (rn = 2)) / (max(value) FILTER (rn <= 10) - min(value) FILTER (rn <= 10)) ELSE 0 END, 6) AS margin FROM r GROUP BY user_id HAVING count(*) > 1")
def _(t: Tables):
    top = R.top_k(t("events").select("user_id", "event_id", "value"), ["user_id"], [F.desc("value"), F.col("event_id")], 10)
    nth = lambda k: F.max(F.when(F.col("rank") == k, F.col("value")))
    width = F.max("value") - F.min("value")
    return top.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.when(width > 0, (nth(1) - nth(2)) / width).otherwise(0.0), 6).alias("margin")).where("n > 1").drop("n")


@query("f05_repeated_prefix", "SELECT source, count(*) AS repeats FROM (SELECT source, row_number() OVER (PARTITION BY source, substr(lower(text), 1, 50) ORDER BY doc_id) AS rn FROM documents) WHERE rn > 1 GROUP BY source")
def _(t: Tables):
    groups = t("documents").groupBy("source", F.substring(F.lower("text"), 1, 50).alias("p")).agg((F.count("*") - 1).alias("r"))
    return groups.where("r > 0").groupBy("source").agg(F.sum("r").alias("repeats"))


@query("f06_document_of_chunk", "SELECT o_custkey, min_by(o_orderkey, (-o_totalprice, o_orderkey)) AS o_orderkey, count(*) AS chunks FROM orders GROUP BY o_custkey")
def _(t: Tables):
    chunk = t("orders").select(F.concat_ws("_chunk_", F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")).alias("chunk_id"), "o_orderkey", "o_totalprice")
    doc = F.substring_index("chunk_id", "_chunk_", 1).cast("long")
    return chunk.groupBy(doc.alias("o_custkey")).agg(F.min_by("o_orderkey", F.struct((-F.col("o_totalprice")).alias("s"), "o_orderkey")).alias("o_orderkey"), F.count("*").alias("chunks"))


@query("f07_reciprocal_rank", "WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) SELECT user_id, round(coalesce(1.0 / min(rn) FILTER (event_type = 'purchase'), 0), 6) AS rr FROM r GROUP BY user_id")
def _(t: Tables):
    ranked = t("events").select("user_id", "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("rn"))
    return ranked.groupBy("user_id").agg(F.round(F.coalesce(1.0 / F.min(F.when(F.col("event_type") == "purchase", F.col("rn"))), F.lit(0.0)), 6).alias("rr"))


@query("f08_segment_end", "SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn FROM conversations")
def _(t: Tables):
    return t("conversations").select("conv_id", "turn", F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn")).alias("next_turn"))


@query("f09_recent_trend", "SELECT * FROM (SELECT event_id, ts, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 50) ORDER BY ts, event_id")
def _(t: Tables):
    return t("events").select("event_id", "ts", "value").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).orderBy("ts", "event_id")


@query("f10_rolling_average", "SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 9) AS rolling FROM events")
def _(t: Tables):
    return t("events").select("user_id", "event_id", F.round(F.avg("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-99, 0)), 9).alias("rolling"))


@query("g01_top_k", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 20")
def _(t: Tables):
    return t("events").orderBy(F.desc("value"), "event_id").limit(20).select("event_id", "value")


@query("g02_tier_then_score", "SELECT doc_id, CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 ELSE 3 END AS tier, n_chars FROM documents ORDER BY tier, n_chars DESC, doc_id LIMIT 50")
def _(t: Tables):
    return R.with_tier(t("documents").select("doc_id", "lang", "n_chars"), "lang", {"en": 1, "de": 2}).orderBy("tier", F.desc("n_chars"), "doc_id").limit(50).select("doc_id", "tier", "n_chars")


@query("g04_page", "SELECT doc_id, source, (SELECT CAST(ceil(count(*) / 25.0) AS BIGINT) FROM documents) AS pages FROM documents ORDER BY doc_id LIMIT 25 OFFSET 50")
def _(t: Tables):
    total = t("documents").agg(F.ceil(F.count("*") / 25.0).alias("pages"))
    return I.page(t("documents").select("doc_id", "source"), [F.col("doc_id")], 50, 25).join(F.broadcast(total))  # one row


@query("g06_claim_next", "SELECT o_orderkey, 'running' AS status FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority, o_orderkey LIMIT 1")
def _(t: Tables):
    return t("orders").where("o_orderstatus = 'O'").orderBy("o_orderpriority", "o_orderkey").limit(1).select("o_orderkey", F.lit("running").alias("status"))


@query("g08_pending", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority, o_orderkey LIMIT 200")
def _(t: Tables):
    return t("orders").where("o_orderstatus = 'O'").orderBy("o_orderpriority", "o_orderkey").limit(200).select("o_orderkey", "o_orderpriority")


@query("g09_recent_completed", "SELECT event_id, event_type FROM events WHERE event_type IN ('purchase', 'signup', 'click') ORDER BY ts DESC, event_id DESC LIMIT 10")
def _(t: Tables):
    return t("events").where(F.col("event_type").isin("purchase", "signup", "click")).orderBy(F.desc("ts"), F.desc("event_id")).limit(10).select("event_id", "event_type")


@query("g11_words_by_length", "SELECT p_partkey, array_to_string(list_transform(list_sort(list_transform(string_split(p_name, ' '), lambda w, i: {'l': -length(w), 'i': i, 'w': w})), lambda x: x.w), ' ') AS words FROM part")
def _(t: Tables):
    words = F.transform(F.split("p_name", " "), lambda w, i: F.struct((-F.length(w)).alias("l"), i.alias("i"), w.alias("w")))
    return t("part").select("p_partkey", F.array_join(F.transform(F.array_sort(words), lambda x: x["w"]), " ").alias("words"))


@query("g14_mean_of_top3", "SELECT user_id, round(avg(value), 6) AS mean FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn <= 3 GROUP BY user_id")
def _(t: Tables):
    return R.top_k(t("events").select("user_id", "event_id", "value"), ["user_id"], [F.desc("value"), F.col("event_id")], 3).groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("mean"))


@query("g15_failed", "SELECT event_id, user_id FROM events WHERE event_type = 'error'")
def _(t: Tables):
    return t("events").where("event_type = 'error'").select("event_id", "user_id")


@query("g16_documents_of_source", "SELECT doc_id, n_chars FROM documents WHERE source = 'src3'")
def _(t: Tables):
    return t("documents").where("source = 'src3'").select("doc_id", "n_chars")


@query("g17_unindexed", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 100")
def _(t: Tables):
    return I.missing_from(t("documents").select("doc_id"), t("labels"), ["doc_id"]).orderBy("doc_id").limit(100)


@query("g19_collections_by_size", "SELECT label, count(*) AS n FROM embeddings GROUP BY label ORDER BY n DESC, label")
def _(t: Tables):
    return t("embeddings").groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")


@query("h01_union_all", "SELECT doc_id AS id, 'doc' AS kind FROM documents UNION ALL SELECT page_id, 'page' FROM pages")
def _(t: Tables):
    return t("documents").select(F.col("doc_id").alias("id"), F.lit("doc").alias("kind")).unionByName(t("pages").select(F.col("page_id").alias("id"), F.lit("page").alias("kind")))


@query("h02_union_with_budget", "SELECT event_id, 1 AS pass FROM events WHERE event_type = 'purchase' UNION ALL (SELECT event_id, 2 FROM events WHERE event_type = 'signup' ORDER BY value DESC, event_id LIMIT 25)")
def _(t: Tables):
    first = t("events").where("event_type = 'purchase'").select("event_id", F.lit(1).alias("pass"))
    return first.unionAll(t("events").where("event_type = 'signup'").orderBy(F.desc("value"), "event_id").limit(25).select("event_id", F.lit(2).alias("pass")))


@query("h03_array_difference", "SELECT conv_id, array_to_string(list_sort(list_filter(list_distinct(list(role) FILTER (turn > 0)), lambda x: NOT list_contains(coalesce(list(role) FILTER (turn = 0), []), x))), ',') AS fresh FROM conversations GROUP BY conv_id")
def _(t: Tables):
    late, first = F.collect_set(F.when(F.col("turn") > 0, F.col("role"))), F.collect_set(F.when(F.col("turn") == 0, F.col("role")))
    return t("conversations").groupBy("conv_id").agg(F.when(F.count_if(F.col("turn") > 0) > 0, F.array_join(F.array_sort(F.array_except(late, first)), ",")).alias("fresh"))


@query("h05_distinct_ids", "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT (l_partkey, l_suppkey)) AS pairs FROM lineitem")
def _(t: Tables):
    return t("lineitem").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_partkey", "l_suppkey").alias("pairs"))


@query("h06_expected_minus_existing", "SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def _(t: Tables):
    return t("nation").select("n_nationkey").subtract(t("supplier").where("s_acctbal > 5000").select("s_nationkey"))


@query("h07_first_seen_prefix50", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY substr(text, 1, 50) ORDER BY doc_id) AS rn FROM documents WHERE length(text) > 50) WHERE rn = 1")
def _(t: Tables):
    return t("documents").where(F.length("text") > 50).groupBy(F.substring("text", 1, 50).alias("k")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("h08_first_seen_prefix80", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY substr(lower(text), 1, 80) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def _(t: Tables):
    return t("documents").groupBy(F.substring(F.lower("text"), 1, 80).alias("k")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("h09_dedup_by_external_id", "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def _(t: Tables):
    return I.missing_from(t("lineitem").select("l_orderkey").distinct(), t("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey")), ["l_orderkey"])


@query("h10_dedup_by_content", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY sha256(text)")
def _(t: Tables):
    return t("documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("h")


@query("h11_ordered_token_dedup", "SELECT p_partkey, array_to_string(list_filter(string_split(p_type || ' ' || p_name || ' ' || p_type, ' '), lambda x, i: list_position(string_split(p_type || ' ' || p_name || ' ' || p_type, ' '), x) = i), ' ') AS tokens FROM part")
def _(t: Tables):
    return t("part").select("p_partkey", F.array_join(F.array_distinct(F.split(F.concat_ws(" ", "p_type", "p_name", "p_type"), " ")), " ").alias("tokens"))
