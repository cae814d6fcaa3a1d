"""Queries of the aggregation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import aggregates as A
from lodestone.operators import inventory as I
from lodestone.plans.registry import Tables, query

STATES = {"done": "F", "open": "O", "partial": "P"}


@query("e01_total_count", "SELECT count(*) AS n FROM documents")
def _(t: Tables):
    return t("documents").agg(F.count("*").alias("n"))


@query("e02_count_by_source_top20", "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 20")
def _(t: Tables):
    return A.top_counts(t("documents"), "source", 20)


@query("e03_count_by_status", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def _(t: Tables):
    return A.count_by(t("orders"), "o_orderstatus")


@query("e04_count_by_type", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(t: Tables):
    return A.count_by(t("events"), "event_type")


@query("e05_status_sums", "SELECT l_linestatus, count(*) AS n, round(coalesce(sum(l_quantity), 0), 4) AS quantity, round(coalesce(sum(l_extendedprice), 0), 2) AS price FROM lineitem GROUP BY l_linestatus")
def _(t: Tables):
    return t("lineitem").groupBy("l_linestatus").agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum("l_quantity"), F.lit(0.0)), 4).alias("quantity"), F.round(F.coalesce(F.sum("l_extendedprice"), F.lit(0.0)), 2).alias("price"))


@query("e06_overall_progress", "SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'P') AS partial, CASE WHEN count(*) = 0 THEN 0.0 ELSE round(count(*) FILTER (o_orderstatus = 'F') * 100.0 / count(*), 1) END AS pct FROM orders")
def _(t: Tables):
    return A.progress(t("orders"), "o_orderstatus", STATES, "done")


@query(
    "e07_harvest_progress",
    """SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS completed, count(*) FILTER (o_orderstatus = 'O') AS pending, count(*) FILTER (o_orderstatus = 'P') AS running,
    count(DISTINCT o_custkey) AS places, round(sum(o_totalprice), 2) AS bytes_total, round(max(o_totalprice), 2) AS largest, min(o_orderdate) AS started, max(o_orderdate) AS finished,
    count(*) FILTER (o_orderpriority LIKE '1%') AS urgent FROM orders""",
)
def _(t: Tables):
    state = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return t("orders").agg(
        F.count("*").alias("total"), state("F").alias("completed"), state("O").alias("pending"), state("P").alias("running"), F.countDistinct("o_custkey").alias("places"), F.round(F.sum("o_totalprice"), 2).alias("bytes_total"),
        F.round(F.max("o_totalprice"), 2).alias("largest"), F.min("o_orderdate").alias("started"), F.max("o_orderdate").alias("finished"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("urgent"),
    )


@query("e08_batch_status", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY o_orderstatus")
def _(t: Tables):
    return A.count_by(t("orders").where(F.col("o_orderpriority").startswith("1")), "o_orderstatus")


@query(
    "e09_document_stats",
    """SELECT CASE WHEN grouping(source) = 0 THEN 'source' WHEN grouping(lang) = 0 THEN 'lang' ELSE 'all' END AS facet, coalesce(source, lang, 'all') AS value, count(*) AS n
    FROM (SELECT coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang FROM documents) GROUP BY GROUPING SETS ((source), (lang), ())""",
)
def _(t: Tables):
    docs = t("documents").select(F.coalesce("source", F.lit("unknown")).alias("source"), F.coalesce("lang", F.lit("unknown")).alias("lang"))
    sets = docs.groupingSets([["source"], ["lang"], []], "source", "lang").agg(F.count("*").alias("n"), F.grouping("source").alias("gs"), F.grouping("lang").alias("gl"))
    facet = F.when(F.col("gs") == 0, "source").when(F.col("gl") == 0, "lang").otherwise("all")
    return sets.select(facet.alias("facet"), F.coalesce("source", "lang", F.lit("all")).alias("value"), "n")


@query(
    "e10_error_summary",
    """SELECT 'type' AS facet, event_type AS value, count(*) AS n FROM events WHERE event_type IN ('error', 'signup') GROUP BY event_type
    UNION ALL SELECT * FROM (SELECT 'user' AS facet, CAST(user_id AS VARCHAR) AS value, count(*) AS n FROM events WHERE event_type IN ('error', 'signup') GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10)
    UNION ALL SELECT 'total', 'all', count(*) FROM events WHERE event_type IN ('error', 'signup')""",
)
def _(t: Tables):
    errors = t("events").where(F.col("event_type").isin("error", "signup"))
    kinds = A.count_by(errors, "event_type").select(F.lit("type").alias("facet"), F.col("event_type").alias("value"), "n")
    users = A.top_counts(errors, "user_id", 10).select(F.lit("user").alias("facet"), F.col("user_id").cast("string").alias("value"), "n")
    return kinds.union(users).union(errors.agg(F.count("*").alias("n")).select(F.lit("total").alias("facet"), F.lit("all").alias("value"), "n"))


@query("e11_json_field_distribution", "SELECT coalesce(json_extract_string(props, '$.k'), 'unknown') AS k, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1")
def _(t: Tables):
    return t("events").groupBy(F.coalesce(F.get_json_object("props", "$.k"), F.lit("unknown")).alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


@query("e12_json_sum_by_type", "SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k_sum FROM events GROUP BY event_type")
def _(t: Tables):
    return t("events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k_sum"))


@query(
    "e13_throughput_eta",
    """WITH d AS (SELECT count(*) AS done, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders WHERE o_orderstatus = 'F'), r AS (SELECT count(*) AS remaining FROM orders WHERE o_orderstatus <> 'F')
    SELECT done, remaining, round(epoch(b - a) / 3600.0, 4) AS hours, round(done / (epoch(b - a) / 3600.0), 6) AS per_hour, round(remaining / (done / (epoch(b - a) / 3600.0)), 4) AS eta_hours, round(done * 100.0 / (done + remaining), 1) AS pct FROM d, r""",
)
def _(t: Tables):
    done = F.col("o_orderstatus") == "F"
    at = F.unix_timestamp("o_orderdate")
    base = t("orders").agg(F.count_if(done).alias("done"), F.count_if(~done).alias("remaining"), ((F.max(F.when(done, at)) - F.min(F.when(done, at))) / 3600.0).alias("h"))
    rate = F.col("done") / F.col("h")
    return base.select("done", "remaining", F.round("h", 4).alias("hours"), F.round(rate, 6).alias("per_hour"), F.round(F.col("remaining") / rate, 4).alias("eta_hours"), A.percent(F.col("done"), F.col("done") + F.col("remaining")).alias("pct"))


@query("e14_worker_partials", "SELECT user_id % 8 AS worker, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1")
def _(t: Tables):
    return t("events").groupBy((F.col("user_id") % 8).alias("worker")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


@query("e15_rating_stats", "SELECT count(*) AS n, round(avg(quality), 2) AS mean, min(quality) AS least, max(quality) AS most FROM labels")
def _(t: Tables):
    return t("labels").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 2).alias("mean"), F.min("quality").alias("least"), F.max("quality").alias("most"))


@query(
    "e16_score_statistics",
    """WITH s AS (SELECT event_type, value, sum(value) OVER (PARTITION BY event_type) AS total, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value > 0)
    SELECT event_type, max(n) AS n, round(max(value), 4) AS top, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, round(sum(-(value / total) * ln(value / total + 1e-10)) / ln(max(n)), 6) AS entropy FROM s GROUP BY event_type""",
)
def _(t: Tables):
    out = A.score_statistics(t("events").where("value > 0"), "event_type", "value")
    return out.select("event_type", "n", *(F.round(c, 4).alias(c) for c in ("top", "mean", "std")), F.round("entropy", 6).alias("entropy"))


@query(
    "e17_fusion_metrics",
    """WITH s AS (SELECT DISTINCT user_id % 50 AS query_id, event_type AS set_id, event_id % 97 AS id FROM events), c AS (SELECT query_id, id, count(*) AS sets FROM s GROUP BY 1, 2),
    f AS (SELECT query_id, count(*) AS first_n FROM s WHERE set_id = 'click' GROUP BY 1)
    SELECT c.query_id, count(*) AS unique_n, CAST(sum(sets) AS BIGINT) AS listed_n, count(*) FILTER (sets >= 2) AS overlap_n, round(count(*) FILTER (sets >= 2) * 1.0 / count(*), 6) AS overlap, round((count(*) - coalesce(max(first_n), 0)) * 1.0 / count(*), 6) AS gain
    FROM c LEFT JOIN f ON c.query_id = f.query_id GROUP BY c.query_id""",
)
def _(t: Tables):
    listed = t("events").select((F.col("user_id") % 50).alias("query_id"), F.col("event_type").alias("set_id"), (F.col("event_id") % 97).alias("id")).distinct()
    ids = listed.groupBy("query_id", "id").agg(F.count("*").alias("sets"), F.max((F.col("set_id") == "click").cast("int")).alias("in_first"))
    many = F.count_if(F.col("sets") >= 2)
    return ids.groupBy("query_id").agg(F.count("*").alias("unique_n"), F.sum("sets").alias("listed_n"), many.alias("overlap_n"), F.round(many / F.count("*"), 6).alias("overlap"), F.round((F.count("*") - F.sum("in_first")) / F.count("*"), 6).alias("gain"))


_RATES = "count(*) AS total, count(*) FILTER (event_type = 'error') AS refusals, round(count(*) FILTER (event_type = 'error') * 100.0 / count(*), 2) AS refusal_pct, round(avg(value), 1) AS latency"


@query("e18_windowed_rates", f"SELECT {_RATES} FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def _(t: Tables):
    from lodestone.streaming.metrics import rates, trailing

    return rates(trailing(t("events"), 3600))


@query("e19_mode_breakdown", f"SELECT json_extract_string(props, '$.k') AS mode, {_RATES} FROM events GROUP BY 1")
def _(t: Tables):
    from lodestone.streaming.metrics import rates

    return rates(t("events").withColumn("mode", F.get_json_object("props", "$.k")), "mode")


@query("e20_top_questions", "SELECT text, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY text ORDER BY n DESC, text LIMIT 10")
def _(t: Tables):
    return A.top_counts(t("conversations").where("role = 'user'"), "text", 10)


@query("e21_heavy_hitters", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 100")
def _(t: Tables):
    return A.top_counts(t("events"), "user_id", 100)


@query("e22_latency_report", "SELECT count(value) AS n, round(avg(value), 4) AS mean, round(median(value), 4) AS median, min(value) AS least, max(value) AS most FROM events")
def _(t: Tables):
    return A.summary(t("events"), "value")


@query("e22b_p95_element", "SELECT event_type, list_sort(list(value))[CAST(floor(count(*) * 0.95) AS BIGINT) + 1] AS at_share FROM events WHERE value IS NOT NULL GROUP BY event_type")
def _(t: Tables):
    return A.element_at_share(t("events"), "value", 0.95, ["event_type"])


@query(
    "e23_evaluation_report",
    "SELECT lang, count(*) AS total, CAST(sum(quality) AS BIGINT) AS passed, count(*) FILTER (quality = 0) AS failed, round(avg(quality), 6) AS pass_rate, round(avg(n_chars) FILTER (toxic = 0), 4) AS clean_chars FROM documents JOIN labels USING (doc_id) GROUP BY lang",
)
def _(t: Tables):
    both = t("documents").select("doc_id", "lang", "n_chars").join(t("labels"), "doc_id")
    return both.groupBy("lang").agg(F.count("*").alias("total"), F.sum("quality").cast("long").alias("passed"), F.count_if(F.col("quality") == 0).alias("failed"), F.round(F.avg("quality"), 6).alias("pass_rate"), F.round(F.avg(F.when(F.col("toxic") == 0, F.col("n_chars"))), 4).alias("clean_chars"))


@query(
    "e24_ab_improvement",
    "WITH m AS (SELECT event_type, avg(value) FILTER (user_id % 2 = 0) AS a, avg(value) FILTER (user_id % 2 = 1) AS b FROM events GROUP BY 1) SELECT event_type, round(a, 4) AS base, round(b, 4) AS variant, CASE WHEN a = 0 THEN NULL ELSE round((b - a) / a, 6) END AS improvement FROM m",
)
def _(t: Tables):
    arm = lambda k: F.avg(F.when(F.col("user_id") % 2 == k, F.col("value")))
    m = t("events").groupBy("event_type").agg(arm(0).alias("a"), arm(1).alias("b"))
    return m.select("event_type", F.round("a", 4).alias("base"), F.round("b", 4).alias("variant"), F.when(F.col("a") != 0, F.round((F.col("b") - F.col("a")) / F.col("a"), 6)).alias("improvement"))


@query("e25_grading_metrics", "SELECT user_id, count(*) AS n, count(*) FILTER (value >= 50) AS relevant, round(count(*) FILTER (value >= 50) * 100.0 / count(*), 1) AS pct, round(avg(value), 4) AS mean FROM events GROUP BY user_id")
def _(t: Tables):
    good = F.count_if(F.col("value") >= 50)
    return t("events").groupBy("user_id").agg(F.count("*").alias("n"), good.alias("relevant"), F.round(good * 100.0 / F.count("*"), 1).alias("pct"), F.round(F.avg("value"), 4).alias("mean"))


@query(
    "e26_evidence_level",
    """SELECT user_id, CASE WHEN count(*) FILTER (value > 70 AND event_type IN ('purchase', 'signup')) >= 2 THEN 'HIGH' WHEN avg(value) > 40 THEN 'LOW' ELSE 'NONE' END AS evidence FROM events GROUP BY user_id""",
)
def _(t: Tables):
    strong = F.count_if((F.col("value") > 70) & F.col("event_type").isin("purchase", "signup"))
    return t("events").groupBy("user_id").agg(F.when(strong >= 2, "HIGH").when(F.avg("value") > 40, "LOW").otherwise("NONE").alias("evidence"))


@query("e27_count_by_field", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand")
def _(t: Tables):
    return A.count_by(t("part"), "p_brand")


@query("e28_year_counters", "SELECT year(o_orderdate) AS year, count(*) AS n, round(sum(o_totalprice) / 1048576.0, 2) AS mb FROM orders GROUP BY 1 ORDER BY 1 DESC")
def _(t: Tables):
    return t("orders").groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice") / 1048576.0, 2).alias("mb")).orderBy(F.desc("year"))


@query("e29_low_yield", "SELECT source, count(*) AS n, count(*) < 100 AS low_yield FROM documents GROUP BY source")
def _(t: Tables):
    return t("documents").groupBy("source").agg(F.count("*").alias("n"), (F.count("*") < 100).alias("low_yield"))


@query("e30_vectors_by_collection", "SELECT label, count(*) AS n FROM embeddings WHERE label IS NOT NULL GROUP BY label")
def _(t: Tables):
    return A.count_by(t("embeddings").where("label IS NOT NULL"), "label")


@query(
    "e31_migration_status",
    "WITH o AS (SELECT source, count(*) AS old_n FROM documents GROUP BY 1), n AS (SELECT source, count(*) AS new_n FROM documents JOIN labels USING (doc_id) GROUP BY 1) SELECT source, old_n, coalesce(new_n, 0) AS new_n, old_n - coalesce(new_n, 0) AS remaining, round(coalesce(new_n, 0) * 100.0 / old_n, 2) AS pct FROM o LEFT JOIN n USING (source)",
)
def _(t: Tables):
    docs = t("documents").select("doc_id", "source")
    return I.migration_status(docs, I.present_in(docs, t("labels"), ["doc_id"]), "doc_id", "source")


@query("e32_distinct_sorted", "SELECT o_orderpriority, array_to_string(list_sort(list_distinct(list(o_orderstatus))), ',') AS states FROM orders GROUP BY 1")
def _(t: Tables):
    return t("orders").groupBy("o_orderpriority").agg(F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("states"))


@query(
    "e33_failure_run",
    """WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events), k AS (SELECT * FROM r WHERE rn <= 5)
    SELECT user_id, CAST(coalesce(min(rn) FILTER (event_type NOT IN ('error', 'click', 'view')) - 1, max(rn)) AS BIGINT) AS failures, coalesce(min(rn) FILTER (event_type NOT IN ('error', 'click', 'view')) - 1, max(rn)) >= 3 AS alert FROM k GROUP BY user_id""",
)
def _(t: Tables):
    return A.run_of_failures(t("events"), "user_id", [F.desc("ts"), F.desc("event_id")], F.col("event_type").isin("error", "click", "view"))


@query("e34_priority_distribution", "SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS open FROM orders GROUP BY 1")
def _(t: Tables):
    return t("orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("open"))


@query(
    "e35_overall_component_status",
    "SELECT o_custkey, CASE WHEN count(*) FILTER (o_orderstatus = 'P') > 0 THEN 'degraded' WHEN count(*) FILTER (o_orderstatus = 'O') = count(*) THEN 'offline' ELSE 'online' END AS status FROM orders GROUP BY o_custkey",
)
def _(t: Tables):
    state = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return t("orders").groupBy("o_custkey").agg(F.when(state("P") > 0, "degraded").when(state("O") == F.count("*"), "offline").otherwise("online").alias("status"))


@query(
    "e36_ordered_content_hash",
    "SELECT conv_id, sha256(string_agg(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), '|' ORDER BY turn)) AS content_hash FROM conversations GROUP BY conv_id",
)
def _(t: Tables):
    norm = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    parts = F.array_sort(F.collect_list(F.struct("turn", norm.alias("x"))))
    return t("conversations").groupBy("conv_id").agg(F.sha2(F.array_join(F.transform(parts, lambda p: p.x), "|"), 256).alias("content_hash"))


@query("e37_status_with_total", "SELECT CASE WHEN grouping(o_orderstatus) = 1 THEN 'TOTAL' ELSE o_orderstatus END AS o_orderstatus, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus)")
def _(t: Tables):
    return A.with_total(t("orders"), "o_orderstatus")


@query(
    "e38_counts_against_estimate",
    "WITH c AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) SELECT n_name, coalesce(n, 0) AS n, n_nationkey * 10 + 10 AS estimate, round(coalesce(n, 0) * 100.0 / (n_nationkey * 10 + 10), 2) AS pct FROM nation LEFT JOIN c ON n_nationkey = c_nationkey",
)
def _(t: Tables):
    counts = A.count_by(t("customer"), "c_nationkey")
    both = t("nation").join(counts, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    n, estimate = F.coalesce("n", F.lit(0)), F.col("n_nationkey") * 10 + 10
    return both.select("n_name", n.alias("n"), estimate.alias("estimate"), F.round(n * 100.0 / estimate, 2).alias("pct"))


@query("e39_counts_with_zero", "SELECT n_name, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal < 0 GROUP BY n_name")
def _(t: Tables):
    s = t("supplier").where("s_acctbal < 0")
    return t("nation").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left").groupBy("n_name").agg(F.count("s_suppkey").alias("n"))


@query("e40_verify_migration", "SELECT (SELECT count(*) FROM documents) AS old_n, (SELECT count(*) FROM labels) AS new_n, (SELECT count(*) FROM documents) = (SELECT count(*) FROM labels) AS complete")
def _(t: Tables):
    sides = t("documents").select(F.lit(1).alias("o"), F.lit(0).alias("n")).unionAll(t("labels").select(F.lit(0).alias("o"), F.lit(1).alias("n")))
    return sides.agg(F.sum("o").alias("old_n"), F.sum("n").alias("new_n")).withColumn("complete", F.col("old_n") == F.col("new_n"))


@query(
    "e41_url_types",
    "SELECT CASE WHEN contains(url, '?') THEN 'query' WHEN contains(url, '#') THEN 'fragment' ELSE 'plain' END AS kind, count(DISTINCT url) AS urls, count(*) AS n FROM pages GROUP BY 1",
)
def _(t: Tables):
    kind = F.when(F.contains("url", F.lit("?")), "query").when(F.contains("url", F.lit("#")), "fragment").otherwise("plain")
    return t("pages").groupBy(kind.alias("kind")).agg(F.countDistinct("url").alias("urls"), F.count("*").alias("n"))


@query("e42_documents_by_month", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, count(*) < 100 AS low FROM orders GROUP BY 1 ORDER BY 1")
def _(t: Tables):
    return t("orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), (F.count("*") < 100).alias("low")).orderBy("month")


@query("e43_last_segment_counts", "SELECT list_extract(string_split(p_type, ' '), -1) AS kind, count(*) AS n FROM part GROUP BY 1 ORDER BY 1")
def _(t: Tables):
    return t("part").groupBy(F.element_at(F.split("p_type", " "), -1).alias("kind")).agg(F.count("*").alias("n")).orderBy("kind")


@query("e44_top_types", "SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_type LIMIT 10")
def _(t: Tables):
    return A.top_counts(t("part"), "p_type", 10)


@query("e45_sum_of_group_stats", "SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS rows_n, round(sum(v), 2) AS value FROM (SELECT event_type, count(*) AS n, sum(value) AS v FROM events GROUP BY 1)")
def _(t: Tables):
    groups = t("events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    return groups.agg(F.count("*").alias("groups"), F.sum("n").alias("rows_n"), F.round(F.sum("v"), 2).alias("value"))
