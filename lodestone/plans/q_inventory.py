"""Queries of joins, sinks as dataflows, and queue operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import inventory as I
from lodestone.plans.registry import Tables, query


@query("d01_not_queued", "SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey) ORDER BY c_custkey")
def _(t: Tables):
    queued = t("orders").select(F.col("o_custkey").alias("c_custkey"))
    return I.missing_from(t("customer"), queued, ["c_custkey"]).select("c_custkey", "c_name").orderBy("c_custkey")


@query("d02_queue_join", "SELECT o_orderkey, c_name, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' ORDER BY o_orderpriority, o_orderkey LIMIT 100")
def _(t: Tables):
    both = t("orders").where("o_orderstatus = 'O'").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return both.orderBy("o_orderpriority", "o_orderkey").limit(100).select("o_orderkey", "c_name", "o_orderpriority")


@query("d03_triggered_documents", "SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id) WHERE toxic = 0")
def _(t: Tables):
    return t("documents").join(t("labels").where("toxic = 0"), "doc_id").select("doc_id", "lang", "quality")


@query("d04_join_distinct", "SELECT DISTINCT l_suppkey, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _(t: Tables):
    return t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_suppkey", "o_orderpriority").distinct()


@query("d05_source_ids_not_in_target", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id")
def _(t: Tables):
    return I.missing_from(t("documents").select("doc_id"), t("labels"), ["doc_id"]).orderBy("doc_id")


@query("d06_exists_by_digest", "SELECT doc_id FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM documents WHERE source = 'src0') AND source <> 'src0'")
def _(t: Tables):
    docs = t("documents").select("doc_id", "source", F.sha2("text", 256).alias("digest"))
    return I.present_in(docs.where("source <> 'src0'"), docs.where("source = 'src0'"), ["digest"]).select("doc_id")


@query("d07_add_if_absent", "SELECT event_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 5000)")
def _(t: Tables):
    have = t("customer").where("c_acctbal < 5000").select(F.col("c_custkey").alias("user_id"))
    return I.missing_from(t("events"), have, ["user_id"]).select("event_id")


@query("d08_unprocessed_by_hash", "SELECT page_id FROM pages WHERE md5(html) NOT IN (SELECT md5(html) FROM pages WHERE page_id % 3 = 0)")
def _(t: Tables):
    pages = t("pages").select("page_id", F.md5("html").alias("h"))
    return I.missing_from(pages, pages.where("page_id % 3 = 0"), ["h"]).select("page_id")


_OLD = "SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 7 <> 0"
_NEW = "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN md5(text || '!') ELSE md5(text) END AS h FROM documents WHERE doc_id % 11 <> 0"


@query("d09_change_detection", f"SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'new' WHEN n.doc_id IS NULL THEN 'missing' WHEN o.h = n.h THEN 'unchanged' ELSE 'changed' END AS change FROM ({_OLD}) o FULL OUTER JOIN ({_NEW}) n ON o.doc_id = n.doc_id")
def _(t: Tables):
    d = t("documents")
    old = d.where("doc_id % 7 <> 0").select("doc_id", F.md5("text").alias("h"))
    new = d.where("doc_id % 11 <> 0").select("doc_id", F.md5(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("h"))
    return I.changes(old, new, "doc_id", "h")


@query(
    "d10_lookup_by_any_key",
    """WITH k AS (SELECT s_suppkey, unnest([CAST(s_suppkey AS VARCHAR), s_name, lower(s_name)]) AS key, unnest([0, 1, 2]) AS pos FROM supplier), q AS (SELECT l_suppkey, l_partkey, 'supplier#' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS a, CAST(l_suppkey AS VARCHAR) AS b FROM lineitem)
    SELECT q.b AS key, count(*) AS n, min(k.s_suppkey) AS s_suppkey FROM q JOIN k ON q.b = k.key GROUP BY q.b""",
)
def _(t: Tables):
    keys = t("supplier").select("s_suppkey", F.posexplode(F.array(F.col("s_suppkey").cast("string"), "s_name", F.lower("s_name"))).alias("pos", "key"))
    wanted = t("lineitem").groupBy(F.col("l_suppkey").cast("string").alias("key")).agg(F.count("*").alias("n"))
    return wanted.join(keys, "key").groupBy("key").agg(F.max("n").alias("n"), F.min("s_suppkey").alias("s_suppkey"))


@query("d11_tier_join", "SELECT doc_id, CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 ELSE 3 END AS tier FROM documents")
def _(t: Tables):
    from lodestone.operators.retrieval import with_tier

    return with_tier(t("documents"), "lang", {"en": 1, "de": 2}).select("doc_id", "tier")


@query(
    "d13_ordered_unique_roles",
    "SELECT n_nationkey, array_to_string(list_filter([CAST(n_regionkey AS VARCHAR), CASE WHEN n_nationkey % 5 <> n_regionkey THEN CAST(n_nationkey % 5 AS VARCHAR) END, n_name], lambda x: x IS NOT NULL), ',') AS roles FROM nation",
)
def _(t: Tables):
    roles = F.array_distinct(F.array(F.col("n_regionkey").cast("string"), (F.col("n_nationkey") % 5).cast("string"), F.col("n_name")))
    return t("nation").select("n_nationkey", F.array_join(roles, ",").alias("roles"))


@query(
    "d15_positional_zip",
    "WITH u AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations WHERE role = 'assistant') SELECT conv_id, p AS pos, length(u.text) AS asked, length(a.text) AS answered FROM u JOIN a USING (conv_id, p)",
)
def _(t: Tables):
    from pyspark.sql import Window

    side = lambda role, name: t("conversations").where(F.col("role") == role).select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long").alias("pos"), F.length("text").cast("long").alias(name))
    return side("user", "asked").join(side("assistant", "answered"), ["conv_id", "pos"])


@query("d18_worker_range", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn BETWEEN 101 AND 200")
def _(t: Tables):
    return I.rows_between(t("orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 101, 200).select("o_orderkey")


@query("d19_catalog_lookup", "SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE' OR r_regionkey = 1")
def _(t: Tables):
    return t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey")).where("r_name = 'EUROPE' OR r_regionkey = 1").select("r_name", "n_name")  # a dimension of a row a region


@query("b02_upsert_latest", "WITH b AS (SELECT o_custkey, o_orderkey, o_totalprice, o_orderdate FROM orders) SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM b GROUP BY o_custkey")
def _(t: Tables):
    base = t("orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return I.latest_state(base, "o_custkey", "o_orderkey", [F.col("o_orderdate"), F.col("o_orderkey")])


@query("b03_delete_then_reindex", "SELECT doc_id, source, n_chars FROM documents WHERE source <> 'src1' UNION ALL SELECT doc_id, source, n_chars + 1 FROM documents WHERE source = 'src1'")
def _(t: Tables):
    d = t("documents").select("doc_id", "source", "n_chars")
    gone = d.where("source = 'src1'")
    return I.missing_from(d, gone, ["doc_id"]).unionByName(gone.withColumn("n_chars", F.col("n_chars") + 1)).select("doc_id", "source", "n_chars")


@query("b05_metadata_merge", "SELECT doc_id, lang AS lang, CASE WHEN doc_id % 2 = 0 THEN 'updated' ELSE source END AS source FROM documents")
def _(t: Tables):
    old = F.create_map(F.lit("lang"), "lang", F.lit("source"), "source")
    new = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("source"), F.lit("updated"))).otherwise(F.create_map().cast("map<string,string>"))
    kept = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(F.col("new")), k))
    merged = t("documents").withColumn("new", new).withColumn("m", F.map_concat(kept, F.col("new")))
    return merged.select("doc_id", F.col("m")["lang"].alias("lang"), F.col("m")["source"].alias("source"))


@query("b07_delete_by_id", "SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity < 10)")
def _(t: Tables):
    gone = t("lineitem").where("l_quantity < 10").select(F.col("l_partkey").alias("vec_id"))
    return I.missing_from(t("embeddings").select("vec_id", "label"), gone, ["vec_id"])


@query("b08_insert_or_ignore", "SELECT user_id, min_by(event_id, (ts, event_id)) AS event_id FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier) GROUP BY user_id")
def _(t: Tables):
    have = t("supplier").select(F.col("s_suppkey").alias("user_id"))
    return I.insert_or_ignore(have, t("events").select("user_id", "event_id", "ts"), "user_id", [F.col("ts"), F.col("event_id")]).select("user_id", "event_id")


@query("b09_insert_or_replace", "SELECT c_custkey, coalesce(o.price, c_acctbal) AS balance FROM customer LEFT JOIN (SELECT o_custkey, max_by(o_totalprice, o_orderkey) AS price FROM orders GROUP BY 1) o ON c_custkey = o_custkey")
def _(t: Tables):
    have = t("customer").select("c_custkey", F.col("c_acctbal").alias("balance"), F.lit(0).cast("long").alias("v"))
    new = t("orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("balance"), F.col("o_orderkey").alias("v")).join(t("customer").select("c_custkey"), "c_custkey", "left_semi")
    return I.insert_or_replace(have, new, ["c_custkey"], F.col("v")).select("c_custkey", "balance")


@query("b10_bulk_enqueue", """SELECT doc_id, '{"doc_id":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '"}' AS payload, 'pending' AS status FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def _(t: Tables):
    new = I.missing_from(t("documents").select("doc_id", "lang", "source"), t("labels"), ["doc_id"])
    return new.select("doc_id", F.to_json(F.struct("doc_id", "lang", "source")).alias("payload"), F.lit("pending").alias("status"))


@query("b12_current_state", "SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def _(t: Tables):
    return I.latest_state(t("events"), "user_id", "event_type", [F.col("ts"), F.col("event_id")])


@query("b13_reset_failed", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'O' ELSE o_orderstatus END AS status, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS result FROM orders")
def _(t: Tables):
    failed = F.col("o_orderstatus") == "P"
    return t("orders").select("o_orderkey", F.when(failed, "O").otherwise(F.col("o_orderstatus")).alias("status"), F.when(~failed, F.col("o_totalprice")).alias("result"))


@query("b15_export_results", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'purchase'")
def _(t: Tables):
    return t("events").where("event_type = 'purchase'").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("b19_migration_ids", "SELECT md5(source || ':' || doc_id) AS point_id, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t: Tables):
    left = I.missing_from(t("documents").select("doc_id", "source"), t("labels"), ["doc_id"])
    return left.select(F.md5(F.concat_ws(":", "source", "doc_id")).alias("point_id"), "doc_id")


@query("b24_prometheus_text", "SELECT 'requests_total{mode=\"' || event_type || '\"} ' || count(*) AS line FROM events GROUP BY event_type")
def _(t: Tables):
    counts = t("events").groupBy("event_type").agg(F.count("*").alias("n"))
    return counts.select(F.format_string('requests_total{mode="%s"} %d', "event_type", "n").alias("line"))


@query("b28_mark_indexed", "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS indexed FROM documents")
def _(t: Tables):
    marks = t("labels").select("doc_id").distinct().withColumn("m", F.lit(True))
    return t("documents").select("doc_id").join(marks, "doc_id", "left").select("doc_id", F.coalesce("m", F.lit(False)).alias("indexed"))


@query("b36_checked_ratings", "SELECT doc_id, quality + 1 AS rating FROM labels WHERE quality + 1 BETWEEN 1 AND 5")
def _(t: Tables):
    return t("labels").select("doc_id", (F.col("quality") + 1).alias("rating")).where(F.expr("assert_true(rating BETWEEN 1 AND 5, 'rating out of range') IS NULL"))


@query("b39_generated_ids", "SELECT lang || '-' || lpad(CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS VARCHAR), 6, '0') AS qid, doc_id FROM documents")
def _(t: Tables):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))
    return t("documents").select(F.format_string("%s-%06d", "lang", n).alias("qid"), "doc_id")
