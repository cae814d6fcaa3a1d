"""Queries of scans and parsers over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.plans.registry import Tables, query
from lodestone.sources import html as H
from lodestone.sources import records as S


@query("a01_collection_scan", "SELECT doc_id, length(trim(source || ' ' || text, ' ')) AS n FROM documents WHERE lang = 'en' AND trim(source || ' ' || text, ' ') <> ''")
def _(t: Tables):
    text = F.trim(F.concat_ws(" ", "source", "text"))
    return t("documents").where("lang = 'en'").select("doc_id", F.length(text).cast("long").alias("n")).where("n > 0")


@query("a02_inventory_scan", "SELECT doc_id, CASE WHEN contains(source, '1') THEN 'one' WHEN contains(source, '2') THEN 'two' ELSE 'other' END AS doc_type FROM documents")
def _(t: Tables):
    return t("documents").select("doc_id", F.when(F.contains("source", F.lit("1")), "one").when(F.contains("source", F.lit("2")), "two").otherwise("other").alias("doc_type"))


@query("a03_point_lookup", "SELECT event_id, arg_min(event_type, event_type) AS event_type FROM events WHERE event_id IN (1, 5, 77, 500) GROUP BY event_id")
def _(t: Tables):
    return t("events").where(F.col("event_id").isin(1, 5, 77, 500)).groupBy("event_id").agg(F.min_by("event_type", "event_type").alias("event_type"))


@query("a04_equality_scan", "SELECT doc_id FROM documents WHERE lang = 'de' AND source = 'src2'")
def _(t: Tables):
    return t("documents").where("lang = 'de' AND source = 'src2'").select("doc_id")


@query("a05_collections_with_fields", "SELECT source, count(*) AS n, array_to_string(list_sort(list_distinct(list(lang))), ',') AS fields FROM documents GROUP BY source")
def _(t: Tables):
    return t("documents").groupBy("source").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("fields"))


@query("a06_polymorphic_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(t: Tables):
    shaped = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("["), "props", F.lit("]"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"records":['), "props", F.lit("]}"))).otherwise(F.col("props"))
    return t("events").select("event_id", F.explode(S.record_array(shaped, "k: bigint")).alias("r")).select("event_id", F.col("r.k").alias("k"))


@query("a08_record_count", "SELECT count(*) AS n FROM lineitem")
def _(t: Tables):
    return t("lineitem").agg(F.count("*").alias("n"))


@query("a12_priority_order", "SELECT source, count(*) AS n, CASE source WHEN 'src7' THEN 0 WHEN 'src3' THEN 1 ELSE 99 END AS prio FROM documents GROUP BY source ORDER BY prio, source")
def _(t: Tables):
    return t("documents").groupBy("source").agg(F.count("*").alias("n")).withColumn("prio", F.when(F.col("source") == "src7", 0).when(F.col("source") == "src3", 1).otherwise(99)).orderBy("prio", "source")


@query("a19_html_text")
def _(t: Tables):
    return t("pages").select("page_id", H.plain_text("html").alias("text"))


@query("a20_html_title", "SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1), ' '), ''), nullif(trim(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1), ' '), ''), url) AS title FROM pages")
def _(t: Tables):
    return t("pages").select("page_id", H.title("html", "url").alias("title"))


@query("a21_links", "WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a\\s+href=\"([^\"]*)\"', 1)) AS href FROM pages) SELECT page_id, CASE WHEN href LIKE '/%' THEN regexp_extract(url, '^[a-z]+://[^/?#]+', 0) || href ELSE href END AS link FROM l GROUP BY 1, 2")
def _(t: Tables):
    return H.links(t("pages")).select("page_id", "link")


@query("a26_rss_items", "SELECT page_id, url AS link, 'page ' || page_id AS title FROM pages")
def _(t: Tables):
    item = F.concat(F.lit("<item><title>page "), F.col("page_id"), F.lit("</title><link>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</link></item>"))
    parsed = t("pages").select("page_id", S.from_xml(item, S.RSS_ITEM).alias("r"))
    return parsed.where("r.title IS NOT NULL OR r.link IS NOT NULL").select("page_id", F.col("r.link").alias("link"), F.col("r.title").alias("title"))


@query("a28_feed_union_dedup", "SELECT regexp_extract(url, '^[^?#]*', 0) AS url, min(page_id) AS page_id FROM pages GROUP BY 1")
def _(t: Tables):
    return t("pages").groupBy(F.regexp_extract("url", "^[^?#]*", 0).alias("url")).agg(F.min("page_id").alias("page_id"))


@query("a33_last_progress", "SELECT user_id, CAST(json_extract_string(max_by(props, (ts, event_id)), '$.k') AS BIGINT) AS k FROM events GROUP BY user_id")
def _(t: Tables):
    last = F.max_by("props", F.struct("ts", "event_id"))
    return t("events").groupBy("user_id").agg(F.regexp_extract(last, r'"k":\s*(\d+)', 1).cast("long").alias("k"))


@query("a34_path_metadata", "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+)/', 1) AS section FROM pages")
def _(t: Tables):
    return t("pages").select("page_id", H.host("url").alias("host"), F.regexp_extract("url", r"^[a-z]+://[^/]+/([a-z]+)/", 1).alias("section"))


@query("a36_identifier_index", "SELECT key, max(p_partkey) AS p_partkey FROM (SELECT p_partkey, unnest([CAST(p_partkey AS VARCHAR), p_brand, lower(p_type)]) AS key FROM part) GROUP BY key")
def _(t: Tables):
    return t("part").select("p_partkey", F.explode(F.array_compact(F.array(F.col("p_partkey").cast("string"), "p_brand", F.lower("p_type")))).alias("key")).groupBy("key").agg(F.max("p_partkey").alias("p_partkey"))


@query("a42_rows_with_title", "SELECT page_id FROM pages WHERE trim(regexp_extract(html, '<title>(.*?)</title>', 1), ' ') <> ''")
def _(t: Tables):
    return t("pages").where(F.trim(F.regexp_extract("html", "<title>(.*?)</title>", 1)) != "").select("page_id")


@query("o01_harvest_report", "SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, count(*) AS n, count(DISTINCT md5(html)) AS contents, round(avg(length(html)), 4) AS size, count(*) < 5 AS low_yield FROM pages GROUP BY 1")
def _(t: Tables):
    return t("pages").groupBy(H.host("url").alias("host")).agg(F.count("*").alias("n"), F.countDistinct(F.md5("html")).alias("contents"), F.round(F.avg(F.length("html")), 4).alias("size"), (F.count("*") < 5).alias("low_yield"))
