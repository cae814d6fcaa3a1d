"""Queries of the evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import retrieval as R
from lodestone.plans.registry import Tables, query

_RANKED = "SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events"


def _ranked(t: Tables, k: int = 1 << 30):
    return R.top_k(t("events").select("user_id", "event_type", "event_id", "value"), ["user_id"], [F.desc("value"), F.col("event_id")], k)


@query("m01_recall_at_k", f"SELECT user_id, round((CAST(bool_or(event_type = 'purchase') AS INT) + CAST(bool_or(event_type = 'signup') AS INT) + CAST(bool_or(event_type = 'error') AS INT)) / 3.0, 6) AS recall FROM ({_RANKED}) WHERE rank <= 5 GROUP BY user_id")
def _(t: Tables):
    found = sum((F.max((F.col("event_type") == e).cast("int")) for e in ("purchase", "signup", "error")), F.lit(0))
    return _ranked(t, 5).groupBy("user_id").agg(F.round(found / 3.0, 6).alias("recall"))


@query("m02_mean_reciprocal_rank", f"SELECT round(avg(rr), 6) AS mrr, count(*) AS queries FROM (SELECT user_id, coalesce(1.0 / min(rank) FILTER (event_type = 'error'), 0) AS rr FROM ({_RANKED}) GROUP BY user_id)")
def _(t: Tables):
    rr = _ranked(t).groupBy("user_id").agg(F.coalesce(1.0 / F.min(F.when(F.col("event_type") == "error", F.col("rank"))), F.lit(0.0)).alias("rr"))
    return rr.agg(F.round(F.avg("rr"), 6).alias("mrr"), F.count("*").alias("queries"))


_PAIR = """SELECT conv_id, list_distinct(list_filter(regexp_extract_all(lower(min_by(text, turn) FILTER (role = 'user')), '[\\p{L}\\p{N}_]+'), lambda w: length(w) >= 4)) AS q,
    list_distinct(list_filter(regexp_extract_all(lower(min_by(text, turn) FILTER (role = 'assistant')), '[\\p{L}\\p{N}_]+'), lambda w: length(w) >= 4)) AS a FROM conversations GROUP BY conv_id"""


def _pair(t: Tables):
    first = lambda role: F.min_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("turn")))
    both = t("conversations").groupBy("conv_id").agg(first("user").alias("q"), first("assistant").alias("a"))
    return both.select("conv_id", *(F.array_distinct(X.tokens(c, 4)).alias(c) for c in ("q", "a")))


@query("m06_answer_relevancy", f"SELECT conv_id, round(CASE WHEN len(q) > 0 THEN len(list_intersect(q, a)) * 1.0 / len(q) ELSE 0 END, 6) AS relevancy FROM ({_PAIR}) WHERE q IS NOT NULL AND a IS NOT NULL")
def _(t: Tables):
    return _pair(t).where("q IS NOT NULL AND a IS NOT NULL").select("conv_id", F.round(X.overlap_share(F.col("q"), F.col("a")), 6).alias("relevancy"))


@query("m03_faithfulness", f"SELECT conv_id, round(CASE WHEN len(a) = 0 THEN 0.5 ELSE len(list_intersect(a, q)) * 1.0 / len(a) END, 6) AS faithfulness FROM ({_PAIR}) WHERE q IS NOT NULL AND a IS NOT NULL")
def _(t: Tables):
    share = F.when(F.size("a") == 0, F.lit(0.5)).otherwise(X.overlap_share(F.col("a"), F.col("q")))
    return _pair(t).where("q IS NOT NULL AND a IS NOT NULL").select("conv_id", F.round(share, 6).alias("faithfulness"))


@query("m04_context_precision", f"SELECT user_id, round(avg(value / 100), 6) AS precision FROM ({_RANKED}) WHERE rank <= 3 GROUP BY user_id")
def _(t: Tables):
    return _ranked(t, 3).groupBy("user_id").agg(F.round(F.avg(F.col("value") / 100), 6).alias("precision"))


@query("m07_evidence_colour", "SELECT event_id, CASE WHEN value >= 80 THEN 'green' WHEN value >= 40 THEN 'yellow' ELSE 'red' END AS colour FROM events")
def _(t: Tables):
    return t("events").select("event_id", F.when(F.col("value") >= 80, "green").when(F.col("value") >= 40, "yellow").otherwise("red").alias("colour"))


@query("m08_pass_by_intent", "SELECT event_type, count(*) FILTER (CASE event_type WHEN 'purchase' THEN value >= 70 WHEN 'error' THEN value < 30 ELSE value >= 50 END) AS passed, count(*) AS total FROM events GROUP BY event_type")
def _(t: Tables):
    ok = F.when(F.col("event_type") == "purchase", F.col("value") >= 70).when(F.col("event_type") == "error", F.col("value") < 30).otherwise(F.col("value") >= 50)
    return t("events").groupBy("event_type").agg(F.count_if(ok).alias("passed"), F.count("*").alias("total"))


@query("m09_query_metrics", "SELECT user_id, round(max(value) - min(value), 4) AS spread, round(count(*) FILTER (event_type = 'purchase') * 1.0 / count(*), 6) AS hit_rate, bool_or(event_type = 'signup') AS expected FROM events GROUP BY user_id")
def _(t: Tables):
    return t("events").groupBy("user_id").agg(F.round(F.max("value") - F.min("value"), 4).alias("spread"), F.round(F.count_if(F.col("event_type") == "purchase") / F.count("*"), 6).alias("hit_rate"), F.bool_or(F.col("event_type") == "signup").alias("expected"))


@query("m10_ab_by_query", "SELECT user_id, count(*) FILTER (event_type = 'view') AS a, count(*) FILTER (event_type IN ('view', 'click')) AS b, count(*) FILTER (event_type = 'click') AS gained FROM events GROUP BY user_id")
def _(t: Tables):
    one = t("events").where("event_type = 'view'").groupBy("user_id").agg(F.count("*").alias("a"))
    two = t("events").groupBy("user_id").agg(F.count_if(F.col("event_type").isin("view", "click")).alias("b"))
    return two.join(one, "user_id", "left").select("user_id", F.coalesce("a", F.lit(0)).alias("a"), "b", (F.col("b") - F.coalesce("a", F.lit(0))).alias("gained"))


@query("m11_pattern_score", "SELECT doc_id, round((CAST(regexp_matches(text, 'the') AS INT) + CAST(regexp_matches(text, '[.]') AS INT) + CAST(regexp_matches(text, '[A-Z]') AS INT) + CAST(regexp_matches(text, '\\|') AS INT)) / 4.0, 6) AS score FROM documents")
def _(t: Tables):
    return t("documents").select("doc_id", F.round(X.matches("text", ("the", "[.]", "[A-Z]", r"\|")) / 4.0, 6).alias("score"))


@query("m12_safety_score", "SELECT doc_id, greatest(0, 1 - 0.5 * (CAST(regexp_matches(lower(text), 'stupid') AS INT) + CAST(regexp_matches(lower(text), 'trash') AS INT) + CAST(regexp_matches(lower(text), 'idiot') AS INT)))::DOUBLE AS safety FROM documents")
def _(t: Tables):
    return t("documents").select("doc_id", F.greatest(F.lit(0.0), 1 - 0.5 * X.matches(F.lower("text"), ("stupid", "trash", "idiot"))).alias("safety"))


@query("m13_weighted_total", "SELECT user_id, round(0.3 * coalesce(avg(value) FILTER (event_type = 'view'), 0) + 0.3 * coalesce(avg(value) FILTER (event_type = 'click'), 0) + 0.4 * coalesce(avg(value) FILTER (event_type = 'purchase'), 0), 9) AS total FROM events GROUP BY user_id")
def _(t: Tables):
    mean = lambda e: F.coalesce(F.avg(F.when(F.col("event_type") == e, F.col("value"))), F.lit(0.0))
    return t("events").groupBy("user_id").agg(F.round(0.3 * mean("view") + 0.3 * mean("click") + 0.4 * mean("purchase"), 9).alias("total"))
