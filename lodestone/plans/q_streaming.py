"""Queries of windows and keyed state."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.plans.registry import Tables, query
from lodestone.streaming import limiter, metrics, queue_machine

_NOW = "(SELECT max(ts) FROM events)"


@query("k02_trailing_windows", " UNION ALL ".join(f"SELECT '{name}' AS span, count(*) AS total, count(*) FILTER (event_type = 'error') AS refusals FROM events WHERE ts >= {_NOW} - INTERVAL {n} SECOND" for name, n in (("hour", 3600), ("day", 86400), ("week", 604800))))
def _(t: Tables):
    parts = [metrics.rates(metrics.trailing(t("events"), n)).select(F.lit(name).alias("span"), "total", "refusals") for name, n in (("hour", 3600), ("day", 86400), ("week", 604800))]
    return parts[0].union(parts[1]).union(parts[2])


@query("k02b_sliding_window", "SELECT s AS starts, s + INTERVAL 1 DAY AS ends, count(*) AS total, count(*) FILTER (event_type = 'error') AS refusals, round(sum(value), 4) AS value FROM (SELECT *, unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS s FROM events) GROUP BY s")
def _(t: Tables):
    return metrics.windowed(t("events"), "1 day", "12 hours")


@query("k03_last_events", "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 10000")
def _(t: Tables):
    return t("events").orderBy(F.desc("ts"), F.desc("event_id")).limit(10000).select("event_id", "ts", "event_type")


@query("k04_lifetime_counters", "SELECT count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors, count(DISTINCT user_id) AS users, round(sum(value), 2) AS value FROM events")
def _(t: Tables):
    return t("events").agg(F.count("*").alias("requests"), F.count_if(F.col("event_type") == "error").alias("errors"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 2).alias("value"))


_OUTCOME = "CASE event_type WHEN 'error' THEN 'refused' WHEN 'view' THEN 'error' ELSE 'ok' END"


@query(
    "k05_adaptive_delay",
    f"""WITH o AS (SELECT CAST(user_id AS VARCHAR) AS domain, list({_OUTCOME} ORDER BY ts, event_id) AS seen FROM events GROUP BY 1)
    SELECT domain, round(list_reduce(list_prepend(1.0::DOUBLE, list_transform(seen, lambda x: CASE x WHEN 'ok' THEN 0.95::DOUBLE WHEN 'error' THEN 1.2::DOUBLE ELSE 2.0::DOUBLE END)), lambda d, f: least(60.0::DOUBLE, greatest(0.1::DOUBLE, d * f))), 9) AS delay, CAST(len(seen) AS BIGINT) AS n FROM o""",
)
def _(t: Tables):
    outcome = F.when(F.col("event_type") == "error", "refused").when(F.col("event_type") == "view", "error").otherwise("ok")
    return limiter.delays(t("events").select(F.col("user_id").cast("string").alias("domain"), "ts", F.col("event_id").alias("seq"), outcome.alias("outcome")))


@query("k07_queue_state", "SELECT event_type, count(*) AS n FROM (SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1) GROUP BY event_type")
def _(t: Tables):
    from lodestone.operators.inventory import latest_state

    return latest_state(t("events"), "user_id", "event_type", [F.col("ts"), F.col("event_id")]).groupBy("event_type").agg(F.count("*").alias("n"))


@query("k20_tumbling_window", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS starts, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS ends, count(*) AS total, count(*) FILTER (event_type = 'error') AS refusals, round(sum(value), 4) AS value FROM events GROUP BY 1")
def _(t: Tables):
    return metrics.windowed(t("events"), "1 hour")


@query(
    "k21_session_window",
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
    SELECT user_id, min(ts) AS starts, max(ts) + INTERVAL 6 HOUR AS ends, count(*) AS n, round(sum(value), 4) AS value FROM s GROUP BY user_id, k""",
)
def _(t: Tables):
    return metrics.sessions(t("events"), "6 hours")


_EVENT = "CASE event_type WHEN 'view' THEN 'enqueue' WHEN 'signup' THEN 'enqueue' WHEN 'click' THEN 'trigger' WHEN 'purchase' THEN 'embed' ELSE 'fail' END"
_STEP = """CASE WHEN s = 'none0' AND e = 'enqueue' THEN 'pending0' WHEN starts_with(s, 'pending') AND e = 'trigger' THEN 'triggered' || substr(s, 8) WHEN starts_with(s, 'triggered') AND e = 'embed' THEN 'embedded' || substr(s, 10)
    WHEN s IN ('triggered0', 'triggered1') AND e = 'fail' THEN 'pending' || (CAST(substr(s, 10) AS INT) + 1) WHEN s = 'triggered2' AND e = 'fail' THEN 'failed3' ELSE s END"""


@query(
    "k07b_queue_machine",
    f"""WITH o AS (SELECT CAST(event_id % 500 AS VARCHAR) AS item, list({_EVENT} ORDER BY ts, event_id) AS seen FROM events GROUP BY 1),
    f AS (SELECT item, len(seen) AS n, list_reduce(list_prepend('none0', seen), lambda s, e: {_STEP}) AS last FROM o)
    SELECT item, regexp_replace(last, '[0-9]', '') AS status, CAST(regexp_extract(last, '[0-9]') AS INT) AS failures, n AS events FROM f""",
)
def _(t: Tables):
    """Items of an event log in their last state; the stream of the same log ends alike (tests)."""
    kind = F.when(F.col("event_type").isin("view", "signup"), "enqueue").when(F.col("event_type") == "click", "trigger").when(F.col("event_type") == "purchase", "embed").otherwise("fail")
    log = t("events").select((F.col("event_id") % 500).cast("string").alias("item"), "ts", F.col("event_id").alias("seq"), kind.alias("event"))
    return queue_machine.final_states(log, "item", "ts", "seq", "event")
