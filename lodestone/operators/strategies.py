"""Retrieval strategies over batches of queries: fusion steps, staged escalation, intent routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import retrieval as R

#: Step, query variants, k multiplier, least confidence to stop there.
ESCALATION = (("A", 1, 1, 0.55), ("B", 2, 1, 0.50), ("C", 3, 2, 0.45), ("D", 3, 3, 0.0))
#: Intent -> collections of the first pass, of the second pass, and the second pass's budget.
ROUTES = {"law": (("purchase", "signup"), ("view",), 4), "news": (("click",), ("view", "purchase"), 6), "chat": ((), (), 0)}


def routing_table(spark) -> DataFrame:
    """intent, role, collection, pos, budget: the routes as rows."""
    rows = [(i, role, c, p, b) for i, (one, two, b) in ROUTES.items() for role, names in (("primary", one), ("secondary", two)) for p, c in enumerate(names)]
    return spark.createDataFrame(rows, "intent string, role string, collection string, pos int, budget int")


def fusion_step(lists: DataFrame, qid: str, did: str, set_idx: str, rank: str, variants: int, k: int, rrf_k: float = 60.0) -> DataFrame:
    """Fused top k over the first ``variants`` lists of each query."""
    fused = R.reciprocal_rank_fusion(lists.where(F.col(set_idx) < variants), qid, did, set_idx, rank, rrf_k)
    fused = fused.withColumn("score", F.round("rrf_score", 10))  # equal sums in another order stay ties
    return R.top_k(fused, [qid], [F.desc("score"), F.col("first_set"), F.col("first_rank"), F.col(did)], k)


def escalate(lists: DataFrame, qid: str, did: str, set_idx: str, rank: str, k: int, confidence: Column, steps=ESCALATION) -> DataFrame:
    """Each query's result of the first step that is confident enough, with the step's name.

    A step runs for the queries that the one before left over, all of them in
    one plan; there is no loop over queries.
    """
    left, out = lists.select(qid).distinct(), None
    for n, (name, variants, multiplier, least) in enumerate(steps):
        found = fusion_step(lists.join(left, qid, "left_semi"), qid, did, set_idx, rank, variants, k * multiplier)
        sure = found.groupBy(qid).agg(confidence.alias("confidence")).withColumn("step", F.lit(name))
        if n < len(steps) - 1:
            sure = sure.where(F.col("confidence") >= least)
        part = found.join(sure, qid)
        out = part if out is None else out.unionByName(part)
        left = left.join(sure.select(qid), qid, "left_anti")
    return out


def routed(ranked: DataFrame, intents: DataFrame, qid: str, collection: str, score: str, order: str, k: int, tiers: dict[str, int]) -> DataFrame:
    """Two-pass retrieval of each query by its intent's routes; unknown intents find nothing."""
    routes = F.broadcast(routing_table(ranked.sparkSession))  # a few rows
    asked = ranked.join(intents.select(qid, F.col("intent").alias("_intent")), qid)
    both = asked.join(routes, (F.col(collection) == F.col("collection")) & (F.col("_intent") == F.col("intent")))
    return R.two_pass(both.select(*ranked.columns, "role", "budget"), qid, collection, score, order, F.col("role") == "primary", F.col("role") == "secondary", F.col("budget"), k, tiers)
