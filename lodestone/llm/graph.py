"""Connected components of a link table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import planned_once, tidy
from lodestone.storage import materialize


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node of it) for every node that has a link.

    Each round points every node at the least of itself and its neighbours,
    follows that pointer twice more, and contracts the links; rounds end when no
    link between different nodes is left.  Every step is an aggregation or an
    equi-join, so a node with very many links is pre-aggregated or split.
    """
    pairs = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    edges = materialize(pairs.where("a <> b").distinct(), "edges")
    whole = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    first, rows = True, edges.count()
    while not edges.isEmpty():
        with planned_once(links.sparkSession, rows) as few:
            point, edges = _contracted(edges)
            if first:
                whole, first = point.select(F.col("a").alias("node"), F.col("m").alias("component")), False
            else:
                step = point.select(F.col("a").alias("component"), "m")
                whole = materialize(whole.join(step, "component", "left").select("node", F.coalesce("m", "component").alias("component")), "components")
        if not few:
            tidy(links.sparkSession)
    return whole


def _contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where each node (a) points to (m), and the links between different ends of pointers; both written."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    point = materialize(least, "least")
    for _ in range(2):
        onward = point.select(F.col("a").alias("m"), F.col("m").alias("m2"))
        point = point.join(onward, "m").select("a", F.col("m2").alias("m"))
    point = materialize(point, "point")
    to = lambda c: point.select(F.col("a").alias(c), F.col("m").alias(f"m{c}"))
    return point, materialize(edges.join(to("a"), "a").join(to("b"), "b").select(F.col("ma").alias("a"), F.col("mb").alias("b")).where("a <> b").distinct(), "edges")
