"""The registered queries of the engine's own operators, with the SQL each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.plans import q_aggregates, q_answers, q_chunks, q_dialogue, q_evaluation, q_fusion, q_guards, q_index, q_inventory, q_more, q_ranking, q_records, q_retrieval, q_scans, q_segments, q_streaming, q_text  # noqa: F401  registers
from lodestone.plans.registry import REGISTRY, bind

FLAGSHIP = "j05_reciprocal_rank_fusion"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal-rank fusion of the ranked lists of every query vector."""
    return queries()[FLAGSHIP](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: bind(f) for name, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
