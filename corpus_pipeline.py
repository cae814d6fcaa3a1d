"""Training-corpus pipeline over the ``documents`` table: five stages, each written and reread.

Stages, in order: quality classifier (rejected documents go), n-gram Jaccard
join (one document of each group of near copies stays), suffix-array dedup
(repeated passages are cut), benchmark decontamination (documents with a
benchmark window go), best-fit packing (the kept documents become sequences).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontaminate, jaccard, packing, quality, substrings
from lodestone.llm.common import bounded_batches, joined_by_shuffle, tidy
from lodestone.session import table
from lodestone.storage import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    joined_by_shuffle(bounded_batches(spark))
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    joined_by_shuffle(bounded_batches(spark))
    return jaccard.keep_one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    joined_by_shuffle(bounded_batches(spark))
    return substrings.deduplicated(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    joined_by_shuffle(bounded_batches(spark))
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    joined_by_shuffle(bounded_batches(spark))
    return packing.pack(docs, packing.public_vocabulary())


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("jaccard", keep_distinct),
    ("substrings", cut_repeats),
    ("decontamination", drop_benchmark),
    ("packing", pack_sequences),
]

#: The stages are learned, iterative and tokenising: SQL can't express them.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        tidy(spark)
    return docs
