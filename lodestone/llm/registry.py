"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import ballcode, decontaminate, hmm, interaction, jaccard, licences, lines, oracles, packing, quality, substrings, telephony, warc, wrappers
from lodestone.llm.common import bounded_batches
from lodestone.session import table as plain_table

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return plain_table(bounded_batches(spark), sf_dir, name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = telephony.decode_media(telephony.write_media(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return stored.select("own.doc_id", "n_bytes", *(name for name, _, _ in telephony.DIGESTS if name != "pcm"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"))


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removal_report(table(spark, sf_dir, "documents"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing.public_vocabulary())


def op9_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract_articles(table(spark, sf_dir, "pages"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_index(table(spark, sf_dir, "pages"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ballcode.code_report(table(spark, sf_dir, "embeddings"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    found = (op1_quality, op2_telephony, op3_decontaminate, op4_jaccard, op5_licences, op6_suffix, op7_language_model, op8_packing, op9_extraction, op10_warc, op11_filter_audit, op12_vector_codes, op13_line_dedup)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_decontaminate": oracles.DECONTAMINATE, "op4_jaccard": oracles.JACCARD, "op11_filter_audit": oracles.INTERACTION, "op12_vector_codes": oracles.VECTOR_CODES,
        "op13_line_dedup": oracles.LINES,
    }
