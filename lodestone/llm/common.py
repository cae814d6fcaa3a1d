"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: ASCII A-Z to a-z, every other byte as it is.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: As LOWER; bytes that are neither ASCII letters or digits nor above 0x7F become blanks.
WORDS = bytes(b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
UPPER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MASK64 = (1 << 64) - 1


#: Rows of an Arrow batch.  Texts are long, so Spark's default of 10,000 makes batches of tens of MB.
BATCH_ROWS = 2000


def bounded_batches(spark: SparkSession) -> SparkSession:
    """The session, its Arrow batches at most ``BATCH_ROWS`` rows; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    return spark


def joined_by_shuffle(spark: SparkSession) -> SparkSession:
    """The session, without joins that Spark itself turns into broadcasts: each of them passes through the driver and stays there for a while."""
    for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(key, "-1")
    return spark


#: Up to so many rows and shuffle partitions, a step of small joins is planned once.
PLANNED_ROWS, PLANNED_PARTITIONS = 1_000_000, 64


@contextmanager
def planned_once(spark: SparkSession, rows: int) -> Iterator[bool]:
    """Within it, steps over few rows are planned once and joined by shuffles: one job each; says whether that holds.

    Adaptive plans are made anew after every stage, each stage a job and a
    thread of the driver.  A long run of small joins gains nothing by that and
    leaves the driver with hundreds of threads.
    """
    wanted = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    few = rows <= PLANNED_ROWS and int(spark.conf.get("spark.sql.shuffle.partitions")) <= PLANNED_PARTITIONS
    before = {key: spark.conf.get(key) for key in wanted}
    try:
        for key, value in wanted.items() if few else ():
            spark.conf.set(key, value)
        yield few
    finally:
        for key, value in before.items() if few else ():
            spark.conf.set(key, value)


def tidy(spark: SparkSession) -> None:
    """Let the driver collect what finished steps have left.

    Spark removes their broadcasts and shuffle files only after such a
    collection, which a long run of small plans may not bring about by itself.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def crc_of_id(column: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def byte_values(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of a string column, null as empty, one value at a time."""
    for x in column.cast(pa.binary()) if pa.types.is_string(column.type) else column.cast(pa.large_binary()):
        yield x.as_py() or b""


def alphanumeric_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return text.translate(WORDS).split()


def blank_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z."""
    return text.translate(LOWER).split()
