"""Written intermediate tables in the folder that driver and executors share.

A written table cuts the lineage: when an executor is lost, its readers start
from the files instead of recomputing (or losing) what that executor held.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch, and list members of a part of one that a task works on at a time.
BATCH_ROWS, PART_MEMBERS = 1000, 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; set to a new folder only where it is unset and driver and tasks share one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/lodestone-{uuid.uuid4().hex}/{tag}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, its session's Arrow batches at most ``BATCH_ROWS`` rows, so that a task of Python never holds thousands of long texts; a smaller setting stays."""
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def parts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about ``PART_MEMBERS`` members of a list column, one row at least."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(b.column(column)), 0).to_numpy().astype(np.int64)) // PART_MEMBERS
        cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(b)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo < hi:
                yield b.slice(lo, hi - lo)
