"""Sinks that may be called twice: batches by id, counts taken by the sink itself, an error log beside the data.

A batch is written into the folder of its id, and replaces what an earlier try
left there; its ledger entry is written last.  A replay therefore adds nothing,
whether it was cut off before or after its data.  Counts come from ``observe``
on the very rows that are written, not from another pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Rows of a file of JSON lines.
FILE_ROWS = 25_000


def write_json_lines(df: DataFrame, path: str, rows: int = FILE_ROWS) -> int:
    """Write ``df`` as JSON lines, at most so many rows a file; the number of rows that were written."""
    seen = Observation()
    df.observe(seen, F.count("*").alias("n")).write.mode("overwrite").option("maxRecordsPerFile", rows).json(path)
    return seen.get["n"]


def append_batch(df: DataFrame, batch: int, path: str, error: str | None = None) -> dict[str, int]:
    """Write one batch under its id: rows without ``error`` to data, the others to errors, then its counts to the ledger."""
    spark = df.sparkSession
    if batch in ledger(spark, path):
        return ledger(spark, path)[batch]
    counts = {}
    parts = {"data": df if error is None else df.where(F.col(error).isNull()).drop(error), "errors": None if error is None else df.where(F.col(error).isNotNull())}
    for name, rows in parts.items():
        if rows is None:
            counts[name] = 0
            continue
        seen = Observation()
        rows.observe(seen, F.count("*").alias("n")).write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS).parquet(f"{path}/{name}/batch={batch}")
        counts[name] = seen.get["n"]
    entry = spark.createDataFrame([(batch, counts["data"], counts["errors"])], _LEDGER).coalesce(1)
    entry.write.mode("overwrite").parquet(f"{path}/ledger/entry={batch}")
    return counts


_LEDGER = "batch long, data long, errors long"


def ledger(spark: SparkSession, path: str) -> dict[int, dict[str, int]]:
    """The counts of every finished batch: a row a batch."""
    return {r["batch"]: {"data": r["data"], "errors": r["errors"]} for r in _read(spark, f"{path}/ledger", _LEDGER).collect()}


def data_of(spark: SparkSession, path: str, schema) -> DataFrame:
    return _read(spark, f"{path}/data", schema)


def errors_of(spark: SparkSession, path: str, schema) -> DataFrame:
    return _read(spark, f"{path}/errors", schema)


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_stream(stream: DataFrame, path: str, checkpoint: str, error: str | None = None) -> StreamingQuery:
    """Every micro-batch through ``append_batch``; started for what is there now."""
    write = stream.writeStream.foreachBatch(lambda df, batch: append_batch(df, batch, path, error) and None)
    return write.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
