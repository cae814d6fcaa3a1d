"""Counting, progress and report aggregates.

All are single aggregations with map-side partials; a distribution plus its
total is one ROLLUP, not two passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_by(df: DataFrame, *keys: str, name: str = "n", missing: str | None = None) -> DataFrame:
    """Rows by key; null keys become ``missing`` where given."""
    cols = [F.coalesce(F.col(k), F.lit(missing)).alias(k) if missing is not None else F.col(k) for k in keys]
    return df.groupBy(*cols).agg(F.count("*").alias(name))


def top_counts(df: DataFrame, key: str, limit: int, name: str = "n") -> DataFrame:
    """The most frequent keys; ties by key."""
    return count_by(df, key, name=name).orderBy(F.desc(name), key).limit(limit)


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """part of whole in percent; 0 of nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(part * 100.0 / whole, digits))


def progress(df: DataFrame, status: str, states: dict[str, str], done: str, keys: list[str] | None = None) -> DataFrame:
    """total, a count for each state (name -> value), and percent done."""
    counts = [F.count("*").alias("total"), *(F.count_if(F.col(status) == v).alias(k) for k, v in states.items())]
    out = df.groupBy(*(keys or [])).agg(*counts)
    return out.withColumn("pct", percent(F.col(done), F.col("total")))


def with_total(df: DataFrame, key: str, name: str = "n", total: str = "TOTAL") -> DataFrame:
    """Counts by key and their grand total, in one pass."""
    return df.rollup(key).agg(F.count("*").alias(name), F.grouping(key).alias("_g")).select(F.when(F.col("_g") == 1, F.lit(total)).otherwise(F.col(key)).alias(key), name)


def summary(df: DataFrame, value: str, digits: int = 4) -> DataFrame:
    """count, mean, median and extremes of the values that are there."""
    return df.agg(F.count(value).alias("n"), F.round(F.avg(value), digits).alias("mean"), F.round(F.percentile(value, 0.5), digits).alias("median"), F.min(value).alias("least"), F.max(value).alias("most"))


def element_at_share(df: DataFrame, value: str, share: float, keys: list[str] | None = None) -> DataFrame:
    """By key, the element at index floor(share * n) of the sorted values.

    The rank comes from cumulated counts of equal values, so no group of rows
    is sorted in one task.
    """
    from pyspark.sql import Window

    keys = keys or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*(keys or [F.lit(1)]))
    ranked = counts.withColumn("_upto", F.sum("_c").over(w.orderBy(value))).withColumn("_n", F.sum("_c").over(w))
    at = F.floor(F.col("_n") * share)
    return ranked.where((F.col("_upto") > at) & (F.col("_upto") - F.col("_c") <= at)).select(*keys, F.col(value).alias("at_share"))


def score_statistics(df: DataFrame, key: str, score: str) -> DataFrame:
    """top, mean, population deviation and normalised entropy of scores by key."""
    total = df.groupBy(key).agg(F.sum(score).alias("_s"), F.count("*").alias("n"))
    p = F.col(score) / F.col("_s")
    joined = df.join(total, key)
    return joined.groupBy(key).agg(
        F.max("n").alias("n"), F.max(score).alias("top"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"),
        F.when(F.max("n") > 1, F.sum(-p * F.log(p + F.lit(1e-10))) / F.log(F.max("n").cast("double"))).otherwise(0.0).alias("entropy"),
    )


def run_of_failures(df: DataFrame, key: str, order: list[Column], failed: Column, latest: int = 5, alert: int = 3) -> DataFrame:
    """Length of the failure run among the latest rows by key, and whether it alarms."""
    from pyspark.sql import Window

    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_rn") <= latest)
    first_good = F.min(F.when(~failed, F.col("_rn")))
    run = F.coalesce(first_good - 1, F.max("_rn"))
    return ranked.groupBy(key).agg(run.cast("long").alias("failures")).withColumn("alert", F.col("failures") >= alert)
