"""Inventory, queue and change-tracking dataflows.

A mutable row of a state store becomes an append-only log with a latest-state
view; insert-if-absent becomes an anti-join; so every step is a plan that
restarts from its inputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def missing_from(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``source`` whose key is not in ``target``."""
    return source.join(target.select(*keys).distinct(), keys, "left_anti")


def present_in(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    return source.join(target.select(*keys).distinct(), keys, "left_semi")


def first_of_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first by ``order``.  An aggregate, so it combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def insert_or_ignore(existing: DataFrame, incoming: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The rows that an insert-or-ignore adds: absent keys, first of each."""
    return first_of_key(missing_from(incoming, existing, [key]), [key], order)


def insert_or_replace(existing: DataFrame, incoming: DataFrame, keys: list[str], version: Column) -> DataFrame:
    """The table after insert-or-replace: the latest version of each key, new rows over old."""
    both = existing.withColumn("_v", F.lit(0)).unionByName(incoming.withColumn("_v", F.lit(1)))
    rest = [c for c in existing.columns if c not in keys]
    picked = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col("_v"), version.alias("_o"))).alias("_r"))
    return picked.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def latest_state(log: DataFrame, key: str, state: str, order: list[Column]) -> DataFrame:
    """The current state of each key of an append-only log."""
    return log.groupBy(key).agg(F.max_by(state, F.struct(*order)).alias(state))


def changes(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """key, change (new, changed, unchanged, missing) from two versions' digests."""
    o = old.select(key, F.col(digest).alias("_o"), F.lit(True).alias("_io"))
    n = new.select(key, F.col(digest).alias("_n"), F.lit(True).alias("_in"))
    kind = F.when(F.col("_io").isNull(), "new").when(F.col("_in").isNull(), "missing").when(F.col("_o").eqNullSafe(F.col("_n")), "unchanged").otherwise("changed")
    return o.join(n, key, "full_outer").select(key, kind.alias("change"))


def migration_status(old: DataFrame, new: DataFrame, key: str, group: str) -> DataFrame:
    """By group: rows in the old and new store, remaining, percent."""
    o, n = old.groupBy(group).agg(F.count("*").alias("old_n")), new.groupBy(group).agg(F.count("*").alias("new_n"))
    both = o.join(n, group, "left").withColumn("new_n", F.coalesce("new_n", F.lit(0)))
    return both.select(group, "old_n", "new_n", (F.col("old_n") - F.col("new_n")).alias("remaining"), F.round(F.col("new_n") * 100.0 / F.col("old_n"), 2).alias("pct"))


def rows_between(df: DataFrame, order: list[Column], first: int, last: int) -> DataFrame:
    """The rows numbered first..last (from 1) in ``order``: a worker's share of a task list."""
    # a top-k of the needed prefix first, so only that prefix is numbered in one place
    head = df.orderBy(*order).limit(last)
    return head.withColumn("_rn", F.row_number().over(Window.orderBy(*order))).where(F.col("_rn").between(first, last)).drop("_rn")


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)
