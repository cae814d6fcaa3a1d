"""Compound words: splits into two or three dictionary words, and texts and tokens expanded by them.

Split points become rows and the dictionary a semi-join, on distinct words only;
no dictionary is held in a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.storage import materialize

#: Letters that may join two parts.
LINKS = ("s",)


def _halves(df: DataFrame, source: str, left: str, right: str, least: int) -> DataFrame:
    """Every split of ``source`` in two, also with a linking letter dropped from the left part."""
    n = F.length(source)
    points = df.where(n >= 2 * least).withColumn("_i", F.explode(F.sequence(F.lit(least), n - least)))
    cut = points.withColumn("_l", F.expr(f"substring({source}, 1, _i)")).withColumn(right, F.expr(f"substring({source}, _i + 1)"))
    bare = [F.when(F.col("_l").endswith(x) & (F.length("_l") > least), F.expr("substring(_l, 1, _i - 1)")) for x in LINKS]
    return cut.withColumn(left, F.explode(F.array_compact(F.array("_l", *bare)))).drop("_i", "_l")


def split_compounds(words: DataFrame, dictionary: DataFrame, least: int = 3, word: str = "word", entry: str = "entry") -> DataFrame:
    """word, parts and score of the best split of each distinct word that has one.

    The score is the mean length of the parts less half their number and must be
    positive; ties prefer fewer parts, then the longer first part.
    """
    known = lambda df, c: df.join(dictionary.select(F.col(entry).alias(c)).distinct(), c, "left_semi")
    base = words.select(F.col(word).alias("word")).where(F.col(word).isNotNull()).distinct()
    opened = materialize(known(_halves(base, "word", "a", "rest", least), "a"), "opened")  # read twice, and few of all points
    two = known(opened.withColumnRenamed("rest", "b"), "b").select("word", F.array("a", "b").alias("parts"))
    three = known(known(_halves(opened, "rest", "b", "c", least), "b"), "c").select("word", F.array("a", "b", "c").alias("parts"))
    size = F.size("parts")
    score = F.aggregate("parts", F.lit(0), lambda s, p: s + F.length(p)) / size - 0.5 * size
    scored = two.unionByName(three).withColumn("score", score).where("score > 0")
    best = F.max_by(F.struct("parts", "score"), F.struct("score", (-size).alias("n"), F.length(F.col("parts")[0]).alias("l"), F.array_join("parts", " ").alias("t")))
    return scored.groupBy("word").agg(best.alias("b")).select("word", "b.parts", "b.score")


def expanded_tokens(tokens: DataFrame, splits: DataFrame, key: str, token: str = "word", pos: str = "pos") -> DataFrame:
    """Each text's tokens in order, every compound followed by its parts."""
    met = tokens.join(splits.select(F.col("word").alias(token), "parts"), token, "left")
    shown = F.concat(F.array(token), F.coalesce("parts", F.array().cast("array<string>")))
    return met.groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(pos, shown.alias("x")))), lambda s: s.x)).alias("tokens"))
