"""Audit of five filters over all their orders, by difference arrays over Lehmer ranks.

Method.  A document is the mask of the filters it fails; documents are counted
by part and mask alone.  Orders stand in lexicographic order, so all orders that
begin with the same filters are one interval of ranks.  A mask is removed at
step s by filter f in exactly the orders that begin with s - 1 filters outside
the mask and then f: for each mask a fixed list of intervals.  Its counts are
added where an interval begins and taken off behind its end, a prefix sum over
the ranks gives what each order removes at each step, and the totals follow.

Only a small row a document is shuffled: once for the least id of equal texts
(combined before the shuffle), once to meet it (a join that Spark may split),
once for its labels; then masks are counted where they lie.  What follows has
fixed size a part: 32 masks, 120 orders, 5 steps.

Defined results.  Null and empty texts are equal, have no words and fail A
alone, unless copied.  Null and empty lang are one part.  Of equal texts all but
those of the smallest id fail E; null ids come after all others.  Rows of one id
and text are ties: both are smallest or neither is.  A document's label is 1 if
any of its label rows says so; null ids have no labels.  Texts are read whole.
An empty table has no parts, so no rows.  Further columns are not read.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.storage import materialize

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MEASURES = ("n", "good", "toxic")
BLANKS = r"[\x20\x09-\x0D]+"


def failures(text: Column) -> Column:
    """The mask of the conditions A to D that a text fails: bit 0 is A."""
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    size, different = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    capitals, points = F.length(F.regexp_replace(text, "[^A-Z]", "")).cast("long"), F.length(text).cast("long")
    fails = (size < 200, 100 * different < 50 * size, 100 * capitals > 3 * points, text.rlike(r"[#$%&*|]"))
    return sum((fail.cast("int") * (1 << i) for i, fail in enumerate(fails)), F.lit(0))


def lehmer_rank(order: str) -> int:
    """An order's place among all orders: its Lehmer code read in the factorial number system."""
    code = [sum(x < f for x in order[i + 1 :]) for i, f in enumerate(order)]
    return sum(c * math.factorial(len(order) - 1 - i) for i, c in enumerate(code))


def removal_intervals(mask: int, filters: str = FILTERS) -> list[tuple[int, int, int]]:
    """(step, first rank, rank behind the last) of the orders that remove a mask at that step."""
    failing = [f for i, f in enumerate(filters) if mask >> i & 1]
    passing = [f for f in filters if f not in failing]
    found = []
    for step in range(1, len(passing) + 2):
        for before in permutations(passing, step - 1):
            for f in failing:
                begin = [*before, f]
                low = lehmer_rank("".join(begin + [x for x in filters if x not in begin]))
                found.append((step, low, low + math.factorial(len(filters) - step)))
    return found


def masks_of(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, and how many documents have it: all, those of quality 1 and those of toxic 1."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("doc_id", "part", failures(F.col("text")).alias("mask"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    least = rows.groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least")).where("copies > 1")
    least = materialize(least, "copies")  # written, so that nothing but exchanges stands under the join
    fails_e = F.coalesce(F.col("least").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("least")), F.lit(False))
    marked = rows.join(least, ["h1", "h2"], "left").select("doc_id", "part", (F.col("mask") + fails_e.cast("int") * 16).alias("mask"))
    known = labels.groupBy("doc_id").agg(*(F.max((F.col(c) == 1).cast("int")).alias(k) for c, k in (("quality", "good"), ("toxic", "toxic"))))
    labelled = marked.join(known, "doc_id", "left")
    return labelled.groupBy("part", "mask").agg(F.count("*").alias("n"), *(F.sum(F.coalesce(k, F.lit(0))).alias(k) for k in ("good", "toxic")))


def removals(masks: DataFrame) -> DataFrame:
    """part, step, rank and what is removed there (all, good, toxic), for every order and step, zeros included."""
    spark = masks.sparkSession
    ends = [(m, s, at, sign) for m in range(1, 1 << len(FILTERS)) for s, low, high in removal_intervals(m) for at, sign in ((low, 1), (high, -1))]
    fixed = F.broadcast(spark.createDataFrame(ends, "mask int, step int, rank int, sign long"))
    points = masks.join(fixed, "mask").select("part", "step", "rank", *((F.col("sign") * F.col(m)).alias(m) for m in MEASURES))
    steps, ranks = F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))), F.explode(F.sequence(F.lit(0), F.lit(len(ORDERS) - 1)))
    zeros = masks.select("part").distinct().select("part", steps.alias("step")).select("part", "step", ranks.alias("rank"), *(F.lit(0).cast("long").alias(m) for m in MEASURES))
    differences = points.unionByName(zeros).groupBy("part", "step", "rank").agg(*(F.sum(m).alias(m) for m in MEASURES))
    up_to = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return differences.select("part", "step", "rank", *(F.sum(m).over(up_to).alias(m) for m in MEASURES)).where(F.col("rank") < len(ORDERS))


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley."""
    masks = materialize(masks_of(documents, labels), "masks")
    orders = F.array(*map(F.lit, ORDERS))
    steps = removals(masks).select("part", orders[F.col("rank")].alias("filter_order"), "step", F.col("n").alias("removed"), F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"))
    steps = steps.withColumn("f", F.substr(F.col("filter_order"), F.col("step"), F.lit(1)))
    so_far = Window.partitionBy("part", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.lit(1 << i).alias("bit")) for i, f in enumerate(FILTERS))))
    fails = masks.withColumn("all", F.sum("n").over(Window.partitionBy("part"))).select("part", "all", "mask", "n", each.alias("e")).select("part", "all", "mask", "n", "e.f", "e.bit")
    alone, has = F.col("mask") == F.col("bit"), F.col("mask").bitwiseAND(F.col("bit")) != 0
    count = lambda test: F.sum(F.when(test, F.col("n")).otherwise(F.lit(0)))
    by_filter = fails.groupBy("part", "f").agg(F.max("all").alias("all"), count(has).alias("failing"), count(alone).alias("unique_fails"))
    worth = Window.partitionBy("part", "f")
    out = steps.withColumn("gone", F.sum("removed").over(so_far)).withColumn("shapley", F.sum("removed").over(worth)).join(by_filter, ["part", "f"])
    return out.select("part", "filter_order", "step", (F.col("all") - F.col("gone")).alias("kept"), "removed", (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")
