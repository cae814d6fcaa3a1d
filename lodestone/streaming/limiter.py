"""Adaptive request spacing by domain, as keyed state over an event stream.

The spacing of a domain shrinks a little with each success and grows with each
refusal; the state of a domain is its spacing and the time of its last request.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Factors of the spacing after a success, a failure, a refusal.
FACTORS = {"ok": 0.95, "error": 1.2, "refused": 2.0}
LEAST, MOST, START = 0.1, 60.0, 1.0


def next_delay(delay: float, outcome: str) -> float:
    return min(MOST, max(LEAST, delay * FACTORS.get(outcome, 1.0)))


def _after(s: Column, x: Column) -> Column:
    return F.least(s["hi"], F.greatest(s["lo"], s["a"] * x))


def _composed(parts: Column) -> Column:
    """One function for an array of functions (at, first, a, lo, hi), applied in order."""
    of = lambda d: F.struct(d["at"].alias("at"), d["first"].alias("first"), d["a"].alias("a"), d["lo"].alias("lo"), d["hi"].alias("hi"))
    step = lambda d, s: F.struct(d["at"].alias("at"), _after(s, d["first"]).alias("first"), (d["a"] * s["a"]).alias("a"), _after(s, d["lo"]).alias("lo"), _after(s, d["hi"]).alias("hi"))
    return F.aggregate(F.slice(parts, 2, F.size(parts)), of(parts[0]), step)


def slices(requests: DataFrame, key: str = "domain", outcome: str = "outcome", ts: str = "ts", bits: int = 12) -> DataFrame:
    """Each key's requests in time-ordered slices of at most ``2 ** (2 * bits)``, each as one function of the spacing before it.

    A request maps a spacing x to min(hi, max(lo, a x)), and such functions are
    closed under composition.  Ranges of (key, time) deal the rows out and their
    places cut them, so no array has more than ``2 ** bits`` entries however many
    requests a key has.  ``first`` is the spacing after the slice if it is the
    key's first.  Once both bounds have met, what came before no longer matters,
    to the last bit.
    """
    factor = F.coalesce(F.create_map(*(F.lit(v) for kv in FACTORS.items() for v in kv))[F.col(outcome)], F.lit(1.0))
    rows = requests.select(F.col(key).alias("key"), F.col(ts).alias("ts"), "seq", F.col(outcome).alias("outcome"), factor.alias("a"))
    ordered = rows.repartitionByRange("key", "ts", "seq").sortWithinPartitions("key", "ts", "seq", "outcome").select("key", "a", F.monotonically_increasing_id().alias("at"))
    bound = lambda x: F.least(F.lit(MOST), F.greatest(F.lit(LEAST), F.lit(x) * F.col("a")))
    out = ordered.select("key", F.struct("at", bound(START).alias("first"), "a", bound(LEAST).alias("lo"), bound(MOST).alias("hi")).alias("f"), F.lit(1).cast("long").alias("n"))
    for level in (1, 2):
        cut = F.shiftright(F.col("f.at"), level * bits).alias("cut")
        out = out.groupBy("key", cut).agg(F.array_sort(F.collect_list("f")).alias("parts"), F.sum("n").alias("n")).select("key", _composed(F.col("parts")).alias("f"), "n")
    return out.withColumnRenamed("key", key)


def delays(requests: DataFrame, key: str = "domain", outcome: str = "outcome", ts: str = "ts", bits: int = 12) -> DataFrame:
    """Batch form: each key's spacing after its last request, from the few slices of the key in order."""
    found = slices(requests, key, outcome, ts, bits).groupBy(key).agg(F.array_sort(F.collect_list("f")).alias("parts"), F.sum("n").alias("n"))
    return found.select(key, F.round(_composed(F.col("parts"))["first"], 9).alias("delay"), "n")


def delays_stream(requests: DataFrame, key: str = "domain") -> DataFrame:
    """Streaming form: the spacing of each key after every micro-batch."""

    def update(keys: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        delay, n = state.get if state.exists else (START, 0)
        rows = pd.concat(list(parts)).sort_values(["ts", "seq"])
        for outcome in rows["outcome"]:
            delay, n = next_delay(delay, outcome), n + 1
        state.update((delay, n))
        yield pd.DataFrame({key: [keys[0]], "delay": [delay], "n": [n]})

    return requests.groupBy(key).applyInPandasWithState(update, f"{key} string, delay double, n long", "delay double, n long", "update", "NoTimeout")
