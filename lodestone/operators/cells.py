"""Approximate nearest neighbours by inverted-file cells: every row in a cell, several cells probed, exact re-rank.

Centres are fitted by k-means on a bounded sample: the ``sample`` rows of the
smallest hashed ids, whatever the table's size.  Every row is then put into the
cell of its nearest centre, and the table is written in ranges of (cell, hashed
id), so that a crowded cell lies in many files.  A query looks into its
``probes`` nearest cells only; distances there are those of the exact search,
so a found neighbour has its true distance and order.

How many cells a query must probe depends on the data: where vectors have no
clusters, most of them.  ``fit`` therefore asks the sample: some hundred of its
rows are looked up among all of it, and the fewest probes that find the wanted
share of the true neighbours are kept with the centres.

Queries travel in blocks of bounded bytes with the cells that they probe; cells
that no query of a block probes are pruned by the files' ranges.  A task keeps
its k best of every query (and group) before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.retrieval import _query_blocks, top_k
from lodestone.storage import materialize

#: Rows that centres are fitted on, at most.
SAMPLE_ROWS = 20_000
#: Cells for n rows: about sqrt(n), at most this many.
MOST_CELLS = 4096


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between all rows of a and b, summed by dimension from differences."""
    d = np.zeros((len(a), len(b)))
    for x, y in zip(a.T, b.T, strict=True):
        d += (x[:, None] - y[None, :]) ** 2
    return d


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    step = max(1, (1 << 21) // len(centres))
    return np.concatenate([squared_distances(x[i : i + step], centres).argmin(axis=1) for i in range(0, len(x), step)]) if len(x) else np.zeros(0, np.int64)


@dataclass(frozen=True)
class Cells:
    """Centres, and how many of the nearest ones a query probes."""

    centres: np.ndarray
    probes: int


def fit(vectors: DataFrame, vec: str = "embedding", vid: str = "vec_id", cells: int | None = None, sample: int = SAMPLE_ROWS, rounds: int = 12, k: int = 10, recall: float = 0.95, asked: int = 256) -> Cells:
    """Centres of k-means on at most ``sample`` rows, and the probes that reach ``recall`` of the k nearest for ``asked`` of them; the same for the same table."""
    rows = vectors.where(F.col(vec).isNotNull() & F.col(vid).isNotNull())
    n = rows.count()
    if not n:
        return Cells(np.zeros((0, 0)), 1)
    held = rows.select(F.xxhash64(vid).alias("h"), vid, vec).orderBy("h", vid).limit(sample).toArrow()  # at most ``sample`` rows
    x = held.column(vec).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(held), -1)
    different = np.unique(x, axis=0)
    c = min(len(different), cells or max(1, min(MOST_CELLS, round(n**0.5))))
    centres = different[np.random.default_rng(0).permutation(len(different))[:c]]
    for _ in range(rounds):
        at = nearest_centre(x, centres)
        count = np.bincount(at, minlength=c)
        sums = np.stack([np.bincount(at, weights=v, minlength=c) for v in x.T], axis=1)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return Cells(centres, fewest_probes(x, centres, k, recall, asked))


def fewest_probes(x: np.ndarray, centres: np.ndarray, k: int, recall: float, asked: int) -> int:
    """Probes that find the wanted share of the k nearest rows of the first ``asked`` rows, among all of x."""
    q, at = x[:asked], nearest_centre(x, centres)
    order = np.argsort(squared_distances(q, centres), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centres))[None, :], axis=1)
    true = np.stack([np.argsort(squared_distances(row[None], x)[0], kind="stable")[:k] for row in q])
    needed = np.sort(np.take_along_axis(place, at[true], axis=1).ravel())  # in which probe each true neighbour is met
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1


def in_cells(vectors: DataFrame, cells: Cells, vec: str = "embedding", vid: str = "vec_id", keep: list[str] | None = None) -> DataFrame:
    """Every row with its cell, written in ranges of (cell, hashed id)."""
    centres = cells.centres
    lean = vectors.where(F.col(vec).isNotNull() & F.col(vid).isNotNull()).select(F.col(vid).cast("long").alias(vid), vec, *(keep or []))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lean.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(b), -1)
            at = nearest_centre(x, centres) if len(b) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32())], names=[*b.schema.names, "cell"])

    placed = lean.mapInArrow(run, f"{kinds}, cell int")
    return materialize(placed.repartitionByRange("cell", F.xxhash64(vid)).sortWithinPartitions("cell"), "cells")


def nearest_in_cells(placed: DataFrame, cells: Cells, queries: DataFrame, k: int, probes: int | None = None, vec: str = "embedding", vid: str = "vec_id", qid: str = "query_id", qvec: str = "query", group: str | None = None, block_bytes: int = 16 << 20) -> DataFrame:
    """The k nearest rows of each query (and group) among its nearest cells, ranked from 1; ties to the smaller id."""
    centres, probes = cells.centres, probes or cells.probes
    spark = placed.sparkSession
    lean = placed.select(vid, vec, "cell", *([group] if group else []))
    more = f", {group} {dict(lean.dtypes)[group]}" if group else ""
    shape = f"{qid} long, {vid} long, distance double{more}"

    def search(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q, asking = shared.value
            best = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.float64, np.int64))  # query, group, distance, id
            codes: dict = {}
            for b in batches:
                cell = b.column(2).to_numpy()
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(b), -1)
                own = b.column(0).to_numpy()
                of = np.array([codes.setdefault(v, len(codes)) for v in b.column(3).to_pylist()], np.int64) if group else np.zeros(len(b), np.int64)
                for c in np.unique(cell).tolist():
                    who = asking.get(c)
                    if who is None:
                        continue
                    rows = np.flatnonzero(cell == c)
                    step = max(1, (1 << 21) // len(who))
                    for at in np.split(rows, range(step, len(rows), step)):
                        d = squared_distances(q[who], x[at])
                        new = np.repeat(who, len(at)), np.tile(of[at], len(who)), d.reshape(-1), np.tile(own[at], len(who))
                        best = tuple(np.concatenate(p) for p in zip(best, new, strict=True))
                        order = np.lexsort((best[3], best[2], best[1], best[0]))
                        key = best[0][order] * (len(codes) + 1) + best[1][order]
                        order = order[np.arange(len(order)) - np.searchsorted(key, key, "left") < k]
                        best = tuple(p[order] for p in best)
            columns = [pa.array(ids[best[0]]), pa.array(best[3]), pa.array(best[2])]
            if group:
                columns.append(pa.array([list(codes)[i] for i in best[1].tolist()] if codes else [], lean_type))
            yield pa.RecordBatch.from_arrays(columns, names=[qid, vid, "distance", *([group] if group else [])])

        return run

    lean_type = lean.select(group).limit(0).toArrow().schema.field(0).type if group else None
    out = None
    for ids, q in _query_blocks(queries.select(F.col(qid).cast("long").alias(qid), qvec), qid, qvec, block_bytes):
        near = np.argsort(squared_distances(q, centres), axis=1, kind="stable")[:, :probes]
        asking = {int(c): np.flatnonzero((near == c).any(axis=1)) for c in np.unique(near)}
        part = lean.where(F.col("cell").isin(sorted(asking))).mapInArrow(search(spark.sparkContext.broadcast((ids, q, asking))), shape)  # at most block_bytes
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], shape)
    return top_k(out, [qid, *([group] if group else [])], [F.col("distance"), F.col(vid)], k)
