"""Bitmaps of a fixed size, filled by Spark: which hashes are frequent, which rows are asked for.

A bitmap only ever says "maybe" or "surely not": values that share a bit cost
work further on, never a result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import byte_values
from lodestone.storage import materialize


def _place(tokens: np.ndarray, bits: int) -> np.ndarray:
    """Bit of each token; rises with the token.  ``bits`` is a power of two."""
    return (tokens >> np.uint64(65 - bits.bit_length())).astype(np.int64)


class Levels:
    """A bitmap of hashes for each frequency level."""

    def __init__(self, maps: list[np.ndarray], bits: int):
        self.maps, self.bits = maps, bits

    def of(self, tokens: np.ndarray) -> np.ndarray:
        """How many of the levels each token reaches."""
        at = _place(tokens, self.bits)
        byte, bit = at >> 3, (at & 7).astype(np.uint8)
        out = (self.maps[0][byte] >> bit) & 1
        some = np.flatnonzero(out)
        for m in self.maps[1:]:
            out[some] += (m[byte[some]] >> bit[some]) & 1
        return out.astype(np.int64)


def bits_for(texts: DataFrame, most: int) -> int:
    """Bits of a bitmap of the texts' tokens: two a byte, a power of two, at most ``most``."""
    size = texts.select(F.sum(F.octet_length(texts.columns[0]).cast("long"))).first()[0] or 0
    return min(most, max(1 << 20, 1 << (2 * size).bit_length()))


def count_levels(texts: DataFrame, tokens_of: Callable, memo: Callable, levels: tuple[int, ...], bits: int) -> Levels:
    """Count 64-bit tokens over all rows and mark those that reach each of ``levels``.

    ``tokens_of(texts of a batch, memo)`` gives tokens, with repeats.  A task
    sends, for each range of token values, one block of its distinct tokens with
    counts, so a frequent token is one entry a batch; a range is merged and
    marked in one pass over its blocks.  An entry holds the 32 bits after the
    range's, so of very many tokens a few share an entry and seem more frequent
    than they are.  ``bits`` are the most; small tables take fewer, so that the
    driver does not gather and hand out bitmaps that are empty.
    """
    spark, bits = texts.sparkSession, bits_for(texts, bits)
    power = min(16, max(6, (16 * int(spark.conf.get("spark.sql.shuffle.partitions"))).bit_length()))
    ranges = 1 << power
    per = bits // ranges

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = memo()
        for b in batches:
            tokens, counts = np.unique(tokens_of(byte_values(b.column(0)), own), return_counts=True)
            if not len(tokens):
                continue
            cut = np.searchsorted(tokens >> np.uint64(64 - power), np.arange(ranges + 1, dtype=np.uint64))
            full = np.flatnonzero(np.diff(cut))
            short = (tokens >> np.uint64(32 - power)).astype(np.uint32)
            counts = np.minimum(counts, 255).astype(np.uint8)
            part = lambda x: pa.array([x[cut[r] : cut[r + 1]].tobytes() for r in full], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(full), part(short), part(counts)], names=["range", "tokens", "counts"])

    def marks(parts: list[tuple[bytes, bytes]]) -> list[bytes]:
        tokens = np.concatenate([np.frombuffer(t, np.uint32) for t, _ in parts])
        counts = np.concatenate([np.frombuffer(c, np.uint8) for _, c in parts])
        order = np.argsort(tokens)
        tokens, counts = tokens[order], counts[order]
        start = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        total = np.add.reduceat(counts.astype(np.int64), start)
        at = (tokens[start] >> np.uint32(33 - per.bit_length())).astype(np.int64)
        out = []
        for least in levels:
            m = np.zeros(per, np.uint8)
            m[at[total >= least]] = 1
            out.append(np.packbits(m, bitorder="little").tobytes())
        return out

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts = None, []
        rows: list[tuple[int, list[bytes]]] = []
        for b in batches:
            for r, t, c in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                if r != held and parts:
                    rows.append((held, marks(parts)))
                    parts = []
                held = r
                parts.append((t.as_py(), c.as_py()))
        if parts:
            rows.append((held, marks(parts)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows]), *(pa.array([m[i] for _, m in rows], pa.binary()) for i in range(len(levels)))], names=["range", *(f"m{i}" for i in range(len(levels)))])

    shape = "range long, " + ", ".join(f"m{i} binary" for i in range(len(levels)))
    maps = [np.zeros(bits // 8, np.uint8) for _ in levels]
    sent = texts.mapInArrow(blocks, "range long, tokens binary, counts binary")
    marked = materialize(sent.repartition("range").sortWithinPartitions("range").mapInArrow(merge, shape), "levels")
    for row in marked.toLocalIterator():  # a part of the bits at a time, from few files' partitions
        for i, m in enumerate(maps):
            m[row["range"] * per // 8 : (row["range"] + 1) * per // 8] = np.frombuffer(row[f"m{i}"], np.uint8)
    return Levels(maps, bits)


def row_bitmap(rows: DataFrame, most_bits: int = 1 << 27, column: str = "row") -> np.ndarray:
    """Marks of the 64-bit row hashes in ``rows``, a written table; sixteen bits a row, ``most_bits`` in all."""
    bits = min(most_bits, max(1 << 15, 1 << (16 * rows.count()).bit_length()))
    place = rows.select((F.pmod(column, F.lit(bits)) + 1).alias("p"))  # Spark's bitmap functions count from 1
    maps = place.groupBy(F.expr("bitmap_bucket_number(p)").alias("g")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("m"))
    out = np.zeros(bits // 8, np.uint8)
    for r in maps.collect():  # ``bits`` bits
        out[(r["g"] - 1) * 4096 : r["g"] * 4096] = np.frombuffer(r["m"], np.uint8)
    return out


def in_bitmap(bitmap: np.ndarray, rows: np.ndarray) -> np.ndarray:
    at = np.mod(rows, len(bitmap) * 8)
    return ((bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
