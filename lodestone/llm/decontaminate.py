"""Benchmark decontamination: a prefix-filtered join of item windows with document windows.

Method.  An item window (10 consecutive words, or a shorter item whole) is the
set of its shingles (3 consecutive words; fewer if the window is shorter).
A document window contains it only if it has its rarest shingle, so that one
shingle is the necessary prefix.  A first pass counts how often each shingle of
the benchmark stands in the documents; a second looks up prefix shingles,
applies the length and positional bounds (the window must begin and end inside
the document) and verifies the words of the whole window.

The benchmark is the stated query set.  It comes to the tasks in blocks of at
most ``block_bytes`` of text, each a broadcast of bounded size (longer items in
parts); documents are never shuffled, so no hot key gathers anywhere.

Defined results.  Null or empty texts have no words: n_words 0, no hit.  Texts
of any length are taken whole.  A null item_id is never reported but its windows
still mark hits.  Repeated documents each get their row; repeated items count by
distinct id.  Of equally rare shingles the first is the prefix.  A row's own
columns travel as one struct, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import alphanumeric_words, byte_values

WINDOW = 10
SHINGLE = 3


@dataclass(frozen=True)
class ItemBlock:
    """Windows of some items as word ids: ``windows`` of one length each."""

    vocabulary: dict[bytes, int]
    #: (length, windows of that length as rows of ids, for each window its item's index)
    groups: list[tuple[int, np.ndarray, np.ndarray]]
    items: list[str | None]

    def ids(self, words: list[bytes]) -> np.ndarray:
        """Ids from 1; 0 for a word that no item has."""
        return np.fromiter(map(self.vocabulary.get, words, [0] * len(words)), np.int64, len(words))


def build_block(rows: list[tuple[str | None, bytes]], window: int = WINDOW) -> ItemBlock:
    vocabulary: dict[bytes, int] = {}
    found: dict[int, dict[tuple[int, ...], set[int]]] = {}
    items: list[str | None] = []
    for item, text in rows:
        words = alphanumeric_words(text)
        if not words:
            continue
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words]
        size = min(window, len(ids))
        for i in range(len(ids) - size + 1):
            found.setdefault(size, {}).setdefault(tuple(ids[i : i + size]), set()).add(len(items))
        items.append(item)
    groups = []
    for size, windows in sorted(found.items()):
        pairs = [(w, i) for w, owners in windows.items() for i in sorted(owners)]
        groups.append((size, np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)))
    return ItemBlock(vocabulary, groups, items)


def shingle_codes(ids: np.ndarray, size: int) -> np.ndarray:
    """A 62-bit hash of each run of ``size`` ids; -1 where a word is unknown.

    Runs that share a hash cost a comparison: words decide in the end.
    """
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    code, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for i in range(size):
        part = ids[i : i + n]
        code = (code ^ (code >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + part.astype(np.uint64)
        known &= part > 0
    code = (code * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(2)
    return np.where(known, code.astype(np.int64), -1)


def _known_codes(block: ItemBlock, shingle: int) -> dict[int, np.ndarray]:
    """Sorted distinct shingle codes of the windows, by shingle size."""
    out: dict[int, list] = {}
    for size, windows, _ in block.groups:
        k = min(shingle, size)
        codes = [shingle_codes(w, k) for w in windows]
        out.setdefault(k, []).extend(codes)
    return {k: np.unique(np.concatenate(v)) for k, v in out.items()}


def _counts(documents: DataFrame, shared, known, shingle: int) -> dict[int, np.ndarray]:
    """How often each known shingle stands in the documents, aligned with ``known``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        codes = _known_codes(block, shingle)
        totals = {k: np.zeros(len(v), np.int64) for k, v in codes.items()}
        for b in batches:
            for text in byte_values(b.column(0)):
                ids = block.ids(alphanumeric_words(text))
                for k, v in codes.items():
                    have = shingle_codes(ids, k)
                    have = have[have >= 0]
                    at = np.minimum(np.searchsorted(v, have), len(v) - 1)
                    np.add.at(totals[k], at[v[at] == have], 1)
        for k, v in totals.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(v[at])], names=["k", "at", "n"])

    counted = documents.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "k long, at long, n long")
    totals = {k: np.zeros(len(v), np.int64) for k, v in known.items()}
    for r in counted.groupBy("k", "at").agg(F.sum("n").alias("n")).toLocalIterator():
        totals[r["k"]][r["at"]] = r["n"]
    return totals


@dataclass(frozen=True)
class PrefixIndex:
    """For each window length: sorted prefix codes, and the windows they belong to."""

    block: ItemBlock
    #: (window length, shingle size, codes, offset of the prefix in its window, window ids, item index)
    parts: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def prefix_index(block: ItemBlock, counts: dict[int, np.ndarray], shingle: int) -> PrefixIndex:
    known = _known_codes(block, shingle)
    parts = []
    for size, windows, owners in block.groups:
        k = min(shingle, size)
        codes = np.array([shingle_codes(w, k) for w in windows])
        rarity = counts[k][np.searchsorted(known[k], codes)]
        offset = rarity.argmin(axis=1)  # ties: the first
        prefix = codes[np.arange(len(codes)), offset]
        order = np.argsort(prefix, kind="stable")
        parts.append((size, k, prefix[order], offset[order], windows[order], owners[order]))
    return PrefixIndex(block, parts)


def spans_in(words: list[bytes], index: PrefixIndex) -> tuple[list[tuple[int, int]], set[int]]:
    """Word ranges of occurring windows, and the items they belong to."""
    ids = index.block.ids(words)
    starts: list[tuple[int, int]] = []
    items: set[int] = set()
    for size, k, codes, offset, windows, owners in index.parts:
        have = shingle_codes(ids, k)
        at = np.flatnonzero(have >= 0)
        left = np.searchsorted(codes, have[at], "left")
        right = np.searchsorted(codes, have[at], "right")
        hit = right > left
        if not hit.any():
            continue
        at, left, width = at[hit], left[hit], (right - left)[hit]
        position = np.repeat(at, width)
        window = np.repeat(left, width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
        start = position - offset[window]
        inside = (start >= 0) & (start + size <= len(ids))  # positional and length bounds
        start, window = start[inside], window[inside]
        for lo in range(0, len(start), 65536):
            s, w = start[lo : lo + 65536], window[lo : lo + 65536]
            same = (ids[s[:, None] + np.arange(size)] == windows[w]).all(axis=1)
            starts += [(int(x), size) for x in np.unique(s[same])]
            items.update(owners[w[same]].tolist())
    return [(s, s + n) for s, n in starts], items


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _parts(text: bytes, most: int, window: int) -> Iterator[bytes]:
    """A text's words in parts of about ``most`` bytes that overlap by all but one word of a window."""
    if len(text) <= most:
        yield text
        return
    words = alphanumeric_words(text)
    at = 0
    while True:
        end, size = at, 0
        while end < len(words) and (size <= most or end < at + window):
            size += len(words[end]) + 1
            end += 1
        yield b" ".join(words[at:end])
        if end == len(words):
            return
        at = end - window + 1


def item_blocks(benchmark: DataFrame, block_bytes: int = 4 << 20, window: int = WINDOW) -> Iterator[ItemBlock]:
    """The query set in blocks of about ``block_bytes`` of text; a longer item comes in parts, each window in one of them."""
    rows: list[tuple[str | None, bytes]] = []
    size = 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).toLocalIterator():
        for text in _parts((r["t"] or "").encode(), block_bytes, window):
            if rows and size + len(text) > block_bytes:
                yield build_block(rows, window)
                rows, size = [], 0
            rows.append((r["i"], text))
            size += len(text)
    if rows:
        yield build_block(rows, window)


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = 4 << 20) -> DataFrame:
    """own (a struct of the row's columns), n_words, hit_spans (flat word ranges, merged) and hit_items (sorted distinct ids)."""
    spark = documents.sparkSession
    df = documents.select(F.struct("*").alias("own"), F.lit(0).cast("long").alias("n_words"), F.array().cast("array<long>").alias("hit_spans"), F.array().cast("array<string>").alias("hit_items"))
    schema = df.schema

    def step(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value if shared else None
            for b in batches:
                sizes, spans, items = [], [], []
                for text, old, named in zip(byte_values(b.column(0).field("text")), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    words = alphanumeric_words(text)
                    more, found = spans_in(words, index) if index and words else ([], set())
                    sizes.append(len(words))
                    spans.append([x for s in _union([*zip(old[::2], old[1::2], strict=True), *more]) for x in s])
                    items.append(sorted({*named, *(index.block.items[i] for i in found if index.block.items[i] is not None)} if found else named))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], names=schema.names)

        return run

    any_block = False
    for block in item_blocks(benchmark, block_bytes, window):
        if not block.groups:
            continue
        any_block = True
        shared = spark.sparkContext.broadcast(block)  # at most block_bytes of text
        counts = _counts(documents, shared, _known_codes(block, shingle), shingle)
        index = spark.sparkContext.broadcast(prefix_index(block, counts, shingle))
        shared.unpersist()
        df = df.mapInArrow(step(index), schema)
    return df if any_block else df.mapInArrow(step(None), schema)


def contamination_report(documents: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The digest per document that the registered query returns."""
    found = contamination(documents.select("doc_id", F.col("text").cast("string").alias("text")), benchmark, **how)
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda total, x: x - total)  # ends minus starts, as x - (y - total) alternates
    return found.select(
        "own.doc_id", "n_words", hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hit_spans") > 0).alias("contaminated"),
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``documents`` without any hit."""
    found = contamination(documents, benchmark, **how)
    return found.where(F.size("hit_spans") == 0).select("own.*")
