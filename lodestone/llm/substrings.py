"""Exact repeated-substring removal over a blockwise, cover-ranked suffix order.

Contract.  Every byte that lies in a ``length``-byte string which also starts
anywhere else (same document included) is removed; matches never cross
documents and are judged on the input as it is.

Method.  Suffixes of all documents fall into buckets: the bucket of a window
(the first ``length`` bytes of a suffix) is the hash of its least 50-byte gram,
leftmost if tied, so equal windows share their bucket and their offset from that
gram.  A first pass counts grams; only buckets with two or more entries are
dealt out.  A bucket's entry is a segment: the windows of one document that
have the same gram.  Equal segments are counted, not kept twice.

A task takes one bucket after the other, in blocks of bounded size, and sorts
their suffixes by their first ``length`` bytes.  The grams are laid on multiples
of 8, so windows that can be equal have equal residues, and of a difference
cover of period 8 the one residue 0 is enough: it is at the same distance from
both.  Ranks of 128-byte strings at the sample come from prefix doubling (8, 16,
... 128 bytes); a window is the few bytes before its first sample, two sample
ranks and the few bytes after them, however long the tie.  A bucket with more
than ``bucket_limit`` different segments is dealt out again by its windows'
whole content, so no bucket must fit a task.

Results return to documents by chains: neighbouring segments that stand in
several places are named by one key, cut where their content says so, so a
passage or a whole text with many copies costs each copy a few rows, and its
segments are looked up once.

Defined results.  Null and empty texts, and texts under ``length`` bytes, keep
all bytes.  Repeated rows repeat every window of theirs, so texts of at least
``length`` bytes go whole.  Kept bytes may begin or end inside a character;
``deduplicated`` drops such broken characters from its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import byte_values, tidy
from lodestone.llm.sketch import count_levels, in_bitmap, row_bitmap
from lodestone.storage import materialize

GRAM = 50
#: Bytes whose windows are found at once; longer texts go piece by piece.
PIECE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.array([xxhash.xxh3_64_intdigest(bytes([i])) for i in range(256)], np.uint64)


class Powers:
    """Powers of the base and of its inverse, grown as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            size = max(n, 1 << 16)
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, x, np.uint64)])) for x in (_BASE, inverse))
        return self.up[:n], self.down[:n]


def gram_hashes(data: np.ndarray, powers: Powers, gram: int) -> np.ndarray:
    """A hash of every gram, from differences of one running sum."""
    up, down = powers.of(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=total[1:])
    h = (total[gram:] - total[:-gram]) * down[: len(data) - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def window_grams(text: bytes, powers: Powers, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with the same least gram: hash, place of the gram, first window, last window."""
    width = length - gram + 1
    out: list[tuple[np.ndarray, ...]] = []
    for lo in range(0, max(0, len(text) - length + 1), PIECE):
        data = np.frombuffer(text, np.uint8, min(PIECE + length - 1, len(text) - lo), lo)
        h = gram_hashes(data, powers, gram)
        low = np.uint64((1 << 21) - 1)
        key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        least, span = key, 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        place = (least & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.concatenate([first[1:], [len(place)]]) - 1
        at = place[first]
        out.append((h[at], at + lo, first + lo, last + lo))
    if not out:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))  # type: ignore[return-value]


def cover_ranks(buffer: np.ndarray) -> np.ndarray:
    """Ranks, in the order of bytes, of the 128-byte strings at every 8th place of ``buffer``, by prefix doubling."""
    rank = np.unique(buffer.view(">u8").astype(np.uint64), return_inverse=True)[1].astype(np.uint64)
    span = 1
    while span < 16:
        after = np.zeros(len(rank), np.uint64)
        after[:-span] = rank[span:]
        rank = np.unique((rank << np.uint64(32)) | after, return_inverse=True)[1].astype(np.uint64)
        span *= 2
    return rank


def window_order(segments: list[bytes], lead: np.ndarray, windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows of all segments in suffix order, by residue of their place, and whether each equals the one before.

    lead: the gram's place in its segment.  windows: how many a segment has.
    """
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    before = 8 + (-lead) % 8
    total = before + sizes + 8
    total += -total % 8
    base = np.concatenate([[0], np.cumsum(total)[:-1]])
    buffer = np.zeros(int(total.sum()) + 160, np.uint8)
    start = base + before
    for s, seg in zip(start.tolist(), segments, strict=True):
        buffer[s : s + len(seg)] = np.frombuffer(seg, np.uint8)
    ranks, words = cover_ranks(buffer), buffer.view(">u8").astype(np.uint64)
    at = np.repeat(start, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    head = (-at) % 8
    sample = (at + head) // 8
    covered = (length // 8 - 1) * 8
    if not 128 <= covered <= 256:
        raise ValueError("length must be between 136 and 271 bytes")
    # bytes before the first sample, as a number that keeps their order
    upper = np.where(head > 0, words[sample - 1] & ((np.uint64(1) << (head * 8).astype(np.uint64)) - np.uint64(1)), 0).astype(np.uint64)
    tail_bits = ((length - covered) * 8 - head * 8).astype(np.uint64)  # 8 to 120 bits, of which a word holds 64
    ends = words[sample + covered // 8]
    lower = np.where(tail_bits < 64, ends >> (np.uint64(64) - np.minimum(tail_bits, 63)), ends)
    rest = np.where(tail_bits > 64, words[sample + covered // 8 + 1] >> (np.uint64(128) - np.maximum(tail_bits, 65)), 0).astype(np.uint64)
    middle = (ranks[sample] << np.uint64(32)) | ranks[sample + (covered - 128) // 8]  # a block has under 2^32 samples
    first = (head.astype(np.uint64) << np.uint64(56)) | upper  # seven bytes at most before a sample
    keys = [lower, middle, first] if not rest.any() else [rest, lower, middle, first]
    order = np.lexsort(keys)
    same = np.zeros(len(order), bool)
    same[1:] = np.logical_and.reduce([k[order[1:]] == k[order[:-1]] for k in keys])
    return order, same


def repeated_windows(segments: list[bytes], lead: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """For all windows of the segments in order: does the same window stand in another segment or place?"""
    order, same = window_order(segments, lead, windows, length)
    out = np.zeros(len(order), bool)
    out[order[same]] = True
    out[order[:-1][same[1:]]] = True
    return out


def _runs(flags: np.ndarray) -> list[int]:
    """Starts and ends of the true runs."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.column_stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)]).ravel().tolist()


def _segments(documents: DataFrame, length: int, bits: int) -> DataFrame:
    """The segments, without their bytes, whose bucket may have two entries: a row a document, written once."""
    texts = documents.select(F.col("text").cast("string").alias("text"))

    def grams(values: Iterator[bytes], powers: Powers) -> np.ndarray:
        found = [window_grams(t, powers, length)[0] for t in values if len(t) >= length]
        return np.concatenate(found) if found else np.zeros(0, np.uint64)

    shared = documents.sparkSession.sparkContext.broadcast(count_levels(texts, grams, Powers, (2,), bits))  # a fixed number of bits
    wide, narrow = pa.list_(pa.int64()), pa.list_(pa.int32())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in batches:
            rows: list[int] = []
            columns: list[list] = [[], [], [], []]
            for row, text in zip(b.column(0).to_pylist(), byte_values(b.column(1)), strict=True):
                if len(text) < length:
                    continue
                h, place, first, last = window_grams(text, powers, length)
                own = np.flatnonzero(shared.value.of(h))
                if not len(own):
                    continue
                first, last, place = first[own], last[own], place[own]
                keys = [segment_key(text[lo : hi + length], at - lo) for lo, hi, at in zip(first.tolist(), last.tolist(), place.tolist(), strict=True)]
                rows.append(row)
                for c, v in zip(columns, (h[own].view(np.int64), np.array(keys, np.int64), first, last - first + 1), strict=True):
                    c.append(v)
            kinds = (wide, wide, narrow, narrow)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["row", "buckets", "segments", "starts", "windows"])

    out = materialize(_keyed(documents).mapInArrow(cut, "row long, buckets array<long>, segments array<long>, starts array<int>, windows array<int>"), "segments")
    shared.destroy()
    tidy(documents.sparkSession)
    return out


def segment_key(data: bytes, lead: int) -> int:
    return xxhash.xxh3_64_intdigest(data, seed=lead) - (1 << 63)


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.select(F.xxhash64("doc_id", "text").alias("row"), F.col("text").cast("string").alias("text"))


def _contents(documents: DataFrame, asked: Broadcast, length: int, few: bool) -> DataFrame:
    """bucket, segment, bytes, lead, windows of the different segments of buckets that have several.

    asked: marks of these buckets, and of those with very many; ``few`` tells which of the two are wanted.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, sent = Powers(), set()
        names, kinds = ["bucket", "segment", "bytes", "lead", "windows"], (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32())
        several, hot = asked.value
        for b in batches:
            rows: list[tuple] = []
            size = 0
            for text in byte_values(b.column(1)):
                if len(text) < length:
                    continue
                h, place, first, last = window_grams(text, powers, length)
                bucket = h.view(np.int64)
                own = np.flatnonzero(in_bitmap(several, bucket) & (in_bitmap(hot, bucket) != few))
                for k, lo, hi, at in zip(bucket[own].tolist(), first[own].tolist(), last[own].tolist(), place[own].tolist(), strict=True):
                    data = text[lo : hi + length]
                    key = (k, segment_key(data, at - lo))
                    if key not in sent:
                        if len(sent) < 200_000:
                            sent.add(key)
                        rows.append((*key, data, at - lo, hi - lo + 1))
                        size += len(data)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return _keyed(documents).mapInArrow(cut, "bucket long, segment long, bytes binary, lead int, windows int")


def _search(entries: DataFrame, length: int, block_bytes: int) -> DataFrame:
    """bucket, segment, runs (of repeated windows) for segments that share windows with others of their bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(found: list[tuple]) -> pa.RecordBatch:
            held: dict[int, int] = {}
            for x in found:
                held[x[0]] = held.get(x[0], 0) + 1
            several = [x for x in found if held[x[0]] > 1]
            keys, segments, runs = [], [], []
            if several:
                windows = np.array([x[4] for x in several])
                flags = repeated_windows([x[2] for x in several], np.array([x[3] for x in several]), windows, length)
                for x, part in zip(several, np.split(flags, np.cumsum(windows)[:-1]), strict=True):
                    if part.any():
                        keys.append(x[0])
                        segments.append(x[1])
                        runs.append(_runs(part))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(segments, pa.int64()), pa.array(runs, pa.list_(pa.int32()))], names=["bucket", "segment", "runs"])

        found: list[tuple] = []
        size = 0
        for b in batches:
            for x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if found and found[-1][:2] == x[:2]:
                    continue
                if size > block_bytes and found[-1][0] != x[0]:
                    yield flush(found)
                    found, size = [], 0
                found.append(x)
                size += len(x[2])
        if found:
            yield flush(found)

    return entries.repartition("bucket").sortWithinPartitions("bucket", "segment").mapInArrow(run, "bucket long, segment long, runs array<int>")


def _chains(places: DataFrame, repeated: np.ndarray, found: np.ndarray, most: int = 16) -> DataFrame:
    """row, start, chain and its members: segments of a document that may have marks; written once.

    Neighbours that may all stand in several places make one chain; it ends
    after a segment whose key is a multiple of ``most``, so chains of one
    passage are cut alike wherever it stands.
    """
    shared = places.sparkSession.sparkContext.broadcast((repeated, found))  # bounded numbers of bits
    fields = [pa.field("bucket", pa.int64()), pa.field("segment", pa.int64()), pa.field("offset", pa.int32()), pa.field("windows", pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again, marked = shared.value
        for b in batches:
            if not len(b):
                continue
            bucket, segment, start, windows = (b.column(i).flatten().to_numpy() for i in (1, 2, 3, 4))
            sizes = pc.list_value_length(b.column(1)).to_numpy()
            opens = np.zeros(len(segment), bool)
            opens[np.cumsum(sizes) - sizes] = True  # no document is without segments
            several = in_bitmap(again, segment)
            onward = several[1:] & several[:-1] & (start[1:] == start[:-1] + windows[:-1]) & (segment[:-1] % most != 0)
            opens[1:] |= ~onward
            keep = np.flatnonzero(several | in_bitmap(marked, segment))
            group = np.cumsum(opens)[keep]
            first = np.flatnonzero(np.diff(group, prepend=-1))
            ends = np.append(first[1:], len(keep))[: len(first)]
            keys = [xxhash.xxh3_128_digest(bucket[at].tobytes() + segment[at].tobytes()) for at in (keep[lo:hi] for lo, hi in zip(first.tolist(), ends.tolist(), strict=True))]
            head = keep[first]
            offset = start[keep] - np.repeat(start[head], ends - first)
            members = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip((bucket[keep], segment[keep], offset, windows[keep]), fields, strict=True)], fields=fields)
            columns = [pa.array(np.repeat(b.column(0).to_numpy(), sizes)[head]), pa.array(start[head]), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(np.append(first, len(keep)).astype(np.int32)), members)]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "start", "chain", "members"])

    shape = "row long, start int, chain binary, members array<struct<bucket: long, segment: long, offset: int, windows: int>>"
    out = materialize(places.mapInArrow(run, shape), "chains")
    shared.destroy()
    return out


def repeated_spans(documents: DataFrame, length: int = 200, bits: int = 1 << 27, block_bytes: int = 4 << 20, bucket_limit: int = 8192) -> DataFrame:
    """row (hash of doc_id and text), spans: byte ranges to remove, flat, unsorted."""
    places = _segments(documents, length, bits)
    each = places.select(F.explode(F.arrays_zip("buckets", "segments")).alias("x")).select(F.col("x.buckets").alias("bucket"), F.col("x.segments").alias("segment"))
    counted = materialize(each.groupBy("bucket", "segment").agg(F.count("*").alias("copies")), "segment_counts")
    sizes = materialize(counted.groupBy("bucket").agg(F.count("*").alias("different")).where("different > 1"), "bucket_sizes")
    hot = row_bitmap(sizes.where(F.col("different") > bucket_limit), bits >> 3, "bucket")
    asked = documents.sparkSession.sparkContext.broadcast((row_bitmap(sizes, bits, "bucket"), hot))  # bounded numbers of bits
    again = counted.where("copies > 1").select("bucket", "segment", F.lit(None).cast("array<int>").alias("runs"))
    found = _search(_contents(documents, asked, length, True), length, block_bytes)
    if hot.any():
        found = found.unionByName(_hot_windows(_contents(documents, asked, length, False), length))
    found = materialize(found.join(again.select("bucket", "segment"), ["bucket", "segment"], "left_anti"), "segment_marks")
    asked.destroy()
    tidy(documents.sparkSession)
    marks = again.unionByName(found)  # a row a segment
    chains = _chains(places, row_bitmap(again, bits, "segment"), row_bitmap(found, bits, "segment"))
    members = chains.groupBy("chain").agg(F.first("members").alias("members")).select("chain", F.explode("members").alias("x")).select("chain", "x.*")
    relative = F.expr(f"if(runs IS NULL, array(offset, offset + windows + {length - 1}), transform(runs, (x, i) -> offset + x + if(i % 2 = 1, {length - 1}, 0)))")
    covered = members.join(marks, ["bucket", "segment"]).groupBy("chain").agg(F.flatten(F.collect_list(relative)).alias("ranges"))
    spans = chains.select("row", "start", "chain").join(materialize(covered, "chain_ranges"), "chain").select("row", F.expr("transform(ranges, x -> start + x)").alias("part"))
    return spans.groupBy("row").agg(F.flatten(F.collect_set("part")).alias("spans"))


def _hot_windows(entries: DataFrame, length: int) -> DataFrame:
    """As ``_search``, for buckets of very many different segments: windows meet by their whole content."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            window, source, place = [], [], []
            for n, (data, lead, windows) in enumerate(zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True)):
                window += [xxhash.xxh3_128_digest(data[i : i + length], seed=lead - i) for i in range(windows)]
                source += [n] * windows
                place += range(windows)
            at = pa.array(source, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(window, pa.binary()), b.column(0).take(at), b.column(1).take(at), pa.array(place, pa.int32())], names=["window", "bucket", "segment", "place"])

    once = entries.dropDuplicates(["bucket", "segment"]).select("bucket", "segment", "bytes", "lead", "windows")
    parts = materialize(once.mapInArrow(split, "window binary, bucket long, segment long, place int"), "hot_windows")
    again = parts.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window")
    met = parts.join(again, "window").groupBy("bucket", "segment").agg(F.array_sort(F.collect_list("place")).alias("places"))
    return met.select("bucket", "segment", F.flatten(F.transform("places", lambda p: F.array(p, p + 1))).cast("array<int>").alias("runs"))


def _union(spans: list[int] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(spans[::2], spans[1::2], strict=True)) if spans else ():
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def removed(documents: DataFrame, length: int = 200, as_text: bool = False, **how) -> DataFrame:
    """own (a struct of the row's columns), kept, n_bytes, n_removed and n_spans of every row.

    ``kept`` is binary, or with ``as_text`` a string without broken characters.
    Only documents with something to remove are shuffled to meet their spans; a
    bitmap of row hashes tells which these may be.
    """
    spans = materialize(repeated_spans(documents, length, **how), "removal_spans")
    shared = documents.sparkSession.sparkContext.broadcast(row_bitmap(spans))  # a bounded number of bits
    base = documents.select(F.struct("*").alias("own"), F.xxhash64("doc_id", "text").alias("row"))
    kind = pa.string() if as_text else pa.binary()

    def pick(asked: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(in_bitmap(shared.value, b.column(1).to_numpy()) == asked))

        return run

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, sizes, gone, runs = [], [], [], []
            for text, parts in zip(byte_values(b.column(0).field("text")), b.column(1).to_pylist(), strict=True):
                cuts = _union(parts)
                edges = [0, *(x for c in cuts for x in c), len(text)]
                rest = b"".join(text[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True))
                kept.append(rest.decode("utf-8", "ignore") if as_text else rest)
                sizes.append(len(text))
                gone.append(sum(z - a for a, z in cuts))
                runs.append(len(cuts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, kind), *(pa.array(x, pa.int64()) for x in (sizes, gone, runs))], names=["own", "kept", "n_bytes", "n_removed", "n_spans"])

    clean = base.mapInArrow(pick(False), base.schema).select("own", F.lit(None).cast("array<bigint>").alias("spans"))
    hit = base.mapInArrow(pick(True), base.schema).join(spans, "row", "left").select("own", F.col("spans").cast("array<bigint>").alias("spans"))
    schema = base.select("own").schema.add("kept", "string" if as_text else "binary").add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long")
    return clean.unionByName(hit).mapInArrow(apply, schema)


def removal_report(documents: DataFrame, **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of what is kept, for every row."""
    done = removed(documents.select("doc_id", F.col("text").cast("string").alias("text")), **how)
    return done.select("own.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def deduplicated(documents: DataFrame, **how) -> DataFrame:
    """``documents`` with repeated passages cut out of ``text``; rows that lose all they had go.

    ``n_chars``, if there, follows the new text; a null text stays null.
    """
    done = removed(documents, as_text=True, **how).where("n_bytes = 0 OR n_removed < n_bytes")
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("own.text"))
    new = {"text": text} | ({"n_chars": F.coalesce(F.length(text), F.col("own.n_chars")).cast(documents.schema["n_chars"].dataType)} if "n_chars" in documents.columns else {})
    return done.select(*(new.get(c, F.col(f"own.`{c}`")).alias(c) for c in documents.columns))
