"""Records of large JSON files, read in byte ranges: one huge array is many tasks.

From the middle of a JSON text one cannot tell whether a brace stands inside a
string, nor how deep it is nested.  So a first pass summarises every range: the
parity of its unescaped quotes, and how the depth changes if it begins outside
or inside a string.  The summaries, a few numbers a range, are added up in
order on the driver, which gives each range's true state.  A second pass cuts
out the records that begin in a range, reading on past its end for the last one.
Files whose top level is an object hold their records in the array of one of
``ENVELOPES``; a pass between the two finds where the top-level arrays begin.

Escapes need no state: whether a range's first character is escaped is told by
the backslashes right before it.  Elements that are no objects are left out, as
are records without an end.  The files are listed by Spark, and opened in tasks
by their URI with pyarrow's file systems.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.records import ENVELOPES

#: Bytes of a range, and the first read beyond one for its last record; each further one is twice as long.
RANGE_BYTES, READ_AHEAD = 8 << 20, 1 << 16
#: Tasks that ranges are dealt to, at most.
MOST_TASKS = 1000
QUOTE, SLASH, OPEN, CLOSE = ord('"'), ord("\\"), b"{[", b"}]"
#: Change of depth by character.
MOVES = np.array([(c in OPEN) - (c in CLOSE) for c in range(256)], np.int8)


def opened(path: str) -> pa.NativeFile:
    system, inner = fs.FileSystem.from_uri(path.replace("file:///", "/").replace("file:/", "/") if path.startswith("file:") else path)
    return system.open_input_file(inner)


def read_at(f: pa.NativeFile, lo: int, hi: int) -> bytes:
    f.seek(lo)
    return f.read(hi - lo)


def starts_escaped(f: pa.NativeFile, lo: int) -> bool:
    """Whether an odd number of backslashes stands right before ``lo``."""
    run, at = 0, lo
    while at > 0:
        back = read_at(f, max(0, at - 4096), at)
        kept = len(back) - len(back.rstrip(b"\\"))
        run, at = run + kept, at - len(back)
        if kept < len(back):
            break
    return run % 2 == 1


def quotes(data: np.ndarray, escaped: bool) -> np.ndarray:
    """Where unescaped quotes stand."""
    at, slash = np.flatnonzero(data == QUOTE), np.flatnonzero(data == SLASH)
    found = np.zeros(len(data), bool)
    found[at] = True
    if escaped and len(data):
        found[0] = False
    if len(slash) and len(at):
        begin = slash[np.maximum.accumulate(np.where(np.diff(slash, prepend=-2) > 1, np.arange(len(slash)), 0))]  # of each backslash's run
        odd = (slash - begin + 1 + ((begin == 0) & escaped)) % 2 == 1
        near = np.minimum(np.searchsorted(slash, at - 1), len(slash) - 1)
        found[at[(slash[near] == at - 1) & odd[near]]] = False
    return found


def steps(data: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """+1 where a bracket opens and -1 where one closes, outside strings."""
    step = MOVES[data]
    step[inside] = 0
    return step


def in_strings(data: np.ndarray, escaped: bool, inside: bool) -> np.ndarray:
    """Whether each character stands in a string; its closing quote counts as outside, which no bracket is."""
    return (np.cumsum(quotes(data, escaped), dtype=np.uint8) + np.uint8(inside)) % 2 == 1  # a count that wraps keeps its parity


def summary(f: pa.NativeFile, lo: int, hi: int) -> tuple[int, int, int]:
    """Parity of the quotes of a range, and its change of depth from outside and from inside a string."""
    data, escaped = np.frombuffer(read_at(f, lo, hi), np.uint8), starts_escaped(f, lo)
    out = in_strings(data, escaped, False)
    return int(quotes(data, escaped).sum() % 2), int(steps(data, out).sum()), int(steps(data, ~out).sum())


def top_arrays(f: pa.NativeFile, lo: int, hi: int, inside: bool, depth: int) -> list[tuple[int, str]]:
    """(place, key) of the values of a range that open at depth 1; of an object the key is empty."""
    data = np.frombuffer(read_at(f, lo, hi), np.uint8)
    step = steps(data, in_strings(data, starts_escaped(f, lo), inside))
    after = depth + np.cumsum(step)
    found = []
    for at in np.flatnonzero((step == 1) & (after == 2)).tolist():
        back = read_at(f, max(0, lo + at - 4096), lo + at)
        m = re.search(rb'"((?:[^"\\]|\\.)*)"\s*:\s*$', back)
        found.append((lo + at, m[1].decode(errors="replace") if m and data[at] == ord("[") else ""))
    return found


def records(f: pa.NativeFile, size: int, lo: int, hi: int, inside: bool, depth: int, at_depth: int, arrays: list[tuple[int, str]] | None) -> Iterator[str]:
    """The objects that begin in a range at the records' depth (and in an array that is an envelope)."""
    data = read_at(f, lo, hi)
    held = np.frombuffer(data, np.uint8)
    strings = in_strings(held, starts_escaped(f, lo), inside)
    step = steps(held, strings)
    after = depth + np.cumsum(step)
    begins = np.flatnonzero((step == 1) & (after == at_depth + 1) & (held == ord("{")))
    ends = np.flatnonzero((step == -1) & (after == at_depth) & (held == ord("}")))
    for b in begins.tolist():
        if arrays is not None:
            of = [key for place, key in arrays if place < lo + b]
            if not of or of[-1] not in ENVELOPES:
                continue
        i = int(np.searchsorted(ends, b))
        if i < len(ends):
            yield data[b : int(ends[i]) + 1].decode(errors="replace")
            continue
        text, at, level, quoted = data[b:], hi, int(after[-1]) if len(after) else depth, bool(strings[-1])
        ahead = READ_AHEAD
        while at < size:  # the last record goes on beyond the range
            more, ahead = read_at(f, at, min(size, at + ahead)), min(2 * ahead, RANGE_BYTES)
            part = np.frombuffer(more, np.uint8)
            out = in_strings(part, starts_escaped(f, at), quoted)
            move = steps(part, out)
            stop = np.flatnonzero((move == -1) & (level + np.cumsum(move) == at_depth))
            if len(stop):
                yield (text + more[: int(stop[0]) + 1]).decode(errors="replace")
                break
            text, at, level, quoted = text + more, at + len(more), level + int(move.sum()), bool(out[-1])


def read_json_records(spark: SparkSession, path: str, record_schema: str, range_bytes: int = RANGE_BYTES, files: str = "*.json") -> DataFrame:
    """file, range and pos (the records' order in the file) and the fields of every record."""
    return record_texts(spark, path, range_bytes, files).select("file", "range", "pos", F.from_json("text", record_schema).alias("r")).select("file", "range", "pos", "r.*")


def record_texts(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, files: str = "*.json") -> DataFrame:
    """file, range, pos and text of every record; (range, pos) is their order in the file."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", files).load(path).select("path", "length")  # sizes alone, no contents
    ranges = listed.where("length > 0").select("path", "length", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("range", "lo"))
    ranges = ranges.select("path", "length", "range", "lo", F.least(F.col("lo") + range_bytes, "length").alias("hi"))
    # by number: the rows are tiny, and Spark would join partitions by their bytes into a single task
    tasks = max(1, min(ranges.count(), MOST_TASKS))
    ranges = ranges.repartition(tasks, "path", "range")

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                with opened(r["path"]) as f:
                    rows.append((*summary(f, r["lo"], r["hi"]), read_at(f, 0, 4096).lstrip(b"\xef\xbb\xbf \t\r\n")[:1].decode(errors="replace") if r["range"] == 0 else ""))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], names=[*b.schema.names, "q", "d0", "d1", "first"])

    held = ranges.mapInArrow(summarise, "path string, length long, range int, lo long, hi long, q long, d0 long, d1 long, first string").orderBy("path", "range").collect()  # a row a range
    states, shape, inside, depth = [], {}, 0, 0
    for r in held:
        if r["range"] == 0:
            inside, depth, shape[r["path"]] = 0, 0, r["first"]
        states.append((r["path"], r["length"], r["range"], r["lo"], r["hi"], bool(inside), depth))
        inside, depth = inside ^ r["q"], depth + (r["d1"] if inside else r["d0"])
    state_schema = "path string, length long, range int, lo long, hi long, inside boolean, depth int"
    placed = spark.createDataFrame(states, state_schema).repartition(tasks, "path", "range")
    enveloped = {p for p, first in shape.items() if first == "{"}
    arrays: dict[str, list[tuple[int, str]]] = {p: [] for p in enveloped}

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                with opened(r["path"]) as f:
                    rows += [(r["path"], *x) for x in top_arrays(f, r["lo"], r["hi"], r["inside"], r["depth"])]
            cols = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.string()), strict=True)], names=["path", "place", "key"])

    if enveloped:
        for r in placed.where(F.col("path").isin(sorted(enveloped))).mapInArrow(find, "path string, place long, key string").orderBy("path", "place").collect():  # a row a top-level field
            arrays[r["path"]].append((r["place"], r["key"]))
    single = {p for p in enveloped if not any(k in ENVELOPES for _, k in arrays[p])}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                p = r["path"]
                level, within = (0, None) if p in single else (1, None) if p not in enveloped else (2, arrays[p])
                with opened(p) as f:
                    found = list(records(f, r["length"], r["lo"], r["hi"], r["inside"], r["depth"], level, within))
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([p.rsplit("/", 1)[-1]] * n, pa.string()), pa.array([r["range"]] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(found, pa.string())], names=["file", "range", "pos", "text"])

    return placed.mapInArrow(cut, "file string, range int, pos int, text string")
