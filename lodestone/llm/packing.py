"""Best-fit packing of tokenised documents into sequences, by bin completion on a histogram.

Method.  Lengths are whole numbers up to the sequence length, so the instance is
a histogram of bounded size, whatever the number of documents.  The driver packs
it: best-fit decreasing gives the incumbent; if that misses the lower bound, bin
completion takes the largest length left, enumerates undominated fillings of
the rest of its sequence (a filling that an exchange for one larger piece would
improve is left out), prunes those whose waste exceeds what a better solution
may waste in all, and branches.  Its result is a short list of patterns with
repeat counts.  Each piece then finds its place from its rank among the pieces
of its length, with no sort and no group of pieces in one task.

Defined results.  Null and empty texts are one piece of the closing id alone.
Repeated rows are packed each.  An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from operator import neg

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.storage import materialize

#: A run of white space from which the tokenizer's own library takes over.
LONG_RUN = 5000
LONG_BLANKS = re.compile(rf"\s{{{LONG_RUN}}}")
Filling = tuple[tuple[int, int], ...]


def byte_bpe_encoder(ranks_file: str) -> Callable[[str], list[int]]:
    """Ids of a byte-level BPE vocabulary given as ranks.

    The usual splitting pattern treats the last blank before a word apart from
    the blanks before it; where a single blank or newline alone stands between
    words, a pattern without look-ahead splits alike and runs about twice as fast.
    Texts with a long run of white space, on which look-ahead takes quadratic time
    and then exhausts the stack, go to the tokenizer's own JSON file beside the ranks; the ids are the same.
    """
    import base64

    import public_tokenizers
    import tiktoken
    import tokenizers

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    special = {"<|endoftext|>": 50256}
    whole = tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    library: list[tokenizers.Tokenizer] = []
    single = tiktoken.Encoding("single", pat_str=r"'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+", mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if len(text) >= LONG_RUN and LONG_BLANKS.search(text):
            if not library:
                library.append(tokenizers.Tokenizer.from_file(ranks_file.removesuffix(".tiktoken") + ".json"))
            return library[0].encode(text, add_special_tokens=False).ids
        if "<|endoftext|>" in text:
            return whole.encode(text, allowed_special="all")
        if " ".join(text.split()) == text.replace("\n", " "):  # no other white space, and no two of it in a row
            return single.encode_ordinary(text)
        return whole.encode_ordinary(text)

    return encode


def public_vocabulary() -> str:
    """The byte-level BPE vocabulary that is installed here."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def vocabulary_ranks(json_file: str) -> str:
    """The ranks file that stands beside a tokenizer's JSON file and holds the same vocabulary."""
    return json_file.removesuffix(".json") + ".tiktoken"


def pieces(documents: DataFrame, tokenizer_json: str, capacity: int = 2048, closing: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and where the piece was written; written once."""
    lean = documents.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe_encoder(vocabulary_ranks(tokenizer_json))
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            rows: list[tuple] = []
            source: list[int] = []
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = np.array([*encode(text or ""), closing], "<u4")
                parts = -(-len(ids) // capacity)
                first = len(ids) - (parts - 1) * capacity
                at = 0
                for k in range(parts):
                    size = first if k == 0 else capacity
                    rows.append((k, at, size, zlib.crc32(ids[at : at + size].tobytes()), task, int(seen[size])))
                    source.append(i)
                    seen[size] += 1
                    at += size
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(source, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    kind = lean.schema["doc_id"].dataType.simpleString()
    return materialize(lean.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, nth long"), "pieces")


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: by volume, and by pieces over half with what cannot join them."""
    total = sum(k * n for k, n in counts.items())
    best = -(-total // capacity)
    sizes = sorted(counts)
    for least in [0, *(k for k in sizes if 2 * k <= capacity)]:
        alone = sum(n for k, n in counts.items() if k > capacity - least)
        large = [(k, n) for k, n in counts.items() if capacity - least >= k and 2 * k > capacity]
        small = sum(k * n for k, n in counts.items() if least <= k and 2 * k <= capacity)
        room = sum((capacity - k) * n for k, n in large)
        best = max(best, alone + sum(n for _, n in large) + max(0, -(-(small - room) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing on the histogram: (contents, repeats)."""
    open_bins: dict[int, list[tuple[Filling, int]]] = {}
    for size in sorted(counts, reverse=True):
        left = counts[size]
        for room in sorted(r for r in open_bins if r >= size):
            put: list[tuple[int, Filling, int]] = []
            for filling, n in open_bins.pop(room):
                each = room // size
                full = min(n, left // each)
                if full:
                    put.append((room - each * size, (*filling, (size, each)), full))
                    left -= full * each
                    n -= full
                if n and left:
                    put.append((room - left * size, (*filling, (size, left)), 1))
                    left, n = 0, n - 1
                if n:
                    put.append((room, filling, n))
            for r, filling, n in put:
                open_bins.setdefault(r, []).append((filling, n))
            if not left:
                break
        each = capacity // size
        if left >= each:
            open_bins.setdefault(capacity - each * size, []).append((((size, each),), left // each))
        if left % each:
            open_bins.setdefault(capacity - left % each * size, []).append((((size, left % each),), 1))
    return [x for entries in open_bins.values() for x in entries]


class Effort:
    """Steps that a search may still take; what it holds when they are used up stays."""

    def __init__(self, steps: int):
        self.left = steps


def fillings(counts: dict[int, int], room: int, waste: int, limit: int, effort: Effort) -> list[Filling]:
    """Undominated fillings of ``room`` that waste at most ``waste``, the least wasteful first."""
    sizes = sorted((k for k, n in counts.items() if n and k <= room), reverse=True)
    found: list[tuple[int, Filling]] = []
    steps = 0
    most = min(50 * limit, max(effort.left, 2 * len(sizes)))

    def dominated(room_left: int, held: list[tuple[int, int]]) -> bool:
        """Could one piece be exchanged for a larger one that is left over and still fits?"""
        used = dict(held)
        for i, _ in held:
            j = i - 1
            while j >= 0 and sizes[j] <= sizes[i] + room_left:
                if used.get(j, 0) < counts[sizes[j]]:
                    return True
                j -= 1
        return False

    def grow(at: int, room_left: int, held: list[tuple[int, int]]) -> None:
        nonlocal steps
        steps += 1
        if room_left <= waste and not dominated(room_left, held):
            found.append((room_left, tuple((sizes[i], n) for i, n in held)))
        if room_left == 0:
            return
        for i in range(bisect_left(sizes, -room_left, lo=at, key=neg), len(sizes)):
            for n in range(min(counts[sizes[i]], room_left // sizes[i]), 0, -1):
                if len(found) >= limit or steps > most:
                    return
                grow(i + 1, room_left - n * sizes[i], [*held, (i, n)])

    grow(0, room, [])
    effort.left -= steps
    return [f for _, f in sorted(found, key=lambda x: (x[0], [(-k, n) for k, n in x[1]]))]


def complete(counts: dict[int, int], capacity: int, incumbent: int, effort: Effort, width: int = 24) -> list[tuple[Filling, int]] | None:
    """Bin completion by depth-first branch and bound; a packing in fewer sequences than ``incumbent``, or None.

    A filling is used as often as it can be before the next is looked for.  The
    first dive always runs to its end; going back ends with the effort.
    """
    total = sum(k * n for k, n in counts.items())
    budget = (incumbent - 1) * capacity - total
    if budget < 0:
        return None
    left = dict(counts)
    trail: list[list] = []  # fillings to try, waste allowed, pattern and repeats, pieces used
    waste = budget
    while True:
        largest = max((k for k, n in left.items() if n), default=0)
        if not largest:
            return [frame[2] for frame in trail]
        left[largest] -= 1
        options = fillings(left, capacity - largest, waste, width, effort)
        left[largest] += 1
        trail.append([iter(options), waste, None, {}])
        while trail:
            frame = trail[-1]
            back = bool(frame[3])
            for k, n in frame[3].items():
                left[k] += n
            frame[2], frame[3] = None, {}
            option = None if back and effort.left <= 0 else next(frame[0], None)
            if option is None:
                trail.pop()
                continue
            whole = dict(option)
            top = max(k for k, n in left.items() if n)
            whole[top] = whole.get(top, 0) + 1
            lost = capacity - sum(k * n for k, n in whole.items())
            times = min(left[k] // n for k, n in whole.items())
            if lost:
                times = min(times, frame[1] // lost)
            if times < 1:
                continue
            frame[3] = {k: n * times for k, n in whole.items()}
            for k, n in frame[3].items():
                left[k] -= n
            frame[2] = (tuple(sorted(whole.items(), reverse=True)), times)
            waste = frame[1] - lost * times
            break
        else:
            return None


def pack_histogram(counts: dict[int, int], capacity: int, steps: int = 200_000) -> list[tuple[Filling, int]]:
    """Patterns (contents, repeats) that hold all pieces in as few sequences as found.

    steps: of the search in all, a few seconds'; it ends at once where the
    incumbent meets the lower bound.  A packing that stays above the bound when
    they are used up is not proven to be the best.
    """
    counts = {k: n for k, n in counts.items() if n}
    if not counts:
        return []
    best = best_fit(counts, capacity)
    used, bound = sum(n for _, n in best), lower_bound(counts, capacity)
    effort = Effort(steps)
    while used > bound and effort.left > 0:
        better = complete(counts, capacity, used, effort)
        if better is None:
            break
        best, used = better, sum(n for _, n in better)
    return best


def _places(patterns: list[tuple[Filling, int]]) -> dict[int, np.ndarray]:
    """For each length, rows of (first rank, pieces a sequence, first sequence, offset), by rank."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for filling, repeats in patterns:
        offset = 0
        for size, each in filling:
            rows.setdefault(size, []).append((used.get(size, 0), each, sequence, offset))
            used[size] = used.get(size, 0) + each * repeats
            offset += size * each
        sequence += repeats
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def pack(documents: DataFrame, tokenizer_json: str, capacity: int = 2048, closing: int = 0) -> DataFrame:
    """Every piece of every document with its sequence and its offset there."""
    cut = pieces(documents, tokenizer_json, capacity, closing)
    counted = materialize(cut.groupBy("task", "length").agg(F.count("*").alias("n")), "piece_counts")
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    places = cut.sparkSession.sparkContext.broadcast(_places(pack_histogram(histogram, capacity)))  # at most a few rows a length
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = cut.join(before.hint("merge"), ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for size in np.unique(length):
                own = np.flatnonzero(length == size)
                table = places.value[int(size)]
                first, each, start, at = table[np.searchsorted(table[:, 0], rank[own], "right") - 1].T
                nth = rank[own] - first
                sequence[own], offset[own] = start + nth // each, at + nth % each * size
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = cut.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
