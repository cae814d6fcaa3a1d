"""Vector codes by ball k-means: eight codebooks of sixteen entries over integer parts of vectors.

Method.  Vectors become integers and lie in blocks of some thousand, each with
the entry that every part was assigned to last.  In a block, the parts of one
entry are a ball: its radius is the largest distance of a part to the entry.
Only entries nearer than twice the radius are neighbours of the ball.  A part
nearer to its entry than half the way to the nearest neighbour is in the stable
core and keeps it; the others lie in rings, and a part of ring t is compared
with the t nearest neighbours alone.  An entry that has not moved since the last
round needs only its neighbours that have; a ball without such is not looked at.
All numbers are integers, so the bounds are exact and ties go to the lower entry.

A round is one pass: tasks assign their blocks and give each block's sums by
entry, Spark adds the sums, and the driver gets one row a component of the
codebooks (parts x entries x width numbers, whatever the input).  Blocks of a
round are persisted on the executors' disks until the next round is done; a lost
executor's blocks are computed again from the written first ones.  Errors by
label are partial sums; they go back to the rows by a join that Spark may split.

Defined results.  Rows whose vector is null or holds null or non-finite
components are dropped; further columns are not read.  Vectors shorter than the
longest, or than a multiple of the parts, end in zeros.  Components beyond what
keeps squared distances in 58 bits (about 2^26 for parts of 8) count as that
bound.  The first entries are the vectors of the smallest ids; null ids come
last, and rows of one id are ordered by their vectors.  With fewer rows than
entries there are as many entries as rows; an empty table gives an empty table.
Repeated rows count as often as they come.  An entry that no part uses stays.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from lodestone.storage import materialize

SCALE = 4096
#: Most vectors and bytes of a block; Spark passes blocks to Python 64 MB at a time.
BLOCK_ROWS = 4096
BLOCK_BYTES = 1 << 20


def finite(vec: str) -> Column:
    """A vector without null, NaN or infinite components."""
    return F.col(vec).isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))


def largest(width: int) -> int:
    """The bound on a component's size that keeps squared distances of ``width`` components within 2^58."""
    return min(math.isqrt((1 << 58) // width) // 2, (1 << 31) - 1)


def as_integers(values: np.ndarray, width: int) -> np.ndarray:
    """floor(4096 * x), within the bound."""
    with np.errstate(over="ignore"):
        x = np.floor(values.astype(np.float64) * SCALE)
    return np.clip(x, -largest(width), largest(width)).astype(np.int64)


def matrix(column: pa.Array, width: int, parts: int) -> np.ndarray:
    """Rows of a list column as integers, [rows, parts, width], short rows filled with zeros."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), parts * width), np.float64)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return as_integers(out, width).reshape(len(column), parts, width)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("...i,...i->...", d, d)


def assign_all(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each row and its squared distance, entry by entry."""
    best, at = squared(x, book[0]), np.zeros(len(x), np.int64)
    for j in range(1, len(book)):
        d = squared(x, book[j])
        nearer = d < best
        best[nearer], at[nearer] = d[nearer], j
    return at, best


def assign_balls(x: np.ndarray, home: np.ndarray, book: np.ndarray, moved: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each row, from the entry it had, and the squared radius of each entry's ball.

    moved: whether an entry changed since ``home`` was assigned.  radius: the
    squared radii of that time, which hold for entries that did not move.
    """
    k = len(book)
    between = squared(book[:, None, :], book[None, :, :])
    rival = (moved[:, None] | moved[None, :]) & ~np.eye(k, dtype=bool)  # who may have come nearer
    gap = np.where(rival, between, np.iinfo(np.int64).max)
    order = np.argsort(gap, axis=1, kind="stable")
    gap = np.take_along_axis(gap, order, axis=1)
    at, out = home.copy(), np.where(moved, 0, radius)
    rows = np.flatnonzero((moved | (gap[:, 0] <= 4 * radius))[home])  # the other balls have no neighbour that moved
    if not len(rows):
        return at, out
    own = squared(x[rows], book[home[rows]])
    np.maximum.at(out, home[rows], own)  # the balls of the moved entries; those of the others are no larger than they were
    ball = np.where(moved, out, radius)
    neighbour = gap <= 4 * ball[:, None]
    ring = (neighbour[home[rows]] & (gap[home[rows]] <= 4 * own[:, None])).sum(axis=1)  # 0: in the stable core
    best = own.copy()
    for t in range(ring.max()):
        far = np.flatnonzero(ring > t)
        j = order[home[rows[far]], t]
        d = squared(x[rows[far]], book[j])
        nearer = (d < best[far]) | (d == best[far]) & (j < at[rows[far]])
        best[far[nearer]], at[rows[far[nearer]]] = d[nearer], j[nearer]
    radii = np.where(moved, 0, radius)
    np.maximum.at(radii, at[rows], best)
    return at, radii


def first_blocks(rows: DataFrame, ids: list[str], width: int, parts: int, vec: str) -> DataFrame:
    """Blocks of integer vectors: the id columns as arrays, the vectors as bytes."""
    lean = rows.select(*ids, vec)
    most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (4 * parts * width)))
    kinds = ", ".join(f"{c} array<{lean.schema[c].dataType.simpleString()}>" for c in ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, len(b), most):
                part = b.slice(start, most)
                x = matrix(pa.concat_arrays([part.column(len(ids))]), width, parts)
                held = [pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), pa.concat_arrays([part.column(i)])) for i in range(len(ids))]
                yield pa.RecordBatch.from_arrays([*held, pa.array([x.astype("<i4").tobytes()]), pa.array([b""]), pa.array([b""])], names=[*ids, "x", "code", "radius"])

    return lean.mapInArrow(run, f"{kinds}, x binary, code binary, radius binary")


def assigned(blocks: DataFrame, books: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """The blocks with the entries nearest under ``books`` and the sums of each entry's parts.

    sums: for part, entry and component the sum, then for part and entry the count.  moved None: no earlier entry.
    """
    parts, k, width = books.shape
    schema = blocks.drop("sums").schema.add("sums", ArrayType(LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.schema.names
            for r in range(len(b)):
                raw = b.column(names.index("x"))[r].as_py()
                x = np.frombuffer(raw, "<i4").reshape(-1, parts, width).astype(np.int64)
                code, radii = np.zeros((len(x), parts), np.uint8), np.zeros((parts, k), np.int64)
                sums, counts = np.zeros((parts, k, width), np.int64), np.zeros((parts, k), np.int64)
                if moved is not None:
                    was = np.frombuffer(b.column(names.index("code"))[r].as_py(), np.uint8).reshape(-1, parts)
                    then = np.frombuffer(b.column(names.index("radius"))[r].as_py(), "<i8").reshape(parts, k)
                for p in range(parts):
                    v = np.ascontiguousarray(x[:, p])
                    if moved is None:
                        at, d = assign_all(v, books[p])
                        np.maximum.at(radii[p], at, d)
                    else:
                        at, radii[p] = assign_balls(v, was[:, p].astype(np.int64), books[p], moved[p], then[p])
                    code[:, p], counts[p] = at, np.bincount(at, minlength=k)
                    for c in range(width):  # sums of a block stay far below 2^53
                        sums[p, :, c] = np.bincount(at, weights=v[:, c], minlength=k)
                new = {"code": code.tobytes(), "radius": radii.astype("<i8").tobytes(), "sums": np.concatenate([sums.ravel(), counts.ravel()])}
                yield pa.RecordBatch.from_arrays([pa.array([new[f.name]]) if f.name in new else b.column(names.index(f.name)).slice(r, 1) for f in schema], names=schema.names)

    return blocks.mapInArrow(run, schema)


def added(blocks: DataFrame, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of all blocks: one row a number of the codebooks."""
    parts, k, width = books.shape
    total = np.zeros(parts * k * (width + 1), dtype=object)
    cells = blocks.select(F.posexplode("sums").alias("i", "n")).groupBy("i").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
    for r in cells.collect():
        total[r["i"]] = int(r["n"])
    return total[: books.size].reshape(books.shape), total[books.size :].reshape(parts, k)


def moved_books(books: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each entry the floor of its parts' mean; unused ones as they are."""
    out = books.copy()
    for p, j in np.ndindex(*counts.shape):
        if counts[p, j]:
            out[p, j] = [int(s) // int(counts[p, j]) for s in sums[p, j]]
    return out


def first_books(rows: DataFrame, vid: str, vec: str, entries: int, parts: int, width: int) -> np.ndarray:
    first = rows.orderBy(F.col(vid).asc_nulls_last(), F.col(vec)).limit(entries).select(vec).collect()
    x = np.zeros((len(first), parts * width), np.float64)
    for i, r in enumerate(first):
        x[i, : len(r[0])] = r[0]
    return as_integers(x, width).reshape(len(first), parts, width).transpose(1, 0, 2).copy()


def train(rows: DataFrame, ids: list[str], vid: str, vec: str, parts: int, entries: int, rounds: int) -> tuple[DataFrame, np.ndarray, np.ndarray | None] | None:
    """The blocks as the last round assigned them, the codebooks that came of it and which entries moved; None for no rows."""
    longest = rows.agg(F.max(F.size(vec)).alias("n")).first()["n"]
    if longest is None:
        return None
    width = max(1, -(-longest // parts))
    books = first_books(rows, vid, vec, entries, parts, width)
    blocks, moved, held = materialize(first_blocks(rows, ids, width, parts, vec), "vectors"), None, None
    for _ in range(rounds):
        blocks = assigned(blocks, books, moved).persist(StorageLevel.DISK_ONLY)
        new = moved_books(books, *added(blocks, books))
        if held is not None:
            held.unpersist()
        moved, books, held = (new != books).any(axis=2), new, blocks
    return blocks, books, moved


def coded_rows(blocks: DataFrame, ids: list[str], books: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """The id columns, code and error of every row under the last codebooks."""
    parts, k, width = books.shape
    last = assigned(blocks, books, moved).drop("radius", "sums")
    kinds = ", ".join(f"{c} {last.schema[c].dataType.elementType.simpleString()}" for c in ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.schema.names
            for r in range(len(b)):
                x = np.frombuffer(b.column(names.index("x"))[r].as_py(), "<i4").reshape(-1, parts, width).astype(np.int64)
                raw = b.column(names.index("code"))[r].as_py()
                code = np.frombuffer(raw, np.uint8).reshape(-1, parts)
                error = sum(squared(x[:, p], books[p][code[:, p]]) for p in range(parts))
                text = raw.hex()
                codes = pa.array([text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)], pa.string())
                yield pa.RecordBatch.from_arrays([*(b.column(names.index(c)).slice(r, 1).flatten() for c in ids), codes, pa.array(error, pa.int64())], names=[*ids, "code", "error"])

    return last.mapInArrow(run, f"{kinds}, code string, error long")


def compress(vectors: DataFrame, vid: str = "vec_id", vec: str = "embedding", label: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6) -> tuple[DataFrame, np.ndarray]:
    """(id, label, code and error of every kept row; the codebooks as [parts, entries, width])."""
    if not 0 < entries <= 256:
        raise ValueError("entries must be from 1 to 256: a code is one byte a part")
    rows = vectors.select(vid, label, vec).where(finite(vec))
    found = train(rows, [vid, label], vid, vec, parts, entries, rounds)
    if found is None:
        kinds = dict(rows.dtypes)
        return vectors.sparkSession.createDataFrame([], f"{vid} {kinds[vid]}, {label} {kinds[label]}, code string, error long"), np.zeros((parts, 0, 0), np.int64)
    blocks, books, moved = found
    coded = materialize(coded_rows(blocks, [vid, label], books, moved), "codes")
    blocks.unpersist()
    return coded, books


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all components in order of part, entry and place, as decimals with commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def code_report(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every kept row."""
    coded, books = compress(vectors)
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    own, sums = coded.alias("c"), by_label.alias("s")
    joined = own.join(sums, F.col("c.label").eqNullSafe(F.col("s.label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
