"""N-gram Jaccard join: exact links between documents by a count-vector R-tree.

Method.  A document is its set of 5-word shingles, hashed.  The hashes fall into
``groups`` groups; the counts by group are the document's point.  Two sets share
at most the summed minima of their points' coordinates, and a node of an R-tree
at most the summed minima with the node's upper corner, so nodes, then points,
that cannot reach the overlap which the threshold demands are left out; pairs
that survive are verified on the sets themselves.

Points are searched in cells.  Linked sets have a shingle in common among the
first ``n - ceil(t n) + 1`` of each under any one order of shingles, so a cell
is such a shingle, and no link is lost.  The order puts shingles that stand in
many documents last; their counts come from all documents.  A shingle that is
certainly in one document only is left out of points and cells: it can be in no
overlap.  Equal sets collapse before the search.  In a few rounds, every set of a
cell is compared with the cell's leader; what that joins needs no further
comparison, so groups of thousands of near copies cost a few comparisons a copy.
The R-tree then finds the remaining pairs across components, with large cells
dealt out as pairs of blocks.

Defined results.  Null, empty and blank texts have no shingles and no links;
their component is their own doc_id.  A row with a null doc_id takes part and
never names a component unless all rows of it are null.  Repeated rows are
linked with each other (if they have words) and each gets its row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import blank_words, byte_values, tidy
from lodestone.llm.graph import connected_components
from lodestone.llm.sketch import Levels, count_levels, in_bitmap, row_bitmap
from lodestone.storage import materialize

#: A shingle's level rises with the number of documents that have it.
LEVELS = (2, 16, 128)
_MULTIPLIERS = np.array([xxhash.xxh3_64_intdigest(bytes([i])) | 1 for i in range(16)], np.uint64)


class WordHashes(dict):
    """Memo of word hashes, bounded."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < 200_000:
            self[word] = value
        return value


def shingle_set(words: list[bytes], memo: WordHashes, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words are one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    size = min(k, len(h))
    n = len(h) - size + 1
    out = np.full(n, size, np.uint64)
    out *= _MULTIPLIERS[15]
    for i in range(size):
        out += h[i : i + n] * _MULTIPLIERS[i]
    out ^= out >> np.uint64(29)
    out *= _MULTIPLIERS[14]
    out ^= out >> np.uint64(32)
    return np.unique(out)


def set_key(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def shingle_levels(documents: DataFrame, bits: int, k: int = 5) -> Levels:
    """Frequency levels of all shingles over all documents; equal sets of a batch count once."""

    def shingles(texts: Iterator[bytes], memo: WordHashes) -> np.ndarray:
        sets: dict[bytes, np.ndarray] = {}
        for text in texts:
            s = shingle_set(blank_words(text), memo, k)
            if len(s):
                sets.setdefault(set_key(s), s)
        return np.concatenate(list(sets.values())) if sets else np.zeros(0, np.uint64)

    return count_levels(documents.select(F.col("text").cast("string").alias("text")), shingles, WordHashes, LEVELS, bits)


def prefix(shingles: np.ndarray, level: np.ndarray, t: tuple[int, int]) -> np.ndarray:
    """Places of the prefix shingles that may stand in another document.

    The order is by level, then by hash.  A shingle of level 0 is in one set only.
    """
    n = len(shingles)
    order = np.argsort(level, kind="stable")[: n - -(-t[0] * n // t[1]) + 1]
    return order[level[order] > 0]


def point(shared: np.ndarray, groups: int) -> np.ndarray:
    """Counts by group of hash, of the shingles that other sets may have too."""
    return np.bincount(((shared >> np.uint64(7)) % np.uint64(groups)).astype(np.int64), minlength=groups).astype("<u2" if len(shared) < 65536 else "<u4")


def points_of(values: list[bytes], groups: int) -> np.ndarray:
    """Stored points as rows of one array; those of very large sets have four bytes a coordinate."""
    if all(len(v) == 2 * groups for v in values):
        return np.frombuffer(b"".join(values), "<u2").reshape(-1, groups)
    return np.array([np.frombuffer(v, "<u2" if len(v) == 2 * groups else "<u4") for v in values], np.uint32)


def star(tokens: np.ndarray, level: np.ndarray, most: int) -> np.ndarray:
    """The most widespread of a set's prefix shingles, which near copies of one text have in common."""
    return tokens[np.lexsort((tokens, -level))[:most]]


def needed(a: np.ndarray, b: np.ndarray, t: tuple[int, int]) -> np.ndarray:
    """Least overlap of sets of sizes a and b whose Jaccard similarity is at least t."""
    return -(-t[0] * (a + b) // (t[0] + t[1]))


class CountTree:
    """R-tree over count vectors: packed by size and then by coordinates, upper corners only."""

    FAN = 16

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        slab = np.argsort(sizes, kind="stable")
        step = max(self.FAN, int(len(slab) ** 0.5) // self.FAN * self.FAN)
        self.order = np.concatenate([s[np.argsort(points[s].argmax(axis=1), kind="stable")] for s in np.array_split(slab, -(-len(slab) // step))])
        self.levels = [(points[self.order], sizes[self.order], sizes[self.order])]
        while len(self.levels[-1][0]) > 1:
            top, low, high = self.levels[-1]
            cuts = np.arange(0, len(top), self.FAN)
            self.levels.append((np.maximum.reduceat(top, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)))

    def pairs(self, other: CountTree, t: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (in the two inputs) whose points may be linked; of a tree with itself, each pair once."""
        same = other is self
        depth = max(len(self.levels), len(other.levels))
        at = lambda tree, d: tree.levels[min(d, len(tree.levels) - 1)]
        stack = [(depth - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            d, i, j = stack.pop()
            if len(i) > 8192:
                stack += [(d, i[8192:], j[8192:])]
                i, j = i[:8192], j[:8192]
            (p, plow, phigh), (q, qlow, qhigh) = at(self, d), at(other, d)
            fit = (t[1] * qhigh[j] >= t[0] * plow[i]) & (t[1] * phigh[i] >= t[0] * qlow[j])
            i, j = i[fit], j[fit]
            bound = np.minimum(p[i], q[j]).sum(axis=1, dtype=np.int64)
            fit = bound >= needed(plow[i], qlow[j], t)
            i, j = i[fit], j[fit]
            if not len(i):
                continue
            if d == 0:
                if same:
                    i, j = i[i < j], j[i < j]
                yield self.order[i], other.order[j]
                continue
            i, j = self._below(i, d), other._below(j, d)
            a = np.concatenate([np.repeat(x, len(y)) for x, y in zip(i, j, strict=True)])
            b = np.concatenate([np.tile(y, len(x)) for x, y in zip(i, j, strict=True)])
            stack.append((d - 1, a[a <= b], b[a <= b]) if same else (d - 1, a, b))

    def _below(self, nodes: np.ndarray, d: int) -> list[np.ndarray]:
        if d >= len(self.levels):
            return [np.array([x]) for x in nodes]
        n = len(self.levels[d - 1][0])
        return [np.arange(x * self.FAN, min(n, (x + 1) * self.FAN)) for x in nodes]


def signatures(documents: DataFrame, levels: Levels, t: tuple[int, int], groups: int, k: int = 5, leaders: int = 6) -> DataFrame:
    """One row per document row, written once: doc_id, row hash, set size and key, point, prefix, its most widespread shingles, and share of common shingles."""
    shared = documents.sparkSession.sparkContext.broadcast(levels)  # bitmaps of a fixed number of bits
    names = ["doc_id", "row", "n", "key", "point", "tokens", "widest", "common"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for b in batches:
            sizes, keys, points, tokens, widest, common = [], [], [], [], [], []
            for text in byte_values(b.column(2)):
                s = shingle_set(blank_words(text), memo, k)
                level = shared.value.of(s)
                own = prefix(s, level, t) if len(s) else np.zeros(0, np.int64)
                mine = s[own].view(np.int64)
                sizes.append(len(s))
                keys.append(set_key(s) if len(s) else None)
                tokens.append(mine)
                widest.append(star(mine, level[own], leaders))
                points.append(point(s[level > 0], groups).tobytes() if len(own) else None)
                common.append(float((level > 1).sum() / len(s)) if len(s) else 0.0)
            columns = (pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(points, pa.binary()), pa.array(tokens, pa.list_(pa.int64())), pa.array(widest, pa.list_(pa.int64())), pa.array(common, pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=names)

    lean = documents.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), F.col("text").cast("string").alias("text"))
    kind = lean.schema["doc_id"].dataType.simpleString()
    out = materialize(lean.mapInArrow(run, f"doc_id {kind}, row long, n long, key binary, point binary, tokens array<long>, widest array<long>, common double"), "signatures")
    shared.destroy()
    tidy(documents.sparkSession)
    return out


def _verified(documents: DataFrame, sets: DataFrame, pairs: DataFrame, t: tuple[int, int], k: int) -> DataFrame:
    """The pairs (a, b) of set ids that are links; texts are read again only to rebuild the sets in question."""
    spark = documents.sparkSession
    asked = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    wanted = materialize(sets.select("sid", "key", "row").join(asked, "sid", "left_semi"), "wanted_sets")
    shared = spark.sparkContext.broadcast(row_bitmap(wanted))  # a bounded number of bits

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, done = WordHashes(), set()
        for b in batches:
            ask = in_bitmap(shared.value, b.column(0).to_numpy())
            keys, values = [], []
            for text in byte_values(b.column(1).filter(pa.array(ask))):
                s = shingle_set(blank_words(text), memo, k)
                key = set_key(s)
                if len(s) and key not in done:
                    if len(done) < 100_000:
                        done.add(key)
                    keys.append(key)
                    values.append(s.tobytes())
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(values, pa.binary())], names=["key", "shingles"])

    lean = documents.select(F.xxhash64("doc_id", "text").alias("row"), F.col("text").cast("string").alias("text"))
    rebuilt = lean.mapInArrow(rebuild, "key binary, shingles binary").dropDuplicates(["key"]).join(wanted.select("key", "sid"), "key")
    rebuilt = materialize(rebuilt, "shingle_sets")
    shared.destroy()
    tidy(spark)
    of = lambda c: rebuilt.select(F.col("sid").alias(c), F.col("shingles").alias(f"s{c}"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                common = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
                keep.append(t[1] * common >= t[0] * (len(p) + len(q) - common))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.select("a", "b").join(of("b"), "b").join(of("a"), "a").select("a", "b", "sa", "sb")
    return materialize(joined.mapInArrow(check, "a long, b long"), "links")


def _tree_candidates(grouped: DataFrame, t: tuple[int, int], groups: int, block: int, bits: int) -> DataFrame:
    """Pairs of set ids of different components that share a cell and pass the tree's bounds.

    Cells of one component are done.  A bitmap of the other cells' shingles cuts
    the sets' prefixes before any point is sent.
    """
    lean = grouped.select(F.explode("tokens").alias("token"), "component")
    counts = lean.groupBy("token").agg(F.count("*").alias("m"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("m > 1 AND lo < hi").select("token", F.ceil(F.col("m") / block).cast("int").alias("k"))
    counts = materialize(counts, "open_cells")
    shared = grouped.sparkSession.sparkContext.broadcast(row_bitmap(counts, bits, "token"))  # a bounded number of bits

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = [x[in_bitmap(shared.value, x)] for x in (np.asarray(v, np.int64) for v in b.column(4).to_pylist())]
            some = [i for i, x in enumerate(tokens) if len(x)]
            rest = b.take(pa.array(some, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rest.columns[:4], pa.array([tokens[i] for i in some], pa.list_(pa.int64()))], names=b.schema.names)

    base = grouped.select("sid", "n", "component", "point", "tokens")
    cells = base.mapInArrow(cut, base.schema).select(F.explode("tokens").alias("token"), "sid", "n", "component", "point")
    placed = cells.join(counts, "token").withColumn("own", F.pmod(F.xxhash64("sid"), F.col("k")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = dealt.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "sid", "component", "n", "point")

    def search(own: np.ndarray, i: int, j: int, ids: np.ndarray, component: np.ndarray, sizes: np.ndarray, points: np.ndarray) -> Iterator[np.ndarray]:
        sides = [np.flatnonzero(own == i)] if i == j else [np.flatnonzero(own == i), np.flatnonzero(own == j)]
        if any(len(s) == 0 for s in sides):
            return
        trees = [CountTree(points[s], sizes[s]) for s in sides]
        for p, q in trees[0].pairs(trees[-1], t):
            x, y = sides[0][p], sides[-1][q]
            apart = component[x] != component[y]
            yield np.sort(np.column_stack([ids[x[apart]], ids[y[apart]]]), axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: pa.Table) -> pa.RecordBatch:
            token, i, j, own, ids, component, sizes = (rows.column(c).to_numpy() for c in ("token", "i", "j", "own", "sid", "component", "n"))
            cut = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]), [True]]))
            points = points_of(rows.column("point").to_pylist(), groups)
            found = [np.zeros((0, 2), np.int64)]
            for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if z - a > 1 and (component[a:z] != component[a]).any():
                    found += search(own[a:z], int(i[a]), int(j[a]), ids[a:z], component[a:z], sizes[a:z], points[a:z])
            pairs = np.unique(np.concatenate(found), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        kept: pa.Table | None = None
        for b in batches:
            rows = pa.Table.from_batches([b])
            rows = pa.concat_tables([kept, rows]) if kept is not None and len(kept) else rows
            if not len(rows):
                continue
            token, i, j = (rows.column(c).to_numpy() for c in ("token", "i", "j"))
            last = np.flatnonzero((token != token[-1]) | (i != i[-1]) | (j != j[-1]))
            end = int(last[-1]) + 1 if len(last) else 0
            if end:
                yield flush(rows.slice(0, end))
            kept = rows.slice(end)  # at most two blocks of one cell
        if kept is not None and len(kept):
            yield flush(kept)

    return dealt.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(run, "a long, b long").distinct()


def similar_sets(documents: DataFrame, threshold: tuple[int, int] = (75, 100), groups: int = 256, k: int = 5, bits: int = 1 << 27, block: int = 4096, rounds: int = 2) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Signatures by row, different sets (with an id each), links between set ids that join them, and components by set id.

    threshold: Jaccard similarity as a fraction.  groups: coordinates of a
    point.  bits: of each frequency bitmap.  block: points of one cell that a
    task holds (times two).  rounds: of comparisons with leaders.
    """
    rows = signatures(documents, shingle_levels(documents, bits, k), threshold, groups, k)
    alike = ["row", "n", "point", "tokens", "widest", "common"]
    sets = rows.where("key IS NOT NULL AND point IS NOT NULL").groupBy("key").agg(F.min(F.struct(*alike)).alias("s")).select("key", *(F.col(f"s.{c}").alias(c) for c in alike))
    sets = materialize(sets.withColumn("sid", F.monotonically_increasing_id()), "sets")
    none = sets.select(F.col("sid").alias("a"), F.col("sid").alias("b")).limit(0)
    tested, links, known = none, none, none.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for turn in range(rounds):
        cells = _with_component(sets, known).select(F.explode("widest").alias("token"), "sid", "n", "common", "component")
        # first the set with the largest share of common shingles, which a group of near copies stems from; then any
        rank = F.struct("common", "sid") if turn == 0 else F.struct(F.xxhash64("sid", F.lit(turn)).alias("r"), "sid")
        leaders = cells.groupBy("token").agg(F.max_by(F.struct("sid", "n", "component"), rank).alias("leader"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token", "leader")
        near = cells.join(leaders, "token").where(f"component <> leader.component AND {threshold[1]} * least(n, leader.n) >= {threshold[0]} * greatest(n, leader.n)")
        asked = near.select(F.least("leader.sid", "sid").alias("a"), F.greatest("leader.sid", "sid").alias("b")).distinct()
        asked = _bounded(asked.join(tested, ["a", "b"], "left_anti"), sets, threshold, groups)
        tidy(documents.sparkSession)
        if asked.isEmpty():
            break
        tested, links = tested.union(asked), links.union(_verified(documents, sets, asked, threshold, k))
        known = connected_components(links)
        tidy(documents.sparkSession)
    found = _tree_candidates(_with_component(sets, known), threshold, groups, block, bits)
    more = materialize(found.join(tested, ["a", "b"], "left_anti"), "tree_pairs")
    if not more.isEmpty():
        links = links.union(_verified(documents, sets, more, threshold, k))
        known = connected_components(links)
    tidy(documents.sparkSession)
    return rows, sets, links, known


def _with_component(sets: DataFrame, known: DataFrame) -> DataFrame:
    return sets.join(known.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))


def _bounded(pairs: DataFrame, sets: DataFrame, t: tuple[int, int], groups: int) -> DataFrame:
    """The pairs whose points leave a link possible; written once."""
    of = lambda c: sets.select(F.col("sid").alias(c), F.col("n").alias(f"n{c}"), F.col("point").alias(f"p{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                p, q = (points_of(b.column(i).to_pylist(), groups) for i in (4, 5))
                bound = np.minimum(p, q).sum(axis=1, dtype=np.int64)
                yield b.select([0, 1]).filter(pa.array(bound >= needed(b.column(2).to_numpy(), b.column(3).to_numpy(), t)))

    joined = pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "na", "nb", "pa", "pb")
    return materialize(joined.mapInArrow(run, "a long, b long"), "leader_pairs")


def components(documents: DataFrame, **how) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) for every row."""
    rows, sets, _, known = similar_sets(documents, **how)
    own = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("first"))
    named = sets.select("key", "sid").join(known.withColumnRenamed("node", "sid"), "sid").join(own, "key").select("key", "component", "first")
    least = named.groupBy("component").agg(F.min("first").alias("least"))
    group = materialize(own.join(named.select("key", "component").join(least, "component"), "key", "left").select("key", F.coalesce("least", "first").alias("least")), "set_names")
    out = rows.select("doc_id", "n", "key").join(group, "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def keep_one_of_each(documents: DataFrame, **how) -> DataFrame:
    """One row of each component: of its smallest doc_id (null comes last), the first as written.

    Of rows without words only repeats of doc_id and text go.  Rows are told
    apart by a number that is written with them, so rows that share a doc_id
    are judged each by its own text.
    """
    rows = materialize(documents.select(F.struct("*").alias("own"), F.monotonically_increasing_id().alias("place")), "numbered_rows")
    name = F.struct(F.col("own.doc_id").isNull().alias("unnamed"), F.col("own.doc_id").alias("doc_id"), "place")
    found = components(rows.select(name.alias("doc_id"), F.col("own.text").alias("text")), **how)
    drop = found.where("doc_id.place <> component_id.place").select("doc_id.place")
    text = F.col("own.text").cast("string")
    blank = rows.where(text.isNull() | ~text.rlike(r"[^\x20\x09-\x0D]")).select(F.col("own.doc_id").alias("doc_id"), text.alias("text"), "place")
    again = blank.select("place").join(blank.groupBy("doc_id", "text").agg(F.min("place").alias("place")), "place", "left_anti")
    return rows.join(drop.union(again), "place", "left_anti").select("own.*")
