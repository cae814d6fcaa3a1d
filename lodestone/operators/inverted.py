"""A stored inverted index for BM25, and the k best documents of a batch of queries by block-max pruning.

Documents fall into intervals of about ``docs_per_interval`` by a hash of their
ids, so every term's postings are cut at the same places: a block is the
postings of one term in one interval.  An interval's documents meet in one
group, where their words are counted and cut into blocks; from then on only
packs travel.  A row of the table ``packs`` holds the blocks of one interval
whose terms share a ``bucket``, a hash of the term: the documents and their
lengths, the terms, where each term's postings end, and for each posting the
place of its document and how often the term stands there.  Packs are laid out
in folders by bucket, and a bucket's in slices of intervals.  ``blocks`` shows
them a row a block: term, interval, its largest impact and its postings (id,
impact), where the impact of a posting is its share of the score before the
term's idf.  The table ``terms`` holds each term's frequencies, ``statistics``
one row.

A search takes its terms' postings out of the packs and deals them by interval.
In a task, the largest impacts bound what a query can reach in the next
intervals; the k-th best score of those before rules it out where that is less.
The result is exact: bounds and scores add the same impacts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.words import hashes, text_columns, text_parts, words_of
from lodestone.operators.retrieval import _term_blocks, top_k
from lodestone.storage import bounded_batches, materialize, new_path, parts

#: Folders of terms, and that of the documents.
BUCKETS, DOCUMENTS = 64, -1
#: Scores are compared after rounding to this many digits.
DIGITS = 6
#: Intervals of a bucket that are written by one task, bits of the bitmap of compounds, and postings that are scored together.
SLICE, COMPOUND_BITS, SCORED = 4096, 1 << 24, 1 << 20


def buckets(words: pa.Array) -> np.ndarray:
    """The bucket of each word."""
    return (hashes(words) % np.uint64(BUCKETS)).astype(np.int64)


def _longs(a: pa.Array) -> np.ndarray:
    return a.to_numpy(zero_copy_only=False).astype(np.int64)


def term_counts(documents: DataFrame, did: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """did, term, tf and dl of every different token of every document, counted inside its row."""
    lean = bounded_batches(documents.select(did, tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 1):
            length = pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy().astype(np.int64)
            coded = pc.list_flatten(b.column(1)).dictionary_encode()
            n = max(1, len(coded.dictionary))
            pair, tf = np.unique(np.repeat(np.arange(len(b)), length) * n + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
            row = pair // n
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), coded.dictionary.take(pa.array(pair % n)), pa.array(tf.astype(np.int64)), pa.array(length[row])], names=[did, "term", "tf", "dl"])

    return lean.mapInArrow(run, f"{did} {lean.schema[did].dataType.simpleString()}, term string, tf long, dl long")


def with_compounds(counts: DataFrame, splits: DataFrame, did: str = "doc_id") -> DataFrame:
    """Counts of the documents with every compound followed by its parts; documents without any stay as they are.

    ``splits`` (word, parts) is joined on terms, not on texts: the order of words does not matter here.
    """
    parts = splits.select(F.col("word").alias("term"), "parts")
    added = counts.join(parts, "term").select(did, F.explode("parts").alias("term"), "tf")
    longer = added.groupBy(did).agg(F.sum("tf").alias("more"))
    merged = counts.select(did, "term", "tf").unionByName(added).groupBy(did, "term").agg(F.sum("tf").alias("tf"))
    lengths = counts.groupBy(did).agg(F.max("dl").alias("dl")).join(longer, did, "left").select(did, (F.col("dl") + F.coalesce("more", F.lit(0))).alias("dl"))
    return merged.join(lengths, did)


def different_words(documents: DataFrame, text: str = "text", least: int = 1) -> DataFrame:
    """(word): the different words of at least so many characters of all documents."""
    lean = bounded_batches(documents.select(*text_columns(text)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_parts(batches, 0, 1):
            own = pc.unique(words_of(b.column(0), b.column(1))[1])
            yield pa.RecordBatch.from_arrays([own.filter(pc.greater_equal(pc.utf8_length(own), least))], names=["word"])

    return lean.mapInArrow(run, "word string").distinct()


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array((hashes(b.column(0)) % np.uint64(COMPOUND_BITS)).astype(np.int64))], names=["_b"])


def compound_parts(documents: DataFrame, splits: DataFrame, did: str = "doc_id", text: str = "text") -> DataFrame:
    """(did, terms, tf): the parts of every different compound of every document, and how often it stands there.

    A bitmap of ``COMPOUND_BITS`` tells what is surely no compound, so that few
    other words meet ``splits`` (word, parts) in the join.
    """
    bit = splits.select("word").mapInArrow(_bits, "_b long").withColumn("_b", F.col("_b") + 1)  # numbers of a bitmap begin at 1
    marked = bit.groupBy(F.expr("bitmap_bucket_number(_b)").alias("n"))
    rows = marked.agg(F.expr("bitmap_construct_agg(bitmap_bit_position(_b))").alias("bits")).collect()  # COMPOUND_BITS at most
    bits = np.zeros((COMPOUND_BITS >> 15, 4096), np.uint8)
    for r in rows:
        bits[r["n"] - 1] = np.frombuffer(bytes(r["bits"]), np.uint8)
    shared = documents.sparkSession.sparkContext.broadcast(bits.reshape(-1))
    lean = bounded_batches(documents.where(F.col(did).isNotNull()).select(did, *text_columns(text)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in text_parts(batches, 1, 2):
            length, flat = words_of(b.column(1), b.column(2))
            coded = flat.dictionary_encode()
            at = (hashes(coded.dictionary) % np.uint64(COMPOUND_BITS)).astype(np.int64)
            maybe = (bits[at >> 3] >> (at & 7)) & 1 > 0
            code, row, n = _longs(coded.indices), np.repeat(np.arange(len(b)), length), max(1, len(coded.dictionary))
            kept = maybe[code]
            pair, tf = np.unique(row[kept] * n + code[kept], return_counts=True)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(pair // n)), coded.dictionary.take(pa.array(pair % n)), pa.array(tf.astype(np.int64))], names=[did, "word", "tf"])

    found = lean.mapInArrow(run, f"{did} {lean.schema[did].dataType.simpleString()}, word string, tf long").join(splits.select("word", "parts"), "word")
    return found.select(did, F.col("parts").alias("terms"), F.transform("parts", lambda _: F.col("tf")).alias("tf"))


@dataclass(frozen=True)
class InvertedIndex:
    """A written index; ``build`` and ``index_texts`` make one, ``InvertedIndex.open`` finds it again."""

    spark: SparkSession
    path: str
    n_docs: int
    avgdl: float
    id_type: str
    k1: float = 1.2
    b: float = 0.75

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> InvertedIndex:
        s = spark.read.parquet(f"{path}/statistics").first()
        return cls(spark, path, s["n_docs"], s["avgdl"], s["id_type"], s["k1"], s["b"])

    def packs(self, folders: list[int] | None = None) -> DataFrame:
        """The packs of the given buckets, of all if none are given, and those of the documents."""
        rows = self.spark.read.schema(_pack_shape(self.id_type)).parquet(f"{self.path}/packs")
        return rows if folders is None or len(folders) == BUCKETS else rows.where(F.col("bucket").isin(sorted(folders) + [DOCUMENTS]))

    def impact(self) -> partial:
        """The impact of a posting by its tf and dl, as columns or arrays."""
        return partial(_impact, avgdl=self.avgdl or 1.0, k1=self.k1, b=self.b)

    def blocks(self, folders: list[int] | None = None) -> DataFrame:
        impact = self.impact()
        begin = lambda i: F.when(i > 0, F.element_at("ends", i)).otherwise(F.lit(0))
        posting = lambda j: F.struct(F.get("docs", F.get("at", j)).alias("id"), impact(F.get("tf", j), F.get("dl", F.get("at", j))).alias("impact"))
        held = lambda i: F.filter(F.transform(F.sequence(begin(i), F.get("ends", i) - 1), posting), lambda p: p.id.isNotNull())
        rows = self.packs(folders)
        met = rows.where(F.col("bucket") != DOCUMENTS).drop("docs", "dl").join(rows.where(F.col("bucket") == DOCUMENTS).select("interval", "docs", "dl"), "interval")
        each = met.select("interval", "bucket", F.explode(F.transform("terms", lambda w, i: F.struct(w.alias("term"), held(i).alias("postings")))).alias("x"))
        largest = F.array_max(F.transform("x.postings", lambda p: p.impact))
        return each.where(F.size("x.postings") > 0).select("x.term", "interval", largest.alias("largest"), "x.postings", "bucket")

    def terms(self) -> DataFrame:
        return self.spark.read.schema("term string, df long, cf long").parquet(f"{self.path}/terms")


def _impact(tf, dl, avgdl: float, k1: float, b: float):
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def _pack_shape(id_type: str) -> str:
    return f"interval long, docs array<{id_type}>, dl array<long>, terms array<string>, ends array<int>, at array<int>, tf array<long>, bucket int"


def build(counts: DataFrame, n_docs: int, n_texts: int | None = None, did: str = "doc_id", path: str | None = None, docs_per_interval: int = 64, k1: float = 1.2, b: float = 0.75) -> InvertedIndex:
    """Write the index of counted documents (did, term, tf); rows without an id are counted, but have no postings.

    n_docs: all rows, for the idf.  n_texts: rows that have a text, for the mean length; all of them if not given.
    """
    by_document = counts.groupBy(did, "dl").agg(F.collect_list(F.struct("term", "tf")).alias("x"))
    none = F.lit(None)
    rows = by_document.select(did, none.cast("string").alias("plain"), none.cast("array<string>").alias("words"), F.col("x.term").alias("terms"), F.col("x.tf").cast("array<long>").alias("tf"))
    return _write(rows, n_docs, n_texts, did, path, docs_per_interval, k1, b)


def index_texts(documents: DataFrame, n_docs: int, n_texts: int | None = None, more: DataFrame | None = None, did: str = "doc_id", text: str = "text", path: str | None = None, docs_per_interval: int = 64, k1: float = 1.2, b: float = 0.75) -> InvertedIndex:
    """Write the index of documents as ``build`` does, from their texts.

    more: words besides those of the texts, (did, terms, tf) in any number of rows for a document.
    """
    rows = documents.select(did, *text_columns(text), F.lit(None).cast("array<string>").alias("terms"), F.lit(None).cast("array<long>").alias("tf"))
    if more is not None:
        rows = rows.unionByName(more.select(did, F.lit(None).cast("string").alias("plain"), F.lit(None).cast("array<string>").alias("words"), "terms", "tf"))
    return _write(rows, n_docs, n_texts, did, path, docs_per_interval, k1, b)


def _write(rows: DataFrame, n_docs: int, n_texts: int | None, did: str, path: str | None, docs_per_interval: int, k1: float, b: float) -> InvertedIndex:
    spark = rows.sparkSession
    path, id_type = path or new_path(spark, "index"), rows.schema[did].dataType.simpleString()
    intervals = max(1, -(-n_docs // docs_per_interval))
    # rows without an id are spread by what they hold
    dealt = F.when(F.col(did).isNotNull(), F.xxhash64(did)).otherwise(F.xxhash64("plain", "words", "terms"))
    packed = rows.withColumn("interval", F.pmod(dealt, F.lit(intervals))).groupBy("interval").applyInArrow(_packer(did), _pack_shape(id_type))
    packed.repartition("bucket", F.floor(F.col("interval") / SLICE)).write.partitionBy("bucket").parquet(f"{path}/packs")
    index = InvertedIndex(spark, path, n_docs, 0.0, id_type, k1, b)
    lean = bounded_batches(index.packs().where(F.col("bucket") != DOCUMENTS).select("terms", "ends", "tf"))
    lean.mapInArrow(_frequencies, "term string, df long, cf long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).write.parquet(f"{path}/terms")
    avgdl = (index.terms().agg(F.sum("cf").alias("n")).first()["n"] or 0) / max(1, n_docs if n_texts is None else n_texts)
    spark.range(0, 1, 1, 1).select(F.lit(n_docs).cast("long").alias("n_docs"), F.lit(float(avgdl)).alias("avgdl"), F.lit(id_type).alias("id_type"), F.lit(float(k1)).alias("k1"), F.lit(float(b)).alias("b")).write.parquet(f"{path}/statistics")
    return InvertedIndex(spark, path, n_docs, float(avgdl), id_type, k1, b)


def _packer(did: str):
    """The packs of an interval's rows.  Rows that share an id are one document."""

    def pack(t: pa.Table) -> pa.Table:
        ids, plain, words, terms, tf, interval = (t[c].combine_chunks() for c in (did, "plain", "words", "terms", "tf", "interval"))
        coded = ids.dictionary_encode()
        doc = _longs(pc.fill_null(coded.indices, -1))
        none = np.flatnonzero(doc < 0)
        doc[none] = len(coded.dictionary) + np.arange(len(none))
        docs = pa.concat_arrays([coded.dictionary, pa.nulls(len(none), ids.type)])
        length, flat = words_of(plain, words)
        more = _longs(pc.fill_null(pc.list_value_length(terms), 0))
        owner = np.concatenate([np.repeat(doc, length), np.repeat(doc, more)])
        times = np.concatenate([np.ones(len(flat), np.int64), _longs(pc.list_flatten(tf))])
        held = pa.concat_arrays([flat, pc.list_flatten(terms)]).dictionary_encode()
        number = buckets(held.dictionary)
        order = np.argsort(number, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        # postings by bucket, term and document
        n = max(1, len(docs))
        pair, inverse = np.unique(place[_longs(held.indices)] * n + owner, return_inverse=True)
        tf = np.bincount(inverse, times, len(pair)).astype(np.int64)
        dl = np.bincount(owner, times, len(docs)).astype(np.int64)
        number, starts = np.unique(number[order], return_index=True)
        cuts = np.append(starts, len(order))
        ends = np.searchsorted(pair, (np.arange(len(order)) + 1) * n)
        edges = np.concatenate([[0], ends[cuts[1:] - 1]]) if len(order) else np.zeros(1, np.int64)
        # the documents' pack comes first
        lists = lambda offsets, values: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], offsets]), pa.int32()), values)
        alone = np.concatenate([[0], np.full(len(number) + 1, len(docs))])
        columns = [
            pa.array(np.full(len(number) + 1, interval[0].as_py(), np.int64)), pa.ListArray.from_arrays(pa.array(alone, pa.int32()), docs), pa.ListArray.from_arrays(pa.array(alone, pa.int32()), pa.array(dl)),
            lists(cuts, held.dictionary.take(pa.array(order))), lists(cuts, pa.array((ends - np.repeat(edges[:-1], np.diff(cuts))).astype(np.int32))),
            lists(edges, pa.array((pair % n).astype(np.int32))), lists(edges, pa.array(tf)), pa.array(np.concatenate([[DOCUMENTS], number]).astype(np.int32)),
        ]
        return pa.Table.from_arrays(columns, names=["interval", "docs", "dl", "terms", "ends", "at", "tf", "bucket"])

    return pack


def _sizes(ends: pa.Array) -> np.ndarray:
    """How many postings each block has, over all rows."""
    flat, n = _longs(pc.list_flatten(ends)), _longs(pc.list_value_length(ends))
    sizes = np.diff(flat, prepend=0)
    first = (np.cumsum(n) - n)[n > 0]
    sizes[first] = flat[first]
    return sizes


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document and corpus frequencies of terms, in parts."""
    for b in parts(batches, 2):
        sizes, coded = _sizes(b.column(1)), pc.list_flatten(b.column(0)).dictionary_encode()
        if not len(sizes):
            continue
        cf = np.add.reduceat(_longs(pc.list_flatten(b.column(2))), np.cumsum(sizes) - sizes)
        n, at = len(coded.dictionary), _longs(coded.indices)
        yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(np.bincount(at, sizes, n).astype(np.int64)), pa.array(np.bincount(at, cf, n).astype(np.int64))], names=["term", "df", "cf"])


def weights(index: InvertedIndex, queries: DataFrame, qid: str = "query_id", terms: str = "terms") -> DataFrame:
    """(qid, term, idf) of the query terms that the index has."""
    wanted = queries.select(qid, F.explode(F.array_distinct(terms)).alias("term")).distinct()
    n = F.lit(float(index.n_docs))
    return wanted.join(index.terms(), "term").select(qid, "term", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def needed_blocks(index: InvertedIndex, wanted: DataFrame) -> DataFrame:
    """The blocks in the folders of the wanted terms: at most ``BUCKETS`` numbers come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(buckets(b.column(0)))], names=["b"])

    return index.blocks([r["b"] for r in wanted.select("term").mapInArrow(run, "b long").distinct().collect()])


def bounds(index: InvertedIndex, wanted: DataFrame, qid: str = "query_id") -> DataFrame:
    """For each query and interval, a bound on the scores of the interval's documents."""
    peaks = needed_blocks(index, wanted).select("term", "interval", "largest")
    return peaks.join(wanted, "term").groupBy(qid, "interval").agg(F.sum(F.col("idf") * F.col("largest")).alias("bound"))


def scores(index: InvertedIndex, wanted: DataFrame, pairs: DataFrame, qid: str = "query_id", did: str = "doc_id") -> DataFrame:
    """Scores of all documents in the given (query, interval) pairs."""
    asked = pairs.select(qid, "interval").join(wanted, qid)
    held = needed_blocks(index, wanted).select("term", "interval", "postings").join(asked, ["term", "interval"])
    each = held.select(qid, "idf", F.explode("postings").alias("p")).select(qid, F.col("p.id").alias(did), (F.col("idf") * F.col("p.impact")).alias("s"))
    return each.groupBy(qid, did).agg(F.round(F.sum("s"), DIGITS).alias("bm25"))


def search(index: InvertedIndex, queries: DataFrame, k: int, qid: str = "query_id", did: str = "doc_id", terms: str = "terms", probe: int = 4, block_bytes: int = 16 << 20) -> DataFrame:
    """The k best documents of each query, ties to the smaller id, ranked from 1.

    Queries travel in blocks of at most ``block_bytes`` of terms.  The wanted
    terms' postings are dealt by interval, so a task has all of an interval's;
    it keeps its k best of every query, and pairs of query and document are
    never shuffled.

    probe: how many intervals at least are scored together before others are ruled out; it changes the work, not the result.
    """
    spark = index.spark
    wanted = materialize(weights(index, queries, qid, terms), "weights")
    shape = f"{qid} {queries.schema[qid].dataType.simpleString()}, {did} {index.id_type}, bm25 double"
    out = None
    for block in _term_blocks(wanted, qid, block_bytes):
        shared = spark.sparkContext.broadcast(block)  # at most block_bytes
        folders = sorted(set(buckets(pa.array(block[1], pa.string())).tolist()))
        packs = bounded_batches(index.packs(folders).select("interval", "docs", "dl", "terms", "ends", "at", "tf"))
        held = packs.mapInArrow(_picker(shared), f"interval long, docs array<{index.id_type}>, dl array<long>, term array<int>, at array<int>, tf array<long>")
        dealt = bounded_batches(held.repartition("interval").sortWithinPartitions("interval"))
        part = dealt.mapInArrow(_scorer(shared, k, probe, index.impact(), qid, did), shape)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], shape)
    return top_k(out, [qid], [F.desc("bm25"), F.col(did)], k)


def _picker(shared):
    """The wanted terms' postings of each pack, with numbers for terms; packs of documents stay whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pa.array(shared.value[1], pa.string())
        for b in parts(batches, 5):
            found = _longs(pc.fill_null(pc.index_in(pc.list_flatten(b.column(3)), value_set=words), -1))
            sizes, n = _sizes(b.column(4)), _longs(pc.list_value_length(b.column(5)))
            kept = np.repeat(found >= 0, sizes)
            edges = np.concatenate([[0], np.cumsum(np.bincount(np.repeat(np.arange(len(b)), n)[kept], minlength=len(b)))])
            lists = lambda values, cuts=pa.array(edges, pa.int32()): pa.ListArray.from_arrays(cuts, values)
            mask = pa.array(kept)
            out = pa.RecordBatch.from_arrays([*b.columns[:3], lists(pa.array(np.repeat(found, sizes)[kept].astype(np.int32))), *(lists(pc.list_flatten(b.column(c)).filter(mask)) for c in (5, 6))], names=["interval", "docs", "dl", "term", "at", "tf"])
            yield out.filter(pa.array((np.diff(edges) > 0) | (_longs(pc.list_value_length(b.column(1))) > 0)))

    return run


def _scorer(shared, k: int, probe: int, impact_of, qid: str, did: str):
    """A task's k best of every query over postings in order of their intervals."""

    def whole_intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += pc.sum(pc.list_value_length(b.column(3))).as_py() or 0
            if size >= SCORED:
                t = pa.Table.from_batches(held).combine_chunks()
                of = t["interval"].to_numpy()
                cut = int(np.searchsorted(of, of[-1]))
                if cut:
                    yield t.slice(0, cut)
                held, size = t.slice(cut).to_batches(), 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, words, idf, ends, asking = shared.value
        of_term = np.repeat(np.arange(len(words)), np.diff(ends))
        by_query = np.argsort(asking, kind="stable")
        query_terms = [x.tolist() for x in np.split(of_term[by_query], np.flatnonzero(np.diff(asking[by_query])) + 1)]  # every query of a block has a term
        best_q, best_s, best_i, kth, kind = np.zeros(0, np.int64), np.zeros(0), None, np.full(len(names), -np.inf), None
        for t in whole_intervals(b for b in batches if len(b)):
            length = _longs(pc.list_value_length(t["term"]).combine_chunks())
            of, ids = t["interval"].to_numpy(), pc.list_flatten(t["docs"]).combine_chunks()
            term, at, tf, dl = (_longs(pc.list_flatten(t[c]).combine_chunks()) for c in ("term", "at", "tf", "dl"))
            # an interval's documents stand in its one pack of them, in any place among its rows
            held = _longs(pc.list_value_length(t["docs"]).combine_chunks())
            here = np.flatnonzero(held)
            begin = (np.cumsum(held) - held)[here][np.searchsorted(of[here], of)]
            at += np.repeat(begin, length)
            impact, named = impact_of(tf, dl[at]), pc.is_valid(ids).to_numpy(zero_copy_only=False)[at]
            length = np.bincount(np.repeat(np.arange(len(of)), length)[named], minlength=len(of))
            term, at, impact = term[named], at[named], impact[named]
            kind, ids = ids.type, ids.to_numpy(zero_copy_only=False)[at]
            starts, cuts = np.concatenate([[0], np.cumsum(length)]), np.append(np.unique(of, return_index=True)[1], len(of)).tolist()
            lo = 0
            while lo < len(cuts) - 1:
                hi = min(lo + probe, len(cuts) - 1)
                while hi < len(cuts) - 1 and starts[cuts[hi + 1]] - starts[cuts[lo]] <= SCORED:
                    hi += 1
                some = slice(starts[cuts[lo]], starts[cuts[hi]])
                lo = hi
                docs, doc = np.unique(ids[some], return_inverse=True)
                n = len(docs)
                key, inverse = np.unique(term[some] * n + doc, return_inverse=True)
                added = np.bincount(inverse, impact[some], len(key))  # rows that share an id are one document
                edges = np.searchsorted(key, np.arange(len(words) + 1) * n)
                at, value = key % n, idf[key // n] * added
                # queries that the terms' largest impacts cannot bring to their k-th best are ruled out
                peak = np.zeros(len(words))
                held = np.flatnonzero(np.diff(edges))
                peak[held] = np.maximum.reduceat(value, edges[held])
                bound = np.bincount(asking, peak[of_term], len(names))
                found = [(best_q, best_s, np.zeros(0, np.int64))]
                edge = edges.tolist()
                for q in np.flatnonzero((bound > 0) & (bound >= kth - 10.0**-DIGITS)).tolist():
                    mine = [(edge[w], edge[w + 1]) for w in query_terms[q] if edge[w] < edge[w + 1]]
                    score = np.bincount(np.concatenate([at[x:y] for x, y in mine]), np.concatenate([value[x:y] for x, y in mine]), n)
                    d = np.flatnonzero((score > 0) & (score >= kth[q] - 10.0**-DIGITS))
                    s = np.floor(score[d] * 10**DIGITS + 0.5) / 10**DIGITS
                    hit = (s > 0) & (s >= (max(kth[q], np.partition(s, len(s) - k)[len(s) - k]) if len(s) > k else kth[q]))
                    found.append((np.full(int(hit.sum()), q), s[hit], d[hit]))
                q, s, d = (np.concatenate(x) for x in zip(*found, strict=True))
                i = docs[d] if best_i is None else np.concatenate([best_i, docs[d]])
                order = np.lexsort((np.unique(i, return_inverse=True)[1], -s, q))
                nth = np.arange(len(order)) - np.searchsorted(q[order], q[order], "left")
                kth[q[order[nth == k - 1]]] = s[order[nth == k - 1]]
                best_q, best_s, best_i = q[order[nth < k]], s[order[nth < k]], i[order[nth < k]]
        if best_i is not None:
            yield pa.RecordBatch.from_arrays([names.take(pa.array(best_q)), pa.array(best_i, kind), pa.array(best_s)], names=[qid, did, "bm25"])

    return run
