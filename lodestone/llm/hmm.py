"""Hidden Markov language model: Baum-Welch by partition sums, exact likelihood by scaled forward recursion.

Method.  Word counts come from all training documents.  The most frequent words
are symbols of their own; every other word belongs to one of a fixed number of
hash classes, and its probability is its class symbol's times its smoothed share
of the class.  Each iteration, every partition runs forward-backward over its
training sequences and sends its expected counts, one row a symbol; their sums
give the next model.  Scoring runs the scaled forward recursion over whole
documents, all documents of a batch side by side.

Training works on runs of ``run`` tokens side by side.  What a cut would lose is
carried over it: the transfer matrix of each run gives the exact state before
its first token and the exact backward message after its last, and the step over
the cut counts as any other, so the counts are those of whole documents.
Iterations end when the likelihood of a token gains less than ``tolerance``, and
after ``iterations`` in any case.

Counts of at most ``table_words`` words travel as a broadcast; tokens of rarer
words meet their counts in a join by word, so none is left out or guessed.

Defined results.  A null or empty text is its end token alone; texts of any
length are scored whole.  Of equally frequent words the lesser in byte order is
the symbol.  Columns beyond doc_id and text are never read.  A null doc_id
counts as held out.  With no training documents, base and model fall back to
their smoothing.  Repeated rows each train and each get their row.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import blank_words, byte_values, crc_of_id
from lodestone.storage import materialize

END = b""  # no word is empty


@dataclass(frozen=True)
class Words:
    """What counts say: the frequent words' counts, and totals."""

    counts: dict[bytes, int]
    symbols: dict[bytes, int]
    whole: bool
    total: int
    distinct: int
    class_total: np.ndarray
    class_distinct: np.ndarray

    @property
    def classes(self) -> int:
        return len(self.class_total)

    def base(self, c: int) -> float:
        return float(np.log10((c + 0.1) / (self.total + 0.1 * (self.distinct + 1))))

    def share(self, c: int, k: int) -> float:
        """log10 of a word's share of its class; all unknown words of a class together are one more."""
        return float(np.log10((c + 0.1) / (self.class_total[k] + 0.1 * (self.class_distinct[k] + 1))))


def class_of(word: bytes, classes: int) -> int:
    return zlib.crc32(word) % classes


def count_words(documents: DataFrame) -> DataFrame:
    """word, c over all rows of ``documents``; the end token is the empty word.  Written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in batches:
            for text in byte_values(b.column(0)):
                held.update(blank_words(text))
                held[END] += 1
            if len(held) > 400_000:
                yield send(held)
                held = Counter()
        yield send(held)

    def send(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])

    lean = documents.select(F.col("text").cast("string").alias("text"))
    return materialize(lean.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "word_counts")


def summarise(counts: DataFrame, symbols: int, classes: int, table_words: int) -> Words:
    """Totals and the most frequent words, at most ``table_words`` of them."""
    size = F.floor(F.log2("c") * 16).cast("int")
    steps = counts.groupBy(size.alias("size")).agg(F.count("*").alias("n"), F.sum("c").alias("c")).orderBy(F.desc("size")).collect()  # a row for each sixteenth of a doubling
    total, distinct = sum(r["c"] for r in steps), sum(r["n"] for r in steps)
    least, held = 1 << 30, 0
    for r in steps:
        if held + r["n"] > table_words:
            break
        least, held = r["size"], held + r["n"]
    table = {bytes(r["word"]): r["c"] for r in counts.where(size >= least).toLocalIterator()}
    table.setdefault(END, 0)
    top = sorted((w for w in table if w != END), key=lambda w: (-table[w], w))[: symbols - 1]
    own = {END: 0} | {w: i + 1 for i, w in enumerate(top)}
    by_class = counts.groupBy((F.crc32("word") % classes).cast("int").alias("k")).agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect()
    class_total, class_distinct = np.zeros(classes), np.zeros(classes)
    for r in by_class:
        class_total[r["k"]], class_distinct[r["k"]] = r["c"], r["n"]
    for w in own:
        if table[w]:
            class_total[class_of(w, classes)] -= table[w]
            class_distinct[class_of(w, classes)] -= 1
    return Words(table, own, held == distinct, total, distinct, class_total, class_distinct)


def encode(documents: DataFrame, words: Words, symbols: int, known_tokens: int = 300_000) -> DataFrame:
    """A row for each document row: its symbols, the parts of its scores that the table gives, and its rarer words.  Written once."""
    shared = documents.sparkSession.sparkContext.broadcast(words)  # at most table_words words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        classes, unknown = w.classes, w.base(0)

        class Entries(dict):
            """word -> place in ``rows``, which hold the symbol, base, share of the class and count of each word met."""

            def __init__(self):
                super().__init__()
                self.words: list[bytes] = []
                self.rows: list[tuple[int, float, float, int]] = []

            def __missing__(self, word: bytes) -> int:
                c = w.counts.get(word, -1)
                symbol = w.symbols.get(word)
                k = class_of(word, classes)
                if c < 0 and not w.whole:
                    value = (symbols + k, 0.0, 0.0, -1)
                else:
                    c = max(c, 0)
                    value = (symbols + k if symbol is None else symbol, w.base(c) if c else unknown, w.share(c, k) if symbol is None else 0.0, c)
                self[word] = at = len(self.rows)
                self.words.append(word)
                self.rows.append(value)
                return at

        entries = Entries()
        task, row = TaskContext.get().partitionId(), 0
        names = ["uid", "doc_id", "held_out", "n_tokens", "n_known", "base", "share", "symbols", "rare", "times"]
        for b in batches:
            if not len(b):
                continue
            if len(entries.rows) > known_tokens:
                entries = Entries()
            parts = []
            for text in byte_values(b.column(2)):
                tokens = [*blank_words(text), END]
                parts.append(np.fromiter(map(entries.__getitem__, tokens), np.int32, len(tokens)))
            ids = np.concatenate(parts)
            sizes = np.fromiter(map(len, parts), np.int64, len(parts))
            first = np.cumsum(sizes) - sizes
            symbol, base, share, count = (np.array(c) for c in zip(*entries.rows, strict=True))
            of, total = count[ids], lambda x: np.add.reduceat(x, first)
            rare: list[list[bytes]] = [[] for _ in parts]
            times: list[list[int]] = [[] for _ in parts]
            for i in np.flatnonzero(total((of < 0).astype(np.int64))).tolist():
                own, n = np.unique(parts[i][count[parts[i]] < 0], return_counts=True)
                rare[i], times[i] = [entries.words[k] for k in own.tolist()], n.tolist()
            flat = symbol.astype("<u2")[ids]
            codes = [flat[lo : lo + n].tobytes() for lo, n in zip(first.tolist(), sizes.tolist(), strict=True)]
            numbers = (pa.array(sizes), pa.array(total((of > 0).astype(np.int64))), pa.array(total(base[ids])), pa.array(total(share[ids])))
            yield pa.RecordBatch.from_arrays([pa.array((task << 36) + row + np.arange(len(b))), b.column(0), b.column(1), *numbers, pa.array(codes, pa.binary()), pa.array(rare, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int32()))], names=names)
            row += len(b)

    lean = documents.select("doc_id", (crc_of_id() % 10 == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    kind = lean.schema["doc_id"].dataType.simpleString()
    return materialize(lean.mapInArrow(run, f"uid long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, share double, symbols binary, rare array<binary>, times array<int>"), "encoded")


@dataclass(frozen=True)
class Model:
    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray  # states x symbols


def transfers(model: Model, runs: list[np.ndarray], side: int = 1024) -> np.ndarray:
    """For each run, up to a factor: chances of its tokens and of the state at its last, by the state at its first."""
    states = len(model.start)
    emit = np.ascontiguousarray(model.emit.T)
    out = np.zeros((len(runs), states, states))
    order = np.argsort([-len(r) for r in runs], kind="stable")
    for lo in range(0, len(order), side):
        group = order[lo : lo + side]
        lengths = np.array([len(runs[i]) for i in group])
        x = np.tile(np.eye(states), (len(group), 1, 1)) * emit[[runs[i][0] for i in group]][:, None, :]
        table = np.zeros((lengths[0], len(group)), np.int64)
        for j, i in enumerate(group):
            table[: lengths[j], j] = runs[i]
        for t in range(1, lengths[0]):
            n = int((lengths > t).sum())
            x[:n] = (x[:n].reshape(-1, states) @ model.step).reshape(n, states, states) * emit[table[t, :n]][:, None, :]
            if t % 16 == 0:
                x[:n] /= x[:n].sum(axis=(1, 2), keepdims=True)
        out[group] = x / x.sum(axis=(1, 2), keepdims=True)
    return out


def cut_runs(model: Model, sequences: list[np.ndarray], run: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Runs of all sequences, which are first, the states' shares at the token before each, and the backward message after its last."""
    runs = [s[i : i + run] for s in sequences for i in range(0, len(s), run)]
    pieces = [-(-len(s) // run) for s in sequences]
    first = np.zeros(len(runs), bool)
    first[np.cumsum([0, *pieces[:-1]])[np.array(pieces) > 0]] = True
    before, after = np.zeros((len(runs), len(model.start))), np.ones((len(runs), len(model.start)))
    several = np.flatnonzero(np.repeat(np.array(pieces) > 1, pieces))
    if len(several):
        matrix = dict(zip(several.tolist(), transfers(model, [runs[i] for i in several]), strict=True))
        for i in several.tolist():
            x = (model.start if first[i] else before[i] @ model.step) @ matrix[i]
            if i + 1 < len(runs) and not first[i + 1]:
                before[i + 1] = x / x.sum()
        for i in several[::-1].tolist():
            if not first[i]:
                y = model.step @ (matrix[i] @ after[i])
                after[i - 1] = y / y.sum()
    return runs, first, before, after


def expected_counts(model: Model, sequences: list[np.ndarray], run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, steps and emissions of the whole sequences, and their log likelihood; runs go side by side."""
    states, n_symbols = model.emit.shape
    starts, steps, emits, log = np.zeros(states), np.zeros((states, states)), np.zeros((states, n_symbols)), 0.0
    runs, first, before, after = cut_runs(model, sequences, run)
    order = np.argsort([-len(r) for r in runs], kind="stable")
    emit = np.ascontiguousarray(model.emit.T)
    for lo in range(0, len(runs), 1024):
        group = order[lo : lo + 1024]
        lengths = np.array([len(runs[i]) for i in group])
        top = lengths[0]
        table = np.zeros((top, len(group)), np.int64)
        for j, i in enumerate(group):
            table[: lengths[j], j] = runs[i]
        active = (lengths[None, :] > np.arange(top)[:, None]).sum(axis=1)
        alpha = np.zeros((top, len(group), states))
        scale = np.ones((top, len(group)))
        head = first[group]
        x = np.where(head[:, None], model.start, before[group] @ model.step)
        last = np.zeros((len(group), states))
        for t in range(top):
            n = active[t]
            x = (x[:n] if t == 0 else x[:n] @ model.step) * emit[table[t, :n]]
            total = x.sum(axis=1)
            x /= total[:, None]
            alpha[t, :n], scale[t, :n] = x, total
            last[:n] = x
        log += float(np.log(scale).sum())
        beta = after[group] / (last * after[group]).sum(axis=1, keepdims=True)
        weight = np.zeros((top, len(group), states))
        for t in range(top - 1, -1, -1):
            n = active[t]
            weight[t, :n] = alpha[t, :n] * beta[:n]
            onward = emit[table[t, :n]] * beta[:n] / scale[t, :n, None]
            if t:
                steps += alpha[t - 1, :n].T @ onward
                beta[:n] = onward @ model.step.T
            else:
                steps += before[group].T @ onward  # over the cut; zero before a first run
        starts += weight[0][head].sum(axis=0)
        seen = np.arange(top)[:, None] < lengths[None, :]
        at, weight = table[seen], weight[seen]
        for k in range(states):
            emits[k] += np.bincount(at, weights=weight[:, k], minlength=n_symbols)
    return starts, steps * model.step, emits, log


def forward_log10(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 likelihood of each whole sequence."""
    out = np.zeros(len(sequences))
    if not sequences:
        return out
    lengths = np.array([len(s) for s in sequences])
    order = np.argsort(-lengths, kind="stable")
    flat = np.concatenate([sequences[i] for i in order]).astype(np.int64)
    sizes = lengths[order]
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    active = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")
    emit = np.ascontiguousarray(model.emit.T)
    total = np.zeros(len(sequences))
    x = np.tile(model.start, (len(sequences), 1))
    held = np.ones(len(sequences))
    for t in range(sizes[0]):
        n = active[t]
        x = (x[:n] if t == 0 else x[:n] @ model.step) * emit[flat[begin[:n] + t]]
        s = x.sum(axis=1)
        x /= s[:, None]
        held[:n] *= s
        if t % 16 == 15:  # sixteen factors above 1e-12 each stay above the smallest double
            total += np.log10(held)
            held[:] = 1.0
    out[order] = total + np.log10(held)
    return out


def _sequences(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), "<u2") for x in column]


def train(encoded: DataFrame, n_symbols: int, frequency: np.ndarray, states: int = 6, iterations: int = 3, tolerance: float = 1e-3, run: int = 256, seed: int = 11) -> Model:
    """Baum-Welch over the training rows of ``encoded``; each iteration reads all of them."""
    spark = encoded.sparkSession
    rng = np.random.default_rng(seed)
    base = (frequency + 0.1) / (frequency + 0.1).sum()
    emit = base * np.exp(0.7 * rng.standard_normal((states, n_symbols)))
    step = 0.5 * np.eye(states) + rng.dirichlet(np.full(states, 5.0), states)
    model = Model(np.full(states, 1.0 / states), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))
    data = encoded.where("NOT held_out").select("symbols")
    size, before = states + 2 + n_symbols, -np.inf

    for _ in range(iterations):
        shared = spark.sparkContext.broadcast(model)  # states x symbols numbers

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            rows = np.zeros((size, states))
            for b in batches:
                starts, steps, emits, log = expected_counts(shared.value, _sequences(b.column(0)), run)
                rows[0] += starts
                rows[1 : states + 1] += steps
                rows[states + 1 : -1] += emits.T
                rows[-1, 0] += log
            full = np.flatnonzero(rows.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(list(rows[full]), pa.list_(pa.float64()))], names=["k", "v"])

        parts = data.mapInArrow(sums, "k long, v array<double>").groupBy("k").agg(*(F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(states)))
        rows = np.zeros((size, states))
        for r in parts.collect():  # states x symbols numbers
            rows[r["k"]] = [r[f"v{i}"] for i in range(states)]
        starts, steps, emits = rows[0] + 1e-2, rows[1 : states + 1] + 1e-2, rows[states + 1 : -1].T + 0.1 * base * states
        model = Model(starts / starts.sum(), steps / steps.sum(axis=1, keepdims=True), emits / emits.sum(axis=1, keepdims=True))
        shared.unpersist()
        each = rows[-1, 0] / max(1.0, rows[states + 1 : -1].sum())
        if each - before < tolerance:
            break
        before = each
    return model


def score(documents: DataFrame, symbols: int = 2048, classes: int = 256, table_words: int = 500_000, **fit) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    symbols: words that are symbols of their own, with the end token.  classes:
    of all other words.  Learns from rows whose crc32(doc_id as text) mod 10 is not 0.
    """
    spark = documents.sparkSession
    counts = count_words(documents.where(crc_of_id() % 10 != 0))
    words = summarise(counts, symbols, classes, table_words)
    encoded = encode(documents, words, symbols)
    frequency = np.zeros(symbols + classes)
    for w, i in words.symbols.items():
        frequency[i] = words.counts[w]
    frequency[symbols:] = np.maximum(words.class_total, 0)
    model = spark.sparkContext.broadcast(train(encoded, symbols + classes, frequency, **fit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, max(1, len(b)), 2048):
                part = b.slice(lo, 2048)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(forward_log10(model.value, _sequences(part.column(len(part.columns) - 1))), pa.float64())], names=[*part.schema.names[:-1], "path"])

    plain = encoded.select("uid", "doc_id", "held_out", "n_tokens", "n_known", "base", "share", "symbols")
    scored = plain.mapInArrow(run, f"uid long, doc_id {encoded.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, base double, share double, path double")
    zero = F.lit(0.0)
    if words.whole:
        scored = scored.withColumns({"more_base": zero, "more_share": zero, "more_known": F.lit(0)})
    else:
        rare = encoded.where(F.size("rare") > 0).select("uid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("uid", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
        c = F.coalesce("c", F.lit(0))
        totals = spark.createDataFrame([(k, float(words.class_total[k] + 0.1 * (words.class_distinct[k] + 1))) for k in range(classes)], "k int, room double")
        met = rare.join(counts, "word", "left").withColumn("k", (F.crc32("word") % classes).cast("int")).join(F.broadcast(totals), "k")  # ``classes`` rows
        weight = float(words.total + 0.1 * (words.distinct + 1))
        sums = met.groupBy("uid").agg(
            F.sum(F.col("times") * F.log10((c + 0.1) / weight)).alias("more_base"),
            F.sum(F.col("times") * F.log10((c + 0.1) / F.col("room"))).alias("more_share"),
            F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more_known"),
        )
        scored = scored.join(sums, "uid", "left")
    return scored.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"), F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", zero)).alias("base_score"), (F.col("path") + F.col("share") + F.coalesce("more_share", zero)).alias("score"),
    )
