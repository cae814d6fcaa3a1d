"""Quality classifier: kernel ridge by random Fourier features, calibrated by isotonic regression.

Method.  Every whole text becomes a vector of document statistics.  Random
Fourier features of the standardised statistics approximate a Gaussian kernel.
Each partition of labelled rows sums its normal equations per fold; the sums
meet in a second stage that holds one row of the matrix per key.  Ridge solves
them on the driver (a matrix whose side is a parameter, whatever the data).
Scores of rows that a fold's model has not seen are counted in fixed bins, and
pool-adjacent-violators over the bins gives the calibration.

Defined results.  A null text counts as empty; an empty text gets a score like
any other; repeated rows get equal scores; a null doc_id is scored and counts as
held out; no labelled row at all gives every document 0.5.  Columns beyond
doc_id and text are never read by the scorer.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import byte_values, crc_of_id
from lodestone.storage import materialize

STATS = 22
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_DIGITS = b"0123456789"
_MARKS = b".,;:?"
_SYMBOLS = b"#$%&*+-/<=>@\\^_`~"
_BARS = b"|"
_SHOUTS = b"!"
_HIGH = bytes(range(128, 256))


def document_statistics(text: bytes) -> list[float]:
    """Statistics of one text; every ratio is 0 for an empty text."""
    n = len(text)
    words = text.split()
    n_words = len(words)
    if not n_words:
        return [np.log1p(n), *[0.0] * (STATS - 1)]
    without = lambda drop: n - len(text.translate(None, drop))
    upper, letters, high = without(_UPPER), without(_LETTERS), without(_HIGH)
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, words), np.int64, n_words)
    noisy = sum(1 for x in lines if 5 * len(x.translate(None, _SYMBOLS + _BARS + _SHOUTS)) < 4 * len(x) or 2 * len(x.translate(None, _UPPER)) < len(x))
    once = sum(1 for c in counts.values() if c == 1)
    root = lambda a, b: (a / b) ** 0.5 if b else 0.0
    return [
        float(np.log1p(n)),
        float(np.log1p(n_words)),
        float(lengths.mean()),
        float(lengths.std()),
        float(np.log1p(lengths.max())),
        root(upper, letters),
        root(without(_DIGITS), n),
        root(without(_MARKS), n_words),
        root(without(_SYMBOLS), n),
        root(without(_BARS), n),
        root(without(_SHOUTS), n),
        root(high, n),
        len(counts) / n_words,
        once / len(counts),
        root(max(counts.values()), n_words),
        root(sum(map(eq, words, words[1:])), n_words),
        float(np.log1p(len(lines))),
        root(len(lines) - len(set(lines)), len(lines)),
        float(np.log1p(n / len(lines))),
        root(noisy, len(lines)),
        root(sum(1 for w in counts if w[-1:] in b"#$%&*!|"), len(counts)),
        root(int((lengths <= 2).sum()), n_words),
    ]


@dataclass(frozen=True)
class QualityModel:
    """What scoring needs; its size depends on ``features`` alone."""

    mean: np.ndarray
    spread: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray
    prior: float | None = None

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.spread, -6, 6)
        wave = np.cos(z @ self.waves + self.phases) * (2.0 / len(self.phases)) ** 0.5
        return np.hstack([np.ones((len(z), 1)), z / 6.0, wave])

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(raw, self.knots, self.levels), 0.0, 1.0)

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(stats), self.prior)
        return self.calibrated(self.features(stats) @ self.weights)


def statistics_table(documents: DataFrame, whole_rows: bool = False) -> DataFrame:
    """doc_id, fold (crc32 of the id mod 5) and the statistics of every row, written once; with ``whole_rows`` also ``own``, a struct of the row's columns."""
    names = [f"s{i}" for i in range(STATS)]
    carried = [F.col("doc_id"), (crc_of_id() % 5).cast("int").alias("fold"), *([F.struct("*").alias("own")] if whole_rows else [])]
    lean = documents.select(*carried, F.col("text").cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([document_statistics(t) for t in byte_values(b.columns[-1])], dtype=np.float64).reshape(-1, STATS)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(rows[:, i]) for i in range(STATS))], names=[*b.schema.names[:-1], *names])

    schema = lean.drop("_text").schema
    for x in names:
        schema = schema.add(x, "double")
    return materialize(lean.mapInArrow(run, schema), "quality_statistics")


def _stats_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(batch.schema.get_field_index(f"s{i}")).to_numpy(zero_copy_only=False) for i in range(STATS)])


def _pool(counts: np.ndarray, positives: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators over bins in order; centres and levels of the blocks."""
    blocks: list[list[float]] = []
    for n, p, x in zip(counts, positives, at, strict=True):
        blocks.append([float(n), float(p), float(n * x)])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    n, p, x = np.array(blocks).T
    return x / n, (p + 0.5 * (p.sum() / n.sum())) / (n + 0.5)


def train(statistics: DataFrame, labels: DataFrame, features: int = 192, bandwidth: float = 3.0, ridge: float = 1e-3, bins: int = 2000, seed: int = 7) -> QualityModel:
    """Fit on every labelled row whose fold is not 0.

    features: side of the Fourier part.  bandwidth: the Gaussian kernel's, on
    standardised statistics.  ridge: times the number of rows.  bins: of the
    calibration.  Labels that contradict each other for one id all count.
    """
    spark = statistics.sparkSession
    rng = np.random.default_rng(seed)
    waves, phases = rng.standard_normal((STATS, features)) / bandwidth, rng.uniform(0, 2 * np.pi, features)
    names = [f"s{i}" for i in range(STATS)]
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("double").alias("y"))
    known = materialize(statistics.where("fold <> 0").join(marks, "doc_id"), "quality_training")
    row = known.agg(F.count("*").alias("n"), *(F.avg(x).alias(f"m_{x}") for x in names), *(F.stddev_pop(x).alias(f"d_{x}") for x in names)).first()
    blank = np.zeros(0)
    if not row["n"]:
        return QualityModel(blank, blank, waves, phases, blank, blank, blank, prior=0.5)
    mean = np.array([row[f"m_{x}"] for x in names])
    spread = np.maximum(np.array([row[f"d_{x}"] for x in names]), 1e-3)
    base = QualityModel(mean, spread, waves, phases, blank, blank, blank)
    side = 1 + STATS + features
    shared = spark.sparkContext.broadcast(base)  # its size depends on ``features`` alone

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, side, side + 1))
        for b in batches:
            x = shared.value.features(_stats_of(b))
            y = b.column(b.schema.get_field_index("y")).to_numpy(zero_copy_only=False)
            fold = b.column(b.schema.get_field_index("fold")).to_numpy(zero_copy_only=False)
            for f in np.unique(fold):
                part = x[fold == f]
                total[f - 1] += part.T @ np.column_stack([part, y[fold == f]])
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(4 * side)), pa.array(list(total.reshape(4 * side, side + 1)), pa.list_(pa.float64()))], names=["k", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            values = b.column(1).flatten().to_numpy().reshape(-1, side + 1)
            for k, v in zip(b.column(0).to_pylist(), values, strict=True):
                total[k] = total[k] + v if k in total else v.copy()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array(list(total.values()), pa.list_(pa.float64()))], names=["k", "v"])

    shape = "k long, v array<double>"
    matrix = np.zeros((4 * side, side + 1))
    for r in known.mapInArrow(sums, shape).repartition("k").mapInArrow(add, shape).collect():
        matrix[r["k"]] = r["v"]
    matrix = matrix.reshape(4, side, side + 1)

    def solve(m: np.ndarray) -> np.ndarray:
        n = max(m[0, 0], 1.0)
        penalty = np.full(side, ridge * n / features)
        penalty[0] = 1e-9 * n + 1e-9
        return np.linalg.solve(m[:, :side] + np.diag(penalty), m[:, side])

    whole = matrix.sum(axis=0)
    weights = solve(whole)
    unseen = spark.sparkContext.broadcast(np.array([solve(whole - m) for m in matrix]))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = shared.value.features(_stats_of(b))
            fold = b.column(b.schema.get_field_index("fold")).to_numpy(zero_copy_only=False)
            raw = np.einsum("ij,ij->i", x, unseen.value[fold - 1])
            k = np.clip(np.floor((raw + 0.5) * bins / 2), 0, bins - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(k), b.column(b.schema.get_field_index("y"))], names=["bin", "y"])

    rows = known.mapInArrow(binned, "bin long, y double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("p")).orderBy("bin").collect()
    knots, levels = _pool(np.array([r["n"] for r in rows]), np.array([r["p"] for r in rows]), np.array([(r["bin"] + 0.5) * 2 / bins - 0.5 for r in rows]))
    shared.unpersist()
    unseen.unpersist()
    return QualityModel(mean, spread, waves, phases, weights, knots, levels)


def score_statistics(statistics: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``statistics``."""
    shared = statistics.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shared.value.score(_stats_of(b)), pa.float64())], names=["doc_id", "fold", "score"])

    kind = statistics.schema["doc_id"].dataType.simpleString()
    scored = statistics.mapInArrow(run, f"doc_id {kind}, fold int, score double")
    return scored.select("doc_id", (F.col("fold") == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def score_documents(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, **fit) -> DataFrame:
    """Train on ``labels`` and score every document."""
    statistics = statistics_table(documents)
    return score_statistics(statistics, train(statistics, labels, **fit), threshold)


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, **fit) -> DataFrame:
    """The rows of ``documents`` that the classifier predicts good, with their columns as they are.

    Rows are written once beside their statistics, so texts are read once.
    """
    statistics = statistics_table(documents, whole_rows=True)
    shared = documents.sparkSession.sparkContext.broadcast(train(statistics.drop("own"), labels, **fit))
    lean = statistics.drop("doc_id", "fold")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(shared.value.score(_stats_of(b)) >= threshold)).select(["own"])

    return lean.mapInArrow(run, lean.select("own").schema).select("own.*")
