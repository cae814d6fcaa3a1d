"""Chunks that end at sentences, and chunk records with their context."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as X


def sentence_chunks_of(text: str, size: int, overlap: int) -> list[str]:
    """Chunks of at most ``size`` characters; a break falls behind the last sentence end in a chunk's last fifth, if any.

    Each start depends on the end before it, so this is a loop over one text.
    """
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + size)
        if end < len(text):
            floor = at + size - size // 5
            cut = max(text.rfind(mark, floor, end) for mark in (". ", "! ", "? ", "\n"))
            end = cut + 1 if cut >= floor else end
        piece = text[at:end].strip()
        if piece:
            out.append(piece)
        if end >= len(text):
            break
        at = max(end - overlap, at + 1)
    return out


def sentence_chunks(df: DataFrame, key: str, text: str = "text", size: int = 800, overlap: int = 80) -> DataFrame:
    """key, pos and chunk of every text."""
    lean = df.select(key, F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            source, pos, chunk = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                parts = sentence_chunks_of(t or "", size, overlap)
                source += [i] * len(parts)
                pos += range(len(parts))
                chunk += parts
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(source, pa.int64())), pa.array(pos, pa.int32()), pa.array(chunk, pa.string())], names=[key, "pos", "chunk"])

    return lean.mapInArrow(run, f"{key} {lean.schema[key].dataType.simpleString()}, pos int, chunk string")


def chunk_records(df: DataFrame, key: str, text: str, size: int, overlap: int, prefix: str = "chunk") -> DataFrame:
    """key, pos, chunk, a stable id and a token estimate of fixed-size chunks."""
    parts = df.select(key, F.posexplode(X.chunks(text, size, overlap)).alias("pos", "chunk"))
    return parts.select(key, "pos", "chunk", X.stable_id(prefix, [key, "pos"], "chunk").alias("chunk_id"), X.token_estimate("chunk").alias("tokens"))


def with_context(context, chunk) -> Column:
    """A chunk behind the context that is searched with it but not shown."""
    return F.concat(F.lit("[CONTEXT] "), context, F.lit(" [TEXT] "), chunk)


def stem(word) -> Column:
    """A word without its commonest endings, if enough of it is left."""
    w = F.col(word) if isinstance(word, str) else word
    return F.when(F.length(w) >= 6, F.regexp_replace(w, "(ingly|edly|ing|ed|ly|es|s)$", "")).otherwise(w)


def hashed_terms(tokens: Column, dims: int) -> Column:
    """Dimension of each token in a hashed bag of words."""
    return F.transform(tokens, lambda w: F.conv(F.substring(F.md5(w), 1, 6), 16, 10).cast("int") % dims)
