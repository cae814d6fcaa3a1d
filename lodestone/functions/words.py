"""Words of texts inside tasks of Python, the same as ``text.tokens`` gives.

Splitting a text there costs a fraction of gathering its words in an expression
and handing them over one by one.  Characters outside Latin and general
punctuation may be classed or lowered differently from engine to engine, so a
text that has any is split by ``text.tokens`` itself and handed over as words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import tokens

#: What is left to Python: texts of Latin and general punctuation, without the capital whose lower case is two characters.  Searching for another character would take ten times as long.
PLAIN = r"\A[\x{0}-\x{12F}\x{131}-\x{24F}\x{2000}-\x{206F}]*+\z"
_BETWEEN = r"[^\pL\pN_]+"
#: Bytes of text of a part of a batch.
PART_BYTES = 1 << 21


def text_columns(text) -> list[Column]:
    """``plain``, the text if tasks may split it, and ``words``, the words of any other."""
    t = F.col(text) if isinstance(text, str) else text
    plain = t.rlike(PLAIN)
    return [F.when(plain, t).alias("plain"), F.when(~plain, tokens(t)).alias("words")]


def token_columns(words) -> list[Column]:
    """The same two columns of a text whose words are known."""
    return [F.lit(None).cast("string").alias("plain"), (F.col(words) if isinstance(words, str) else words).alias("words")]


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def words_of(plain: pa.Array, words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many words each row has, and all words end to end."""
    split = pc.split_pattern_regex(pc.utf8_lower(plain), pattern=_BETWEEN)
    flat, n = pc.list_flatten(split), _lengths(split)
    kept = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    flat = flat.filter(pa.array(kept))
    n = np.bincount(np.repeat(np.arange(len(n)), n)[kept], minlength=len(n))
    if words.null_count == len(words):
        return n, flat
    more, rest = _lengths(words), pc.list_flatten(words)
    row = np.concatenate([np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(n)), more)])
    return n + more, pa.concat_arrays([flat, rest.cast(flat.type)]).take(pa.array(np.argsort(row, kind="stable")))


def hashes(words: pa.Array) -> np.ndarray:
    """64 bits of each word, from its bytes and their places, for all words at once."""
    words = words.cast(pa.string())
    if not len(words):
        return np.zeros(0, np.uint64)
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int32, len(words) + 1, 4 * words.offset).astype(np.int64)
    held = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].astype(np.uint64) if data else np.zeros(0, np.uint64)
    ends -= ends[0]
    power = np.cumprod(np.full(int(np.diff(ends).max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64))
    held = (held + np.uint64(1)) * power[np.arange(len(held)) - np.repeat(ends[:-1], np.diff(ends))]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(held)])
    h = total[ends[1:]] - total[ends[:-1]]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def text_parts(batches: Iterator[pa.RecordBatch], plain: int, words: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about ``PART_BYTES`` of text, one row at least; a word counts as eight bytes."""
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column(plain)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 8 * _lengths(b.column(words))
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(size) // PART_BYTES)) + 1).tolist(), len(b)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo < hi:
                yield b.slice(lo, hi - lo)
