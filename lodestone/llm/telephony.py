"""Media columns of telephony audio: G.711 mu-law and A-law, IMA ADPCM, PCM.

``encode_media`` stores a payload losslessly as the 8-bit codes of a RIFF file.
``decode_media`` reads stored files: it expands G.711 codes by lookup tables,
decodes ADPCM with numpy across all blocks of many rows, resamples, and gives
16-bit PCM as a column beside digests of the stored bytes.  ``write_media``
writes the media table, ``store_media`` that and the table of resampled PCM.

Defined results.  A null or empty text is a payload of 64 zero bytes; any other,
however long, is padded with zero bytes to a multiple of 64.  Equal texts give
equal values wherever they stand.  A stored value that is no RIFF file of a
known codec gives nulls.  A row's own columns travel as the struct ``own``,
whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import byte_values
from lodestone.storage import materialize

#: RIFF format tags, fixed by the file format.
TAGS = {"pcm": 1, "alaw": 6, "mulaw": 7, "adpcm": 0x11}
BLOCK = 64
#: Samples of an ADPCM block: one in its head and two a byte of its body.
PER_BLOCK = 1 + 2 * (BLOCK - 4)
#: IMA ADPCM index adjustments, fixed by the codec.
INDEX_STEPS = (-1, -1, -1, -1, 2, 4, 6, 8)


def mulaw_table() -> np.ndarray:
    """PCM value of each mu-law code."""
    code = ~np.arange(256) & 0xFF
    size = ((((code & 15) << 3) + 132) << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """PCM value of each A-law code."""
    code = np.arange(256) ^ 0x55
    segment, low = code >> 4 & 7, (code & 15) << 4
    size = np.where(segment == 0, low + 8, (low + 264) << np.maximum(segment - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


#: Fixed values of the codec's published step table.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796,
    876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], dtype=np.int32)


def adpcm_decode(blocks: np.ndarray) -> np.ndarray:
    """PCM of IMA ADPCM blocks (one a row): 1 + 2 * (bytes - 4) samples each.

    The loop goes over the samples of a block; each step is one numpy operation
    across all blocks.
    """
    head = blocks[:, :4]
    value = np.ascontiguousarray(head[:, :2]).view("<i2").astype(np.int32)[:, 0]
    index = np.minimum(head[:, 2].astype(np.int32), 88)
    body = blocks[:, 4:]
    n = 2 * body.shape[1]
    nibbles = np.empty((n, len(blocks)), np.uint8)
    nibbles[0::2], nibbles[1::2] = (body & 15).T, (body >> 4).T
    out = np.empty((n + 1, len(blocks)), np.int16)
    out[0] = value
    # difference and next index for each (index, nibble), so a sample is two look-ups
    code = np.arange(16)
    size = (STEPS[:, None] >> 3) + np.where(code & 1, STEPS[:, None] >> 2, 0) + np.where(code & 2, STEPS[:, None] >> 1, 0) + np.where(code & 4, STEPS[:, None], 0)
    change = np.where(code & 8, -size, size).astype(np.int32).ravel()
    follow = (np.clip(np.arange(89)[:, None] + np.array(INDEX_STEPS * 2), 0, 88) * 16).astype(np.int32).ravel()
    at = index * 16
    for i in range(n):
        k = at + nibbles[i]
        value = value + change[k]
        np.clip(value, -32768, 32767, out=value)
        out[i + 1] = value
        at = follow[k]
    return np.ascontiguousarray(out.T)


def in_blocks(pcm: np.ndarray, per: int = PER_BLOCK) -> np.ndarray:
    """Samples as rows of one block each; the last is filled with the last sample."""
    rows = -(-len(pcm) // per)
    return np.concatenate([pcm, np.full(rows * per - len(pcm), pcm[-1] if len(pcm) else 0, np.int16)]).reshape(rows, per)


def adpcm_encode(x: np.ndarray) -> np.ndarray:
    """IMA ADPCM blocks of samples given by block, encoded across all blocks."""
    rows, per = x.shape
    x = x.astype(np.int32)
    out = np.zeros((rows, 4 + (per - 1) // 2), np.uint8)
    out[:, :2] = np.ascontiguousarray(x[:, 0].astype("<i2")).view(np.uint8).reshape(rows, 2)
    value, index = x[:, 0].copy(), np.zeros(rows, np.int32)
    adjust = np.array(INDEX_STEPS * 2, np.int32)
    for i in range(per - 1):
        step = STEPS[index]
        gap = x[:, i + 1] - value
        code = np.where(gap < 0, 8, 0)
        rest, size = np.abs(gap), step >> 3
        for bit in (4, 2, 1):
            hit = rest >= step
            code = code | np.where(hit, bit, 0)
            rest, size = rest - np.where(hit, step, 0), size + np.where(hit, step, 0)
            step = step >> 1
        value = np.clip(value + np.where(code & 8, -size, size), -32768, 32767)
        index = np.clip(index + adjust[code], 0, 88)
        out[:, 4 + i // 2] |= (code << (4 * (i & 1))).astype(np.uint8)
    return out


def alaw_encode(pcm: np.ndarray) -> np.ndarray:
    """The A-law code nearest to each sample."""
    table = alaw_table().astype(np.int32)
    order = np.argsort(table, kind="stable")
    middle = (table[order][1:] + table[order][:-1]) / 2
    return order[np.searchsorted(middle, pcm)].astype(np.uint8)


def resample(pcm: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Samples at another rate: smoothed if it is lower, interpolated in integers."""
    if not len(pcm) or rate == target:
        return pcm.astype(np.int16)
    up, down = target // gcd(rate, target), rate // gcd(rate, target)
    x = pcm.astype(np.int64)
    if down > up:
        y = np.concatenate([x[:1], x, x[-1:]])
        x = (y[:-2] + 2 * y[1:-1] + y[2:] + 2) >> 2
    at = np.arange(-(-len(x) * up // down)) * down
    base, part = at // up, at % up
    return ((x[base] * (up - part) + x[np.minimum(base + 1, len(x) - 1)] * part) // up).astype(np.int16)


def riff(codec: str, data: bytes, rate: int = 8000) -> bytes:
    """A RIFF/WAVE file around the codes of one channel."""
    align = BLOCK if codec == "adpcm" else 2 if codec == "pcm" else 1
    per = PER_BLOCK
    speed = rate * BLOCK // per if codec == "adpcm" else rate * align
    extra = struct.pack("<HH", 2, per) if codec == "adpcm" else struct.pack("<H", 0) if codec != "pcm" else b""
    form = struct.pack("<HHIIHH", TAGS[codec], 1, rate, speed, align, {"adpcm": 4, "pcm": 16}.get(codec, 8)) + extra
    samples = len(data) // BLOCK * per if codec == "adpcm" else len(data) // align
    fact = b"" if codec == "pcm" else b"fact" + struct.pack("<II", 4, samples)
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + fact + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def unriff(media: bytes | None) -> tuple[str, int, bytes] | None:
    """codec, rate and data of a stored file; None if it is none."""
    if not media or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, codec, rate = 12, None, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt " and at + 16 <= len(media):
            tag, _, rate = struct.unpack_from("<HHI", media, at + 8)
            codec = next((k for k, v in TAGS.items() if v == tag), None)
        elif name == b"data":
            return (codec, rate, media[at + 8 : at + 8 + size]) if codec else None
        at += 8 + size + (size & 1)
    return None


def decode(codec: str, data: bytes) -> np.ndarray:
    """16-bit PCM of stored codes."""
    codes = np.frombuffer(data, np.uint8)
    if codec == "adpcm":
        return adpcm_decode(codes[: len(codes) // BLOCK * BLOCK].reshape(-1, BLOCK)).reshape(-1)
    if codec == "pcm":
        return codes[: len(codes) // 2 * 2].view("<i2").astype(np.int16)
    return (mulaw_table() if codec == "mulaw" else alaw_table())[codes]


def padded(text: bytes) -> bytes:
    return text + b"\0" * (max(1, -(-len(text) // BLOCK)) * BLOCK - len(text))


def encode_media(df: DataFrame, text: str = "text", codec: str = "mulaw", rate: int = 8000) -> DataFrame:
    """own (a struct of the row's other columns), n_bytes and media: a RIFF file whose codes are the padded text."""
    lean = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns if c != text)).alias("own"), F.col(text).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = list(byte_values(b.column(1)))
            media = pa.array([riff(codec, padded(t), rate) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), media], names=["own", "n_bytes", "media"])

    return lean.mapInArrow(run, lean.select("own").schema.add("n_bytes", "long").add("media", "binary"))


def _wave(pcm: np.ndarray) -> str:
    x = pcm.astype(np.int64)
    turns = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"n={len(x)};peak={int(np.abs(x).max(initial=0))};energy={int((x * x).sum()) // max(1, len(x))};turns={turns};crc={zlib.crc32(pcm.astype('<i2').tobytes())}"


def _over_adpcm(rows: list[np.ndarray]) -> list[np.ndarray]:
    """Each row's samples after ADPCM, coded and decoded with the blocks of its neighbours."""
    blocks = [in_blocks(x) for x in rows]
    back = adpcm_decode(adpcm_encode(np.concatenate(blocks)))
    ends = np.cumsum([len(x) for x in blocks])
    return [part.reshape(-1)[: len(x)] for part, x in zip(np.split(back, ends[:-1]), rows, strict=True)]


DIGESTS = (("payload_bytes", pa.int64(), "long"), ("payload_sha256", pa.string(), "string"), ("tail_crc32", pa.int64(), "long"), ("media_bytes", pa.int64(), "long"), ("media_sha256", pa.string(), "string"), ("feature", pa.string(), "string"), ("pcm", pa.binary(), "binary"))


def decode_media(df: DataFrame, rate: int = 6000, chunk_samples: int = 1 << 20) -> DataFrame:
    """own, n_bytes and, from the stored bytes alone: the payload's size, SHA-256 and tail CRC, those of the stored form, a feature, and ``pcm``.

    ``pcm`` is a RIFF file of 16-bit samples at ``rate``.  The feature describes
    it, and the samples after A-law and after ADPCM; ADPCM goes across the
    blocks of many rows at once, in runs of ``chunk_samples``.
    """
    lean = df.select("own", "n_bytes", "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alaw = alaw_table()
        over_alaw = alaw[alaw_encode(mulaw_table())]  # what A-law makes of each mu-law code

        def rows_of(values: list[bytes | None]) -> list[tuple]:
            files = [unriff(x) for x in values]
            waves = [decode(f[0], f[2]) if f else None for f in files]
            coded = iter(_over_adpcm([w for w in waves if w is not None]) if any(f for f in files) else ())
            rows = []
            for value, got, wave in zip(values, files, waves, strict=True):
                if got is None:
                    rows.append((None,) * len(DIGESTS))
                    continue
                codec, own_rate, data = got
                pcm = resample(wave, own_rate, rate)
                a = over_alaw[np.frombuffer(data, np.uint8)] if codec == "mulaw" else alaw[alaw_encode(wave)]
                feature = f"{codec}@{own_rate}>{rate}:{_wave(pcm)}|alaw:{_wave(a)}|adpcm:{_wave(next(coded))}"
                rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(value), hashlib.sha256(value).hexdigest(), feature, riff("pcm", pcm.astype("<i2").tobytes(), rate)))
            return rows

        for b in batches:
            sizes = [len(x.as_py() or b"") for x in b.column(2)] if len(b) else []
            start = 0
            while start < len(b) or not len(b):
                stop, size = start, 0
                while stop < len(b) and (stop == start or size + sizes[stop] <= chunk_samples):
                    size += sizes[stop]
                    stop += 1
                rows = rows_of([x.as_py() for x in b.column(2)[start:stop]])
                columns = list(zip(*rows, strict=True)) or [()] * len(DIGESTS)
                part = b.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, t) for c, (_, t, _) in zip(columns, DIGESTS, strict=True))], names=["own", "n_bytes", *(f[0] for f in DIGESTS)])
                start = stop
                if not len(b):
                    break

    schema = lean.select("own", "n_bytes").schema
    for name, _, kind in DIGESTS:
        schema = schema.add(name, kind)
    return lean.mapInArrow(run, schema)


def write_media(df: DataFrame, text: str = "text", codec: str = "mulaw") -> DataFrame:
    """The media table as ``encode_media`` gives it, written and reread."""
    return materialize(encode_media(df, text, codec), "media")


def store_media(df: DataFrame, text: str = "text", codec: str = "mulaw", rate: int = 6000) -> DataFrame:
    """The table of resampled PCM with its digests, decoded from the written media table and written itself."""
    return materialize(decode_media(write_media(df, text, codec), rate), "pcm")
