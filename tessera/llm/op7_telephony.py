"""Telephony audio columns: mu-law, A-law and IMA ADPCM in WAV containers, decoded to resampled PCM.

Companded bytes expand through 256-entry tables built from the G.711 rules.  ADPCM blocks are decoded
with numpy across blocks: one step handles the same sample of every block.  Decoded audio is resampled
by linear interpolation to `rate` and kept as 16-bit PCM.

`store` wraps a payload as 8-bit samples (for ADPCM: as the nibbles of 64-byte blocks behind a zero
header) without loss; `load` reads the stored bytes back.

Defined results: null text is the empty payload, padded to 64 zero bytes.  Equal texts get equal values.
Extra columns pass through both functions, one called as `out` under the name `out`_input; an empty table gives
an empty one.  A long text is one file, whatever its length.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import cleared
from .text import slices

UNIT = 64
RATE_IN, RATE_OUT = 8000, 16000
#: Fixed values of the IMA ADPCM coder: step sizes grow by a tenth, index moves by code magnitude.
STEPS = np.array([7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], np.int32)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)
#: WAVE format tags.
TAGS = {"alaw": 6, "mulaw": 7, "ima": 17}
FORMATS = ("mulaw", "alaw", "ima")
BATCH_BYTES = 2 << 20

LOADED = T.StructType([T.StructField("payload", T.BinaryType()), T.StructField("samples", T.LongType()), T.StructField("rms", T.LongType()), T.StructField("peak", T.LongType()), T.StructField("crossings", T.LongType()), T.StructField("pcm", T.BinaryType())])


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 15) << 3) + 132 << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    step, low = (code >> 4) & 7, ((code & 15) << 4) + 8
    size = np.where(step == 0, low, (low + 256) << np.maximum(step - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


TABLES = {"mulaw": mulaw_table(), "alaw": alaw_table()}


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """Samples (blocks x samples) of mono IMA ADPCM blocks: 4 header bytes, then two codes a byte, the low one first."""
    n = len(blocks)
    value = (blocks[:, 0].astype(np.int32) | blocks[:, 1].astype(np.int32) << 8).astype(np.uint16).view(np.int16).astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(STEPS) - 1)
    body = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((2 * len(body) + 1, n), np.int16)
    out[0] = value
    for k, byte in enumerate(body):
        for j, code in enumerate((byte & 15, byte >> 4)):
            step, size = STEPS[index], (code & 7).astype(np.int32)
            move = ((2 * size + 1) * step) >> 3
            value = np.clip(value + np.where(code & 8, -move, move), -32768, 32767)
            index = np.clip(index + MOVES[size], 0, len(STEPS) - 1)
            out[2 * k + 1 + j] = value
    return out.T


def resample(pcm: np.ndarray, rate_in: int, rate_out: int) -> np.ndarray:
    if rate_in == rate_out or not len(pcm):
        return pcm
    if rate_out == 2 * rate_in:
        out = np.empty(2 * len(pcm), np.int16)
        out[::2] = pcm
        nxt = np.append(pcm[1:], pcm[-1:]).astype(np.int32)
        out[1::2] = (pcm.astype(np.int32) + nxt) >> 1
        return out
    n = max(1, len(pcm) * rate_out // rate_in)
    return np.rint(np.interp(np.arange(n) * (rate_in / rate_out), np.arange(len(pcm)), pcm)).astype(np.int16)


def wav(kind: str, payload: bytes, rate: int = RATE_IN) -> bytes:
    if kind == "ima":
        blocks = np.zeros((len(payload) // UNIT, UNIT + 4), np.uint8)
        blocks[:, 4:] = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
        data, align, bits, extra = blocks.tobytes(), UNIT + 4, 4, struct.pack("<HH", 2, 2 * UNIT + 1)
        speed, samples = rate * align // (2 * UNIT + 1), (2 * UNIT + 1) * len(blocks)
    else:
        data, align, bits, extra, speed, samples = payload, 1, 8, struct.pack("<H", 0), rate, len(payload)
    fmt = struct.pack("<HHIIHH", TAGS[kind], 1, rate, speed, align, bits) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def unwav(media: bytes) -> tuple[str, int, bytes, int]:
    """(kind, rate, data, block size) of a WAV file, by walking its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, kind, rate, align, data = 12, "", 0, 1, b""
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag, _, rate, _, align, _ = struct.unpack_from("<HHIIHH", media, at + 8)
            kind = {v: k for k, v in TAGS.items()}[tag]
        elif name == b"data":
            data = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    return kind, rate, data, align


def read(media: bytes, rate: int = RATE_OUT) -> tuple[bytes, np.ndarray]:
    """The payload and the resampled PCM of a stored file."""
    kind, stored, data, align = unwav(media)
    raw = np.frombuffer(data, np.uint8)
    if kind == "ima":
        blocks = raw.reshape(-1, align)
        return blocks[:, 4:].tobytes(), resample(decode_ima(blocks).reshape(-1), stored, rate)
    return data, resample(TABLES[kind][raw], stored, rate)


def _encode(data: np.ndarray, off: np.ndarray, kind: str | None) -> list[bytes]:
    raw, files = data.tobytes(), []
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        payload = raw[a:b] + bytes(max(UNIT, -(-(b - a) // UNIT) * UNIT) - (b - a))
        files.append(wav(kind or FORMATS[zlib.crc32(payload) % len(FORMATS)], payload))
    return files


def store(docs: DataFrame, text_col: str = "text", out: str = "media", kind: str | None = None) -> DataFrame:
    """docs with a binary column `out`: the text's UTF-8, padded with zero bytes to a positive multiple of 64, as a WAV file.

    Without a kind the payload's checksum chooses one of the three, so equal texts give equal files.
    """

    docs = cleared(docs, out)

    def encode(texts: pa.Array) -> pa.Array:
        return pa.array([f for _, _, data, off in slices(texts, BATCH_BYTES) for f in _encode(data, off, kind)], pa.binary())

    return docs.withColumn(out, F.arrow_udf(encode, T.BinaryType()).asNondeterministic()(F.col(text_col)))


def _decode_many(files: list[bytes], rate: int) -> list[tuple[bytes, np.ndarray]]:
    """As `read` for each file, with the ADPCM blocks of all files decoded together."""
    parsed = [unwav(f) for f in files]
    ima = [k for k, p in enumerate(parsed) if p[0] == "ima" and p[3] == UNIT + 4]
    got: dict[int, tuple[bytes, np.ndarray]] = {}
    if ima:
        blocks = [np.frombuffer(parsed[k][2], np.uint8).reshape(-1, UNIT + 4) for k in ima]
        pcm = decode_ima(np.concatenate(blocks))
        ends = np.cumsum([len(b) for b in blocks])
        for k, b, e in zip(ima, blocks, ends, strict=True):
            got[k] = (b[:, 4:].tobytes(), resample(pcm[e - len(b) : e].reshape(-1), parsed[k][1], rate))
    return [got[k] if k in got else read(f, rate) for k, f in enumerate(files)]


def _rows(files: list[bytes], rate: int) -> list[tuple]:
    out = []
    for payload, pcm in _decode_many(files, rate):
        wide, sign = pcm.astype(np.int64), pcm >= 0
        out.append((payload, len(pcm), int(np.sqrt((wide * wide).sum() // max(1, len(pcm)))), int(np.abs(wide).max(initial=0)), int((sign[1:] != sign[:-1]).sum()), pcm.astype("<i2").tobytes()))
    return out


_KINDS = [pa.binary(), *[pa.int64()] * 4, pa.binary()]


def load(docs: DataFrame, media_col: str = "media", out: str = "audio", *, rate: int = RATE_OUT) -> DataFrame:
    """docs with a struct column `out`: the payload read back, features of the resampled PCM, and the PCM itself (little-endian 16 bit)."""

    docs = cleared(docs, out)

    def decode(media: pa.Array) -> pa.Array:
        rows = []
        for _, _, data, off in slices(media, BATCH_BYTES):
            raw = data.tobytes()
            rows += _rows([raw[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], rate)
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_KINDS)], names=LOADED.fieldNames())

    return docs.withColumn(out, F.arrow_udf(decode, LOADED).asNondeterministic()(F.col(media_col)))
