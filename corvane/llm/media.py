"""Telephony audio: mu-law, A-law and ADPCM payloads in WAV form, expanded and resampled."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corvane.llm.common import blocks, buffers, giving_back, python_ready, text_or_empty, written

#: A stored payload is padded to a positive multiple of this; it is also the size of an ADPCM block.
UNIT = 64
RATE = 8000
#: WAV format tags, fixed by the file format.
MULAW, ALAW, IMA_ADPCM = 7, 6, 17
#: Fixed values of IMA ADPCM: what a 4-bit code adds to the step index.
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def _steps() -> np.ndarray:
    """The 89 step sizes of IMA ADPCM: 7, growing by a tenth, rounded down, 32767 at most."""
    # The table's first entries aren't on the rule.
    out = [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767]
    return np.array(out, np.int32)


STEPS = _steps()


def mulaw_table() -> np.ndarray:
    """The PCM value of each mu-law byte, by the rule of G.711."""
    u = ~np.arange(256) & 0xFF
    size = (((u & 0x0F) << 3) + 0x84 << ((u >> 4) & 7)) - 0x84
    return np.where(u & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """The PCM value of each A-law byte, by the rule of G.711."""
    a = np.arange(256) ^ 0x55
    exponent, size = (a >> 4) & 7, ((a & 0x0F) << 4) + 8
    size = np.where(exponent > 0, (size + 0x100) << np.maximum(exponent - 1, 0), size)
    return np.where(a & 0x80, size, -size).astype(np.int16)


TABLES = {MULAW: mulaw_table(), ALAW: alaw_table()}


def wav(payload: bytes, tag: int = MULAW) -> bytes:
    """A one-channel WAV file whose data chunk is the payload, byte for byte."""
    block, bits, extra, samples = (UNIT, 4, struct.pack("<H", 2 * (UNIT - 4) + 1), len(payload) // UNIT * (2 * (UNIT - 4) + 1)) if tag == IMA_ADPCM else (1, 8, b"", len(payload))
    fmt = struct.pack("<HHIIHHH", tag, 1, RATE, RATE if tag != IMA_ADPCM else RATE * UNIT // (2 * (UNIT - 4) + 1), block, bits, len(extra)) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes) -> tuple[int, bytes]:
    """The format tag and the data chunk of a WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, tag = 12, 0
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            tag = struct.unpack_from("<H", media, at + 8)[0]
        elif kind == b"data":
            return tag, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def decode_adpcm(data: np.ndarray) -> np.ndarray:
    """PCM of IMA ADPCM blocks, a row per block: one step of time at once over all of them."""
    b = data.reshape(-1, UNIT)
    value = b[:, 0].astype(np.int32) | b[:, 1].view(np.int8).astype(np.int32) << 8
    index = np.minimum(b[:, 2], 88).astype(np.int32)
    codes = np.ascontiguousarray(b[:, 4:].T)
    out = np.empty((2 * (UNIT - 4) + 1, len(b)), np.int16)
    out[0] = value
    # What a code adds, for each step index: the format's shifts and adds, once per pair.
    s = STEPS[:, None]
    c = np.arange(16)[None, :]
    delta = (s >> 3) + (c & 1) * (s >> 2) + (c >> 1 & 1) * (s >> 1) + (c >> 2 & 1) * s
    delta = np.where(c & 8, -delta, delta).astype(np.int32).ravel()
    after = np.clip(np.arange(89)[:, None] + INDEX_STEP[np.arange(16) & 7][None, :], 0, 88).astype(np.int32).ravel()
    for t in range(UNIT - 4):
        for half in (0, 1):
            key = (index << 4) + (codes[t] >> 4 if half else codes[t] & 15)
            value = np.clip(value + delta[key], -32768, 32767)
            index = after[key]
            out[1 + 2 * t + half] = value
    return np.ascontiguousarray(out.T)


def resampled(pcm: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Twice the rate: between two samples of a recording their mean, after its last one that again."""
    out = np.empty(2 * len(pcm), np.int16)
    out[0::2] = pcm
    following = np.empty_like(pcm)
    following[:-1] = pcm[1:]
    last = at[1:] - 1
    following[last] = pcm[last]
    out[1::2] = (pcm.astype(np.int32) + following) >> 1
    return out


def _payloads(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.diff(at)
    to = np.zeros(len(at), np.int64)
    np.cumsum(np.maximum(1, -(-size // UNIT)) * UNIT, out=to[1:])
    out = np.zeros(to[-1], np.uint8)
    out[np.arange(len(raw)) + np.repeat(to[:-1] - at[:-1], size)] = raw
    return out, to


def _stored(column: pa.Array) -> list[pa.Array]:
    """n_bytes and the WAV file of each text."""
    raw, at = buffers(column)
    payload, to = _payloads(raw, at)
    whole = payload.tobytes()
    media = [wav(whole[a:b]) for a, b in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)]
    return [pa.array(np.diff(at)), pa.array(media, pa.binary())]


def _read(column: pa.Array, keep_pcm: bool) -> list[pa.Array]:
    """What `READ` names, from the stored files' bytes."""
    back = [read_wav(m.as_py())[1] for m in column]
    to = np.concatenate([[0], np.cumsum([len(x) for x in back])])
    data = np.frombuffer(b"".join(back), np.uint8)
    mu, al, ad = TABLES[MULAW][data], TABLES[ALAW][data], decode_adpcm(data)
    up = resampled(mu, to)
    parts = [np.add.reduceat(np.abs(x.astype(np.int64)), to[:-1]).tolist() for x in (mu, al)]
    rows = np.abs(ad.astype(np.int32)).sum(1, dtype=np.int64)
    parts.append(np.add.reduceat(rows, to[:-1] // UNIT).tolist())
    sign = mu < 0
    turn = np.zeros(len(mu), np.int64)
    turn[1:] = sign[1:] != sign[:-1]
    turn[to[:-1]] = 0
    turns = np.add.reduceat(turn, to[:-1]).tolist()
    view = memoryview(up).cast("B")
    feature = [f"mulaw:{m}|alaw:{a}|adpcm:{d}|turns:{t}|pcm16k:{zlib.crc32(view[4 * i : 4 * j])}" for m, a, d, t, i, j in zip(*parts, turns, to[:-1].tolist(), to[1:].tolist(), strict=True)]
    out = [pa.array([len(x) for x in back], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string()), pa.array([zlib.crc32(x[-UNIT:]) for x in back], pa.int64()), pa.array(feature, pa.string())]
    if keep_pcm:
        out.append(pa.array([bytes(view[4 * i : 4 * j]) for i, j in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)], pa.binary()))
    return out


READ = ("payload_bytes bigint", "payload_sha256 string", "tail_crc32 bigint", "feature string")


def stored(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key, n_bytes and media: each text's bytes as a mu-law WAV file, a column of Parquet files in the shared folder."""
    python_ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", 2 << 20):
            yield pa.RecordBatch.from_arrays([block.column("key"), *_stored(block.column("text"))], ["key", "n_bytes", "media"])

    kind = docs.schema[key].dataType.simpleString()
    made = docs.select(docs[key].alias("key"), text_or_empty(text).alias("text")).mapInArrow(giving_back(run), f"key {kind}, n_bytes bigint, media binary")
    return written(made.withColumnRenamed("key", key), "media")


def decoded(media: DataFrame, key: str = "doc_id", keep_pcm: bool = False) -> DataFrame:
    """The key, n_bytes and media of `stored`, and what is read from the files' bytes: payload_bytes, payload_sha256,
    tail_crc32, feature, and with keep_pcm pcm16k."""
    python_ready(media.sparkSession)
    names = ["key", "n_bytes", "media", *[c.split()[0] for c in READ], *["pcm16k"] * keep_pcm]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "media", 2 << 20):
            yield pa.RecordBatch.from_arrays([*[block.column(c) for c in ("key", "n_bytes", "media")], *_read(block.column("media"), keep_pcm)], names)

    kind = media.schema[key].dataType.simpleString()
    cols = ", ".join([f"key {kind}", "n_bytes bigint", "media binary", *READ, *["pcm16k binary"] * keep_pcm])
    return media.select(media[key].alias("key"), "n_bytes", "media").mapInArrow(giving_back(run), cols).withColumnRenamed("key", key)


def telephony(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_pcm: bool = False) -> DataFrame:
    """Store each text's bytes as a mu-law recording in the shared folder, read the files back and decode them.

    Returns the key, n_bytes, media (the WAV file), payload_bytes, payload_sha256 and tail_crc32 of the
    bytes read back, feature, and with keep_pcm pcm16k: the recording expanded by table and resampled to
    16 kHz, little-endian 16-bit. The feature holds the sums of sizes of the payload expanded as mu-law,
    as A-law and, block by block, as ADPCM, the changes of sign, and the resampled recording's checksum.

    A null or empty text is one unit of zeros. Rows with a null or repeated key stay as they are; other
    columns are not read, so names can't clash. No shuffle; a worker holds one block of texts at a time.
    """
    return decoded(stored(docs, key, text), key, keep_pcm)
