"""Media columns: telephony audio (G.711 mu-law and A-law, IMA ADPCM) in WAV form.

mu-law and A-law samples are expanded by lookup tables of 256 entries.  ADPCM blocks of one size
are decoded together: a step of the decoder runs over all blocks at once, so the Python loop has as
many steps as a block has samples.  Decoded audio is resampled and kept as 16-bit PCM WAV.

Payloads of any bytes survive encode_wav -> read_wav unchanged.  Null and empty texts give the
padding alone.  Very long texts are one recording; 64 rows are in hand at a time.  Repeated rows give equal
values.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.llm.common import small_batches

RATE = 8000
#: WAV format tags.
PCM, ALAW, MULAW, ADPCM = 1, 6, 7, 17
#: Bytes of an ADPCM block: a 4-byte head and 32 bytes of two samples each.
BLOCK = 36

#: The step sizes and index moves of IMA ADPCM.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066,
    2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], dtype=np.int32)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    exponent, mantissa = (code >> 4) & 7, (code & 0x0F) << 4
    size = np.where(exponent == 0, mantissa + 8, (mantissa + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


MULAW_TABLE, ALAW_TABLE = mulaw_table(), alaw_table()


def adpcm_decode(data: bytes, block: int = BLOCK) -> np.ndarray:
    """Samples of whole IMA ADPCM blocks (mono), a block's first sample from its head; rest bytes are left out."""
    n = len(data) // block
    if n == 0:
        return np.zeros(0, np.int16)
    raw = np.frombuffer(data, np.uint8, n * block).reshape(n, block)
    value = raw[:, :2].copy().view("<i2").astype(np.int32).reshape(n)
    index = np.clip(raw[:, 2].astype(np.int32), 0, 88)
    body = raw[:, 4:]
    codes = np.empty((2 * (block - 4), n), np.uint8)
    codes[0::2], codes[1::2] = (body & 15).T, (body >> 4).T
    out = np.empty((len(codes) + 1, n), np.int16)
    out[0] = value
    for k, c in enumerate(codes, 1):
        step = STEPS[index]
        move = step >> 3
        move += np.where(c & 4, step, 0)
        move += np.where(c & 2, step >> 1, 0)
        move += np.where(c & 1, step >> 2, 0)
        value = np.clip(np.where(c & 8, value - move, value + move), -32768, 32767)
        index = np.clip(index + MOVES[c & 7], 0, 88)
        out[k] = value
    return out.T.reshape(-1)


def resample(pcm: np.ndarray, up: int = 2) -> np.ndarray:
    """To up times the rate: straight lines between samples, the last one held."""
    if len(pcm) == 0:
        return pcm.astype(np.int16)
    a = pcm.astype(np.int32)
    b = np.append(a[1:], a[-1])
    out = np.empty((len(a), up), np.int16)
    for i in range(up):
        out[:, i] = a if i == 0 else (a + b) >> 1 if up == 2 else (a * (up - i) + b * i) // up
    return out.reshape(-1)


def encode_wav(data: bytes, tag: int, rate: int = RATE) -> bytes:
    """A mono WAV file around data, which holds samples of the tag's coding."""
    bits, align = {PCM: (16, 2), ALAW: (8, 1), MULAW: (8, 1), ADPCM: (4, BLOCK)}[tag]
    per_second = rate * BLOCK // (2 * (BLOCK - 4) + 1) if tag == ADPCM else rate * align
    extra = b"" if tag == PCM else struct.pack("<HH", 2, 2 * (BLOCK - 4) + 1) if tag == ADPCM else struct.pack("<H", 0)
    form = struct.pack("<HHIIHH", tag, 1, rate, per_second, align, bits) + extra
    chunks = b"fmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def read_wav(stored: bytes) -> tuple[int, int, bytes]:
    """(tag, rate, data) of a WAV file."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, tag, rate, data = 12, 0, 0, b""
    while at + 8 <= len(stored):
        kind, (size,) = stored[at : at + 4], struct.unpack_from("<I", stored, at + 4)
        if kind == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", stored, at + 8)
        elif kind == b"data":
            data = stored[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    return tag, rate, data


def decode(tag: int, data: bytes) -> np.ndarray:
    """16-bit samples of any of the codings."""
    if tag == MULAW:
        return MULAW_TABLE[np.frombuffer(data, np.uint8)]
    if tag == ALAW:
        return ALAW_TABLE[np.frombuffer(data, np.uint8)]
    if tag == ADPCM:
        return adpcm_decode(data)
    if tag == PCM:
        return np.frombuffer(data, "<i2", len(data) // 2).astype(np.int16)
    raise ValueError(f"format tag {tag}")


def to_pcm_wav(stored: bytes, up: int = 2) -> bytes:
    """The stored recording, decoded, resampled and stored as 16-bit PCM WAV."""
    tag, rate, data = read_wav(stored)
    return encode_wav(resample(decode(tag, data), up).astype("<i2").tobytes(), PCM, rate * up)


def shape(sum_squares: int, n: int, peak: int, changes: int) -> str:
    """Root mean square, peak and sign changes of n samples."""
    return f"{int((sum_squares / n) ** 0.5) if n else 0}/{peak}/{changes}"


def law_shape(codes: np.ndarray, table: np.ndarray) -> str:
    """The shape of G.711 samples, from the counts of their 256 codes; bit 7 is the sign."""
    n = np.bincount(codes, minlength=256)
    level = np.abs(table.astype(np.int64))
    return shape(int((n * level * level).sum()), len(codes), int(level[n > 0].max(initial=0)), int(np.count_nonzero((codes[1:] ^ codes[:-1]) & 0x80)))


def adpcm_shapes(data: list[bytes]) -> list[str]:
    """The shape and CRC of each recording's ADPCM samples; the blocks of all of them are decoded together."""
    blocks = [len(d) // BLOCK for d in data]
    out = adpcm_decode(b"".join(d[: n * BLOCK] for d, n in zip(data, blocks, strict=True))).reshape(-1, 2 * (BLOCK - 4) + 1)
    wide = out.astype(np.int32)
    squares, peaks, negative = (wide * wide).sum(axis=1, dtype=np.int64), np.abs(wide).max(axis=1, initial=0), out < 0
    inner = (negative[:, 1:] != negative[:, :-1]).sum(axis=1)
    across = np.append(negative[1:, 0] != negative[:-1, -1], False) if len(out) else inner
    found, at = [], 0
    for n in blocks:
        own = slice(at, at + n)
        changes = int(inner[own].sum()) + int(across[at : at + n - 1].sum()) if n else 0
        found.append(f"{shape(int(squares[own].sum()), n * out.shape[1], int(peaks[own].max(initial=0)), changes)},{zlib.crc32(out[own].tobytes())}")
        at += n
    return found


def pad(payload: bytes, unit: int = 576) -> bytes:
    """payload and bytes 255 up to a positive multiple of unit."""
    return payload + b"\xff" * ((-len(payload)) % unit or (0 if payload else unit))


def features(stored: list[bytes]) -> list[tuple[str, bytes]]:
    """For each recording, what it sounds like under each coding with the CRC of its resampled PCM, and that PCM."""
    data = [read_wav(s)[2] for s in stored]
    out = []
    for s, d, adpcm in zip(stored, data, adpcm_shapes(data), strict=True):
        codes, pcm = np.frombuffer(d, np.uint8), to_pcm_wav(s)
        out.append((f"mulaw={law_shape(codes, MULAW_TABLE)};alaw={law_shape(codes, ALAW_TABLE)};adpcm={adpcm};pcm={len(pcm)},{zlib.crc32(pcm)}", pcm))
    return out


def telephony(docs: DataFrame, unit: int = 576, id_col: str = "doc_id", text_col: str = "text", with_media: bool = True) -> DataFrame:
    """Each text's bytes as a mu-law recording: the stored WAV (media), its resampled PCM WAV (pcm), and digests of what is read back.

    Columns: id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature; with_media adds media and pcm.
    """
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def rows(texts: list[str | None]) -> Iterator[tuple]:
        raw = [(t or "").encode() for t in texts]
        stored = [encode_wav(pad(r, unit), MULAW) for r in raw]
        for r, s, (feature, pcm) in zip(raw, stored, features(stored), strict=True):
            back = read_wav(s)[2]
            out = (len(r), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(s), hashlib.sha256(s).hexdigest(), feature)
            yield (*out, s, pcm) if with_media else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                columns = list(zip(*rows(b.column("text").to_pylist()), strict=True))
                kinds = types + [pa.binary(), pa.binary()] * with_media
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names + ["media", "pcm"] * with_media)

    return slim.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string" + ", media binary, pcm binary" * with_media)
