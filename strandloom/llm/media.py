"""Media columns: signature sniffing with Aho-Corasick, format checks, type correction and carving."""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_batch

# The magic bytes of the formats.
MAGIC = {
    b"\x89PNG\r\n\x1a\n": "image/png",
    b"GIF87a": "image/gif",
    b"GIF89a": "image/gif",
    b"\xff\xd8\xff": "image/jpeg",
    b"BM": "image/bmp",
    b"RIFF": "audio/wav",
    b"\x1f\x8b\x08": "application/gzip",
}


def png_end(b: bytes, at: int) -> int | None:
    p, first = at + 8, True
    while p + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, p)
        if p + 12 + n > len(b) or (first and kind != b"IHDR") or zlib.crc32(b[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return None
        p, first = p + 12 + n, False
        if kind == b"IEND":
            return p
    return None


def gif_end(b: bytes, at: int) -> int | None:
    if at + 13 > len(b):
        return None
    p = at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 128 else 0)
    while p < len(b):
        if b[p] == 0x3B:
            return p + 1
        if b[p] == 0x21:
            p += 2
        elif b[p] == 0x2C and p + 10 < len(b):
            p += 11 + (3 << ((b[p + 9] & 7) + 1) if b[p + 9] & 128 else 0)
        else:
            return None
        while p < len(b) and b[p]:
            p += 1 + b[p]
        p += 1
    return None


def jpeg_end(b: bytes, at: int) -> int | None:
    p = at + 2
    while p + 4 <= len(b) and b[p] == 0xFF:
        if b[p + 1] == 0xDA:
            end = b.find(b"\xff\xd9", p)
            return end + 2 if end >= 0 else None
        n = int.from_bytes(b[p + 2 : p + 4], "big")
        if n < 2:
            return None
        p += 2 + n
    return None


def bmp_end(b: bytes, at: int) -> int | None:
    if at + 54 > len(b):
        return None
    size, zero, pixels, header, _, _, planes, depth = struct.unpack_from("<IIIIiiHH", b, at + 2)
    good = not zero and planes == 1 and depth in (1, 4, 8, 16, 24, 32) and 40 <= header <= 124 and 14 + header <= pixels <= size
    return at + size if good and at + size <= len(b) else None


def wav_end(b: bytes, at: int) -> int | None:
    if b[at + 8 : at + 12] != b"WAVE" or at + 12 > len(b):
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return None
    p, seen = at + 12, set()
    while p + 8 <= end:
        kind, n = struct.unpack_from("<4sI", b, p)
        seen.add(kind)
        p += 8 + n + (n & 1)
    return end if p == end and {b"fmt ", b"data"} <= seen else None


def gzip_end(b: bytes, at: int) -> int | None:
    d, whole = zlib.decompressobj(31), memoryview(b)
    try:
        while at < len(b) and not d.eof:  # what is inflated goes at once, 64 KiB at a time
            d.decompress(whole[at : at + 65_536], 65_536)
            while d.unconsumed_tail and not d.eof:
                d.decompress(d.unconsumed_tail, 65_536)
            at = min(at + 65_536, len(b))
    except zlib.error:
        return None
    return at - len(d.unused_data) if d.eof else None


CHECKS = {"image/png": png_end, "image/gif": gif_end, "image/jpeg": jpeg_end, "image/bmp": bmp_end, "audio/wav": wav_end, "application/gzip": gzip_end}


@cache
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic, kind in MAGIC.items():
        found.add_word(magic.decode("latin-1"), (len(magic), kind))
    found.make_automaton()
    return found


def sniff(b: bytes) -> list[tuple[int, int, str]]:
    """(start, length, type) of the media in b, outermost only, in order: a signature counts if its format's check holds."""
    out, free = [], 0
    for last, (n, kind) in automaton().iter(b.decode("latin-1")):
        at = last + 1 - n
        if at >= free and (end := CHECKS[kind](b, at)):
            out.append((at, end - at, kind))
            free = end
    return out


def sniffed(df: DataFrame, content: str, declared: str) -> DataFrame:
    """Adds detected (the type of the medium that fills the bytes, else application/octet-stream), corrected
    (whether that differs from the declared type) and carved (array of start, length, type of embedded media).

    Null or empty bytes: nothing detected, nothing carved. Other columns stay; a column of one of these names
    is replaced. Repeated rows are treated alike.
    """
    found = F.pandas_udf(lambda s: s.map(lambda b: [{"start": a, "length": n, "type": k} for a, n, k in sniff(b or b"")]), "array<struct<start:long,length:long,type:string>>")
    carved = df.withColumn("carved", found(F.col(content)))
    whole = F.expr(f"filter(carved, x -> x.start = 0 AND x.length = octet_length(`{content}`))")
    carved = carved.withColumn("detected", F.coalesce(F.get(whole, F.lit(0))["type"], F.lit("application/octet-stream")))
    return carved.withColumn("corrected", ~F.col("detected").eqNullSafe(F.col(declared)))


def as_wav(samples: bytes, rate: int = 8000) -> bytes:
    """8-bit mono PCM."""
    head = struct.pack("<4sIIHHIIHH4sI", b"WAVE", 0x20746D66, 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return struct.pack("<4sI", b"RIFF", len(head) + len(samples) + len(samples) % 2) + head + samples + b"\0" * (len(samples) % 2)


def wav_samples(b: bytes) -> np.ndarray:
    """The 8-bit samples of the data chunk of a checked file."""
    p = 12
    while True:
        kind, n = struct.unpack_from("<4sI", b, p)
        if kind == b"data":
            return np.frombuffer(b, np.uint8, n, p + 8)
        p += 8 + n + (n & 1)


def as_bmp(samples: bytes, width: int = 576) -> bytes:
    """8-bit grey, one row of `width` samples after another from the bottom; the samples are a multiple of a width that 4 divides."""
    grey = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4)
    grey[:, 3] = 0
    start = 54 + grey.size
    return struct.pack("<2sIIIIiiHHIIiiII", b"BM", start + len(samples), 0, start, 40, width, len(samples) // width, 1, 8, 0, len(samples), 2835, 2835, 256, 0) + grey.tobytes() + samples


def bmp_samples(b: bytes) -> np.ndarray:
    """The 8-bit samples of a checked file, in the order of its rows."""
    width, height = struct.unpack_from("<ii", b, 18)
    step = -(-width // 4) * 4
    rows = np.frombuffer(b, np.uint8, step * abs(height), struct.unpack_from("<I", b, 10)[0]).reshape(abs(height), step)
    return rows[:, :width].reshape(-1)


def as_png(samples: bytes, width: int = 576, level: int = 1) -> bytes:
    """8-bit grey, rows of `width` samples without a filter; the samples are a multiple of the width."""
    rows = np.zeros((len(samples) // width, width + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(samples, np.uint8).reshape(-1, width)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + chunk(b"IEND", b"")


def png_samples(b: bytes) -> np.ndarray:
    """The 8-bit samples of a checked grey file whose rows have no filter (an error where they have one)."""
    width, height, packed, p = *struct.unpack_from(">II", b, 16), [], 8
    while p + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, p)
        if kind == b"IDAT":
            packed.append(b[p + 8 : p + 8 + n])
        p += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("rows with a filter")
    return rows[:, 1:].reshape(-1)


STORED = {"audio/wav": (as_wav, wav_samples), "image/bmp": (as_bmp, bmp_samples), "image/png": (as_png, png_samples)}


def features(kind: str, samples: np.ndarray) -> str:
    """Type, sample count, sum, changes of side of the middle, and a histogram of 16 bins."""
    bins = np.bincount(samples >> 4, minlength=16)
    turns = int(np.count_nonzero(np.diff(samples >= 128)))
    return f"{kind};n={len(samples)};sum={int(samples.sum(dtype=np.int64))};turns={turns};hist={','.join(map(str, bins.tolist()))}"


def stored_media(documents: DataFrame, multiple: int = 576) -> DataFrame:
    """(doc_id, n_bytes, declared, media binary): each whole text's UTF-8 bytes, filled up with 255, as a sound, a
    bitmap or a PNG image, with a declared type that is right for some and wrong for others.

    Both types follow from a CRC of the payload, so equal texts give equal media; text/plain is declared too. Null
    text: as empty. The fill reaches a positive multiple of `multiple`, which is the images' width and must be a
    multiple of 4. Repeated rows are treated alike, other columns do no harm, no rows give no rows.
    """
    if multiple <= 0 or multiple % 4:
        raise ValueError("the width must be a positive multiple of 4")
    kinds = list(STORED)

    def stored(payload: bytes) -> tuple[str, bytes]:
        drawn, kind = divmod(zlib.crc32(payload), len(kinds))
        to_file = STORED[kinds[kind]][0]
        return [*kinds, "text/plain"][drawn % (len(kinds) + 1)], to_file(payload) if to_file is as_wav else to_file(payload, multiple)

    def run(batch: pa.RecordBatch) -> dict:
        raw = [(t or "").encode() for t in batch.column("text").to_pylist()]
        declared, media = zip(*(stored(b + b"\xff" * (-len(b) % multiple or (0 if b else multiple))) for b in raw))
        return {"doc_id": batch.column("doc_id"), "n_bytes": [len(b) for b in raw], "declared": declared, "media": media}

    return per_batch(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_bytes long, declared string, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_*, tail_crc32, media_*, feature, declared, detected, corrected, carved) of
    (doc_id, n_bytes, declared, media) by sniffing and carving the bytes.

    detected is the type that the bytes show, corrected whether it differs from the declared one; carved holds
    start:length:type of the media that lie within the payload, in order. The medium must be of a type that
    `stored_media` writes, and the first in its bytes. Repeated rows are treated alike; no rows
    give no rows.
    """

    def run(batch: pa.RecordBatch) -> dict:
        rows = []
        for b, declared in zip(batch.column("media").to_pylist(), batch.column("declared").to_pylist()):
            at, n, kind = sniff(b)[0]
            samples = STORED[kind][1](b[at : at + n])
            own = samples.tobytes()
            rows.append((len(own), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-32:]), len(b), hashlib.sha256(b).hexdigest(), features(kind, samples), declared, kind, kind != declared, ",".join(f"{a}:{k}:{t}" for a, k, t in sniff(own))))
        names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "declared", "detected", "corrected", "carved")
        return {"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes")} | dict(zip(names, zip(*rows)))

    return per_batch(media, run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, declared string, detected string, corrected boolean, carved string")
