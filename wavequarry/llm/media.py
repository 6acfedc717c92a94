"""Media columns: signature sniffing with validated structure, and a lossless store of text as audio.

An Aho-Corasick automaton finds the magic bytes of known formats anywhere in a value; a validator
per format then walks its chunks and confirms lengths. A format confirmed at the start corrects
the declared type, those confirmed further in are carved out.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, worker_cache

BATCH = 256
PAD, RATE = 64, 8000


def u32(data: bytes, at: int, order: str = "<") -> int:
    return struct.unpack_from(order + "I", data, at)[0] if at + 4 <= len(data) else -1


def riff(data: bytes, at: int) -> int:
    """End of a RIFF/WAVE whose chunks fill it and include fmt and data; 0: not one."""
    end = at + 8 + u32(data, at + 4)
    if u32(data, at + 4) < 4 or end > len(data) or data[at + 8 : at + 12] != b"WAVE":
        return 0
    chunk, names = at + 12, set()
    while chunk + 8 <= end:
        names.add(data[chunk : chunk + 4])
        size = u32(data, chunk + 4)
        chunk += 8 + size + size % 2
    return end if chunk == end and {b"fmt ", b"data"} <= names else 0


def png(data: bytes, at: int) -> int:
    chunk = at + 8
    while chunk + 12 <= len(data):
        size, kind = u32(data, chunk, ">"), data[chunk + 4 : chunk + 8]
        stop = chunk + 12 + size
        if stop > len(data) or zlib.crc32(data[chunk + 4 : stop - 4]) != u32(data, stop - 4, ">") or (chunk == at + 8) != (kind == b"IHDR"):
            return 0
        if kind == b"IEND":
            return stop
        chunk = stop
    return 0


def gif(data: bytes, at: int) -> int:
    if at + 13 > len(data):
        return 0
    flags = data[at + 10]
    p = at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)
    images = 0
    while p < len(data):
        if data[p] == 0x3B:
            return p + 1 if images else 0
        if data[p] == 0x2C and p + 10 <= len(data):
            local = data[p + 9]
            p += 11 + (3 << (local & 7) + 1 if local & 0x80 else 0)
            images += 1
        elif data[p] == 0x21:
            p += 2
        else:
            return 0
        while p < len(data) and data[p]:
            p += 1 + data[p]
        p += 1
    return 0


def jpeg(data: bytes, at: int) -> int:
    p, frame = at + 2, False
    while p + 4 <= len(data):
        if data[p] != 0xFF:
            return 0
        mark = data[p + 1]
        if mark == 0xD9:
            return p + 2 if frame else 0
        size = struct.unpack_from(">H", data, p + 2)[0]
        if size < 2:
            return 0
        frame |= 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC)
        p += 2 + size
        if mark == 0xDA:
            while (p := data.find(b"\xff", p)) >= 0 and p + 1 < len(data) and (data[p + 1] == 0 or 0xD0 <= data[p + 1] <= 0xD7):
                p += 2
            if p < 0:
                return 0
    return data[p : p + 2] == b"\xff\xd9" and frame and p + 2 or 0


def pdf(data: bytes, at: int) -> int:
    stop = data.find(b"%%EOF", at)
    return stop + 5 if stop >= 0 and data.find(b"startxref", at, stop) >= 0 else 0


def zipped(data: bytes, at: int) -> int:
    stop = data.find(b"PK\x05\x06", at)
    if stop < 0 or stop + 22 > len(data):
        return 0
    size, offset, note = u32(data, stop + 12), u32(data, stop + 16), struct.unpack_from("<H", data, stop + 20)[0]
    return stop + 22 + note if at + offset + size == stop and stop + 22 + note <= len(data) else 0


def au(data: bytes, at: int) -> int:
    head, size = u32(data, at + 4, ">"), u32(data, at + 8, ">")
    return at + head + size if 24 <= head and size >= 0 and size != 0xFFFFFFFF and at + head + size <= len(data) else 0


#: Magic bytes, media type and validator of each format. Fixed values of the public formats.
FORMATS = [
    (b"RIFF", "audio/wav", riff),
    (b"\x89PNG\r\n\x1a\n", "image/png", png),
    (b"GIF87a", "image/gif", gif),
    (b"GIF89a", "image/gif", gif),
    (b"\xff\xd8\xff", "image/jpeg", jpeg),
    (b"%PDF-", "application/pdf", pdf),
    (b"PK\x03\x04", "application/zip", zipped),
    (b".snd", "audio/basic", au),
]


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, (magic, _, _) in enumerate(FORMATS):
        found.add_word(magic.decode("latin-1"), i)
    found.make_automaton()
    return found


def sniff(data: bytes) -> list[tuple[str, int, int]]:
    """(type, start, stop) of every confirmed format, outermost first; a match inside a confirmed one is listed too."""
    out = []
    for last, i in worker_cache("magic", automaton).iter(data.decode("latin-1")):
        magic, kind, check = FORMATS[i]
        at = last - len(magic) + 1
        if stop := check(data, at):
            out.append((kind, at, stop))
    return sorted(out, key=lambda x: (x[1], -x[2]))


def to_wave(payload: bytes) -> bytes:
    """Unsigned 8-bit mono PCM; a RIFF size limits a payload to 4 GiB."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload


def from_wave(data: bytes) -> bytes:
    """Samples of a confirmed WAVE file."""
    at = 12
    while data[at : at + 4] != b"data":
        size = u32(data, at + 4)
        at += 8 + size + size % 2
    return data[at + 8 : at + 8 + u32(data, at + 4)]


def sniff_for(declared: str | None):
    def go(batches):
        for batch in batches:
            for i in range(0, len(batch), BATCH):
                rows = []
                for key, data, said in zip(*(batch.column(c)[i : i + BATCH].to_pylist() for c in range(3)), strict=True):
                    found = sniff(data or b"")
                    whole = found and found[0][1] == 0
                    rows.append((key, found[0][0] if whole else said, bool(whole), [{"type": k, "start": a, "stop": b, "data": data[a:b]} for k, a, b in found[1 if whole else 0 :]]))
                kind = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("data", pa.binary())]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.bool_(), kind), strict=True)], names=["key", "type", "confirmed", "embedded"])

    return go


def inspect(media: DataFrame, key: str, data: str, declared: str | None = None) -> DataFrame:
    """(key, type, confirmed, embedded): the confirmed type of each value or else the declared one, and what it carries within.

    embedded is an array of (type, start, stop, data). A null value is empty: nothing is confirmed.
    """
    rows = media.select(F.col(key).cast("long").alias("key"), F.col(data).cast("binary").alias("data"), (F.col(declared) if declared else F.lit(None)).cast("string").alias("said"))
    schema = "key long, type string, confirmed boolean, embedded array<struct<type:string,start:bigint,stop:bigint,data:binary>>"
    return rows.mapInArrow(sniff_for(declared), schema).withColumnRenamed("key", key)


def stored(batches):
    """Text to payload to stored WAVE, sniffed, and back."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    names = ["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media"]
    for batch in batches:
        for i in range(0, len(batch), BATCH):
            rows = []
            for key, text in zip(batch.column(0)[i : i + BATCH].to_pylist(), batch.column(1)[i : i + BATCH].to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                media = to_wave(raw + bytes(-len(raw) % PAD or (0 if raw else PAD)))
                found = sniff(media)
                if not found or found[0][1:] != (0, len(media)):
                    raise ValueError("the stored form is not a whole WAVE file")
                back = from_wave(media)
                levels = np.frombuffer(back, np.uint8)
                inner = ",".join(f"{k}@{a - 44}+{b - a}" for k, a, b in found[1:])
                feature = f"{found[0][0]};rate={RATE};bits=8;frames={len(back)};peak={int(np.abs(levels.astype(np.int16) - 128).max())};mean={levels.mean():.6f};embedded={inner}"
                rows.append((key, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), feature, media))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text as a WAVE file (`media`) with digests and features of what reading it back gives.

    A null text is empty: 64 zero bytes. Repeated rows give a row each; other columns are ignored.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    schema = "key long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media binary"
    return rows.mapInArrow(stored, schema).withColumnRenamed("key", key)


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("media")
