"""Container audits: signature dispatch, then structure rules per format, one row per check."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from . import isobmff, lossless, wave, wave_xml

CHECKS = "path string, format string, layer string, rule_id string, passed boolean, message string"
Check = tuple[str, str, bool, str]


def u(data: bytes, at: int, n: int, order: str = "big") -> int:
    return int.from_bytes(data[at : at + n], order) if at + n <= len(data) else -1


def iff_chunks(data: bytes, at: int, end: int, order: str) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        n = u(data, at + 4, 4, order)
        yield data[at : at + 4], at + 8, n
        at += 8 + n + n % 2


def riff_chunks(data: bytes) -> Iterator[tuple[bytes, int, int]]:
    """Chunks of a WAVE file; the long form states the size of its data elsewhere."""
    at, stated = 12, None
    while at + 8 <= len(data):
        name, n = data[at : at + 4], u(data, at + 4, 4, "little")
        if name == b"ds64":
            stated = u(data, at + 16, 8, "little")
        if name == b"data" and n == 0xFFFFFFFF and stated is not None and stated >= 0:
            n = stated
        yield name, at + 8, n
        at += 8 + n + n % 2


def riff(data: bytes) -> Iterator[Check]:
    declared = u(data, 4, 4, "little")
    long_form = data[:4] != b"RIFF"
    yield "wrapper", "RIFF-SIZE", long_form or declared + 8 <= len(data), f"{declared} declared"
    names, odd, count = [], False, 0
    for name, at, n in riff_chunks(data):
        names.append(name)
        count += 1
        odd |= name not in (b"data",) and at + n > len(data)
        if count > 100_000:
            break
    yield "wrapper", "CHUNK-COUNT", count <= 100_000, f"{count} chunks"
    yield "wrapper", "CHUNK-BOUNDS", not odd, "chunks inside the file"
    yield "wrapper", "DS64", not long_form or (names[:1] == [b"ds64"]), "the long form begins with ds64"
    yield "wrapper", "FMT-BEFORE-DATA", b"fmt " in names and b"data" in names and names.index(b"fmt ") < names.index(b"data"), "fmt comes before data"
    yield "wrapper", "SINGLE-DATA", names.count(b"data") == 1 and names.count(b"fmt ") == 1, "one fmt and one data"
    frames = None
    try:
        info = wave.probe(data, len(data))
        frames = info["frames"]
        yield "bitstream", "FORMAT", True, info["kind"]
        yield "bitstream", "WHOLE-FRAMES", True, f"{info['frames']} frames"
        yield "bitstream", "CHANNEL-MASK", not info["mask"] or info["mask"].bit_count() <= info["channels"], f"mask {info['mask']:#x}"
    except wave.WaveError as e:
        yield "bitstream", "FORMAT", False, str(e)
    for name, at, n in riff_chunks(data):
        if name == b"bext":
            version = u(data, at + 346, 2, "little")
            yield "wrapper", "BEXT-SIZE", n >= 602, f"{n} bytes"
            yield "wrapper", "BEXT-VERSION", version in (0, 1, 2), f"version {version}"
            date = data[at + 320 : at + 330]
            yield "wrapper", "BEXT-DATE", date == bytes(10) or (len(date) == 10 and date[:4].isdigit() and date[5:7].isdigit() and date[8:10].isdigit()), date.decode("latin-1")
    yield from wave_xml.checks(data, list(riff_chunks(data)), frames)


def aiff(data: bytes) -> Iterator[Check]:
    size = u(data, 4, 4)
    yield "wrapper", "FORM-SIZE", size + 8 <= len(data), f"{size} declared"
    found = {name: (at, n) for name, at, n in iff_chunks(data, 12, len(data), "big")}
    yield "wrapper", "COMM", b"COMM" in found and found[b"COMM"][1] >= 18, "common chunk"
    yield "wrapper", "SSND", b"SSND" in found, "sound chunk"
    yield "wrapper", "FVER", data[8:12] != b"AIFC" or b"FVER" in found, "AIFC says its version"
    if b"COMM" in found and b"SSND" in found and data[8:12] == b"AIFF":
        at = found[b"COMM"][0]
        want = u(data, at, 2) * u(data, at + 2, 4) * ((u(data, at + 6, 2) + 7) // 8)
        yield "bitstream", "FRAMES", want == found[b"SSND"][1] - 8, f"{want} bytes wanted"


def caf(data: bytes) -> Iterator[Check]:
    yield "wrapper", "VERSION", u(data, 4, 2) == 1, "version 1"
    at, names, whole = 8, [], True
    while at + 12 <= len(data):
        n = struct.unpack_from(">q", data, at + 4)[0]
        names.append(data[at : at + 4])
        if n < 0:
            whole &= names[-1] == b"data"
            break
        whole &= at + 12 + n <= len(data)
        at += 12 + n
    yield "wrapper", "DESC-FIRST", names[:1] == [b"desc"], "description comes first"
    yield "wrapper", "DATA", names.count(b"data") == 1, "one data chunk"
    yield "wrapper", "CHUNK-BOUNDS", whole, "chunks inside the file"


def au(data: bytes) -> Iterator[Check]:
    head, size = u(data, 4, 4), u(data, 8, 4)
    yield "wrapper", "OFFSET", 24 <= head <= len(data), f"data at {head}"
    yield "wrapper", "SIZE", size == 0xFFFFFFFF or head + size <= len(data), f"{size} declared"
    yield "bitstream", "ENCODING", 1 <= u(data, 12, 4) <= 27, f"encoding {u(data, 12, 4)}"
    yield "bitstream", "CHANNELS", u(data, 20, 4) > 0 and u(data, 16, 4) > 0, "rate and channels"


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c ^= b
        for _ in range(8):
            c = (c << 1 ^ 0x07) & 0xFF if c & 0x80 else c << 1
    return c


def flac(data: bytes) -> Iterator[Check]:
    at, kinds, ok, last = 4, [], True, False
    while not last and at + 4 <= len(data):
        last, kind, n = bool(data[at] & 0x80), data[at] & 0x7F, u(data, at + 1, 3)
        kinds.append(kind)
        ok &= at + 4 + n <= len(data)
        at += 4 + n
    yield "wrapper", "STREAMINFO-FIRST", kinds[:1] == [0] and kinds.count(0) == 1, "stream information first and once"
    yield "wrapper", "METADATA-BOUNDS", ok and last, "metadata ends inside the file"
    yield "wrapper", "BLOCK-TYPE", all(k <= 6 for k in kinds), "known block types"
    if len(data) >= 42:
        low, high = u(data, 8, 2), u(data, 10, 2)
        packed = u(data, 18, 8)
        yield "bitstream", "BLOCK-SIZE", 16 <= low <= high, f"{low} to {high}"
        yield "bitstream", "SAMPLE-RATE", packed >> 44 > 0, f"{packed >> 44} Hz"
    if ok and last and at + 6 <= len(data):
        yield "bitstream", "FRAME-SYNC", u(data, at, 2) & 0xFFFC == 0xFFF8, "frames follow the metadata"


def mp3(data: bytes) -> Iterator[Check]:
    rates, kbps = (44100, 48000, 32000), (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
    at = 0
    if data[:3] == b"ID3":
        n = sum((data[6 + i] & 0x7F) << (21 - 7 * i) for i in range(4)) if len(data) >= 10 else 0
        yield "wrapper", "ID3-SIZE", len(data) >= 10 and 10 + n <= len(data) and all(b < 0x80 for b in data[6:10]), f"{n} bytes"
        at = 10 + n
    frames, kinds, clean = 0, set(), True
    while at + 4 <= len(data) and data[at : at + 3] != b"TAG":
        h = u(data, at, 4)
        if h >> 21 != 0x7FF or (h >> 19 & 3) != 3 or (h >> 17 & 3) != 1 or not 0 < (h >> 12 & 15) < 15 or (h >> 10 & 3) == 3:
            clean = False
            break
        rate = rates[h >> 10 & 3]
        size = 144_000 * kbps[h >> 12 & 15] // rate + (h >> 9 & 1)
        kinds.add((rate, (h >> 6 & 3) == 3))
        if at + size > len(data):
            clean = False
            break
        frames += 1
        at += size
    yield "bitstream", "FRAMES", frames > 0, f"{frames} frames"
    yield "bitstream", "CONTIGUOUS", clean, f"stopped at {at}" if not clean else "frames follow each other"
    yield "bitstream", "CONSTANT-FORMAT", len(kinds) <= 1, "one rate and channel count"


def adts(data: bytes) -> Iterator[Check]:
    at, frames, kinds, clean = 0, 0, set(), True
    while at + 7 <= len(data):
        if u(data, at, 2) & 0xFFF6 != 0xFFF0:
            clean = False
            break
        size = u(data, at + 3, 3) >> 5 & 0x1FFF
        kinds.add((u(data, at + 2, 2) >> 6) & 0x3FF & ~8)
        if size < 7 or at + size > len(data):
            clean = False
            break
        frames += 1
        at += size
    yield "bitstream", "FRAMES", frames > 0, f"{frames} frames"
    yield "bitstream", "CONTIGUOUS", clean and at == len(data), f"ends at {at}"
    yield "bitstream", "CONSTANT-FORMAT", len(kinds) <= 1, "one configuration"


def ac3(data: bytes) -> Iterator[Check]:
    sizes = (64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384, 448, 512, 640, 768, 896, 1024, 1152, 1280)
    at, frames, clean = 0, 0, True
    while at + 6 <= len(data):
        if data[at : at + 2] != b"\x0b\x77":
            clean = False
            break
        rate, code = data[at + 4] >> 6, data[at + 4] & 63
        if data[at + 5] >> 3 > 10:
            size = ((u(data, at + 2, 2) & 0x7FF) + 1) * 2
        elif rate == 3 or code >= 38:
            clean = False
            break
        else:
            words = sizes[code >> 1]
            size = 2 * (words if rate == 0 else words * 3 // 2 if rate == 2 else words * 48000 // 44100 + (code & 1))
        if at + size > len(data):
            clean = False
            break
        frames += 1
        at += size
    yield "bitstream", "FRAMES", frames > 0, f"{frames} frames"
    yield "bitstream", "CONTIGUOUS", clean, f"ends at {at}"


def ogg_crc(page: bytes) -> int:
    c = 0
    for b in page:
        c ^= b << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if c & 0x80000000 else c << 1
    return c


def ogg(data: bytes) -> Iterator[Check]:
    at, pages, crc, order, granule, begins = 0, 0, True, True, True, 0
    last: dict[int, tuple[int, int]] = {}
    while at + 27 <= len(data):
        if data[at : at + 4] != b"OggS":
            break
        n = data[at + 26]
        size = 27 + n + sum(data[at + 27 : at + 27 + n])
        if at + size > len(data):
            break
        serial, number, position = u(data, at + 14, 4, "little"), u(data, at + 18, 4, "little"), struct.unpack_from("<q", data, at + 6)[0]
        crc &= ogg_crc(data[at : at + 22] + bytes(4) + data[at + 26 : at + size]) == u(data, at + 22, 4, "little")
        begins += data[at + 5] >> 1 & 1
        if serial in last:
            order &= number == last[serial][0] + 1
            granule &= position == -1 or position >= last[serial][1]
        last[serial] = (number, position if position != -1 else last.get(serial, (0, 0))[1])
        pages += 1
        at += size
    yield "wrapper", "PAGES", pages > 0 and at == len(data), f"{pages} pages, ends at {at}"
    yield "wrapper", "PAGE-CRC", crc, "checksums"
    yield "wrapper", "PAGE-SEQUENCE", order, "page numbers"
    yield "wrapper", "GRANULE-ORDER", granule, "positions do not fall"
    yield "wrapper", "BEGIN-OF-STREAM", begins == len(last), "a first page for each stream"


def transport(data: bytes) -> Iterator[Check]:
    packets = [data[i : i + 188] for i in range(0, len(data) - 187, 188)]
    yield "wrapper", "SYNC", bool(packets) and all(p[0] == 0x47 for p in packets) and len(data) % 188 == 0, f"{len(packets)} packets"
    last, steady, scrambled = {}, True, False
    for p in packets:
        pid, flags, count = u(p, 1, 2) & 0x1FFF, p[3] >> 4 & 3, p[3] & 15
        scrambled |= p[3] >> 6 != 0
        if pid != 0x1FFF and flags & 1:
            if pid in last and count not in ((last[pid] + 1) & 15, last[pid]):
                steady = False
            last[pid] = count
    yield "wrapper", "CONTINUITY", steady, "continuity counters"
    yield "wrapper", "PAT", 0 in last, "a programme table"
    yield "wrapper", "CLEAR", not scrambled, "not scrambled"


def matroska(data: bytes) -> Iterator[Check]:
    def number(at: int, keep: bool) -> tuple[int, int]:
        n = 9 - data[at].bit_length() if data[at] else 9
        v = u(data, at, n)
        return (v if keep else v & ((1 << 7 * n) - 1)), at + n

    at, names, ok = 0, [], True
    try:
        while at < len(data):
            name, at = number(at, True)
            width = 9 - data[at].bit_length() if data[at] else 9
            size, at = number(at, False)
            names.append(name)
            if size == (1 << 7 * width) - 1:
                break
            ok &= at + size <= len(data)
            at += size
    except IndexError:
        ok = False
    yield "wrapper", "EBML-HEADER", names[:1] == [0x1A45DFA3], "header first"
    yield "wrapper", "SEGMENT", 0x18538067 in names, "a segment"
    yield "wrapper", "ELEMENT-BOUNDS", ok, "elements inside the file"


def signed_pcm(data: bytes) -> Iterator[Check]:
    """DSF: sizes of its three chunks."""
    yield "wrapper", "DSD-SIZE", u(data, 4, 8, "little") == 28 and u(data, 12, 8, "little") == len(data), "header and file size"
    yield "wrapper", "FMT", data[28:32] == b"fmt " and u(data, 32, 8, "little") == 52, "format chunk"
    yield "wrapper", "DATA", data[80:84] == b"data", "data chunk"


#: Magic bytes at an offset, format name and audit. Fixed values of the public formats.
FORMATS = [
    (0, b"RIFF", "wave", riff), (0, b"RF64", "wave", riff), (0, b"BW64", "wave", riff), (0, b"FORM", "aiff", aiff), (0, b"caff", "caf", caf), (0, b".snd", "au", au), (0, b"fLaC", "flac", flac),
    (0, b"OggS", "ogg", ogg), (0, b"ID3", "mp3", mp3), (4, b"ftyp", "isobmff", isobmff.audit), (4, b"styp", "isobmff", isobmff.audit), (4, b"moof", "isobmff", isobmff.audit), (0, b"\x1aE\xdf\xa3", "matroska", matroska),
    (0, b"DSD ", "dsf", signed_pcm), (0, b"\x0b\x77", "ac3", ac3), (0, b"\x47", "mpegts", transport), (0, b"wvpk", "wavpack", lossless.wavpack), (0, b"MAC ", "ape", lossless.monkeys), (0, b"MACF", "ape", lossless.monkeys),
]


def audit(data: bytes) -> tuple[str, list[Check]]:
    """Format and checks of a file's bytes; unknown ones have no checks."""
    for at, magic, name, run in FORMATS:
        if data[at : at + len(magic)] == magic:
            return name, list(run(data))
    if len(data) > 3 and u(data, 0, 2) & 0xFFF6 == 0xFFF0:
        return "adts", list(adts(data))
    if len(data) > 3 and u(data, 0, 4) >> 21 == 0x7FF:
        return "mp3", list(mp3(data))
    return "unknown", []


def audit_batches(batches):
    names = [x.split()[0] for x in CHECKS.split(", ")]
    for rows in batches:
        out = []
        for path, content in zip(rows["path"], rows["content"], strict=True):
            try:
                kind, checks = audit(bytes(content))
            except (struct.error, IndexError, zlib.error) as e:
                kind, checks = "unreadable", [("wrapper", "READABLE", False, str(e))]
            out += [(path, kind, layer, f"AQ-{kind.upper()}-{rule}", bool(ok), message) for layer, rule, ok, message in checks]
        yield pd.DataFrame(out, columns=names)


def audit_files(spark: SparkSession, path: str) -> DataFrame:
    """A row per file and check of everything under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(audit_batches, CHECKS)
