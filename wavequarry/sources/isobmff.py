"""Audit of ISO base media files: boxes, movies, tracks, sample tables and fragments.

A file's boxes are read into a tree of byte ranges; tables become numpy arrays, and each rule is a
predicate on them. Checks that need a table which is missing or misshapen aren't made: the table has failed its own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

#: Boxes that hold boxes. Fixed values of the public format.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"mvex", b"moof", b"traf"}
DEPTH = 8
Check = tuple[str, str, bool, str]


@dataclass
class Box:
    name: bytes
    start: int
    end: int
    inner: list[Box] = field(default_factory=list)

    def all(self, *path: bytes) -> list[Box]:
        found = [self]
        for name in path:
            found = [b for f in found for b in f.inner if b.name == name]
        return found

    def one(self, *path: bytes) -> Box | None:
        found = self.all(*path)
        return found[0] if len(found) == 1 else None


def tree(data: bytes, start: int, end: int, depth: int = 0) -> tuple[list[Box], bool]:
    """Boxes of a range, and whether they fill it exactly, inner ones too; no valid file nests deeper than `DEPTH`."""
    if depth > DEPTH:
        return [], False
    out, at, whole = [], start, True
    while at < end:
        size, name, head = int.from_bytes(data[at : at + 4]), data[at + 4 : at + 8], 8
        if size == 1:
            size, head = int.from_bytes(data[at + 8 : at + 16]), 16
        size = size or end - at
        if at + head > end or size < head or at + size > end:
            return out, False
        box = Box(name, at + head, at + size)
        if name in CONTAINERS:
            box.inner, fits = tree(data, box.start, box.end, depth + 1)
            whole &= fits
        out.append(box)
        at += size
    return out, whole


class Reader:
    """Fields of a full box; a read beyond its end gives None."""

    def __init__(self, data: bytes, box: Box):
        self.data, self.box = data, box
        self.version, self.flags = self.number(0, 1), self.number(1, 3)

    def number(self, at: int, n: int, signed: bool = False) -> int | None:
        a = self.box.start + at
        return int.from_bytes(self.data[a : a + n], signed=signed) if a + n <= self.box.end else None

    def rows(self, at: int, columns: int, kind: str = ">u4") -> np.ndarray | None:
        """The table behind a count of rows at an offset; None unless it ends with the box."""
        n = self.number(at, 4)
        if n is None or self.box.start + at + 4 + n * columns * np.dtype(kind).itemsize != self.box.end:
            return None
        return np.frombuffer(self.data, kind, n * columns, self.box.start + at + 4).reshape(n, columns).astype(np.int64)


def reader(data: bytes, box: Box | None) -> Reader | None:
    return Reader(data, box) if box else None


def times(r: Reader | None) -> tuple[int | None, int | None]:
    """Timescale and duration of a movie or media header."""
    if r is None:
        return None, None
    return (r.number(20, 4), r.number(24, 8)) if r.version == 1 else (r.number(12, 4), r.number(16, 4))


def sizes(r: Reader | None) -> tuple[int, int] | None:
    """Number and total of samples by either form of the size table."""
    if r is None:
        return None
    n = r.number(8, 4)
    if n is None:
        return None
    if r.box.name == b"stsz":
        if fixed := r.number(4, 4):
            return (n, n * fixed) if r.box.end == r.box.start + 12 else None
        table = r.rows(8, 1)
        return (n, int(table.sum())) if table is not None else None
    width = r.number(7, 1)
    if width not in (4, 8, 16) or r.box.end - r.box.start != 12 + (n * width + 7) // 8:
        return None
    raw = np.frombuffer(r.data, np.uint8, r.box.end - r.box.start - 12, r.box.start + 12)
    values = raw if width == 8 else raw[: n * 2].view(">u2") if width == 16 else np.stack([raw >> 4, raw & 15], 1).ravel()[:n]
    return n, int(values.astype(np.int64).sum())


def tables(data: bytes, stbl: Box, media: list[Box], duration: int | None, fragmented: bool) -> Iterator[Check]:
    """Rules of one audio track's sample table, by itself and against the media boxes."""
    get = lambda *names: reader(data, next((b for n in names if (b := stbl.one(n))), None))
    once = {n: len(stbl.all(n)) for n in (b"stsd", b"stts", b"stsc", b"stsz", b"stz2", b"stco", b"co64")}
    yield "wrapper", "SAMPLE-TABLE", once[b"stsd"] == once[b"stts"] == once[b"stsc"] == once[b"stsz"] + once[b"stz2"] == once[b"stco"] + once[b"co64"] == 1, "each table once"
    stsd, entries = get(b"stsd"), []
    if stsd:
        entries, fits = tree(data, stsd.box.start + 8, stsd.box.end)
        yield "wrapper", "SAMPLE-DESCRIPTION", fits and 0 < len(entries) == stsd.number(4, 4), f"{len(entries)} entries"
        sound = [(int.from_bytes(data[e.start + 16 : e.start + 18]), int.from_bytes(data[e.start + 24 : e.start + 28]) >> 16) for e in entries if e.end - e.start >= 28]
        yield "bitstream", "AUDIO-DESCRIPTION", 0 < len(sound) == len(entries) and all(c and rate for c, rate in sound), f"channels and rates {sound}"
    stts, stsc, size = get(b"stts"), get(b"stsc"), get(b"stsz", b"stz2")
    spans = stts.rows(4, 2) if stts else None
    if stts:
        yield "wrapper", "TIME-TO-SAMPLE", spans is not None and bool((spans > 0).all()), "runs of positive counts and durations"
    samples = sizes(size)
    if size:
        yield "wrapper", "SAMPLE-SIZE" if size.box.name == b"stsz" else "COMPACT-SAMPLE-SIZE", samples is not None, "sizes fill their box"
    runs = stsc.rows(4, 3) if stsc else None
    if stsc:
        ordered = runs is not None and (len(runs) == 0 or bool(runs[0, 0] == 1 and (np.diff(runs[:, 0]) > 0).all() and (runs[:, 1:] > 0).all() and (runs[:, 2] <= max(len(entries), 1)).all()))
        yield "wrapper", "SAMPLE-TO-CHUNK", ordered, "runs rise from chunk one and name a description"
        runs = runs if ordered else None
    place = get(b"stco", b"co64")
    offsets = place.rows(4, 1, ">u4" if place.box.name == b"stco" else ">u8") if place else None
    if place:
        yield "wrapper", "CHUNK-OFFSETS", offsets is not None and bool((np.diff(offsets[:, 0]) > 0).all()), "offsets rise"
    if spans is not None and samples:
        yield "xcheck", "SAMPLE-COUNT-XCHECK", int(spans[:, 0].sum()) == samples[0], f"{spans[:, 0].sum()} timed, {samples[0]} sized"
    if spans is not None and duration is not None and not fragmented:
        yield "xcheck", "DURATION-XCHECK", int((spans[:, 0] * spans[:, 1]).sum()) == duration, f"{duration} declared"
    if runs is not None and offsets is not None and samples:
        last = np.append(runs[1:, 0], len(offsets) + 1)
        placed = int(((last - runs[:, 0]) * runs[:, 1]).sum()) if len(runs) else 0
        yield "xcheck", "CHUNK-SAMPLE-COUNT-XCHECK", placed == samples[0] and bool((last >= runs[:, 0]).all()), f"{placed} in chunks, {samples[0]} sized"
    if offsets is not None and len(offsets) and media:
        starts, ends = np.array(sorted((m.start, m.end) for m in media)).T
        at = np.searchsorted(starts, offsets[:, 0], "right") - 1
        outside = int(((at < 0) | (offsets[:, 0] >= ends[np.maximum(at, 0)])).sum())
        yield "xcheck", "CHUNK-OFFSET-XCHECK", outside == 0, f"{outside} outside the media"
    if samples:
        held = sum(m.end - m.start for m in media)
        yield "xcheck", "SAMPLE-BYTES-XCHECK", samples[1] <= held, f"{samples[1]} of {held} bytes"
    for box in stbl.all(b"sbgp"):
        r = Reader(data, box)
        groups = r.rows(12 if r.version == 1 else 8, 2)
        yield "wrapper", "SAMPLE-TO-GROUP", groups is not None, "runs fill their box"
        if groups is not None and samples:
            yield "xcheck", "SAMPLE-GROUP-COUNT-XCHECK", int(groups[:, 0].sum()) == samples[0], f"{groups[:, 0].sum()} grouped, {samples[0]} sized"


def fragments(data: bytes, root: Box) -> Iterator[Check]:
    moofs, movie = root.all(b"moof"), root.one(b"moov")
    numbers = [r.number(4, 4) if (r := reader(data, m.one(b"mfhd"))) else None for m in moofs]
    yield "wrapper", "FRAGMENT-HEADER", None not in numbers, "a sequence number for each fragment"
    yield "bitstream", "FRAGMENT-SEQUENCE", None not in numbers and all(b == a + 1 for a, b in zip(numbers, numbers[1:], strict=False)), f"{len(numbers)} fragments"
    tracks = [(reader(data, t.one(b"tfhd")), reader(data, t.one(b"tfdt"))) for m in moofs for t in m.all(b"traf")]
    yield "wrapper", "TRACK-FRAGMENT", bool(tracks) and all(head and head.number(4, 4) for head, _ in tracks), f"{len(tracks)} track fragments"
    last, steady = {}, True
    for head, time in tracks:
        if head and time:
            track, now = head.number(4, 4), time.number(4, 8 if time.version == 1 else 4)
            steady &= now is not None and now >= last.get(track, 0)
            last[track] = now or 0
    yield "bitstream", "FRAGMENT-TIMELINE", steady, "decode times do not fall"
    if movie:
        extended = {Reader(data, b).number(4, 4) for b in movie.all(b"mvex", b"trex")}
        yield "wrapper", "TRACK-EXTENDS", all(head is None or head.number(4, 4) in extended for head, _ in tracks), f"defaults for {len(extended)} tracks"


def audit(data: bytes) -> Iterator[Check]:
    top, whole = tree(data, 0, len(data))
    root = Box(b"", 0, len(data), top)
    names = Counter(b.name for b in top)
    fragmented, media = bool(names[b"moof"]), root.all(b"mdat")
    yield "wrapper", "BOX-SCAN", whole, "boxes fill the file and their parents"
    yield "wrapper", "STRUCTURE", bool(names[b"moov"] or fragmented), "a movie or a fragment"
    yield "wrapper", "FILE-TYPE-REQUIRED", bool(top) and (top[0].name in (b"ftyp", b"styp") or (fragmented and not names[b"moov"])), "file type first; a bare fragment needs none"
    for b in root.all(b"ftyp") + root.all(b"styp"):
        brand = data[b.start : b.start + 4]
        yield "wrapper", "FILE-TYPE", b.end - b.start >= 8 and (b.end - b.start) % 4 == 0 and all(32 <= c < 127 for c in brand), f"brand {brand!r}"
    yield "wrapper", "MOOV-UNIQUE", names[b"moov"] <= 1, f"{names[b'moov']} movies"
    yield "wrapper", "MDAT-REQUIRED", bool(media) or not names[b"moov"], f"{len(media)} media boxes"
    for movie in root.all(b"moov"):
        scale, _ = times(reader(data, movie.one(b"mvhd")))
        yield "wrapper", "MOVIE-HEADER", bool(scale), f"timescale {scale}"
        tracks = movie.all(b"trak")
        heads = [reader(data, t.one(b"tkhd")) for t in tracks]
        ids = [h.number(20 if h.version == 1 else 12, 4) if h else None for h in heads]
        yield "wrapper", "TRACK-HEADER", all(ids) and len(set(ids)) == len(ids), f"tracks {ids}"
        kinds = [data[h.start + 8 : h.start + 12] if (h := t.one(b"mdia", b"hdlr")) else None for t in tracks]
        yield "wrapper", "HANDLER", None not in kinds, f"{len(tracks)} handlers"
        yield "wrapper", "AUDIO-TRACK", b"soun" in kinds, f"{kinds.count(b'soun')} audio tracks"
        for track, kind in zip(tracks, kinds, strict=True):
            scale, duration = times(reader(data, track.one(b"mdia", b"mdhd")))
            yield "wrapper", "MEDIA-HEADER", bool(scale), f"timescale {scale}"
            if edits := reader(data, track.one(b"edts", b"elst")):
                wide = edits.version == 1
                n, row, at, width = edits.number(4, 4), *((20, 16, 8) if wide else (12, 12, 4))
                fits = n is not None and edits.box.end - edits.box.start == 8 + n * row
                starts = [edits.number(at + i * row, width, signed=True) for i in range(n)] if fits else [-2]
                yield "wrapper", "EDIT-LIST", min(starts, default=0) >= -1, f"{n} edits"
            if kind == b"soun" and (stbl := track.one(b"mdia", b"minf", b"stbl")):
                yield from tables(data, stbl, media, duration, fragmented or bool(movie.all(b"mvex")))
            elif kind == b"soun":
                yield "wrapper", "SAMPLE-TABLE", False, "no sample table"
    if fragmented:
        yield from fragments(data, root)
