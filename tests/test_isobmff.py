"""Rules on ISO base media files: files that pass them all, and one change for each rule that fails it."""

import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wavequarry.sources import containers, isobmff


def box(name, *parts):
    return struct.pack(">I", 8 + sum(map(len, parts))) + name + b"".join(parts)


def full(name, *words, version=0, tail=b""):
    return box(name, struct.pack(f">I{len(words)}I", version << 24, *words), tail)


ENTRY = box(b"mp4a", bytes(6) + b"\0\1" + bytes(8) + struct.pack(">HHHHI", 2, 16, 0, 0, 48000 << 16))
FTYP = box(b"ftyp", b"isom" + bytes(4) + b"isom")
#: Four samples of 1024 ticks in two chunks; offsets are filled in by whole().
TABLE = {
    "stsd": full(b"stsd", 1, tail=ENTRY), "stts": full(b"stts", 1, 4, 1024), "stsc": full(b"stsc", 1, 1, 2, 1), "stsz": full(b"stsz", 0, 4, 10, 11, 12, 13),
    "stco": full(b"stco", 2, 0, 21), "sbgp": full(b"sbgp", int.from_bytes(b"roll"), 1, 4, 1),
}


def track(table=TABLE, number=1, handler=b"soun", mdhd=None, edits=None):
    head = full(b"tkhd", 0, 0, number, 0, 4096)
    media = box(b"mdia", mdhd or full(b"mdhd", 0, 0, 48000, 4096, 0), full(b"hdlr", 0, int.from_bytes(handler), 0, 0, 0), box(b"minf", box(b"stbl", *table.values())))
    return box(b"trak", head, box(b"edts", edits or full(b"elst", 1, 4096, 0, 1 << 16)), media)


def whole(tracks=None, mvhd=None, media=bytes(46), shift=0, front=FTYP):
    """A file with its media first, so that the chunks lie at fixed places."""
    at = len(front) + 8 + shift
    tracks = [t.replace(struct.pack(">III", 2, 0, 21), struct.pack(">III", 2, at, at + 21)) for t in (tracks if tracks is not None else [track()])]
    return front + (box(b"mdat", media) if media is not None else b"") + box(b"moov", mvhd or full(b"mvhd", 0, 0, 1000, 85), *tracks)


def changed(**boxes):
    return whole([track({**TABLE, **boxes})])


def fragment(number, time, track_id=1, mfhd=True):
    return box(b"moof", *([full(b"mfhd", number)] if mfhd else []), box(b"traf", full(b"tfhd", track_id), full(b"tfdt", 0, time, version=1))) + box(b"mdat", bytes(8))


EMPTY = {"stsd": TABLE["stsd"], "stts": full(b"stts", 0), "stsc": full(b"stsc", 0), "stsz": full(b"stsz", 0, 0), "stco": full(b"stco", 0)}
INIT = FTYP + box(b"moov", full(b"mvhd", 0, 0, 1000, 0), track(EMPTY), box(b"mvex", full(b"trex", 1, 1, 0, 0, 0)))
GOOD = {
    "whole": whole(), "fragmented": INIT + fragment(1, 0) + fragment(2, 1024), "bare": fragment(7, 9) + fragment(8, 9),
    "compact": changed(stsz=full(b"stz2", 4, 4, tail=bytes([0x9A, 0xBC]))), "fixed": changed(stsz=full(b"stsz", 11, 4)), "long": changed(stco=full(b"co64", 2, 0, len(FTYP) + 8, 0, len(FTYP) + 29)),
    "long edit": whole([track(edits=full(b"elst", 1, 0, 4096, 0xFFFFFFFF, 0xFFFFFFFF, 1 << 16, version=1))]),
}
BROKEN = [
    ("BOX-SCAN", whole() + b"\0\0\0\x20free"),
    ("STRUCTURE", FTYP + box(b"mdat", b"x")),
    ("FILE-TYPE-REQUIRED", whole(front=box(b"free"))),
    ("FILE-TYPE", whole(front=box(b"ftyp", b"is\0m" + bytes(4)))),
    ("MOOV-UNIQUE", whole() + box(b"moov", full(b"mvhd", 0, 0, 1000, 0), track())),
    ("MDAT-REQUIRED", whole(media=None)),
    ("MOVIE-HEADER", whole(mvhd=full(b"mvhd", 0, 0, 0, 0))),
    ("TRACK-HEADER", whole([track(), track()])),
    ("HANDLER", whole([track().replace(b"hdlr", b"free")])),
    ("AUDIO-TRACK", whole([track(handler=b"vide")])),
    ("MEDIA-HEADER", whole([track(mdhd=full(b"mdhd", 0, 0, 0, 4096, 0))])),
    ("EDIT-LIST", whole([track(edits=full(b"elst", 1, 4096, 0xFFFFFFFE, 1 << 16))])),
    ("EDIT-LIST", whole([track(edits=full(b"elst", 2, 4096, 0, 1 << 16))])),
    ("SAMPLE-TABLE", changed(stsz=TABLE["stsz"] * 2)),
    ("SAMPLE-TABLE", whole([track().replace(b"stbl", b"free")])),
    ("SAMPLE-DESCRIPTION", changed(stsd=full(b"stsd", 2, tail=ENTRY))),
    ("AUDIO-DESCRIPTION", changed(stsd=full(b"stsd", 1, tail=ENTRY.replace(struct.pack(">HH", 2, 16), struct.pack(">HH", 0, 16))))),
    ("TIME-TO-SAMPLE", changed(stts=full(b"stts", 2, 4, 1024))),
    ("SAMPLE-SIZE", changed(stsz=full(b"stsz", 0, 4, 10, 11))),
    ("COMPACT-SAMPLE-SIZE", changed(stsz=full(b"stz2", 5, 4, tail=bytes(4)))),
    ("SAMPLE-TO-CHUNK", changed(stsc=full(b"stsc", 1, 2, 2, 1))),
    ("SAMPLE-TO-CHUNK", changed(stsc=full(b"stsc", 1, 1, 2, 2))),
    ("CHUNK-OFFSETS", changed(stco=full(b"stco", 2, 40, 30))),
    ("SAMPLE-COUNT-XCHECK", changed(stts=full(b"stts", 1, 2, 2048))),
    ("DURATION-XCHECK", changed(stts=full(b"stts", 1, 4, 1000))),
    ("CHUNK-SAMPLE-COUNT-XCHECK", changed(stsc=full(b"stsc", 1, 1, 3, 1))),
    ("CHUNK-OFFSET-XCHECK", whole(shift=40)),
    ("SAMPLE-BYTES-XCHECK", whole(media=bytes(45))),
    ("SAMPLE-TO-GROUP", changed(sbgp=full(b"sbgp", 0, 2, 4, 1))),
    ("SAMPLE-GROUP-COUNT-XCHECK", changed(sbgp=full(b"sbgp", 0, 1, 3, 1))),
    ("FRAGMENT-HEADER", INIT + fragment(1, 0, mfhd=False)),
    ("FRAGMENT-SEQUENCE", INIT + fragment(1, 0) + fragment(3, 0)),
    ("FRAGMENT-TIMELINE", INIT + fragment(1, 9) + fragment(2, 8)),
    ("TRACK-FRAGMENT", INIT + fragment(1, 0, track_id=0)),
    ("TRACK-EXTENDS", INIT + fragment(1, 0, track_id=2)),
]


def failed(data):
    return {rule for _, rule, ok, _ in isobmff.audit(data) if not ok}


@pytest.mark.parametrize("name", GOOD)
def test_good_files_pass(name):
    assert failed(GOOD[name]) == set()
    assert containers.audit(GOOD[name])[0] == "isobmff"


@pytest.mark.parametrize("at", range(len(BROKEN)), ids=lambda i: f"{i}-{BROKEN[i][0]}")
def test_changed_files_fail_their_rule(at):
    rule, data = BROKEN[at]
    assert rule in failed(data)


def test_endless_nesting_is_rejected():
    data = b""
    for _ in range(3000):
        data = box(b"moov", data)
    assert "BOX-SCAN" in failed(FTYP + data)


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(sorted(GOOD)), st.integers(0, 2000), st.integers(0, 255), st.integers(0, 2000))
def test_any_damage_is_judged(name, at, value, cut):
    data = bytearray(GOOD[name][: max(cut, 12)])
    data[at % len(data)] = value
    assert all(isinstance(rule, str) for _, rule, _, _ in isobmff.audit(bytes(data)))
