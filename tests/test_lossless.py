"""Blocks, descriptors and their digests: a sound file and what breaks it."""

import struct
from hashlib import md5

import pytest

from wavequarry.sources import containers
from wavequarry.sources.lossless import CHECKED, FINAL, INITIAL, MONO, block_checksum


def plain_checksum(data, width):
    total = 0xFFFFFFFF
    for (w,) in struct.iter_unpack("<H", data):
        total = (total * 3 + w) % 2**32
    return (total ^ total >> 16 if width == 2 else total).to_bytes(4, "little")[:width]


def block(index, samples=100, flags=INITIAL | FINAL | 1, total=200, rate=9, width=4, items=b"", version=0x410):
    flags |= rate << 23 | (CHECKED if width else 0)
    items += bytes([0x0A, 2]) + b"data"
    size = 32 + len(items) + (2 + width if width else 0)
    out = b"wvpk" + struct.pack("<IHBBIIIII", size - 8, version, 0, 0, total, index, samples, flags, 0) + items
    return out + (bytes([0x2F, width // 2]) + plain_checksum(out, width) if width else b"")


def ape(frames=(b"abcdefgh", b"ijkl"), level=2000, channels=2, offsets=None, last=50, header_data=b"RIFF", md=None, magic=b"MAC "):
    body = b"".join(frames)
    start = 52 + 24 + 4 * len(frames) + len(header_data)
    offsets = offsets or [start + sum(map(len, frames[:k])) for k in range(len(frames))]
    header = struct.pack("<HHIIIHHI", level, 0, 100, last, len(frames), 16, channels, 44100)
    seek = struct.pack(f"<{len(offsets)}I", *offsets)
    digest = md or md5(header_data + body + b"end" + header + seek).digest()
    return magic + struct.pack("<HHIIIIQI", 3990, 3990, 52, 24, len(seek), len(header_data), len(body), 3) + digest + header + seek + header_data + body + b"end"


def failed(data):
    kind, checks = containers.audit(data)
    return kind, {rule for _, rule, ok, _ in checks if not ok}


def test_checksums_equal_the_recurrence():
    for n in (0, 2, 4, 1000, 65536):
        data = bytes((i * 37 + 11) % 256 for i in range(n))
        assert all(block_checksum(data, w) == plain_checksum(data, w) for w in (2, 4))


GOOD = block(0) + block(100)
PAIR = lambda index: block(index, flags=INITIAL | 1) + block(index, flags=FINAL | MONO | 1)


@pytest.mark.parametrize(("data", "want"), [
    (GOOD, set()), (block(0, width=2) + block(100, width=0), set()), (PAIR(0) + PAIR(100), set()), (GOOD + b"APETAGEX tail", set()), (GOOD[:-6] + b"X" + GOOD[-5:], {"METADATA-FRAMING", "ENCODED-CHECKSUM"}),
    (GOOD[:-1] + bytes([GOOD[-1] ^ 1]), {"ENCODED-CHECKSUM"}), (GOOD[:-2], {"BLOCK-BOUNDS", "TOTAL-SAMPLES"}), (block(0, version=0x300), {"BLOCK-BOUNDS", "SEQUENCE"}), (block(0) + block(90), {"SEQUENCE"}), (block(0) + block(100, flags=FINAL | 1), {"SEQUENCE"}),
    (block(0) + block(100, flags=INITIAL | FINAL), {"FORMAT-STABILITY"}), (block(0) + block(100, rate=10), {"FORMAT-STABILITY"}), (block(0, rate=15) + block(100, rate=15), {"FORMAT-STABILITY"}), (block(0, rate=15, items=bytes([0x67, 2, 1, 2, 3, 0])) + block(100, rate=15), set()),
    (block(0, total=300) + block(100), {"TOTAL-SAMPLES"}), (block(0, samples=200_000, total=200_000), {"SEQUENCE"}), (block(0, items=bytes([0x05, 200]), width=0), {"METADATA-FRAMING", "TOTAL-SAMPLES"}),
])
def test_wavpack(data, want):
    assert failed(data) == ("wavpack", want)


@pytest.mark.parametrize(("data", "want"), [
    (ape(), set()), (ape() + b"tag", set()), (ape(level=2500), {"FORMAT"}), (ape(channels=0), {"FORMAT"}), (ape(magic=b"MACF"), {"FORMAT"}), (ape(md=b"x" * 16), {"DESCRIPTOR-MD5"}), (ape(frames=(b"abcdefgh", b"ijk")), {"FRAME-CRC-PRESENCE"}),
    (ape(offsets=[88, 88]), {"SEEK-TABLE", "FRAME-CRC-PRESENCE"}), (ape(last=0), {"DESCRIPTOR-BOUNDS", "FORMAT", "SEEK-TABLE", "FRAME-CRC-PRESENCE", "TOTAL-SAMPLES"}),
    (ape()[:60], {"DESCRIPTOR-BOUNDS", "FORMAT", "SEEK-TABLE", "FRAME-CRC-PRESENCE", "DESCRIPTOR-MD5", "TOTAL-SAMPLES"}),
])
def test_monkeys(data, want):
    assert failed(data) == ("ape", want)
