"""Audits of two lossless formats: blocks, metadata and checksums; descriptors, seek tables and digests. Nothing is decoded."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import md5

import numpy as np

Check = tuple[str, str, bool, str]
#: Fixed values of the public formats.
RATES = (6000, 8000, 9600, 11025, 12000, 16000, 22050, 24000, 32000, 44100, 48000, 64000, 88200, 96000, 192000)
VERSIONS = range(0x402, 0x411)
LARGEST_BLOCK, MOST_SAMPLES = 1 << 24, 131_072
MONO, INITIAL, FINAL, CHECKED, FALSE_STEREO = 1 << 2, 1 << 11, 1 << 12, 1 << 28, 1 << 30
LEVELS, DEPTHS, FLAGS, FLOAT = (1000, 2000, 3000, 4000, 5000), (8, 16, 24, 32), (1 << 13) - 1, 1 << 12
DESCRIPTOR, HEADER = 52, 24


def le(data: bytes, at: int, n: int) -> int:
    return int.from_bytes(data[at : at + n], "little")


def block_checksum(data: bytes, width: int) -> bytes:
    """Of 16-bit words w: s becomes 3 s + w, from all ones; written out as one sum over powers of three."""
    words = np.frombuffer(data[: len(data) // 2 * 2], "<u2").astype(np.uint32)
    powers = np.cumprod(np.append(np.uint32(1), np.full(len(words), 3, np.uint32)), dtype=np.uint32)
    total = (int(powers[-1]) * 0xFFFFFFFF + int((powers[-2::-1] * words).sum(dtype=np.uint32) if len(words) else 0)) & 0xFFFFFFFF
    return (total ^ total >> 16 if width == 2 else total).to_bytes(4, "little")[:width]


@dataclass
class Block:
    flags: int
    index: int
    samples: int
    total: int | None
    rate: int | None
    framed: bool
    checked: bool

    @property
    def layout(self) -> tuple:
        """What all blocks of a group, and all groups, have in common."""
        return self.flags & 3, self.flags >> 7 & 1, self.flags >> 31


def read_block(block: bytes) -> Block:
    """One whole block, its items walked from the header to its end."""
    flags, low = le(block, 24, 4), le(block, 12, 4)
    framed, checked, sums, rates, at = True, True, 0, [], 32
    while at < len(block) and framed:
        start, item = at, block[at]
        size = 2 * (le(block, at + 1, 3) if item & 0x80 else le(block, at + 1, 1))
        at += 4 if item & 0x80 else 2
        if at > len(block) or size > len(block) - at or (item & 0x40 and not size):
            framed = False
            break
        length = size - bool(item & 0x40)
        if item & 0x3F == 0x27:
            rates.append(le(block, at, 3))
            framed &= length in (3, 4) and rates[-1] > 0 and len(rates) == 1
        elif item & 0x3F == 0x2F:
            sums += 1
            placed = sums == 1 and not item & 0xC0 and length in (2, 4) and at + size == len(block)
            framed &= placed
            checked &= placed and block[at : at + length] == block_checksum(block[:start], length)
        at += size
    agreed = bool(flags & CHECKED) == (sums == 1)
    code = flags >> 23 & 15
    rate = RATES[code] if code < 15 else rates[0] if rates else None
    total = None if low == 0xFFFFFFFF else low | block[11] << 32
    return Block(flags, le(block, 16, 4) | block[10] << 32, le(block, 20, 4), total, rate, framed and agreed, checked and agreed)


def wavpack(data: bytes) -> Iterator[Check]:
    blocks, whole, at = [], True, 0
    while (at := data.find(b"wvpk", at)) >= 0:
        size = le(data, at + 4, 4) + 8
        if not 32 <= size <= LARGEST_BLOCK or size % 2 or at + size > len(data) or le(data, at + 8, 2) not in VERSIONS:
            whole = False
            at += 4
            continue
        blocks.append(read_block(data[at : at + size]))
        at += size
    yield "wrapper", "BLOCK-BOUNDS", whole and bool(blocks), f"{len(blocks)} blocks"
    yield "wrapper", "METADATA-FRAMING", all(b.framed for b in blocks), "items inside their blocks"
    yield "bitstream", "ENCODED-CHECKSUM", all(b.checked for b in blocks), "checksums of blocks that have one"
    groups: list[list[Block]] = []
    ordered, closed = True, True
    for b in (b for b in blocks if b.samples):
        ordered &= b.samples <= MOST_SAMPLES and bool(b.flags & INITIAL) == closed
        if closed or b.flags & INITIAL:
            groups.append([])
        groups[-1].append(b)
        closed = bool(b.flags & FINAL)
    ordered &= closed and bool(groups)
    for g in groups:
        ordered &= len({(b.index, b.samples, b.layout) for b in g}) == 1 and len({b.rate for b in g if b.rate}) <= 1
    ordered &= all(a[0].index + a[0].samples == b[0].index for a, b in zip(groups, groups[1:], strict=False))
    yield "bitstream", "SEQUENCE", ordered, f"{len(groups)} groups"
    rate = lambda g: next((b.rate for b in g if b.rate), None)
    formats = {(g[0].layout, sum(1 if b.flags & MONO else 2 for b in g)) for g in groups}
    rates = {rate(g) for g in groups} - {None}
    plain = not any(b.flags & MONO and b.flags & FALSE_STEREO for b in blocks)
    yield "bitstream", "FORMAT-STABILITY", plain and len(formats) <= 1 and (len(rates) == 1 or not groups), "one format and rate"
    declared = groups[0][0].total if groups and groups[0][0].index == 0 else None
    found = sum(g[0].samples for g in groups)
    yield "xcheck", "TOTAL-SAMPLES", declared is None or declared == found, f"{declared} declared, {found} found"


def monkeys(data: bytes) -> Iterator[Check]:
    sizes = [le(data, at, 4) for at in (8, 12, 16, 20)] + [le(data, 24, 8), le(data, 32, 4)]
    starts = [sum(sizes[:k]) for k in range(7)]  # descriptor, header, seek table, original header, frames, original end
    descriptor, header, seek, _, frames, _ = sizes
    bounded = data[:4] in (b"MAC ", b"MACF") and 3980 <= le(data, 4, 2) <= 3990 and descriptor >= DESCRIPTOR and header >= HEADER and seek > 0 and seek % 4 == 0 and frames > 0 and starts[6] <= len(data)
    h = data[starts[1] :] if bounded else b""
    level, flags, per_frame, last, count = le(h, 0, 2), le(h, 2, 2), le(h, 4, 4), le(h, 8, 4), le(h, 12, 4)
    depth, channels, rate = le(h, 16, 2), le(h, 18, 2), le(h, 20, 4)
    geometry = bounded and 0 < last <= per_frame <= (10_000_000 if level >= 5000 else 1_000_000) and 0 < count <= seek // 4
    yield "wrapper", "DESCRIPTOR-BOUNDS", geometry, f"regions end at {starts[6]} of {len(data)}"
    yield "wrapper", "FORMAT", geometry and level in LEVELS and not flags & ~FLAGS and depth in DEPTHS and 1 <= channels <= 32 and rate > 0 and (data[:4] == b"MACF") == bool(flags & FLOAT), f"level {level}, {depth} bits, {channels} channels at {rate} Hz"
    at = np.frombuffer(data[starts[2] : starts[2] + 4 * count], "<u4").astype(np.int64) if geometry else np.zeros(0, np.int64)
    at = at + (np.concatenate([[0], np.cumsum(np.diff(at) < 0)]) << 32 if len(at) else 0)  # offsets wrap at 4 GiB
    lengths = np.diff(np.append(at, starts[5]))
    seekable = geometry and int(at[0]) == starts[4] and bool((lengths > 0).all())
    yield "bitstream", "SEEK-TABLE", seekable, f"{count} frames"
    yield "bitstream", "FRAME-CRC-PRESENCE", seekable and bool((lengths >= 4).all()), "room for a checksum in each frame"
    regions = [(3, 4), (4, 6), (1, 2), (2, 3)]
    digest = md5(b"".join(data[starts[a] : starts[b]] for a, b in regions), usedforsecurity=False).digest() if bounded else b""
    yield "bitstream", "DESCRIPTOR-MD5", digest == data[36:52] != bytes(16), "digest of all regions"
    yield "xcheck", "TOTAL-SAMPLES", geometry and (count - 1) * per_frame + last > 0, f"{max(0, count - 1) * per_frame + last} samples"
