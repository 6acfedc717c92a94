"""XML chunks of long-form WAVE files (ITU-R BS.2088): plain, compressed and serial documents, and how they may be combined."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from . import manifests as m

Check = tuple[str, str, bool, str]
#: Largest document after decompression; a larger one fails as unreadable.
MOST = 64 * 1024 * 1024
EBU_CORE = r"urn:ebu:metadata-schema:ebuCore_\d{4}"


@dataclass
class Model:
    """What a document says about audio definitions, within frames of a serial model or outside of them."""

    present: bool = False
    ids: set[str] = field(default_factory=set)
    refs: set[str] = field(default_factory=set)


def read_document(data: bytes, form: int = 0) -> ET.Element:
    if form == 1:
        unzip = zlib.decompressobj(31)
        data = unzip.decompress(data, MOST + 1)
        if not unzip.eof or unzip.unused_data:
            raise ValueError("not one whole gzip stream")
    elif form:
        raise ValueError(f"unknown compression {form}")
    if len(data) > MOST:
        raise ValueError("document too large")
    return m.safe_xml(data.decode("utf-8-sig"))


def model_of(root: ET.Element, serial: bool) -> Model:
    """The definition model within (serial) or outside of frame elements."""
    found, stack = Model(), [(root, False, False)]
    while stack:
        e, framed, inside = stack.pop()
        name = m.local(e)
        framed |= name == "frame"
        inside |= name == "audioFormatExtended"
        if framed == serial and (inside or framed):
            found.present |= inside or framed
            found.ids |= {v for k, v in e.attrib.items() if k.endswith(("ID", "UID"))}
            if name.endswith("IDRef") and (e.text or "").strip():
                found.refs.add(e.text.strip())
        stack += [(c, framed, inside) for c in e]
    return found


def read_serial(body: bytes) -> tuple[list[ET.Element], int]:
    """Documents of a serial chunk and the samples that they span; its tables must cover it exactly."""
    number = lambda at, n: int.from_bytes(body[at : at + n], "little")
    form, end = number(0, 2), 10 + number(2, 8)
    if len(body) < 14 or end < 14 or end + 4 > len(body):
        raise ValueError("tables outside the chunk")
    roots, starts, at, sample = [], set(), 14, 0
    for _ in range(number(10, 4)):
        size = number(at, 4)
        if at + 8 + size > end:
            raise ValueError("a document outside its table")
        starts.add((at, sample))
        sample += number(at + 4, 4)
        roots.append(read_document(body[at + 8 : at + 8 + size], form))
        at += 8 + size
    points = number(end, 4)
    if at != end or end + 4 + 16 * points != len(body):
        raise ValueError("tables that do not cover the chunk")
    if any((number(p, 8), number(p + 8, 8)) not in starts for p in range(end + 4, len(body), 16)):
        raise ValueError("an alignment point that is no document's start")
    return roots, sample


def core(root: ET.Element) -> Iterator[Check]:
    if m.local(root) == "ebuCoreMain":
        space = root.tag.rpartition("}")[0].lstrip("{")
        yield "xml", "BS2088-EBUCORE-NAMESPACE", bool(re.fullmatch(EBU_CORE, space)), space
        yield "xml", "BS2088-EBUCORE-STRUCTURE", len(m.children(root, "coreMetadata")) == 1, "one core element"


def checks(data: bytes, chunks: list[tuple[bytes, int, int]], frames: int | None) -> Iterator[Check]:
    """Checks of a file's XML chunks (name, offset, size); none where it has none. frames: its length, if known."""
    bodies = {k: [data[at : at + n] for name, at, n in chunks if name == k] for k in (b"axml", b"bxml", b"sxml")}
    if not any(bodies.values()):
        return
    roots: dict[bytes, list[ET.Element]] = {k: [] for k in bodies}
    broken = (ET.ParseError, ValueError, zlib.error)
    for name, found in bodies.items():
        if found:
            yield "xml", "BS2088-XML-CHUNK-UNIQUE", len(found) == 1, f"{len(found)} {name.decode()} chunks"
    for body in bodies[b"axml"]:
        try:
            roots[b"axml"].append(read_document(body))
            yield "xml", "BS2088-AXML-XML", True, "well-formed"
        except broken as e:
            yield "xml", "BS2088-AXML-XML", False, str(e)
    for body in bodies[b"bxml"]:
        form = int.from_bytes(body[:2], "little") if len(body) >= 2 else -1
        yield "xml", "BS2088-BXML-STRUCTURE", form in (0, 1), f"compression {form}"
        if form in (0, 1):
            try:
                roots[b"bxml"].append(read_document(body[2:], form))
                yield "xml", "BS2088-BXML-XML", True, "well-formed"
            except broken as e:
                yield "xml", "BS2088-BXML-XML", False, str(e)
    for body in bodies[b"sxml"]:
        try:
            found, samples = read_serial(body)
            roots[b"sxml"] += found
            yield "xml", "BS2088-SXML-STRUCTURE", True, f"{len(found)} documents"
            yield "xml", "BS2088-SXML-XML", True, "well-formed"
            yield "xml", "BS2088-SXML-SAMPLE-COUNT", frames is None or samples <= frames, f"{samples} samples"
        except broken as e:
            syntax = isinstance(e, (ET.ParseError, UnicodeDecodeError))
            yield "xml", "BS2088-SXML-XML" if syntax else "BS2088-SXML-STRUCTURE", False, str(e)
    for root in roots[b"axml"] + roots[b"bxml"]:
        yield from core(root)
    models = {(k, serial): [model_of(r, serial) for r in found] for k, found in roots.items() for serial in (False, True)}
    has = lambda k, serial: any(x.present for x in models[k, serial])
    union = lambda serial, part: set().union(*(getattr(x, part) for k in roots for x in models[k, serial]))
    adm = [has(k, False) for k in (b"axml", b"bxml", b"sxml")]
    yield "xml", "BS2088-ADM-PLACEMENT", not (adm[0] and adm[1]) and not adm[2], "definitions in one of axml and bxml"
    yield "xml", "BS2088-ADM-CHNA", not any(adm) or any(name == b"chna" for name, _, _ in chunks), "definitions come with chna"
    yield "xml", "BS2088-SADM-PLACEMENT", not has(b"axml", True) and not has(b"bxml", True), "serial definitions in sxml only"
    crossed = union(False, "refs") & union(True, "ids") | union(True, "refs") & union(False, "ids")
    yield "xml", "BS2088-ADM-SADM-INDEPENDENCE", not crossed, f"{len(crossed)} references between the models"
