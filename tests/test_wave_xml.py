"""XML chunks of WAVE files, and what breaks their rules."""

import gzip
import struct

import pytest

from wavequarry.sources import containers

ADM = b'<ebuCoreMain xmlns="urn:ebu:metadata-schema:ebuCore_2016"><coreMetadata><format><audioFormatExtended><audioObject audioObjectID="AO_1001"><audioPackFormatIDRef>AP_1</audioPackFormatIDRef></audioObject></audioFormatExtended></format></coreMetadata></ebuCoreMain>'
SADM = b'<frame><frameHeader/><audioFormatExtended><audioObject audioObjectID="AO_2001"/></audioFormatExtended></frame>'


def serial(docs, points=((14, 0),), form=0):
    table = b"".join(struct.pack("<II", len(d), n) + d for d, n in docs)
    return struct.pack("<HQI", form, len(table) + 4, len(docs)) + table + struct.pack("<I", len(points)) + b"".join(struct.pack("<QQ", *p) for p in points)


def wave(*chunks, chna=True, frames=10):
    parts = [(b"fmt ", struct.pack("<HHIIHH", 1, 1, 48000, 96000, 2, 16)), *([(b"chna", bytes(4))] if chna else []), *chunks, (b"data", bytes(2 * frames))]
    body = b"WAVE" + b"".join(k + struct.pack("<I", len(v)) + v + bytes(len(v) % 2) for k, v in parts)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def bxml(form, data=ADM):
    return b"bxml", form.to_bytes(2, "little") + data


SECOND = 14 + 8 + len(SADM)


@pytest.mark.parametrize(("data", "want"), [
    (wave(), set()), (wave((b"axml", b"\xef\xbb\xbf" + ADM)), set()), (wave(bxml(0)), set()), (wave(bxml(1, gzip.compress(ADM))), set()), (wave((b"sxml", serial([(SADM, 4), (SADM, 6)], [(14, 0), (SECOND, 4)])), (b"axml", ADM)), set()),
    (wave((b"axml", b"<a")), {"AXML-XML"}), (wave((b"axml", b"<!DOCTYPE a><a/>")), {"AXML-XML"}), (wave((b"axml", b"<a>\xff</a>")), {"AXML-XML"}), (wave((b"axml", ADM), (b"axml", b"<a/>")), {"XML-CHUNK-UNIQUE"}), (wave(bxml(2)), {"BXML-STRUCTURE"}), (wave((b"bxml", b"x")), {"BXML-STRUCTURE"}),
    (wave(bxml(1, b"no gzip")), {"BXML-XML"}), (wave(bxml(1, gzip.compress(ADM)[:-4])), {"BXML-XML"}), (wave((b"axml", ADM.replace(b"ebuCore_2016", b"other"))), {"EBUCORE-NAMESPACE"}), (wave((b"axml", ADM.replace(b"coreMetadata", b"c"))), {"EBUCORE-STRUCTURE"}),
    (wave((b"axml", ADM), bxml(0)), {"ADM-PLACEMENT"}), (wave((b"axml", ADM), chna=False), {"ADM-CHNA"}), (wave((b"axml", SADM)), {"SADM-PLACEMENT"}), (wave((b"sxml", serial([(b"<audioFormatExtended/>", 4)]))), {"ADM-PLACEMENT"}),
    (wave((b"sxml", serial([(SADM, 11)]))), {"SXML-SAMPLE-COUNT"}), (wave((b"sxml", serial([(SADM, 4)], [(15, 0)]))), {"SXML-STRUCTURE"}), (wave((b"sxml", serial([(SADM, 4)])[:-1])), {"SXML-STRUCTURE"}), (wave((b"sxml", b"")), {"SXML-STRUCTURE"}), (wave((b"sxml", serial([(b"<x", 4)]))), {"SXML-XML"}),
    (wave((b"axml", ADM.replace(b"AP_1", b"AO_2001")), (b"sxml", serial([(SADM, 4)]))), {"ADM-SADM-INDEPENDENCE"}),
])
def test_xml_chunks(data, want):
    kind, found = containers.audit(data)
    assert kind == "wave" and {rule.removeprefix("BS2088-") for _, rule, ok, _ in found if not ok} == want


def test_files_without_xml_have_no_such_checks():
    assert not [rule for _, rule, _, _ in containers.audit(wave())[1] if "BS2088" in rule]


def test_chunks_behind_long_data_are_found():
    data = wave((b"axml", b"<a"))
    at = data.index(b"axml")
    axml, tail = data[at : at + 10], data[at + 10 :]
    fmt = data[12:at]
    body = b"WAVE" + b"ds64" + struct.pack("<IQQQI", 28, 0, 20, 10, 0) + fmt + b"data" + b"\xff" * 4 + tail[8:] + axml
    found = containers.audit(b"BW64" + b"\xff" * 4 + body)[1]
    assert ("BS2088-AXML-XML", False) in {(rule, ok) for _, rule, ok, _ in found}
