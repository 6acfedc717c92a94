"""PCM, captures, session descriptions, playlists and graphs, made byte by byte."""

import json
import math
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wavequarry.operators import pcm
from wavequarry.sources import graph, playlist, rtp, wave


@pytest.mark.parametrize("kind", sorted(wave.KINDS))
def test_wave_round_trip(kind):
    x = np.array([[0.0, 0.5, -0.5, 0.25], [-1.0, 0.125, 0.75, 0.0]])
    data = wave.wave_bytes(x, 48000, kind)
    info = wave.probe(data, len(data))
    assert (info["kind"], info["channels"], info["frames"]) == (kind, 2, 4)
    assert np.allclose(wave.decode(data[info["data_offset"] :][: 4 * info["frame_bytes"]], kind, 2), x, atol=1 / 100)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=300))
def test_any_bytes_are_rejected_or_read(data):
    for head in (b"", b"RIFF\0\0\0\0WAVE"):
        try:
            wave.probe(head + data, len(head + data))
        except wave.WaveError:
            pass
    list(rtp.frames(data))
    rtp.rtp(data)


def test_rf64_takes_its_length_from_ds64():
    fmt = struct.pack("<HHIIHH", 1, 1, 48000, 96000, 2, 16)
    body = b"WAVEds64" + struct.pack("<IQQQI", 28, 0, 8, 4, 0) + b"fmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", 0xFFFFFFFF) + bytes(8)
    assert wave.probe(b"RF64" + struct.pack("<I", 0xFFFFFFFF) + body)["frames"] == 4


def test_stereo_sine_measures_minus_23(spark, tmp_path):
    """A 1 kHz stereo sine at -23 dBFS is -23 LUFS, however the file is cut into chunks."""
    fs, amp = 48000, 10 ** (-23 / 20)
    x = np.tile(amp * np.sin(2 * math.pi * 1000 * np.arange(fs * 8) / fs), (2, 1))
    (tmp_path / "a.wav").write_bytes(wave.wave_bytes(x, fs, "f32"))
    wave.register(spark)
    roles = spark.createDataFrame([], "asset_id string, channel int, role string, azimuth int, elevation int")
    results = []
    for chunk in (48000, 384000):
        chunks = spark.read.format("pcm_wave").option("chunkframes", chunk).option("chunksperpartition", 2).load(str(tmp_path))
        results.append(pcm.analyze(chunks, roles).first())
    for r in results:
        assert r.integrated_lufs == pytest.approx(-23.0, abs=0.1)
        assert r.max_momentary_lufs == pytest.approx(-23.0, abs=0.1)
        assert r.true_peak_dbtp == pytest.approx(-23.0, abs=0.1)
        assert r.lra == pytest.approx(0, abs=0.05)
    assert results[0].integrated_lufs == pytest.approx(results[1].integrated_lufs, abs=1e-6)


def test_range_scan_clips_chunks(spark, tmp_path):
    x = np.arange(1000)[None] / 1000
    (tmp_path / "a.wav").write_bytes(wave.wave_bytes(x, 1000, "f32"))
    wave.register(spark)
    chunks = spark.read.format("pcm_wave").option("chunkframes", 100).load(str(tmp_path))
    got = pcm.analyze_range(chunks, 250, 420).orderBy("frame_start").collect()
    assert [r.frame_start for r in got] == [0, 50, 150]
    assert np.allclose(np.concatenate([r.samples for r in got]), x[0, 250:420])


def packet(seq, ts, ssrc=7, payload=b"\0" * 6):
    data = struct.pack(">BBHII", 0x80, 96, seq, ts, ssrc) + payload
    udp = struct.pack(">HHHH", 5004, 5004, 8 + len(data), 0) + data
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(udp), 0, 0, 64, 17, 0, bytes([10, 0, 0, 1]), bytes([239, 0, 0, 1])) + udp
    return bytes(12) + b"\x08\x00" + ip


def capture(frames):
    return b"\xd4\xc3\xb2\xa1" + bytes(20) + b"".join(struct.pack("<IIII", 100, i * 1000, len(f), len(f)) + f for i, f in enumerate(frames))


def test_capture_to_packets_and_continuity(spark, tmp_path):
    seqs = [65534, 65535, 0, 2, 1, 2, 3]  # a gap, then the missing one late, then a duplicate
    (tmp_path / "a.pcap").write_bytes(capture([packet(s, (s + 10) % 65536 * 2) for s in seqs] + [b"junk" * 8]))
    k = rtp.read_captures(spark, str(tmp_path))
    assert [r.seq for r in k.orderBy("capture_no").collect()] == seqs
    assert k.first().dst == "239.0.0.1"
    r = rtp.continuity(k.selectExpr("ssrc", "capture_no", "arrival", "seq", "rtp_ts", "2 AS samples")).first()
    assert (r.packets, r.gaps, r.lost, r.reordered, r.duplicates) == (7, 1, 1, 1, 1)


def test_session_description_rules(spark, tmp_path):
    good = "v=0\r\ns=Stage\r\nc=IN IP4 239.0.0.1/32\r\nm=audio 5004 RTP/AVP 96\r\na=rtpmap:96 L24/48000/2\r\na=ptime:1\r\na=ts-refclk:ptp=IEEE1588-2008:39-A7-94-FF-FE-07-CB-D0:0\r\na=mediaclk:direct=0\r\na=fmtp:96 channel-order=SMPTE2110.(ST)\r\n"
    (tmp_path / "good.sdp").write_text(good, newline="")
    (tmp_path / "bad.sdp").write_text(good.replace("L24", "L20").replace("(ST)", "(51)"), newline="")
    failed = rtp.session_findings(rtp.read_sdp(spark, str(tmp_path))).where("NOT passed").collect()
    assert {(r.path.rsplit("/", 1)[1], r.rule_id) for r in failed} == {("bad.sdp", "AQ-RTP-ENCODING"), ("bad.sdp", "AQ-RTP-CHANNEL-ORDER")}


def test_playlist_rules(spark, tmp_path):
    (tmp_path / "ok.m3u8").write_text("#EXTM3U\n#EXT-X-VERSION:4\n#EXT-X-TARGETDURATION:7\n#EXT-X-PLAYLIST-TYPE:VOD\n#EXTINF:6.2,\na.ts\n#EXT-X-DISCONTINUITY\n#EXTINF:5,\nb.ts\n#EXT-X-ENDLIST\n")
    (tmp_path / "long.m3u8").write_text("#EXTM3U\n#EXT-X-TARGETDURATION:5\n#EXTINF:6,\na.m4s\n")
    (tmp_path / "bad.m3u8").write_text("nothing")
    s = playlist.read_playlists(spark, str(tmp_path))
    failed = {(r.path.rsplit("/", 1)[1], r.rule_id) for r in playlist.findings(s).where("NOT passed").collect()}
    assert failed == {("long.m3u8", "AQ-HLS-TARGET-DURATION"), ("long.m3u8", "AQ-HLS-FMP4-MAP"), ("bad.m3u8", "AQ-HLS-SYNTAX"), ("bad.m3u8", "AQ-HLS-TARGET-PRESENT")}
    rows = playlist.discontinuity_sequence(s.where("path LIKE '%ok.m3u8'")).orderBy("ordinal").collect()
    assert [(r.discontinuity_sequence, round(r.start, 3)) for r in rows] == [(0, 0.0), (1, 6.2)]


def uuid(n):
    return f"00000000-0000-4000-8000-{n:012x}"


def snapshot():
    base = lambda n, **x: {"id": uuid(n), "version": "1:0", "label": "", "description": "", **x}
    audio = "urn:x-nmos:format:audio"
    return {
        "nodes": [base(1, clocks=[{"name": "clk0"}])],
        "devices": [base(2, node_id=uuid(1), senders=[uuid(5)], receivers=[uuid(6)])],
        "sources": [base(3, device_id=uuid(2), parents=[], clock_name="clk0", format=audio, channels=[{"label": "L"}])],
        "flows": [base(4, source_id=uuid(3), device_id=uuid(2), parents=[], format=audio, media_type="audio/L24", bit_depth=24)],
        "senders": [base(5, device_id=uuid(2), flow_id=None)],
        "receivers": [base(6, device_id=uuid(2))],
    }


def test_device_graph(spark, tmp_path):
    (tmp_path / "ok.json").write_text(json.dumps(snapshot()))
    assert graph.graph_findings(graph.read_snapshot(spark, str(tmp_path / "ok.json"))).count() == 0
    bad = snapshot()
    bad["flows"][0] |= {"bit_depth": 16, "source_id": uuid(99), "parents": [uuid(77)]}
    bad["devices"][0]["senders"] = []
    bad["sources"][0]["clock_name"] = "clk9"
    (tmp_path / "bad.json").write_text(json.dumps(bad))
    found = {(r.rule_id, r.severity) for r in graph.graph_findings(graph.read_snapshot(spark, str(tmp_path / "bad.json"))).collect()}
    assert found == {("AQ-NMOS-RESOURCE-GRAPH", "error"), ("AQ-NMOS-AUDIO-FLOW", "error"), ("AQ-NMOS-PARENT-PRESENT", "warning"), ("AQ-NMOS-DEVICE-MEMBERSHIP", "error"), ("AQ-NMOS-AUDIO-SOURCE", "error")}


def test_serial_frames(spark):
    doc = '<frame><frameHeader><frameFormat frameFormatID="FF_{n:08x}" type="{t}" start="00:00:{s}" duration="00:00:0.5" timeReference="local" flowID="{f}"/></frameHeader></frame>'
    good = [("a", i, doc.format(n=i, t="full", s=f"{i * 0.5:05.2f}", f="x")) for i in range(3)]
    bad = [("b", i, doc.format(n=i * 2, t="intermediate", s=f"{i * 0.7:05.2f}", f=str(i))) for i in range(3)] + [("c", 0, "<x"), ("d", 0, "<!DOCTYPE x><x/>")]
    failed = {(r.path, r.rule_id) for r in graph.flow_findings(graph.serial_frames(spark.createDataFrame(good + bad, "path string, ordinal int, text string"))).where("NOT passed").collect()}
    assert not {x for x in failed if x[0] == "a"}
    assert {x[1] for x in failed if x[0] == "b"} == {"AQ-SADM-FLOW-ID", "AQ-SADM-FRAME-INDEX", "AQ-SADM-CONTIGUITY", "AQ-SADM-FIRST-FRAME"}
    assert ("c", "AQ-SADM-SYNTAX") in failed and ("d", "AQ-SADM-SYNTAX") in failed
