"""Sinks, rendering, comparison and container audits."""

import json
import math
import struct
import xml.etree.ElementTree as ET

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wavequarry.functions import dims, kernels
from wavequarry.operators import compare, render
from wavequarry.sources import containers, sinks, wave

FS = 8000


def chunks(spark, channels, step=FS // 2, asset="a"):
    rows = [(asset, FS, len(channels), c, i // step, i, np.asarray(x[i : i + step], np.float32).tolist()) for c, x in enumerate(channels) for i in range(0, len(x), step)]
    return spark.createDataFrame(rows, render.CHUNK)


def samples(df):
    rows = df.orderBy("channel", "chunk_no").collect()
    return np.stack([np.concatenate([r.samples for r in rows if r.channel == c]) for c in sorted({r.channel for r in rows})])


def tone(f, amp, n=FS):
    return amp * np.sin(2 * math.pi * f * np.arange(n) / FS)


def test_gain_and_limit_and_rate(spark):
    x = chunks(spark, [tone(200, 0.5), tone(300, 0.9)])
    assert np.abs(samples(render.gain(x, spark.createDataFrame([("a", 3.0)], "asset_id string, gain double"), 0.8))).max() == pytest.approx(0.8)
    assert np.abs(samples(render.limit(x, 0.4))).max() <= 0.4 + 1e-6
    assert samples(render.convert_rate(x, 4000)).shape == (2, 4000)


def test_downmix_is_the_matrix_product(spark):
    x = [tone(100 * (i + 1), 0.1) for i in range(6)]
    labels = spark.createDataFrame([("a", i, r[0]) for i, r in enumerate(dims.LAYOUTS["5.1"])], "asset_id string, channel int, label string")
    m = dims.DOWNMIX["stereo"]
    matrix = spark.createDataFrame([(o, i, c) for o, out in enumerate(("L", "R")) for i, c in m[out].items()], "out_channel int, in_label string, coef double")
    got = samples(render.downmix(chunks(spark, x), labels, matrix))
    names = [r[0] for r in dims.LAYOUTS["5.1"]]
    want = np.stack([sum(m[o].get(n, 0) * x[i] for i, n in enumerate(names)) for o in ("L", "R")])
    assert np.allclose(got, want, atol=1e-6)


def test_downmix_adds_all_channels(spark):
    labels = spark.createDataFrame([("a", i, "X") for i in range(70)], "asset_id string, channel int, label string")
    matrix = spark.createDataFrame([(0, "X", 1.0)], "out_channel int, in_label string, coef double")
    assert samples(render.downmix(chunks(spark, [np.ones(8)] * 70), labels, matrix)).tolist() == [[70.0] * 8]


def test_owners_of_deep_chains_and_cycles(spark):
    edges = [(i, i - 1) for i in range(1, 60)] + [(100, 101), (101, 102), (102, 100), (103, 100), (200, None)]
    got = {r.node: (r.depth, r.root, r.cyclic) for r in compare.owners(spark.createDataFrame(edges, "node long, parent long"), "node", "parent").collect()}
    assert all(got[i] == (i, 0, False) for i in range(1, 60)) and all(got[i] == (None, None, True) for i in (100, 101, 102, 103)) and 200 not in got
    assert compare.owners(spark.createDataFrame([], "node long, parent long"), "node", "parent").count() == 0


def test_segment_envelope_ramps(spark):
    y = samples(render.segment_envelope(chunks(spark, [np.full(FS, 0.1)]), [(0, 0.5, -6.0), (0.5, 1.0, 0.0)]))[0]
    assert y[100] == pytest.approx(0.1 * 10 ** (-6 / 20), abs=1e-5) and y[-1] == pytest.approx(0.1, abs=1e-6)
    assert np.all(np.diff(y) >= -1e-7)


def test_comparison_finds_lag_swap_and_level(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(2, FS)) * 0.1
    same = render.compare_audio(chunks(spark, a), chunks(spark, a), 50).collect()
    assert all(r.null_depth_db == 300 and r.exact_ratio == 1 and r.lag == 0 and r.channel == r.matched for r in same)
    moved = np.concatenate([np.zeros((2, 17)), a[::-1, :-17]], axis=1) * 0.5
    rows = render.compare_audio(chunks(spark, a), chunks(spark, moved), 50)
    assert all(r.lag == 17 and r.channel != r.matched and r.correlation > 0.999 and r.gain_db == pytest.approx(-6.02, abs=0.1) for r in rows.collect())
    assert failing(rows) == {"OFFSET", "CHANNEL-PERMUTATION", "NULL-DEPTH", "RESIDUAL-PEAK", "SPECTRAL-ERROR"}


def failing(rows, **limits):
    return {r.rule_id.removeprefix("AQ-AUDIO-COMPARE-") for r in render.comparison_gates(rows, **limits).where("NOT passed").collect()}


def test_comparison_gates_each_fire(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(2, FS)) * 0.1
    against = lambda b, reach=20: render.compare_audio(chunks(spark, a), chunks(spark, b), reach)
    assert failing(against(a)) == set()
    assert {r.rule_id.rpartition("COMPARE-")[2] for r in render.comparison_gates(against(a)).collect()} == {
        "NON-FINITE", "SAMPLE-RATE", "CHANNEL-COUNT", "OFFSET", "DURATION", "ALIGNMENT-CONFIDENCE", "OVERLAP", "CHANNEL-PERMUTATION", "NULL-DEPTH", "RESIDUAL-PEAK", "POLARITY", "CORRELATION", "SPECTRAL-ERROR"
    }
    turned = a * np.array([[-1], [1]])
    assert failing(against(turned)) == {"POLARITY", "NULL-DEPTH", "RESIDUAL-PEAK"} and {r.signed_correlation < 0 for r in against(turned).collect()} == {True, False}
    notes = render.comparison_gates(against(turned), allow_inversion=True).where("NOT passed").collect()
    assert {(r.rule_id, r.level, r.channel) for r in notes} == {("AQ-AUDIO-COMPARE-POLARITY", "note", 0)}
    assert failing(against(a[::-1])) == {"CHANNEL-PERMUTATION"} and failing(against(a[:, : FS - 7])) == {"DURATION"}
    assert failing(against(a[:1])) == {"CHANNEL-COUNT"}
    assert failing(against(np.where(np.arange(FS) == 5, np.nan, a))) == {"NON-FINITE"}
    assert failing(render.compare_audio(chunks(spark, a), chunks(spark, a).withColumn("sample_rate", F.lit(2 * FS)))) == {"SAMPLE-RATE"}
    assert {"ALIGNMENT-CONFIDENCE", "CORRELATION"} <= failing(against(rng.normal(size=(2, FS)) * 0.1))
    assert failing(render.compare_audio(chunks(spark, a * 0), chunks(spark, a * 0), 20)) == set()


def test_lag_is_found_behind_long_silence():
    x = np.concatenate([np.zeros((1, 30 * 1000)), np.random.default_rng(4).normal(size=(1, 2000))], axis=1)
    later = np.concatenate([np.zeros((1, 9)), x[:, :-9]], axis=1)
    assert [render.compare_signals(a, b, 20, 1000)[0][:2] for a, b in ((x, later), (later, x))] == [(9, pytest.approx(1)), (-9, pytest.approx(1))]


def test_band_amplitudes_equal_direct_sums():
    x = np.random.default_rng(3).normal(size=500)
    w = np.hanning(500)
    for f, got in zip((31.5, 1000.0), kernels.band_amplitudes(x, 8000, np.array([31.5, 1000.0])), strict=True):
        t = 2 * math.pi * f / 8000 * np.arange(500)
        assert got == pytest.approx(math.hypot((x * w * np.cos(t)).sum(), (x * w * np.sin(t)).sum()) / w.sum())
    long = np.tile(x, 100)
    assert kernels.spectral_error(long, long / 2, 8000) == pytest.approx(20 * math.log10(2)) and kernels.spectral_error(long, long, 8000) == 0 == kernels.spectral_error(long * 0, long * 0, 8000)


def test_dialogue_is_found_where_it_is(spark):
    t = np.arange(4 * FS) / FS
    voice = sum(0.2 / k * np.sin(2 * math.pi * 125 * k * t) for k in range(1, 9)) * (0.5 + 0.5 * np.sin(2 * math.pi * 20 * t)) * ((t > 1) & (t < 3))
    found = render.detect_dialogue(chunks(spark, [voice, voice], step=FS), 0.6).collect()
    assert len(found) == 1 and found[0].start_seconds == pytest.approx(1, abs=0.3) and found[0].start_seconds + found[0].duration_seconds == pytest.approx(3, abs=0.6)


def test_documents(spark):
    f = spark.createDataFrame([("b.wav", "AQ-X", "error", False, 'a<"b"&'), ("a.wav", "AQ-X", "note", True, "fine")], "path string, rule_id string, severity string, passed boolean, message string")
    doc = json.loads(sinks.sarif(f).first().document)
    assert doc["version"] == "2.1.0" and [r["level"] for r in doc["runs"][0]["results"]] == ["note", "error"]
    suite = ET.fromstring(sinks.junit(f, "audit").first().document)
    assert suite.get("failures") == "1" and [c.get("classname") for c in suite] == ["a.wav", "b.wav"] and suite[1][0].get("message") == 'a<"b"&'
    m = json.loads(sinks.manifest(spark.createDataFrame([("x", True, None), ("y", False, True), ("z", None, None)], "path string, a boolean, b boolean"), ["a", "b"], ["path"]).first().document)
    assert (m["assets_total"], m["assets_passed"], m["assets_failed"]) == (3, 2, 1) and [x["path"] for x in m["assets"]] == ["x", "y", "z"]
    text = sinks.metrics_text(spark.createDataFrame([(0.5, 1), (None, 3)], "le double, n long"), "wait_seconds").first().document
    assert 'wait_seconds_bucket{le="0.5"} 1\nwait_seconds_bucket{le="+Inf"} 3\nwait_seconds_count 3' in text


def test_files(spark, tmp_path):
    x = chunks(spark, [tone(200, 0.5), tone(300, 0.25)], asset="/in/take.wav")
    r = sinks.write_waves(x, str(tmp_path / "out"), "s24").first()
    data = (tmp_path / "out" / "take.wav").read_bytes()
    assert len(data) == r.bytes and np.allclose(wave.decode(data[44:], "s24", 2)[0], tone(200, 0.5), atol=1e-6)
    sinks.write_csv(x.limit(1), str(tmp_path / "csv"))
    assert "samples_json" in spark.read.option("header", "true").csv(str(tmp_path / "csv")).columns
    sinks.write_ndjson(x.select("asset_id", "channel"), str(tmp_path / "nd"))
    assert spark.read.json(str(tmp_path / "nd")).count() == 4
    assert len(json.loads(sinks.json_document(x.select("channel", "chunk_no"), ["channel", "chunk_no"]).first().document)) == 4


def ogg_page(number, position, body, flags=0):
    head = b"OggS\0" + bytes([flags]) + struct.pack("<qII", position, 7, number) + bytes(4) + bytes([1, len(body)]) + body
    return head[:22] + struct.pack("<I", containers.ogg_crc(head)) + head[26:]


def box(name, body=b""):
    return struct.pack(">I", 8 + len(body)) + name + body


def moof(number):
    return box(b"moof", box(b"mfhd", struct.pack(">II", 0, number)) + box(b"traf", box(b"tfhd", struct.pack(">II", 0, 1))))


def ts(pid, count):
    return bytes([0x47, pid >> 8, pid & 255, 0x10 | count]) + bytes(184)


GOOD = {
    "wave": wave.wave_bytes(np.zeros((1, 4)), 48000),
    "au": b".snd" + struct.pack(">IIIII", 24, 8, 3, 8000, 1) + bytes(8),
    "flac": b"fLaC\x80" + (34).to_bytes(3, "big") + struct.pack(">HH", 4096, 4096) + bytes(6) + ((44100 << 44) | 1).to_bytes(8, "big") + bytes(16) + b"\xff\xf8" + bytes(8),
    "ogg": ogg_page(0, 0, b"a", 2) + ogg_page(1, 10, b"b"),
    "isobmff": moof(1) + moof(2),
    "mpegts": ts(0, 0) + ts(0, 1),
    "matroska": b"\x1aE\xdf\xa3\x80" + b"\x18S\x80g\x81\x00",
    "mp3": (b"\xff\xfb\x90\x00" + bytes(413)) * 3,
    "adts": (b"\xff\xf1\x50\x80" + (16 << 13).to_bytes(3, "big") + bytes(9)) * 2,
    "caf": b"caff\x00\x01\x00\x00" + b"desc" + struct.pack(">q", 4) + bytes(4) + b"data" + struct.pack(">q", 4) + bytes(4),
}
BAD = {
    "ogg": (ogg_page(0, 0, b"a", 2) + ogg_page(2, 10, b"b"), {"AQ-OGG-PAGE-SEQUENCE"}),
    "mpegts": (ts(0, 0) + ts(0, 5), {"AQ-MPEGTS-CONTINUITY"}),
    "isobmff": (moof(1) + moof(3), {"AQ-ISOBMFF-FRAGMENT-SEQUENCE"}),
    "mp3": ((b"\xff\xfb\x90\x00" + bytes(413)) * 2 + b"junkjunk", {"AQ-MP3-CONTIGUOUS"}),
    "au": (b".snd" + struct.pack(">IIIII", 24, 80, 3, 8000, 1), {"AQ-AU-SIZE"}),
}


@pytest.mark.parametrize("kind", GOOD)
def test_good_files_pass(kind):
    found, checks = containers.audit(GOOD[kind])
    assert found == kind and checks and all(ok for _, _, ok, _ in checks), checks


def test_bad_files_fail_their_rule(spark, tmp_path):
    for kind, (data, _) in BAD.items():
        (tmp_path / kind).write_bytes(data)
    (tmp_path / "none").write_bytes(b"")
    failed: dict = {}
    for r in containers.audit_files(spark, str(tmp_path)).where("NOT passed").collect():
        failed.setdefault(r.path.rsplit("/", 1)[1], set()).add(r.rule_id)
    assert failed == {k: rules for k, (_, rules) in BAD.items()}


def test_many_empty_chunks_are_rejected():
    data = b"RIFF" + struct.pack("<I", 4 + 100_001 * 8) + b"WAVE" + b"junk\0\0\0\0" * 100_001
    assert not {r: ok for _, r, ok, _ in containers.audit(data)[1]}["CHUNK-COUNT"]


@settings(max_examples=300, deadline=None)
@given(st.sampled_from([m for _, m, _, _ in containers.FORMATS]), st.binary(max_size=200), st.integers(0, 4))
def test_any_bytes_can_be_audited(magic, data, at):
    list(containers.audit_batches([__import__("pandas").DataFrame({"path": ["x"], "content": [data[:at] + magic + data]})]))
