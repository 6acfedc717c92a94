"""Delivery checks, live gain, detectors, edit lists and models."""

import math

import numpy as np
import pandas as pd
import pytest

from wavequarry.functions import dims
from wavequarry.operators import delivery, render
from wavequarry.sources import editlists
from wavequarry.streaming import gain, live

FS = 8000
ROLES = "asset_id string, channel int, role string, azimuth int, elevation int"


def chunks(spark, channels, step=FS, asset="a"):
    rows = [(asset, FS, len(channels), c, i // step, i, np.asarray(x[i : i + step], np.float32).tolist()) for c, x in enumerate(channels) for i in range(0, len(x), step)]
    return spark.createDataFrame(rows, render.CHUNK)


def tone(f, amp, seconds=4):
    return amp * np.sin(2 * math.pi * f * np.arange(FS * seconds) / FS)


@pytest.mark.parametrize("limiter", [False, True])
def test_normalization_reaches_its_target(spark, limiter):
    x = chunks(spark, [tone(997, 0.05)] * 2)
    out, result = delivery.normalize(x, spark.createDataFrame([], ROLES), -20.0, -1.0, limiter=limiter)
    r = result.first()
    assert r.verified and r.gain_db == pytest.approx(6, abs=0.3)
    assert out.count() == x.count()


def test_ceiling_holds_the_gain_back(spark):
    x = chunks(spark, [np.where(np.arange(FS * 4) % 4000 == 0, 0.5, tone(997, 0.01))])
    _, result = delivery.normalize(x, spark.createDataFrame([], ROLES), -14.0, -1.0)
    assert result.first().gain_db < 6 and not result.first().verified


def test_presentations_and_downmixes(spark):
    inf = float("-inf")
    r = spark.createDataFrame([("a", -23.0, -2.0, 100, FS), ("b", inf, inf, 100, FS), ("c", -23.0, -2.0, 100, FS)], "id string, integrated_lufs double, true_peak_dbtp double, frames long, sample_rate int")
    ref = r.where("id <> 'c'").withColumn("integrated_lufs", delivery.F.when(delivery.F.col("id") == "a", -21.0).otherwise(inf))
    v = spark.createDataFrame([("c", True)], "id string, compliant boolean")
    assert {x.id: (x.reference_passed, x.passed) for x in delivery.presentation_qc(r, ref, v, 0.5).collect()} == {"a": (False, False), "b": (True, True), "c": (None, True)}
    m = "asset_id string, integrated_lufs double, true_peak_dbtp double, sample_peak_dbfs double, lra double"
    s = spark.createDataFrame([("a", -23.0, -3.0, -3.0, 5.0)], m)
    mixed = spark.createDataFrame([("a", -20.0, 0.5, 0.0, 5.0, "stereo"), ("a", -23.0, -3.0, -3.0, 5.0, "5.1")], m + ", profile string")
    clipped = spark.createDataFrame([("a", "stereo", 3)], "asset_id string, profile string, clipped long")
    assert {x.profile: (x.clip_risk, x.passed) for x in delivery.downmix_qc(s, mixed, clipped, -1.0, 0, 2.0).collect()} == {"stereo": ("sample-clipping", False), "5.1": ("none", True)}
    d = {x.metric: x.change for x in delivery.normalization_difference(s, s.withColumn("integrated_lufs", delivery.F.lit(inf))).collect()}
    assert d["integrated_lufs"] is None and d["lra"] == 0


def test_profiles_are_valid_and_broken_ones_are_not(spark):
    assert delivery.invalid_profiles(dims.profiles(spark)).count() == 0
    bad = spark.createDataFrame([("", "other", None, -1.0, None, None, 2.0, None, None, None)], dims.PROFILE_SCHEMA)
    assert set(delivery.invalid_profiles(bad).first().problems) == {"name", "basis", "no-loudness-rule", "tolerance-without-target", "negative-tolerance", "true-peak-over-zero"}


def test_detectors_plug_in(spark):
    def loud(rows):
        found = [(r.asset_id, "pop", r.frame_start / FS, (r.frame_start + len(r.samples)) / FS, 0.9, 0.5) for r in rows.itertuples() if max(r.samples) > 0.5]
        return pd.DataFrame(found, columns=[x.split()[0] for x in delivery.EVENTS.split(", ")])

    delivery.register_detector("loud", loud)
    x = np.concatenate([tone(100, 0.1, 1), tone(100, 0.9, 1)])
    assert [(r.start_seconds, r.end_seconds) for r in delivery.run_detector(chunks(spark, [x]), "loud", 0.5).collect()] == [(1.0, 2.0)]


def test_live_gain_equals_itself_however_it_arrives(spark, tmp_path):
    x = np.stack([tone(200, 0.5, 1), tone(300, 0.9, 1)]).astype(np.float32)
    schema = "asset_id string, sample_rate int, frame_start long, samples array<array<float>>"
    results = []
    for name, step in (("a", 2000), ("b", 500)):
        for i in range(0, FS, step):
            rows = [("a", FS, i, x[:, i : i + step].tolist())]
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        out = live.run_to_end(gain.live_gain(live.read_stream(spark, str(tmp_path / name), spark.createDataFrame([], schema).schema), 6.0, -3.0), str(tmp_path / f"out-{name}"), "append")
        rows = out.orderBy("frame_start").collect()
        results.append(np.concatenate([np.array(r.samples) for r in rows], axis=1))
    assert results[0].shape == results[1].shape == (2, FS - 40)
    assert np.abs(results[0]).max() <= 10 ** (-3 / 20) + 1e-6


ADL = """<ADL>
<VERSION>
(VER_ADL_VERSION) 01.02
</VERSION>
<PROJECT>
(PROJ_TITLE) "T"
</PROJECT>
<SEQUENCE>
(SEQ_SAMPLE_RATE) S48000
(SEQ_FRAME_RATE) 25
</SEQUENCE>
<TRACKLIST>
(Track) 1 "Mono"
</TRACKLIST>
<SOURCE_INDEX>
(Index) 1
(F) "URL:file://localhost/a.wav" _ _ _ "S" N
</SOURCE_INDEX>
<EVENT_LIST>
(Entry) 1
(Cut) I 1 1 1 00:00:00:00/0000 00:00:00:00/0000 00:00:01:00/0000 _
(Entry) 2
(Cut) I 1 1 1 00:00:00:00/0000 00:00:01:00/0000 00:00:02:12/0010 _
</EVENT_LIST>
</ADL>
"""


def test_edit_lists(spark):
    bad = ADL.replace("(Entry) 2", "(Entry) 3").replace("I 1 1 1 00:00:00:00/0000 00:00:01:00", "I 2 1 4-5 00:00:00:00/0000 00:00:00:20").replace("</PROJECT>", "")
    docs = spark.createDataFrame([("ok", ADL), ("bad", bad), ("overlap", ADL.replace("00:00:01:00/0000 00:00:02", "00:00:00:20/0000 00:00:02"))], "path string, text string")
    records = editlists.edit_lists(docs)
    assert editlists.edits(records.where("path = 'ok'")).where("entry = 2").first().stop == 2 * 48000 + 12 * 1920 + 10
    got: dict = {}
    for r in editlists.edit_findings(records).collect():
        got.setdefault(r.path, set()).add(r.rule_id.removeprefix("AQ-AES31-"))
    assert got == {"bad": {"SYNTAX", "EVENT-LIST", "EVENT-SOURCE-REFERENCE", "EVENT-TRACK-REFERENCE"}, "overlap": {"OVERLAPS"}}


def test_models(spark):
    good = '<x><audioFormatExtended version="ITU-R_BS.2076-2"><audioProgramme audioProgrammeID="APR_1001" audioProgrammeName="p"><audioContentIDRef>ACO_1001</audioContentIDRef></audioProgramme><audioContent audioContentID="ACO_1001" audioContentName="c"><audioObjectIDRef>AO_1001</audioObjectIDRef></audioContent><audioObject audioObjectID="AO_1001" audioObjectName="o"><audioPackFormatIDRef>AP_00010002</audioPackFormatIDRef></audioObject></audioFormatExtended></x>'
    loop = good.replace('audioObjectName="o">', 'audioObjectName="o"><audioObjectIDRef>AO_1002</audioObjectIDRef>').replace("</audioFormatExtended>", '<audioObject audioObjectID="AO_1002"><audioObjectIDRef>AO_1001</audioObjectIDRef></audioObject></audioFormatExtended>')
    docs = spark.createDataFrame([("ok", good), ("loop", loop), ("lost", good.replace(">AO_1001<", ">AO_9999<")), ("form", good.replace("ACO_1001", "XX_1")), ("twice", good.replace("APR_1001", "AO_1001")), ("xml", "<x")], "path string, text string")
    got: dict = {}
    for r in editlists.model_findings(editlists.models(docs)).collect():
        got.setdefault(r.path, set()).add(r.rule_id.removeprefix("AQ-ADM-"))
    assert got == {"loop": {"OBJECT-LOOP"}, "lost": {"REFERENCE"}, "form": {"ID-FORM"}, "twice": {"ID-FORM", "UNIQUE-ID"}, "xml": {"XML"}}


def test_binaural_renderings(spark):
    m = "id string, channels int, frames long, sample_rate int, integrated_lufs double, true_peak_dbtp double"
    ids = ["good", "alone", "long", "clip", "peak", "loud", "mono", "silent"]
    source = spark.createDataFrame([(i, 12, FS * 10, FS, -23.0, -5.0) for i in ids], m)
    change = {"long": (2, FS * 10 + 100, -23.0, -5.0), "peak": (2, FS * 10, -23.0, -0.5), "loud": (2, FS * 10, -21.5, -5.0), "mono": (1, FS * 10, -23.0, -5.0), "silent": (2, FS * 10, float("-inf"), float("-inf"))}
    rendered = spark.createDataFrame([(i, c, n, FS, lufs, peak) for i in ids for c, n, lufs, peak in [change.get(i, (2, FS * 10, -23.0, -5.0))]], m)
    reference = spark.createDataFrame([(i, 2, FS * 10, FS, -23.0, -5.0) for i in ids if i not in ("alone", "mono")], m)
    found = {x.id: x for x in delivery.binaural_qc(source, rendered, reference, spark.createDataFrame([("clip", 4)], "id string, clipped long")).collect()}
    assert {i for i, x in found.items() if x.passed} == {"good", "alone"} and found["alone"].reference_passed is None
    assert not found["long"].duration_passed and found["clip"].clip_risk == "sample-clipping" and found["peak"].clip_risk == "true-peak-ceiling"
    assert not found["loud"].reference_passed and found["loud"].loudness_delta == 1.5 and found["silent"].clip_risk_passed and not found["silent"].reference_passed and found["silent"].loudness_delta is None
