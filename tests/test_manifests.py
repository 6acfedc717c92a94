"""Streaming manifests, their updates and patches, and IMF packages."""

from base64 import b64encode
from hashlib import sha1

import pytest

from wavequarry.sources import manifest_rules as rules
from wavequarry.sources import manifests as m

MPD = """<MPD xmlns="urn:mpeg:dash:schema:mpd:2011" type="{type}" id="x" profiles="p" minBufferTime="PT2S" availabilityStartTime="2026-01-01T00:00:00Z" publishTime="{publish}" mediaPresentationDuration="PT12S">
<Period id="1" start="PT0S"><AdaptationSet id="s" contentType="audio"><SegmentTemplate timescale="10" media="$RepresentationID$-$Number%03d$-$Time$.m4s" startNumber="5"><SegmentTimeline>{line}</SegmentTimeline></SegmentTemplate>
<Representation id="a" bandwidth="1"/><Representation id="b" bandwidth="2"/></AdaptationSet></Period></MPD>"""


def mpd(kind="static", publish="2026-01-01T00:00:01Z", line='<S t="0" d="20" r="2"/><S d="15" r="-1"/>'):
    return MPD.format(type=kind, publish=publish, line=line)


def docs(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, text string")


def test_timelines_and_templates_expand(spark):
    rows = m.segments(docs(spark, mpd())).where("representation = 'a'").orderBy("time").collect()
    assert [(r.time, r.duration) for r in rows] == [(0, 20), (20, 20), (40, 20), (60, 15), (75, 15), (90, 15), (105, 15)]
    assert rows[3].uri == "a-008-60.m4s"


def test_manifest_rules(spark):
    found = m.manifest_findings(docs(spark, mpd(), mpd(line='<S t="0" d="20"/><S t="30" d="20"/>'), "<x", mpd().replace('id="b"', 'id="a"'))).where("NOT passed").collect()
    got = {p: {r.rule_id for r in found if r.path == p} for p in "0123"}
    assert got["0"] == set() and got["1"] == {"AQ-DASH-TIMELINE-CONTINUITY"} and "AQ-DASH-SYNTAX" in got["2"]


def test_updates(spark):
    old, new = mpd("dynamic"), mpd("dynamic", "2026-01-01T00:00:09Z", '<S t="0" d="20" r="2"/><S d="15" r="3"/>')
    bad = mpd("dynamic", "2026-01-01T00:00:00Z", '<S t="0" d="25" r="2"/>').replace('id="x"', 'id="y"').replace('<Representation id="b" bandwidth="2"/>', "")
    twice = lambda text: text.replace("</MPD>", '<Period id="2" start="PT12S"/></MPD>')
    turned = mpd("dynamic", "2026-01-01T00:00:09Z").replace('<Period id="1"', '<Period id="2" start="PT0S"/><Period id="1"').replace('bandwidth="2"', 'bandwidth="3"').replace('00:00:00Z" publish', '00:00:02Z" publish')
    nameless = new.replace(' id="s"', "")
    pairs = [(old, new), (old, bad), (twice(old), turned), (nameless.replace("09Z", "01Z"), nameless), (mpd(), new), ("<x", new)]
    found = rules.update_findings(docs(spark, *[a for a, _ in pairs]), docs(spark, *[b for _, b in pairs], old)).collect()
    assert len(found) == len(pairs) * len(rules.UPDATES)
    failed = [{r.rule_id.removeprefix("AQ-DASH-UPDATE-") for r in found if r.path == str(i) and not r.passed} for i in range(len(pairs))]
    assert failed[:5] == [
        set(), {"ID", "PUBLISH-TIME", "REPRESENTATION-SET", "SEGMENT-EQUIVALENCE"}, {"AVAILABILITY-START", "PERIOD-ORDER", "PERIOD-TIMING", "FUNCTIONAL-EQUIVALENCE"}, {"IDENTITY"}, {"TYPE"},
    ] and "TYPE" in failed[5]
    chain = spark.createDataFrame([("a", "p", 1, old), ("b", "p", 2, new), ("c", "p", 3, bad), ("d", "q", 1, bad)], "path string, presentation string, taken int, text string")
    assert {(r.path, r.passed) for r in rules.successive_findings(chain).where("rule_id LIKE '%PUBLISH-TIME'").collect()} == {("b", True), ("c", False)}


def test_patches_of_many_documents(spark):
    base = mpd("dynamic", "2026-01-01T00:00:01Z")
    patch = '<Patch mpdId="x" originalPublishTime="2026-01-01T00:00:01Z" publishTime="2026-01-01T00:00:05Z"><replace sel="/MPD/@publishTime">2026-01-01T00:00:05Z</replace></Patch>'
    cases = [(patch, set()), (patch.replace('"x"', '"y"'), {"MPD-ID"}), (patch.replace("00:01Z", "00:02Z"), {"ORIGINAL-PUBLISH-TIME"}), (patch.replace('00:05Z">', '00:06Z">'), {"RESULT-PUBLISH-TIME"}),
             (patch.replace("/@", "/No/@"), {"APPLIES", "MPD-ID", "ORIGINAL-PUBLISH-TIME", "PUBLISH-TIME", "RESULT-PUBLISH-TIME"})]
    pairs = spark.createDataFrame([(str(i), base, p) for i, (p, _) in enumerate(cases)], "path string, text string, operations string")
    found = rules.patch_findings(pairs).where("NOT passed").collect()
    assert [{r.rule_id.removeprefix("AQ-DASH-PATCH-") for r in found if r.path == str(i)} for i in range(len(cases))] == [w for _, w in cases]
    assert 'publishTime="2026-01-01T00:00:05Z"' in rules.patched(pairs).where("path = '0'").first().text


def test_patches():
    base = '<MPD a="1"><P id="1"/><P id="2"><S n="1"/></P></MPD>'
    ops = "<Patch><replace sel=\"/MPD/@a\">2</replace><add sel=\"/MPD/P[@id='2']\"><S n=\"2\"/></add><remove sel=\"/MPD/P[1]\"/><add sel=\"/MPD/P[@id='2']/S[1]\" pos=\"before\"><S n=\"0\"/></add></Patch>"
    assert m.patch(base, ops) == '<MPD a="2"><P id="2"><S n="0" /><S n="1" /><S n="2" /></P></MPD>'
    with pytest.raises(ValueError, match="selects 0"):
        m.patch(base, '<Patch><remove sel="/MPD/P[9]"/></Patch>')


def package(folder, **edit):
    essence = edit.get("essence", b"essence")
    cpl = b"<CompositionPlaylist><Id>c</Id><EditRate>24 1</EditRate><SegmentList><Segment><SequenceList>" + b"".join(
        f"<S><TrackId>{t}</TrackId><ResourceList><Resource><TrackFileId>{edit.get('ref', 'e')}</TrackFileId><EditRate>{rate}</EditRate><IntrinsicDuration>{n}</IntrinsicDuration></Resource></ResourceList></S>".encode()
        for t, rate, n in (("v", "24 1", 48), ("a", "48000 1", edit.get("audio", 96000)))
    ) + b"</SequenceList></Segment></SegmentList></CompositionPlaylist>"
    asset = lambda i, d: f"<Asset><Id>{i}</Id><Hash>{b64encode(sha1(d).digest()).decode()}</Hash><Size>{len(d)}</Size></Asset>"
    pkl = f"<PackingList><Id>p</Id><AssetList>{asset('e', b'essence')}{asset('c', cpl)}</AssetList></PackingList>".encode()
    chunk = lambda i, p, extra="": f"<Asset><Id>{i}</Id>{extra}<ChunkList><Chunk><Path>{p}</Path></Chunk></ChunkList></Asset>"
    amap = f"<AssetMap><AssetList>{chunk('p', 'pkl.xml', '<PackingList>true</PackingList>')}{chunk('e', edit.get('path', 'e.mxf'))}{chunk('c', 'cpl.xml')}</AssetList></AssetMap>"
    for name, data in (("ASSETMAP.xml", amap.encode()), ("pkl.xml", pkl), ("cpl.xml", cpl), ("e.mxf", essence)):
        (folder / name).write_bytes(data)


@pytest.mark.parametrize(("edit", "want"), [
    ({}, set()), ({"essence": b"Essence"}, {"PKL-HASH"}), ({"essence": b"other length"}, {"PKL-HASH", "PKL-SIZE"}), ({"path": "../e.mxf"}, {"ASSETMAP-LOCAL-PATH", "PKL-FILE"}),
    ({"ref": "nobody"}, {"CPL-ASSETMAP-REFERENCES", "CPL-PKL-REFERENCES"}), ({"audio": 90000}, {"CPL-SEGMENT-DURATION"}),
])
def test_imf_packages(spark, tmp_path, edit, want):
    package(tmp_path, **edit)
    found = {r.rule_id.removeprefix("AQ-IMF-") for r in m.imf_findings(m.read_imf(spark, str(tmp_path))).collect()}
    assert found - {"SHA1-SECURITY"} == want
