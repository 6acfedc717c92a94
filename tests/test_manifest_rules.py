"""Rules on manifest elements, each with a document that passes and one that fails it."""

from base64 import b64encode

import pytest

from wavequarry.sources import manifest_rules as r

KID = "01234567-89ab-cdef-0123-456789abcdef"
PSSH = b64encode((32).to_bytes(4, "big") + b"pssh" + bytes(24)).decode()
LIVE = f"""<MPD xmlns="urn:mpeg:dash:schema:mpd:2011" xmlns:cenc="urn:mpeg:cenc:2013" type="dynamic" id="x" profiles="http://dashif.org/guidelines/dash-if-simple" minBufferTime="PT2S" availabilityStartTime="2026-01-01T00:00:00Z" publishTime="2026-01-01T00:00:01Z" minimumUpdatePeriod="PT2S" timeShiftBufferDepth="PT30S" suggestedPresentationDelay="PT6S">
<ServiceDescription id="1"><Latency target="4000" min="2000" max="8000" referenceId="7"/><PlaybackRate min="0.9" max="1.1"/></ServiceDescription>
<Period id="p1" start="PT0S" duration="PT20S"><EventStream schemeIdUri="urn:e" timescale="10"><Event presentationTime="1" id="1"/><Event presentationTime="5" id="2" duration="3"/></EventStream>
<AdaptationSet id="1" contentType="audio" mimeType="audio/mp4" codecs="mp4a.40.2" lang="en" audioSamplingRate="48000"><AudioChannelConfiguration schemeIdUri="urn:c" value="2"/>
<ContentProtection schemeIdUri="urn:mpeg:dash:mp4protection:2011" value="cenc" cenc:default_KID="{KID}"/><ContentProtection schemeIdUri="urn:uuid:{KID}"><cenc:pssh>{PSSH}</cenc:pssh></ContentProtection>
<ProducerReferenceTime id="7" type="encoder" wallClockTime="2026-01-01T00:00:00Z" presentationTime="0"/>
<SegmentTemplate timescale="10" duration="20" media="$RepresentationID$-$Number$.m4s" availabilityTimeOffset="1.5" availabilityTimeComplete="false"/><Representation id="a" bandwidth="1"/><Representation id="b" bandwidth="2"/></AdaptationSet>
<AdaptationSet id="2" contentType="video"><Representation id="v" bandwidth="9"><SegmentTemplate timescale="10" media="$Time$.m4s"><SegmentTimeline><S t="0" d="20" r="4"/><S d="100" r="-1"/></SegmentTimeline></SegmentTemplate></Representation></AdaptationSet></Period>
<Period id="p2" start="PT20S" duration="PT10S"><AdaptationSet id="1" contentType="video"><Representation id="a" bandwidth="1"><SegmentList timescale="1" duration="5"><SegmentURL media="1.m4s"/><SegmentURL media="2.m4s"/></SegmentList></Representation>
<Representation id="b" bandwidth="1"><SegmentBase indexRange="100-199"><Initialization range="0-99"/></SegmentBase></Representation></AdaptationSet></Period>
<UTCTiming schemeIdUri="urn:mpeg:dash:utc:http-iso:2014" value="https://time.example.org"/></MPD>"""

#: (what is replaced, by what, rules that must then fail)
EDITS = [
    ("dash:schema:mpd:2011", "dash:schema:mpd:2010", "DASH-NAMESPACE"), ('type="dynamic"', 'type="other"', "DASH-TYPE DASH-LIVE-TYPE"), (' type="dynamic"', "", "DASH-LIVE-TYPE"), (' minBufferTime="PT2S"', "", "DASH-MIN-BUFFER-TIME"),
    ("T00:00:00Z\" publish", '" publish', "DASH-DYNAMIC-TIMING DASH-LIVE-AVAILABILITY-ANCHOR"), ('00:01Z"', '00:01"', "DASH-LIVE-PUBLISH-TIME"), (' minimumUpdatePeriod="PT2S"', "", "DASH-UPDATE-PERIOD DASH-LIVE-UPDATE-PERIOD"),
    (' timeShiftBufferDepth="PT30S"', "", "DASHIF-AVAILABILITY-WINDOW"), ('Depth="PT30S"', 'Depth="PT0S"', "DASH-LIVE-BUFFER-DEPTH DASHIF-PRESENTATION-DELAY"), (' suggestedPresentationDelay="PT6S"', "", "DASHIF-PRESENTATION-DELAY"), ("dashif.org/", "example/", "DASHIF-PROFILE-DECLARATION"),
    ('id="p2"', 'id="p1"', "DASH-UNIQUE-PERIOD-ID"), ('start="PT20S"', 'start="PT15S"', "DASH-PERIOD-TIMELINE DASH-LIVE-PERIOD-RESOLUTION"), ("</Period>\n<UTC", '</Period><Period id="p3"/>\n<UTC', "DASH-ADAPTATION-SET"), ('<AdaptationSet id="2"', '<AdaptationSet id="1"', "DASH-UNIQUE-ADAPTATION-ID"),
    ("</AdaptationSet></Period>\n<UTC", "</AdaptationSet><AdaptationSet/></Period>\n<UTC", "DASH-REPRESENTATION"), ('<Representation id="b" bandwidth="2"/>', '<Representation id="a" bandwidth="0"/>', "DASH-REPRESENTATION-ID DASH-BANDWIDTH"),
    ('id="2" contentType="video"', 'id="2"', "DASH-CONTENT-TYPE"), (' codecs="mp4a.40.2"', "", "DASH-AUDIO-CODEC"), (' audioSamplingRate="48000"', "", "DASH-AUDIO-SAMPLE-RATE"), ('"urn:c" value="2"', '"urn:c"', "DASH-AUDIO-CHANNEL-CONFIG"), (' lang="en"', "", "DASHIF-AUDIO-LANGUAGE"),
    ("<SegmentBase indexRange", '<SegmentList duration="9"/><SegmentBase indexRange', "DASH-SEGMENT-ADDRESSING"), ('<SegmentList timescale="1"', '<SegmentList timescale="0"', "DASH-TIMESCALE DASH-SEGMENT-LIST-COUNT"), (' media="$Time$.m4s"', "", "DASH-MEDIA-TEMPLATE"),
    (' duration="5">', ">", "DASH-SEGMENT-DURATION DASH-SEGMENT-LIST-COUNT"), ('d="20" r="4"', 'd="0" r="4"', "DASH-TIMELINE-ENTRY DASH-TIMELINE-EXPANSION"), ('<S d="100"', '<S t="80" d="0"', "DASH-TIMELINE-ENTRY DASH-TIMELINE-EXPANSION"),
    ('<SegmentURL media="1.m4s"/><SegmentURL media="2.m4s"/>', "", "DASH-SEGMENT-LIST DASH-SEGMENT-LIST-COUNT"), ('<SegmentURL media="1.m4s"/>', "<SegmentURL/>", "DASH-SEGMENT-URL"), (' indexRange="100-199"', "", "DASH-SEGMENT-BASE-INDEX"), ('<Initialization range="0-99"', '<Initialization sourceURL="i"', "DASH-SEGMENT-BASE-INITIALIZATION DASHIF-SEGMENT-BASE-INITIALIZATION"),
    ('<UTCTiming schemeIdUri="urn:mpeg:dash:utc:http-iso:2014" value="https://time.example.org"/>', "", "DASH-LIVE-UTC-TIMING"), ('value="https', 'value="ftp', "DASH-LIVE-UTC-TIMING"), ('type="encoder" wallClockTime="2026-01-01T00:00:00Z"', "", "DASH-LIVE-PRODUCER-REFERENCE-TIME"),
    ('referenceId="7"', 'referenceId="8"', "DASH-LIVE-SERVICE-DESCRIPTION"), ('max="8000"', 'max="3000"', "DASH-LIVE-SERVICE-DESCRIPTION"), ('max="1.1"', 'max="0.9"', "DASH-LIVE-SERVICE-DESCRIPTION"), ('<Latency target="4000" min="2000" max="8000" referenceId="7"/>', "", "DASH-LL-SERVICE-DESCRIPTION DASH-LL-LATENCY-GEOMETRY DASHIF-LL-SEGMENT-DURATION"),
    ('<ProducerReferenceTime id="7" type="encoder" wallClockTime="2026-01-01T00:00:00Z" presentationTime="0"/>', "", "DASHIF-LL-PRODUCER-REFERENCE-TIME DASH-LIVE-SERVICE-DESCRIPTION"), ('"urn:e"', '""', "DASH-EVENT-STREAM"), ('presentationTime="5"', 'presentationTime="0"', "DASH-EVENT-ORDER"),
    ('presentationTime="5" id="2"', 'presentationTime="5" id="1"', "DASH-EVENT-ID"), ('duration="3"', 'duration="9223372036854775807"', "DASH-EVENT-ID"), ("dash:mp4protection:2011", "dash:other:2011", "DASH-CONTENT-PROTECTION-SET DASH-CENC-DEFAULT-KID"), (f"urn:uuid:{KID}", "urn:uuid:1", "DASH-CONTENT-PROTECTION-SCHEME"),
    ('value="cenc"', 'value="none"', "DASH-CENC-DEFAULT-KID"), (f' cenc:default_KID="{KID}"', "", "DASHIF-CENC-DEFAULT-KID"), (PSSH, PSSH[:-8], "DASH-CENC-PSSH"), ('Offset="1.5"', 'Offset="-1"', "DASH-LIVE-AVAILABILITY-OFFSET DASH-LL-AVAILABILITY"), ('Offset="1.5"', 'Offset="2.5"', "DASH-LL-AVAILABILITY"),
    ("-$Number$.m4s", ".m4s", "DASH-LL-MEDIA-TEMPLATE"), ('target="4000"', 'target="2000"', "DASH-LL-LATENCY-GEOMETRY DASHIF-LL-SEGMENT-DURATION"), ('<SegmentBase indexRange', '<SegmentBase availabilityTimeComplete="false" indexRange', "DASH-LIVE-SEGMENT-BASE-COMPLETE DASH-LL-AVAILABILITY DASH-LL-LATENCY-GEOMETRY DASHIF-LL-SEGMENT-DURATION"),
]


@pytest.fixture(scope="module")
def failed(spark):
    texts = [LIVE, *(LIVE.replace(a, b, 1) for a, b, _ in EDITS), "<x", "", None, "<Other/>"]
    assert all(t != LIVE for t in texts[1:])
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, text string").repartition(4)
    found = r.element_findings(docs, "live").collect()
    assert {x.rule_id for x in found if x.path == "0"} | {"AQ-DASH-STATIC-DURATION"} == {f"AQ-{rule}" for rule, *_ in r.rules("live")}
    return [{x.rule_id.removeprefix("AQ-") for x in found if x.path == str(i) and not x.passed} for i in range(len(texts))]


def test_good_manifest_passes_every_rule(failed):
    assert failed[0] == set()


def test_each_edit_fails_its_rules(failed):
    for (_, to, want), got in zip(EDITS, failed[1:], strict=False):
        assert got == set(want.split()), to


def test_unreadable_documents_fail_the_root(failed):
    assert failed[-4:] == [{"DASH-MPD-ROOT"}] * 4


def test_profiles_and_static_bounds(spark):
    docs = lambda *t: spark.createDataFrame([(str(i), x) for i, x in enumerate(t)], "path string, text string")
    still = LIVE.replace(' type="dynamic"', "")
    open_end = still.replace('start="PT20S" duration="PT10S"', 'start="PT20S"')
    got = r.element_findings(docs(still, open_end)).collect()
    assert {(x.path, x.rule_id) for x in got if not x.passed} == {("1", "AQ-DASH-STATIC-DURATION")} and not any("LIVE" in x.rule_id or "DASHIF" in x.rule_id for x in got)
    assert any("DASHIF" in x.rule_id for x in r.element_findings(docs(still), "dash-if").collect())
    with pytest.raises(ValueError):
        r.element_findings(docs(still), "no")
    assert r.element_findings(docs(still).where("false")).count() == 0
