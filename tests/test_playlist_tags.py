"""Rules on playlist lines: a playlist that passes them all, and one change for each rule that fails it."""

import pytest

from wavequarry.sources import playlist_tags

MEDIA = """#EXTM3U
#EXT-X-VERSION:9
#EXT-X-TARGETDURATION:6
#EXT-X-DISCONTINUITY-SEQUENCE:2
#EXT-X-PART-INF:PART-TARGET=1.0
#EXT-X-SERVER-CONTROL:CAN-BLOCK-RELOAD=YES,PART-HOLD-BACK=3.0,HOLD-BACK=18,CAN-SKIP-UNTIL=36
#EXT-X-MAP:URI="init.mp4"
#EXT-X-PROGRAM-DATE-TIME:2024-05-01T10:00:00.000Z
#EXTINF:6.0,
a.m4s
#EXT-X-DISCONTINUITY
#EXT-X-PART:DURATION=1.0,URI="b0.m4s",BYTERANGE="100@0"
#EXT-X-PART:DURATION=0.5,URI="b0.m4s",BYTERANGE="50",INDEPENDENT=YES
#EXT-X-PART:DURATION=0.4,URI="b2.m4s"
#EXTINF:1.9,
b.m4s
#EXT-X-PART:DURATION=1.0,URI="c0.m4s"
#EXT-X-PRELOAD-HINT:TYPE=PART,URI="c1.m4s"
#EXT-X-RENDITION-REPORT:URI="../low/live.m3u8",LAST-MSN=4,LAST-PART=0
"""
VARIANTS = """#EXTM3U
#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="aac",NAME="One, two",DEFAULT=YES,AUTOSELECT=YES,URI="a.m3u8"
#EXT-X-STREAM-INF:BANDWIDTH=128000,CODECS="mp4a.40.2,avc1",AUDIO="aac"
v.m3u8
"""
ENDED = "#EXTM3U\n#EXT-X-TARGETDURATION:6\n#EXT-X-PLAYLIST-TYPE:VOD\n#EXTINF:6.4,\na.ts\n#EXT-X-ENDLIST\n"
SKIP = MEDIA.replace("#EXT-X-MAP", "#EXT-X-SKIP:SKIPPED-SEGMENTS=3\n#EXT-X-MAP")

#: Rule, playlist, what is replaced, and by what.
BROKEN = [
    ("HLS-EXTM3U", MEDIA, "#EXTM3U\n", "\n"),
    ("HLS-PLAYLIST-KIND", ENDED, "#EXTINF", "#EXT-X-STREAM-INF:BANDWIDTH=1\nv.m3u8\n#EXTINF"),
    ("HLS-SINGLE-TAGS", MEDIA, "#EXT-X-VERSION:9\n", "#EXT-X-VERSION:9\n#EXT-X-VERSION:9\n"),
    ("HLS-DANGLING-TAG", ENDED, "a.ts\n", ""),
    ("HLS-DANGLING-TAG", ENDED, "a.ts\n", "a.ts\n#EXT-X-DISCONTINUITY\n"),
    ("HLS-ORPHAN-URI", ENDED, "a.ts\n", "a.ts\nb.ts\n"),
    ("HLS-EXTINF", ENDED, "6.4", "x"),
    ("HLS-SEGMENTS", ENDED, "#EXTINF:6.4,\na.ts\n", ""),
    ("HLS-TARGET-DURATION", ENDED, "6.4", "6.5"),
    ("HLS-FMP4-MAP", MEDIA, '#EXT-X-MAP:URI="init.mp4"\n', ""),
    ("HLS-PROTOCOL-VERSION", MEDIA, "VERSION:9", "VERSION:5"),
    ("HLS-PLAYLIST-TYPE", ENDED, "#EXT-X-ENDLIST\n", ""),
    ("HLS-PLAYLIST-TYPE", ENDED, "VOD", "LIVE"),
    ("HLS-DISCONTINUITY-SEQUENCE-ORDER", ENDED, "a.ts\n", "a.ts\n#EXT-X-DISCONTINUITY-SEQUENCE:1\n"),
    ("HLS-DISCONTINUITY-PLACEMENT", MEDIA, "#EXT-X-DISCONTINUITY\n", "#EXT-X-DISCONTINUITY\n#EXT-X-DISCONTINUITY\n"),
    ("HLS-PART-INF", MEDIA, "PART-TARGET=1.0", "PART-TARGET=0"),
    ("HLS-PART-TARGET", MEDIA, "#EXT-X-PART-INF:PART-TARGET=1.0\n", ""),
    ("HLS-PART", MEDIA, 'URI="c0.m4s"', "URI=c0.m4s"),
    ("HLS-PART", MEDIA, 'URI="b0.m4s",BYTERANGE="50"', 'URI="other.m4s",BYTERANGE="50"'),
    ("HLS-PART-DURATION", MEDIA, ",INDEPENDENT=YES", ""),
    ("HLS-PART-DURATION", MEDIA, 'DURATION=1.0,URI="c0', 'DURATION=1.1,URI="c0'),
    ("HLS-PART-TAG-ORDER", MEDIA, "#EXTINF:1.9", "#EXT-X-KEY:METHOD=NONE\n#EXTINF:1.9"),
    ("HLS-SERVER-CONTROL", MEDIA, "CAN-BLOCK-RELOAD=YES", "CAN-BLOCK-RELOAD=MAYBE"),
    ("HLS-SERVER-CONTROL-RELATIONSHIPS", MEDIA, "HOLD-BACK=18", "HOLD-BACK=17"),
    ("HLS-SERVER-CONTROL-RELATIONSHIPS", MEDIA, "CAN-SKIP-UNTIL=36", "CAN-SKIP-UNTIL=35"),
    ("HLS-DELTA-UPDATE", SKIP, "SKIPPED-SEGMENTS=3", "SKIPPED-SEGMENTS=-3"),
    ("HLS-DELTA-VERSION", SKIP, "VERSION:9", "VERSION:8"),
    ("HLS-PRELOAD-HINT", MEDIA, ',URI="c1.m4s"', ""),
    ("HLS-PRELOAD-HINT-TYPE", MEDIA, "TYPE=PART", "TYPE=KEY"),
    ("HLS-PRELOAD-HINT-SET", MEDIA, "#EXT-X-PRELOAD-HINT", '#EXT-X-PRELOAD-HINT:TYPE=PART,URI="d"\n#EXT-X-PRELOAD-HINT'),
    ("HLS-PRELOAD-ENDLIST", MEDIA, "LAST-PART=0\n", "LAST-PART=0\n#EXT-X-ENDLIST\n"),
    ("HLS-RENDITION-REPORT", MEDIA, "../low", "http://x/low"),
    ("HLS-PROGRAM-DATE-TIME", MEDIA, "2024-05-01T", "2024-13-01T"),
    ("HLS-PROGRAM-DATE-TIME-PRECISION", MEDIA, ".000Z", "Z"),
    ("HLS-STREAM-INF", VARIANTS, "BANDWIDTH=128000", "BANDWIDTH=0"),
    ("HLS-MEDIA-RENDITION", VARIANTS, ",AUTOSELECT=YES", ""),
    ("APPLE-HLS-CODECS", VARIANTS, 'CODECS="mp4a.40.2,avc1",', ""),
    ("APPLE-HLS-SIX-SECOND-TARGET", ENDED, "TARGETDURATION:6", "TARGETDURATION:7"),
    ("APPLE-HLS-SEGMENT-DURATION", ENDED, "6.4", "6.6"),
    ("LL-HLS-PARTS", MEDIA, "#EXT-X-PART:", "#EXT-X-OTHER:"),
    ("LL-HLS-PRELOAD", MEDIA, "TYPE=PART", "TYPE=MAP"),
    ("LL-HLS-PROGRAM-DATE-TIME", MEDIA, "#EXT-X-PROGRAM-DATE-TIME:2024-05-01T10:00:00.000Z\n", ""),
    ("LL-HLS-BLOCKING-RELOAD", MEDIA, "CAN-BLOCK-RELOAD=YES,", ""),
    ("LL-HLS-PART-HOLD-BACK", MEDIA, "PART-HOLD-BACK=3.0", "PART-HOLD-BACK=2.5"),
    ("LL-HLS-I-FRAMES", MEDIA, "#EXT-X-MAP", "#EXT-X-I-FRAMES-ONLY\n#EXT-X-MAP"),
]


def profile_of(rule):
    return {"APPLE": "apple", "LL": "low-latency"}.get(rule.split("-")[0], "hls")


@pytest.fixture(scope="module")
def failed(spark):
    """Failed rules of every case by profile and number."""
    out = {}
    for profile in playlist_tags.PROFILES:
        rows = [(str(i), text.replace(old, new)) for i, (rule, text, old, new) in enumerate(BROKEN) if profile_of(rule) == profile]
        rows += [("ok", MEDIA), ("skip", SKIP)] + ([("variants", VARIANTS), ("ended", ENDED)] if profile != "low-latency" else [])
        rows += [("null", None), ("blank", " \n")]
        found = playlist_tags.findings(playlist_tags.lines_of(spark.createDataFrame(rows, "path string, text string")), profile)
        for r in found.where("NOT passed").collect():
            out.setdefault((profile, r.path), set()).add(r.rule_id)
    return out


def test_changed_playlists_fail_their_rule(failed):
    missing = [(rule, i, failed.get((profile_of(rule), str(i)))) for i, (rule, *_) in enumerate(BROKEN) if f"AQ-{rule}" not in failed.get((profile_of(rule), str(i)), ())]
    assert missing == []


def test_good_playlists_pass(failed):
    assert {k: v for k, v in failed.items() if k[1] in ("ok", "skip", "variants", "ended")} == {}


def test_blank_and_null_playlists_have_no_header(failed):
    for path in ("null", "blank"):
        assert failed["hls", path] == {"AQ-HLS-EXTM3U", "AQ-HLS-PLAYLIST-KIND"}


def test_files_and_unknown_profiles(spark, tmp_path):
    (tmp_path / "a.m3u8").write_text(ENDED.replace("\n", "\r\n"), newline="")
    lines = playlist_tags.read_lines(spark, str(tmp_path))
    assert [r.tag for r in lines.orderBy("line").collect()] == ["EXTM3U", "EXT-X-TARGETDURATION", "EXT-X-PLAYLIST-TYPE", "EXTINF", None, "EXT-X-ENDLIST"]
    assert playlist_tags.findings(lines).where("NOT passed").count() == 0
    with pytest.raises(ValueError):
        playlist_tags.findings(lines, "other")
