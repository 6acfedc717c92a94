"""Request documents and probe reports."""

import json

from wavequarry.sources import specs


def test_json_and_toml_give_the_same(spark):
    docs = [("a.json", '{"target": -23.0, "names": ["x"], "more": 1}'), ("b.TOML", 'target = -23.0\nnames = ["x"]\n'), ("c.json", "{"), ("d.toml", "= 1"), ("e.json", None), ("f.json", '{"target": "loud"}'), ("g.json", ""), ("h.json", "{}"), (None, "{}")]
    found = {r.path: r for r in specs.read_specs(spark.createDataFrame(docs, "path string, text string"), "struct<target: double, names: array<string>>").collect()}
    assert len(found) == len(docs) and found["a.json"].spec == found["b.TOML"].spec and found["a.json"].spec.target == -23 and found["a.json"].error is None
    assert {p for p, r in found.items() if r.error} == {"c.json", "d.toml", "e.json", "f.json", "g.json"} and all((r.spec is None) == bool(r.error) for r in found.values())


def test_too_long_documents_are_errors(spark, monkeypatch):
    monkeypatch.setattr(specs, "MOST", 5)
    assert specs.read_specs(spark.createDataFrame([("a.json", '{"a": 1}')], "path string, text string"), "struct<a: int>").first().error == "too long"


def test_probe_reports(spark):
    audio = {"index": 1, "codec_type": "audio", "codec_name": "aac", "sample_rate": "48000", "channels": 2, "duration": "1.5"}
    report = json.dumps({"streams": [{"index": 0, "codec_type": "video"}, audio], "format": {"format_name": "mov", "bit_rate": "128000"}})
    rows = specs.probed_streams(spark.createDataFrame([("a", report), ("b", '{"streams": []}'), ("c", "no")], "path string, text string")).orderBy("path").collect()
    assert (rows[0].stream, rows[0].codec, rows[0].sample_rate, rows[0].bit_rate, rows[0].seconds, rows[0].container, rows[0].error) == (1, "aac", 48000, 128000, 1.5, "mov", None)
    assert [r.error for r in rows[1:]] == ["no audio stream", "not of the schema"]
