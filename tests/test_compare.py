"""Comparison of manifests: fields and verdicts of two runs."""

from wavequarry.operators import compare


def test_changed_fields_and_verdicts(spark):
    schema = "path string, rate int, ok boolean"
    base = spark.createDataFrame([("same", 48, True), ("rate", 48, True), ("lost", 48, True), ("fails", 48, True), ("first", None, None), ("failed", 48, False), ("gone", 48, True)], schema)
    cand = spark.createDataFrame([("same", 48, True), ("rate", 44, True), ("lost", None, None), ("fails", 48, False), ("first", 48, False), ("failed", 48, False), ("new", 48, False)], schema)
    found = {(r.path, r.metric, r.base, r.cand, r.rule_id) for r in compare.field_changes(base, cand, "path", ["rate"], ["ok"]).collect()}
    assert found == {
        ("rate", "rate", "48", "44", "AQ-FORMAT-CHANGED"), ("lost", "rate", "48", None, "AQ-EVIDENCE-MISSING"), ("lost", "ok", "true", None, "AQ-EVIDENCE-MISSING"),
        ("fails", "ok", "true", "false", "AQ-NEW-FAILURE"), ("first", "ok", None, "false", "AQ-NEW-FAILURE"),
    }


def test_container_verdicts_have_their_own_rules(spark):
    schema = "path string, rule string, passed boolean"
    base = spark.createDataFrame([("a", "R", True), ("b", "R", True), ("c", "R", None)], schema)
    cand = spark.createDataFrame([("a", "R", False), ("c", "R", False)], schema)
    found = {(r.path, r.rule_id) for r in compare.verdict_diff(base, cand, ["path", "rule"], "CONTAINER-QC").collect()}
    assert found == {("a", "AQ-NEW-CONTAINER-QC-FAILURE"), ("b", "AQ-CONTAINER-QC-EVIDENCE-MISSING")}


def test_audits_are_joined_by_place(spark):
    reports = spark.createDataFrame([("m", 2, "b"), ("m", 1, "a"), ("n", 1, "c"), ("o", 1, "d")], "manifest string, at int, path string")
    audits = spark.createDataFrame([("m", 5, True), ("m", 9, False), ("n", 1, True), ("n", 2, True), ("p", 1, True)], "manifest string, nth int, ok boolean")
    found = compare.zip_audits(reports, audits, "manifest", "at", "nth").collect()
    assert {(r.path, r.position, r.ok, r.mismatched) for r in found} == {("a", 1, True, False), ("b", 2, False, False), ("c", 1, None, True), ("d", 1, None, False)}
