"""Compliance, planning, comparison, packets, integrity and catalogue over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dims
from ..functions.units import expand_template, iso_duration_seconds, redact_uri, rounded, wrap16
from ..operators import compare, compliance, sequence
from ..sources import playlist_tags
from .mappings import MEASURE_SQL, PACKET_SQL, measurements, packets, read
from .registry import query

RULE_SQL = f"""{MEASURE_SQL}, pr({", ".join(dims.PROFILE_COLUMNS)}) AS {dims.values(dims.PROFILES)},
x AS (SELECT m.*, pr.*, CASE WHEN basis = 'dialogue' THEN dialogue_lufs ELSE integrated_lufs END AS base FROM m, pr),
ru AS (SELECT asset, profile, 'integrated_lufs' AS metric, base AS measured, target - lower_tol AS minimum, target + upper_tol AS maximum, true AS maximum_inclusive FROM x WHERE target IS NOT NULL
 UNION ALL SELECT asset, profile, 'max_loudness', base, NULL, max_loudness, true FROM x WHERE max_loudness IS NOT NULL
 UNION ALL SELECT asset, profile, 'true_peak_dbtp', true_peak_dbtp, NULL, max_true_peak, true FROM x WHERE max_true_peak IS NOT NULL
 UNION ALL SELECT asset, profile, 'max_short_term_lufs', max_short_term_lufs, NULL, max_short_term, true FROM x WHERE max_short_term IS NOT NULL
 UNION ALL SELECT asset, profile, 'ldr', integrated_lufs - dialogue_lufs, NULL, max_ldr, true FROM x WHERE max_ldr IS NOT NULL
 UNION ALL SELECT asset, profile, 'plr', true_peak_dbtp - integrated_lufs, NULL, plr_below, false FROM x WHERE plr_below IS NOT NULL),
ev AS (SELECT *, coalesce(measured IS NOT NULL AND (minimum IS NULL OR measured >= minimum) AND (maximum IS NULL OR CASE WHEN maximum_inclusive THEN measured <= maximum ELSE measured < maximum END), false) AS passed FROM ru)"""


@query(f"WITH {RULE_SQL} SELECT asset, profile, metric, round(measured, 6) + 0 AS measured, round(minimum, 6) AS minimum, round(maximum, 6) AS maximum, passed FROM ev")
def compliance_eval(spark, sf_dir):
    """Every rule of every profile."""
    ev = compliance.evaluate(measurements(spark, sf_dir), dims.profiles(spark))
    return ev.select("asset", "profile", "metric", *[rounded(F.col(c)).alias(c) for c in ("measured", "minimum", "maximum")], "passed")


@query(f"WITH {RULE_SQL}, v AS (SELECT asset, profile, bool_and(passed) AS ok, count(*) FILTER (NOT passed) AS failed FROM ev GROUP BY asset, profile) SELECT profile, count(*) AS assets, count(*) FILTER (ok) AS passing, CAST(sum(failed) AS BIGINT) AS failed_rules FROM v GROUP BY profile")
def compliance_rollup(spark, sf_dir):
    """Verdict per asset and profile, counted per profile."""
    ev = compliance.evaluate(measurements(spark, sf_dir), dims.profiles(spark))
    v = ev.groupBy("asset", "profile").agg(F.bool_and("passed").alias("ok"), F.count_if(~F.col("passed")).alias("failed"))
    return v.groupBy("profile").agg(F.count("*").alias("assets"), F.count_if("ok").alias("passing"), F.sum("failed").alias("failed_rules"))


@query(f"WITH {RULE_SQL}, t(metric, remedy) AS {dims.values(list(dims.REMEDIES.items()))} SELECT asset, 'AQ-COMPLIANCE-' || upper(replace(metric, '_', '-')) AS rule_id, remedy, count(*) AS profiles FROM ev JOIN t USING (metric) WHERE NOT passed GROUP BY ALL")
def failed_rule_explanations(spark, sf_dir):
    """Failed rules with identifiers and advice."""
    texts = spark.createDataFrame(list(dims.REMEDIES.items()), "metric string, remedy string")
    failed = compliance.evaluate(measurements(spark, sf_dir), dims.profiles(spark)).where(~F.col("passed"))
    return failed.groupBy("asset", "metric").agg(F.count("*").alias("profiles")).join(F.broadcast(texts), "metric").select("asset", compliance.rule_id(F.col("metric")).alias("rule_id"), "remedy", "profiles")


GAIN_SQL = "pow(10, least(-23.0 - integrated_lufs, -1.0 - true_peak_dbtp, 20.0) / 20)"


@query(f"WITH {MEASURE_SQL} SELECT asset, round({GAIN_SQL}, 6) AS gain, round(integrated_lufs + 20 * log10({GAIN_SQL}), 6) AS loudness_after FROM m")
def gain_plan(spark, sf_dir):
    """Static gain to -23 LUFS under a ceiling of -1 dBTP."""
    m = measurements(spark, sf_dir).withColumn("gain", compliance.gain_plan(F.col("integrated_lufs"), F.col("true_peak_dbtp"), -23.0, -1.0, 20.0))
    return m.select("asset", rounded(F.col("gain")).alias("gain"), rounded(F.col("integrated_lufs") + 20 * F.log10("gain")).alias("loudness_after"))


@query(f"WITH {MEASURE_SQL} SELECT asset, abs(integrated_lufs + 20 * log10({GAIN_SQL}) + 23.0) <= 0.2 AND true_peak_dbtp + 20 * log10({GAIN_SQL}) <= -1.0 + 0.1 AS verified FROM m")
def gain_verification(spark, sf_dir):
    """Is the target reached without passing the ceiling."""
    g = 20 * F.log10(compliance.gain_plan(F.col("integrated_lufs"), F.col("true_peak_dbtp"), -23.0, -1.0, 20.0))
    return measurements(spark, sf_dir).select("asset", compliance.verified(F.col("integrated_lufs") + g, -23.0, 0.2, F.col("true_peak_dbtp") + g, -1.0, 0.1).alias("verified"))


@query(f"WITH {MEASURE_SQL}, a AS (SELECT album, avg(pow(10, (integrated_lufs + 0.691) / 10)) AS ms, max(true_peak_dbtp) AS peak, count(*) AS assets FROM m GROUP BY album) SELECT album, assets, round(-0.691 + 10 * log10(ms), 6) AS album_lufs, round(least(-16.0 - (-0.691 + 10 * log10(ms)), -1.0 - peak), 6) AS album_gain_db FROM a")
def album_gain(spark, sf_dir):
    """One gain for an album: joint loudness, worst true peak."""
    a = measurements(spark, sf_dir).groupBy("album").agg(F.avg(F.pow(F.lit(10.0), (F.col("integrated_lufs") + 0.691) / 10)).alias("ms"), F.max("true_peak_dbtp").alias("peak"), F.count("*").alias("assets"))
    loud = -0.691 + 10 * F.log10("ms")
    return a.select("album", "assets", rounded(loud).alias("album_lufs"), rounded(F.least(-16.0 - loud, -1.0 - F.col("peak"))).alias("album_gain_db"))


@query(f"WITH {MEASURE_SQL}, i AS (SELECT album, max(-36 - integrated_lufs) AS lowest, min(-1 - true_peak_dbtp) AS highest, count(*) AS assets FROM m GROUP BY album) SELECT album, assets, round(lowest, 6) AS lowest, round(highest, 6) AS highest, CASE WHEN lowest <= highest THEN round(greatest(lowest, least(0, highest)), 6) END AS shared_gain FROM i")
def shared_gain_interval(spark, sf_dir):
    """Gains that suit all assets of an album."""
    rows = measurements(spark, sf_dir).select("album", (-36 - F.col("integrated_lufs")).alias("low"), (-1 - F.col("true_peak_dbtp")).alias("high"))
    out = compliance.shared_interval(rows, ["album"], "low", "high")
    return out.select("album", "assets", *[rounded(F.col(c)).alias(c) for c in ("lowest", "highest", "shared_gain")])


@query(
    """WITH s AS (SELECT l_orderkey AS asset, l_linenumber AS seg, -23.0 - (-30 + (l_extendedprice % 1500) / 100) AS d, -1.0 - (-8 + (l_extendedprice % 600) / 100) AS safe, l_partkey AS part, l_suppkey AS supp FROM lineitem),
n AS (SELECT asset, seg, d, safe, lead(d) OVER w AS nd, lead(safe) OVER w AS ns FROM s WINDOW w AS (PARTITION BY asset ORDER BY seg, part, supp, s.d, s.safe))
SELECT asset, seg, round(least((d + nd) / 2, safe, ns), 6) AS boundary_gain FROM n WHERE nd IS NOT NULL"""
)
def segment_boundary_gains(spark, sf_dir):
    """Gains at segment boundaries."""
    p = F.col("l_extendedprice")
    s = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("asset"), F.col("l_linenumber").alias("seg"), (-23.0 - (-30 + p % 1500 / 100)).alias("d"), (-1.0 - (-8 + p % 600 / 100)).alias("safe"), "l_partkey", "l_suppkey")
    return compliance.boundary_gains(s, "asset", ["seg", "l_partkey", "l_suppkey", "d", "safe"], "d", "safe").select("asset", "seg", rounded(F.col("boundary_gain")).alias("boundary_gain"))


@query(f"WITH {MEASURE_SQL}, pr({', '.join(dims.PROFILE_COLUMNS)}) AS {dims.values(dims.PROFILES)}, t AS (SELECT asset, min(target) AS target, min(max_true_peak) AS ceiling, count(*) AS profiles FROM m, pr WHERE target IS NOT NULL GROUP BY asset) SELECT asset, profiles, target, ceiling, round(least(target - integrated_lufs, ceiling - true_peak_dbtp), 6) AS gain_db FROM t JOIN m USING (asset)")
def multi_delivery_targets(spark, sf_dir):
    """One render for all profiles that have a target: lowest target, lowest ceiling."""
    wanted = dims.profiles(spark).where("target IS NOT NULL").agg(F.min("target").alias("target"), F.min("max_true_peak").alias("ceiling"), F.count("*").alias("profiles"))
    t = measurements(spark, sf_dir).crossJoin(F.broadcast(wanted))  # a single row
    return t.select("asset", "profiles", "target", "ceiling", rounded(F.least(F.col("target") - F.col("integrated_lufs"), F.col("ceiling") - F.col("true_peak_dbtp"))).alias("gain_db"))


@query(
    f"""WITH {MEASURE_SQL}, g AS (SELECT *, greatest(-12.0, least(12.0, -16.0 - integrated_lufs)) AS gain FROM m), p AS (SELECT *, true_peak_dbtp + gain AS after FROM g)
SELECT asset, round(gain, 6) AS gain_db, concat_ws(',', CASE WHEN abs(gain) > 0.05 THEN 'static-gain' END, CASE WHEN after > -1 THEN 'true-peak-limiter' END, CASE WHEN duration_seconds >= 60 AND lra > 15 THEN 'range-compressor' END) AS actions,
concat_ws(',', CASE WHEN abs(-16.0 - integrated_lufs) > 12 THEN 'gain-limit' END, CASE WHEN after > 5 THEN 'limiting-over-6-db' END) AS reasons,
NOT (abs(-16.0 - integrated_lufs) > 12 OR after > 5) AS feasible, CASE WHEN duration_seconds >= 60 THEN lra <= 15 END AS lra_ok FROM p"""
)
def remediation_plan(spark, sf_dir):
    """Dry run of what would make an asset compliant."""
    out = compliance.remediation(measurements(spark, sf_dir), -16.0, 12.0, -1.0, 15.0)
    return out.select("asset", rounded(F.col("gain_db")).alias("gain_db"), F.array_join("actions", ",").alias("actions"), F.array_join("reasons", ",").alias("reasons"), "feasible", "lra_ok")


def manifests(spark, sf_dir):
    """M4: orders, and the same with rows dropped, prices drifted and keys added."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_totalprice").alias("integrated_lufs"), (F.col("o_totalprice") % 100).alias("true_peak_dbtp"), F.col("o_orderstatus").alias("status"))
    kept = o.where("path % 17 <> 0").withColumn("integrated_lufs", F.col("integrated_lufs") + F.when(F.col("path") % 13 == 0, 0.5).otherwise(0.0)).withColumn("true_peak_dbtp", F.when(F.col("path") % 23 != 0, F.col("true_peak_dbtp")))
    return o, kept.union(o.where("path % 29 = 0").withColumn("path", F.col("path") + 1_000_000_000))


MANIFEST_SQL = """b AS (SELECT o_orderkey AS path, o_totalprice AS integrated_lufs, o_totalprice % 100 AS true_peak_dbtp, o_orderstatus AS status FROM orders),
c AS (SELECT path, integrated_lufs + CASE WHEN path % 13 = 0 THEN 0.5 ELSE 0.0 END AS integrated_lufs, CASE WHEN path % 23 <> 0 THEN true_peak_dbtp END AS true_peak_dbtp, status FROM b WHERE path % 17 <> 0
      UNION ALL SELECT path + 1000000000, integrated_lufs, true_peak_dbtp, status FROM b WHERE path % 29 = 0)"""


@query(f"WITH {MANIFEST_SQL} SELECT coalesce(b.path, c.path) AS path, CASE WHEN c.path IS NULL THEN 'AQ-ASSET-MISSING' ELSE 'AQ-ASSET-NEW' END AS rule_id, CASE WHEN c.path IS NULL THEN 'error' ELSE 'note' END AS severity FROM b FULL JOIN c ON b.path = c.path WHERE b.path IS NULL OR c.path IS NULL")
def manifest_diff_full_outer(spark, sf_dir):
    """Missing and new assets."""
    b, c = manifests(spark, sf_dir)
    return compare.manifest_diff(compare.unique_or_fail(b, "path"), compare.unique_or_fail(c, "path"), "path")


@query(
    f"""WITH {MANIFEST_SQL}, x AS (SELECT b.path, 'integrated_lufs' AS metric, b.integrated_lufs AS base, c.integrated_lufs AS cand, 0.1 AS tol FROM b JOIN c USING (path)
 UNION ALL SELECT b.path, 'true_peak_dbtp', b.true_peak_dbtp, c.true_peak_dbtp, 0.1 FROM b JOIN c USING (path))
SELECT path, metric, round(base, 6) AS base, round(cand, 6) AS cand, CASE WHEN cand IS NULL THEN 'AQ-EVIDENCE-MISSING' ELSE 'AQ-METRIC-DRIFT' END AS rule_id FROM x WHERE (base IS NOT NULL AND cand IS NULL) OR abs(cand - base) > tol"""
)
def manifest_metric_drift(spark, sf_dir):
    """Drifted and lost metrics."""
    b, c = manifests(spark, sf_dir)
    out = compare.metric_drift(b, c, "path", {"integrated_lufs": 0.1, "true_peak_dbtp": 0.1})
    return out.select("path", "metric", rounded(F.col("base")).alias("base"), rounded(F.col("cand")).alias("cand"), "rule_id")


@query(
    f"""WITH {MANIFEST_SQL}, vb AS (SELECT path, 'R' || (path % 3) AS rule, status <> 'F' AS passed FROM b), vc AS (SELECT path, 'R' || (path % 3) AS rule, CASE WHEN path % 7 = 0 THEN NULL ELSE path % 5 <> 0 END AS passed FROM c WHERE path % 11 <> 0)
SELECT vb.path, vb.rule, CASE WHEN vc.path IS NULL THEN 'AQ-QC-EVIDENCE-MISSING' ELSE 'AQ-NEW-QC-FAILURE' END AS rule_id FROM vb LEFT JOIN vc ON vb.path = vc.path AND vb.rule = vc.rule WHERE vb.passed AND (vc.path IS NULL OR NOT coalesce(vc.passed, false))"""
)
def rule_verdict_diff(spark, sf_dir):
    """Rules that passed before and do not now."""
    b, c = manifests(spark, sf_dir)
    rule = F.concat(F.lit("R"), (F.col("path") % 3).cast("string")).alias("rule")
    vb = b.select("path", rule, (F.col("status") != "F").alias("passed"))
    vc = c.where("path % 11 <> 0").select("path", rule, F.when(F.col("path") % 7 != 0, F.col("path") % 5 != 0).alias("passed"))
    return compare.verdict_diff(vb, vc, ["path", "rule"])


@query(
    f"""WITH {MANIFEST_SQL}, x AS (SELECT path, status, CASE WHEN path % 5 <> 0 THEN path % 3 <> 0 END AS passed FROM b),
y AS (SELECT path, CASE WHEN path % 31 = 0 THEN NULL WHEN path % 19 = 0 THEN 'X' ELSE status END AS status, CASE WHEN path % 7 <> 0 THEN path % 2 = 0 END AS passed FROM c),
j AS (SELECT x.path, x.status AS s1, y.status AS s2, x.passed AS p1, y.passed AS p2 FROM x JOIN y ON x.path = y.path)
SELECT path, 'status' AS metric, s1 AS base, s2 AS cand, CASE WHEN s2 IS NULL THEN 'AQ-EVIDENCE-MISSING' ELSE 'AQ-FORMAT-CHANGED' END AS rule_id FROM j WHERE s1 IS NOT NULL AND s1 IS DISTINCT FROM s2
UNION ALL SELECT path, 'passed', p1::VARCHAR, p2::VARCHAR, CASE WHEN p2 IS NULL THEN 'AQ-EVIDENCE-MISSING' ELSE 'AQ-NEW-FAILURE' END FROM j WHERE (p1 IS NOT NULL AND p2 IS NULL) OR (NOT p2 AND coalesce(p1, true))"""
)
def manifest_field_changes(spark, sf_dir):
    """Changed format fields, new failures and lost evidence."""
    b, c = manifests(spark, sf_dir)
    x = b.select("path", "status", F.when(F.col("path") % 5 != 0, F.col("path") % 3 != 0).alias("passed"))
    status = F.when(F.col("path") % 31 != 0, F.when(F.col("path") % 19 == 0, "X").otherwise(F.col("status")))
    y = c.select("path", status.alias("status"), F.when(F.col("path") % 7 != 0, F.col("path") % 2 == 0).alias("passed"))
    return compare.field_changes(x, y, "path", ["status"], ["passed"])


@query(
    f"""WITH {MEASURE_SQL} SELECT album, count(*) AS assets, count(*) FILTER (coalesce(CASE WHEN dialogue_lufs IS NULL THEN NULL ELSE dialogue_lufs > -25 END, true) AND true_peak_dbtp <= 0.5) AS passing,
count(*) FILTER (NOT (coalesce(CASE WHEN dialogue_lufs IS NULL THEN NULL ELSE dialogue_lufs > -25 END, true) AND true_peak_dbtp <= 0.5)) AS failing FROM m GROUP BY album"""
)
def manifest_document(spark, sf_dir):
    """K5: manifest counts; a null verdict is no failure."""
    dialogue = F.coalesce(F.when(F.col("dialogue_lufs").isNotNull(), F.col("dialogue_lufs") > -25), F.lit(True))
    m = measurements(spark, sf_dir).withColumn("ok", dialogue & (F.col("true_peak_dbtp") <= 0.5))
    return m.groupBy("album").agg(F.count("*").alias("assets"), F.count_if("ok").alias("passing"), F.count_if(~F.col("ok")).alias("failing"))


LEG_SQL = f"{PACKET_SQL}, a AS (SELECT * FROM k WHERE event_id % 7 <> 0), b AS (SELECT event_id, ssrc, seq, rtp_ts, arrival + (event_id % 13) / 1000 AS arrival, CASE WHEN event_id % 101 = 0 THEN 'x' ELSE digest END AS digest FROM k WHERE event_id % 11 <> 0)"


def legs(spark, sf_dir):
    k = packets(spark, sf_dir)
    b = k.where("event_id % 11 <> 0").withColumn("arrival", F.col("arrival") + F.col("event_id") % 13 / 1000).withColumn("digest", F.when(F.col("event_id") % 101 == 0, "x").otherwise(F.col("digest")))
    return k.where("event_id % 7 <> 0"), b


@query(f"WITH {LEG_SQL} SELECT CASE WHEN b.seq IS NULL THEN 'a' WHEN a.seq IS NULL THEN 'b' ELSE 'both' END AS leg, count(*) AS n FROM a FULL JOIN b ON a.ssrc = b.ssrc AND a.rtp_ts = b.rtp_ts AND a.seq = b.seq GROUP BY ALL")
def rtp_leg_merge(spark, sf_dir):
    """Packets by the legs that carried them."""
    a, b = legs(spark, sf_dir)
    return compare.merge_legs(a, b, ["ssrc", "rtp_ts", "seq"]).groupBy("leg").agg(F.count("*").alias("n"))


@query(f"WITH {LEG_SQL}, s AS (SELECT a.ssrc, list_sort(list(abs(b.arrival - a.arrival))) AS x FROM a JOIN b ON a.ssrc = b.ssrc AND a.rtp_ts = b.rtp_ts AND a.seq = b.seq GROUP BY a.ssrc) SELECT ssrc, len(x) AS packets, round(x[ceil((len(x) - 1) * 0.95)::INT + 1], 3) AS p95_skew, round(list_max(x), 3) AS max_skew FROM s")
def rtp_skew(spark, sf_dir):
    """Skew between legs."""
    from ..operators.measure import nearest_rank_up

    a, b = legs(spark, sf_dir)
    both = compare.merge_legs(a, b, ["ssrc", "rtp_ts", "seq"]).where("leg = 'both'").groupBy("ssrc").agg(F.collect_list(F.abs("skew")).alias("x"))
    return both.select("ssrc", F.size("x").cast("long").alias("packets"), F.round(nearest_rank_up(F.col("x"), 0.95), 3).alias("p95_skew"), F.round(F.array_max("x"), 3).alias("max_skew"))


@query(f"WITH {LEG_SQL}, u AS (SELECT DISTINCT ssrc, rtp_ts, seq FROM (SELECT ssrc, rtp_ts, seq FROM a UNION ALL SELECT ssrc, rtp_ts, seq FROM b)), d AS (SELECT ssrc, (seq - lag(seq) OVER (PARTITION BY ssrc ORDER BY rtp_ts, seq) + 65536) % 65536 AS delta FROM u) SELECT ssrc, count(*) AS packets, count(*) FILTER (delta > 1 AND delta < 32768) AS gaps, CAST(coalesce(sum(delta - 1) FILTER (delta > 1 AND delta < 32768), 0) AS BIGINT) AS lost FROM d GROUP BY ssrc")
def rtp_gaps(spark, sf_dir):
    """Sequence gaps of the merged legs, modulo 2**16."""
    a, b = legs(spark, sf_dir)
    u = a.select("ssrc", "rtp_ts", "seq").union(b.select("ssrc", "rtp_ts", "seq")).distinct()
    d = u.withColumn("delta", wrap16(F.col("seq") - F.lag("seq").over(Window.partitionBy("ssrc").orderBy("rtp_ts", "seq"))))
    gap = (F.col("delta") > 1) & (F.col("delta") < 32768)
    return d.groupBy("ssrc").agg(F.count("*").alias("packets"), F.count_if(gap).alias("gaps"), F.coalesce(F.sum(F.when(gap, F.col("delta") - 1)), F.lit(0)).cast("long").alias("lost"))


@query(f"WITH {LEG_SQL}, u AS (SELECT 'a' AS leg, * FROM a UNION ALL SELECT 'b', * FROM b) SELECT ssrc, count(*) AS received, count(DISTINCT (seq, rtp_ts)) AS packets, count(*) - count(DISTINCT (seq, rtp_ts)) AS duplicates FROM u GROUP BY ssrc")
def rtp_dedup(spark, sf_dir):
    """Duplicates by (sender, sequence, timestamp)."""
    a, b = legs(spark, sf_dir)
    each = a.select("ssrc", "seq", "rtp_ts").union(b.select("ssrc", "seq", "rtp_ts")).groupBy("ssrc", "seq", "rtp_ts").agg(F.count("*").alias("n"))
    return each.groupBy("ssrc").agg(F.sum("n").alias("received"), F.count("*").alias("packets"), (F.sum("n") - F.count("*")).alias("duplicates"))


@query(f"WITH {LEG_SQL} SELECT a.ssrc, a.seq, a.rtp_ts FROM a JOIN b ON a.ssrc = b.ssrc AND a.seq = b.seq AND a.rtp_ts = b.rtp_ts WHERE a.digest <> b.digest")
def rtp_payload_mismatch(spark, sf_dir):
    """The same packet with another payload on the other leg."""
    a, b = legs(spark, sf_dir)
    return a.join(b.select("ssrc", "seq", "rtp_ts", F.col("digest").alias("other")), ["ssrc", "seq", "rtp_ts"]).where("digest <> other").select("ssrc", "seq", "rtp_ts")


@query(
    """WITH a AS (SELECT event_id % 997 AS seq, list_distinct(list(event_id // 997)) AS ts FROM events WHERE event_id % 3 = 0 GROUP BY 1), b AS (SELECT event_id % 997 AS seq, list_distinct(list(event_id // 997)) AS ts FROM events WHERE event_id % 3 = 1 GROUP BY 1)
SELECT seq, len(a.ts) AS n_a, len(b.ts) AS n_b FROM a JOIN b USING (seq) WHERE len(list_intersect(a.ts, b.ts)) = 0"""
)
def rtp_identity_mismatch(spark, sf_dir):
    """Sequence numbers that both legs have with disjoint timestamps."""
    e = read(spark, sf_dir, "events")
    leg = lambda r, name: e.where(F.col("event_id") % 3 == r).groupBy((F.col("event_id") % 997).alias("seq")).agg(F.collect_set(F.floor(F.col("event_id") / 997)).alias(name))
    both = leg(0, "x").join(leg(1, "y"), "seq").where(~F.arrays_overlap("x", "y"))
    return both.select("seq", F.size("x").cast("long").alias("n_a"), F.size("y").cast("long").alias("n_b"))


@query(
    """SELECT 'customer.nation' AS edge, count(*) AS missing FROM customer WHERE c_nationkey IS NOT NULL AND c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 7 <> 3)
UNION ALL SELECT 'lineitem.orders', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 19 <> 0) UNION ALL SELECT 'labels.documents', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 5 <> 0)"""
)
def referential_integrity(spark, sf_dir):
    """References without a parent, per edge."""
    t = lambda n: read(spark, sf_dir, n)
    edges = [
        ("customer.nation", t("customer"), "c_nationkey", t("nation").where("n_nationkey % 7 <> 3"), "n_nationkey"),
        ("lineitem.orders", t("lineitem"), "l_orderkey", t("orders").where("o_orderkey % 19 <> 0"), "o_orderkey"),
        ("labels.documents", t("labels"), "doc_id", t("documents").where("doc_id % 5 <> 0"), "doc_id"),
    ]
    out = None
    for name, child, column, parent, key in edges:
        one = compare.missing_references(child, column, parent, key).agg(F.lit(name).alias("edge"), F.count("*").alias("missing"))
        out = one if out is None else out.union(one)
    return out


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def exists_semi(spark, sf_dir):
    """Parents that have a qualifying child."""
    big = read(spark, sf_dir, "orders").where("o_totalprice > 300000")
    return read(spark, sf_dir, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_missing(spark, sf_dir):
    """Parents without a child."""
    return read(spark, sf_dir, "customer").join(read(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_mktsegment")


@query("SELECT sha256(text) AS content, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicate_content(spark, sf_dir):
    """Content that occurs more than once."""
    d = read(spark, sf_dir, "documents").where("text IS NOT NULL").groupBy(F.sha2("text", 256).alias("content")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
    return d.where("n > 1")


@query("WITH w AS (SELECT conv_id, turn, turn - lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) <> 1 AS broken FROM conversations) SELECT conv_id, count(*) AS n, min(turn) AS first_no, max(turn) AS last_no, count(*) FILTER (broken) AS breaks FROM w GROUP BY conv_id")
def turn_contiguity(spark, sf_dir):
    """Turns that follow each other without a gap."""
    return sequence.contiguity(read(spark, sf_dir, "conversations"), ["conv_id"], "turn")


@query(
    """WITH r AS (SELECT source, doc_id::DOUBLE AS s, doc_id + n_chars / 100 AS e FROM documents),
o AS (SELECT source, s, e, CASE WHEN s <= max(e) OVER (PARTITION BY source ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 0.5 THEN 0 ELSE 1 END AS new FROM r),
g AS (SELECT *, sum(new) OVER (PARTITION BY source ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS merged FROM o)
SELECT source, round(min(s), 6) AS range_start, round(max(e), 6) AS range_end, count(*) AS parts FROM g GROUP BY source, merged"""
)
def merged_ranges(spark, sf_dir):
    """Overlapping and touching ranges merged."""
    r = read(spark, sf_dir, "documents").select("source", F.col("doc_id").cast("double").alias("s"), (F.col("doc_id") + F.col("n_chars") / 100).alias("e"))
    return sequence.merge_ranges(r, ["source"], "s", "e", 0.5).select("source", rounded(F.col("range_start")).alias("range_start"), rounded(F.col("range_end")).alias("range_end"), "parts")


@query(
    """WITH a AS (SELECT l_orderkey AS k, list(l_partkey ORDER BY l_linenumber, l_partkey) AS x FROM lineitem GROUP BY 1), b AS (SELECT l_orderkey AS k, list(l_partkey ORDER BY l_linenumber, l_partkey) AS y FROM lineitem WHERE l_linenumber % 3 <> 0 GROUP BY 1)
SELECT a.k AS l_orderkey, len(list_filter(x, lambda v: list_contains(y, v))) AS common, list_filter(x, lambda v: list_contains(y, v)) = list_filter(y, lambda v: list_contains(x, v)) AS same_order FROM a JOIN b ON a.k = b.k"""
)
def ordered_intersection(spark, sf_dir):
    """What two ordered lists share, and whether in the same order."""
    l = read(spark, sf_dir, "lineitem")  # noqa: E741
    lists = lambda df, name: df.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda s: s["l_partkey"]).alias(name))
    both = lists(l, "x").join(lists(l.where("l_linenumber % 3 <> 0"), "y"), "l_orderkey")
    p, q = F.filter("x", lambda v: F.array_contains("y", v)), F.filter("y", lambda v: F.array_contains("x", v))
    return both.select("l_orderkey", F.size(p).cast("long").alias("common"), (p == q).alias("same_order"))


@query(
    """WITH t AS (SELECT o_orderkey AS id, sha256(o_custkey::VARCHAR) AS source, o_orderpriority AS profile, o_totalprice AS lufs, o_orderdate AS recorded FROM orders WHERE o_orderkey % 2 = 0 QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) = 1),
c AS (SELECT o_orderkey AS id, sha256(o_custkey::VARCHAR) AS source, o_orderpriority AS profile, o_totalprice AS lufs, o_orderdate AS recorded FROM orders WHERE o_orderkey % 2 = 1),
u AS (SELECT *, 0 AS new FROM t UNION ALL SELECT *, 1 FROM c), r AS (SELECT *, min(id) FILTER (new = 0) OVER (PARTITION BY source, profile) AS old, row_number() OVER (PARTITION BY source, profile ORDER BY new DESC, recorded DESC, id DESC) AS n FROM u)
SELECT coalesce(old, id) AS id, source, profile, lufs FROM r WHERE n = 1"""
)
def catalogue_upsert(spark, sf_dir):
    """Upsert on (source digest, profile); identifiers stay."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", F.sha2(F.col("o_custkey").cast("string"), 256).alias("source"), F.col("o_orderpriority").alias("profile"), F.col("o_totalprice").alias("lufs"), F.struct("o_orderdate", "o_orderkey").alias("recorded"))
    first = F.row_number().over(Window.partitionBy("o_custkey", "profile").orderBy("id"))
    table = o.where("id % 2 = 0").withColumn("n", first).where("n = 1").drop("n", "o_custkey")
    return compare.upsert(table, o.where("id % 2 = 1").drop("o_custkey"), ["source", "profile"], "recorded").select("id", "source", "profile", "lufs")


@query(
    """WITH c AS (SELECT sha256(text) AS h, doc_id % 6 <> 0 AS valid FROM documents WHERE doc_id % 4 <> 0 QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1), r AS (SELECT doc_id, sha256(text) AS h FROM documents)
SELECT doc_id, CASE WHEN valid THEN 'hit' WHEN valid IS NOT NULL THEN 'repaired' ELSE 'stored' END AS disposition FROM r LEFT JOIN c USING (h)"""
)
def content_cache_probe(spark, sf_dir):
    """What a content-addressed cache answers."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    first = F.row_number().over(Window.partitionBy("h").orderBy("doc_id"))
    cache = d.where("doc_id % 4 <> 0").withColumn("n", first).where("n = 1")
    return compare.probe_cache(d, cache, ["h"], F.col("doc_id") % 6 != 0).select("doc_id", "disposition")


@query(
    """WITH e AS (SELECT o_orderkey AS id, o_orderdate::DATE AS day, CAST(floor(o_totalprice) AS BIGINT) AS size FROM orders), x AS (SELECT *, sum(size) OVER () AS total FROM e),
k AS (SELECT *, coalesce(sum(size) OVER (ORDER BY day, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM x WHERE id % 97 <> 0) SELECT id, day, size FROM k WHERE total - ahead > 1000000000"""
)
def lru_evict(spark, sf_dir):
    """O3: oldest entries leave until the rest fits; some are protected."""
    e = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("day"), F.floor("o_totalprice").cast("long").alias("size"))
    return compare.evict(e, "size", ["day", "id"], 1_000_000_000, F.col("id") % 97 == 0)


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL")
def json_evidence_extract(spark, sf_dir):
    """2.13: fields of embedded JSON."""
    return read(spark, sf_dir, "events").groupBy("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, to_base64(unhex(sha1(text))) AS sha1_base64 FROM documents WHERE text IS NOT NULL")
def content_hashes(spark, sf_dir):
    """Digests in the forms that packing lists use."""
    d = read(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select("doc_id", F.md5("text").alias("md5"), F.sha1("text").alias("sha1"), F.base64(F.unhex(F.sha1("text"))).alias("sha1_base64"))


@query("SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '://[^/@]*@', '://') AS uri FROM pages")
def redacted_uris(spark, sf_dir):
    """Locations without user information, query and fragment."""
    return read(spark, sf_dir, "pages").select("page_id", redact_uri(F.col("url")).alias("uri"))


@query(
    """SELECT o_orderkey, 'seg-' || lpad((o_orderkey % 100000)::VARCHAR, 5, '0') || '-' || (o_custkey * 48)::VARCHAR || '.m4s' AS uri, (o_orderkey % 3) * 3600 + (o_orderkey % 60) * 60 + (o_orderkey % 7) + 0.5::DOUBLE AS seconds FROM orders"""
)
def template_and_duration(spark, sf_dir):
    """Segment names from a template, ISO durations to seconds."""
    o = read(spark, sf_dir, "orders")
    uri = expand_template(F.lit("seg-$Number%05d$-$Time$.m4s"), {"Number": F.col("o_orderkey") % 100000, "Time": F.col("o_custkey") * 48})
    text = F.concat(F.lit("PT"), (F.col("o_orderkey") % 3).cast("string"), F.lit("H"), (F.col("o_orderkey") % 60).cast("string"), F.lit("M"), (F.col("o_orderkey") % 7).cast("string"), F.lit(".5S"))
    return o.select("o_orderkey", uri.alias("uri"), iso_duration_seconds(text).alias("seconds"))


@query(
    """WITH s AS (SELECT l_orderkey AS rep, l_linenumber AS n, l_quantity::BIGINT * 100 AS d, l_suppkey % 4 AS r, l_partkey AS part, l_suppkey AS supp FROM lineitem), x AS (SELECT rep, n, d, part, supp, unnest(range(r + 1)) AS k FROM s)
SELECT rep, row_number() OVER w AS number, CAST(sum(d) OVER (PARTITION BY rep ORDER BY n, part, supp, d, k ROWS UNBOUNDED PRECEDING) - d AS BIGINT) AS start_time, d AS duration FROM x WINDOW w AS (PARTITION BY rep ORDER BY n, part, supp, d, k)"""
)
def timeline_expansion(spark, sf_dir):
    """Segment timelines with repeats to segments with start times."""
    s = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("rep"), F.col("l_linenumber").alias("n"), (F.col("l_quantity").cast("long") * 100).alias("d"), (F.col("l_suppkey") % 4).alias("r"), "l_partkey", "l_suppkey")
    x = s.select("rep", "n", "d", "l_partkey", "l_suppkey", F.explode(F.sequence(F.lit(0).cast("long"), F.col("r"))).alias("k"))
    w = Window.partitionBy("rep").orderBy("n", "l_partkey", "l_suppkey", "d", "k")
    return x.select("rep", F.row_number().over(w).cast("long").alias("number"), (F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("d")).alias("start_time"), F.col("d").alias("duration"))


@query(
    """WITH f AS (SELECT l_orderkey AS segment, l_linenumber AS track, (l_quantity::BIGINT * 2) // gcd(l_quantity::BIGINT * 2, l_linenumber * 4) AS num, (l_linenumber * 4) // gcd(l_quantity::BIGINT * 2, l_linenumber * 4) AS den FROM lineitem)
SELECT segment, count(*) AS tracks, count(DISTINCT (num, den)) AS durations FROM f GROUP BY segment"""
)
def rational_durations(spark, sf_dir):
    """P16, 2.11: reduced fractions compared exactly per segment."""
    a, b = F.col("l_quantity").cast("long") * 2, (F.col("l_linenumber") * 4).cast("long")
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.when(s["b"] != 0, s["a"] % F.when(s["b"] != 0, s["b"]).otherwise(1)).otherwise(0).alias("b")))
    gcd = F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.struct(a.alias("a"), b.alias("b")), step, lambda s: s["a"])
    f = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("segment"), a.alias("x"), b.alias("y"), gcd.alias("g"))
    f = f.select("segment", F.struct((F.col("x") / F.col("g")).cast("long"), (F.col("y") / F.col("g")).cast("long")).alias("q"))
    return f.groupBy("segment").agg(F.count("*").alias("tracks"), F.count_distinct("q").alias("durations"))


@query(
    """WITH s AS (SELECT l_orderkey AS playlist, max(round(l_extendedprice / 10000)) AS longest, count(*) AS segments FROM lineitem GROUP BY 1) SELECT playlist, segments, longest, longest <= 7 AS target_ok FROM s"""
)
def playlist_target_duration(spark, sf_dir):
    """2.11: rounded segment durations against the playlist's target."""
    s = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("playlist")).agg(F.max(F.round(F.col("l_extendedprice") / 10000)).alias("longest"), F.count("*").alias("segments"))
    return s.select("playlist", "segments", "longest", (F.col("longest") <= 7).alias("target_ok"))


@query(
    """WITH l AS (SELECT l_orderkey AS playlist, CAST(l_quantity AS INTEGER) AS q, l_returnflag = 'R' AS independent, l_linenumber % 3 = 0 AS ends, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_returnflag) AS n FROM lineitem),
s AS (SELECT *, sum(ends::INT) OVER (PARTITION BY playlist ORDER BY n) - ends::INT AS seg, sum(ends::INT) OVER (PARTITION BY playlist) AS segs FROM l), f AS (SELECT *, lead(seg) OVER (PARTITION BY playlist ORDER BY n) AS following FROM s),
p AS (SELECT playlist, ends, q, q <= 45 AND (q >= 38.25 OR independent OR (seg < segs AND (following IS NULL OR following <> seg))) AS good FROM f)
SELECT playlist, 'AQ-HLS-PART-DURATION' AS rule_id, count(*) AS checks, count(*) FILTER (NOT good) AS failed FROM p GROUP BY 1
UNION ALL SELECT playlist, 'AQ-HLS-SEGMENTS', 1, CASE WHEN bool_or(ends) THEN 0 ELSE 1 END FROM p GROUP BY 1
UNION ALL SELECT playlist, 'AQ-HLS-TARGET-DURATION', 1, CASE WHEN coalesce(max(q) FILTER (ends), 0) <= 45 THEN 0 ELSE 1 END FROM p GROUP BY 1"""
)
def playlist_part_rules(spark, sf_dir):
    """2.11: an order as a low-latency playlist, a part a line; rules on parts and segments from its text."""
    quantity = F.col("l_quantity").cast("int").cast("string")
    part = F.concat(F.lit("#EXT-X-PART:DURATION="), quantity, F.lit(',URI="p.m4s"'), F.when(F.col("l_returnflag") == "R", ",INDEPENDENT=YES").otherwise(""))
    rows = F.concat(part, F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("\n#EXTINF:"), quantity, F.lit(",\ns.m4s"))).otherwise(""))
    parts = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_returnflag", rows.alias("rows"))))
    head = '#EXTM3U\n#EXT-X-VERSION:9\n#EXT-X-TARGETDURATION:45\n#EXT-X-PART-INF:PART-TARGET=45\n#EXT-X-MAP:URI="i.mp4"\n'
    text = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("path")).agg(F.concat(F.lit(head), F.array_join(F.transform(parts, lambda p: p["rows"]), "\n")).alias("text"))
    found = playlist_tags.findings(playlist_tags.lines_of(text)).where(F.col("rule_id").isin("AQ-HLS-PART-DURATION", "AQ-HLS-SEGMENTS", "AQ-HLS-TARGET-DURATION"))
    return found.groupBy(F.col("path").alias("playlist"), "rule_id").agg(F.count("*").alias("checks"), F.count_if(~F.col("passed")).alias("failed"))


@query(
    """SELECT a.l_orderkey AS track, a.l_linenumber AS first_event, b.l_linenumber AS second_event, CAST(least(epoch(a.l_shipdate) + a.l_quantity * 86400, epoch(b.l_shipdate) + b.l_quantity * 86400) - greatest(epoch(a.l_shipdate), epoch(b.l_shipdate)) AS BIGINT) AS overlap
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND epoch(a.l_shipdate) < epoch(b.l_shipdate) + b.l_quantity * 86400 AND epoch(b.l_shipdate) < epoch(a.l_shipdate) + a.l_quantity * 86400"""
)
def event_overlaps(spark, sf_dir):
    """2.11: overlapping events of a track, an interval join within it."""
    begin = F.unix_seconds(F.col("l_shipdate").cast("timestamp"))
    e = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("track"), F.col("l_linenumber").alias("n"), begin.alias("s"), (begin + F.col("l_quantity") * 86400).alias("e"))
    f = e.toDF("track", "m", "s2", "e2")
    both = e.join(f, "track").where("n < m AND s < e2 AND s2 < e")
    return both.select("track", F.col("n").alias("first_event"), F.col("m").alias("second_event"), (F.least("e", "e2") - F.greatest("s", "s2")).cast("long").alias("overlap"))


@query(
    """WITH a AS (SELECT l_orderkey AS manifest, l_partkey AS part, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS position, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
b AS (SELECT l_orderkey AS manifest, l_suppkey::VARCHAR AS audit, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey::VARCHAR) AS position, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem WHERE l_returnflag <> 'R'),
s AS (SELECT DISTINCT manifest, n FROM b)
SELECT a.manifest, a.position, a.part, CASE WHEN a.n = s.n THEN b.audit END AS audit, coalesce(a.n <> s.n, false) AS mismatched FROM a LEFT JOIN s ON a.manifest = s.manifest LEFT JOIN b ON a.manifest = b.manifest AND a.position = b.position"""
)
def audits_by_position(spark, sf_dir):
    """Audits of the lines that were not returned, by their place among an order's lines; other numbers of audits than of lines are mismatches."""
    l = read(spark, sf_dir, "lineitem")  # noqa: E741
    reports = l.select(F.col("l_orderkey").alias("manifest"), F.col("l_partkey").alias("part"))
    audits = l.where("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("manifest"), F.col("l_suppkey").cast("string").alias("audit"))
    return compare.zip_audits(reports, audits, "manifest", "part", "audit").select("manifest", F.col("position").cast("long").alias("position"), "part", "audit", "mismatched")
