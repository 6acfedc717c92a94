"""Evidence operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dims
from ..functions.units import rounded
from ..operators import evidence
from .mappings import MEASURE_SQL, PAIR_SQL, STREAM_SQL, measurements, pairs, read, stream
from .registry import query


@query(f"WITH {MEASURE_SQL}, p(preset, target, ceiling) AS {dims.values(dims.PRESETS)} SELECT preset, count(*) AS assets, count(*) FILTER (target - integrated_lufs > ceiling - true_peak_dbtp) AS peak_limited, round(avg(least(target - integrated_lufs, ceiling - true_peak_dbtp)), 6) AS mean_gain_db FROM m, p GROUP BY preset")
def preset_gains(spark, sf_dir):
    """What each preset would do to the assets."""
    p = F.broadcast(spark.createDataFrame(dims.PRESETS, "preset string, target double, ceiling double"))
    x = measurements(spark, sf_dir).crossJoin(p).withColumns({"want": F.col("target") - F.col("integrated_lufs"), "room": F.col("ceiling") - F.col("true_peak_dbtp")})
    return x.groupBy("preset").agg(F.count("*").alias("assets"), F.count_if(F.col("want") > F.col("room")).alias("peak_limited"), rounded(F.avg(F.least("want", "room"))).alias("mean_gain_db"))


@query(
    f"""WITH {MEASURE_SQL}, x AS (SELECT *, CASE WHEN asset % 3 <> 0 THEN -20 - asset % 9 END AS dialnorm, CASE WHEN asset % 4 <> 0 THEN integrated_lufs + (asset % 25) / 10 - 1.1 END AS ref_lufs, true_peak_dbtp + 0.3 AS ref_peak, duration_seconds + CASE WHEN asset % 6 = 0 THEN 0.5 ELSE 0 END AS ref_seconds FROM m)
SELECT asset, CASE WHEN dialogue_lufs IS NOT NULL THEN 'dialogue' ELSE 'programme' END AS loudness_basis, round(coalesce(dialogue_lufs, integrated_lufs) - dialnorm, 6) + 0 AS dialnorm_deviation, abs(round(coalesce(dialogue_lufs, integrated_lufs) - dialnorm, 9)) <= 1 AS dialnorm_pass,
CASE WHEN ref_lufs IS NOT NULL THEN abs(round(integrated_lufs - ref_lufs, 9)) <= 1 AND duration_seconds = ref_seconds END AS roundtrip_pass FROM x"""
)
def codec_delivery(spark, sf_dir):
    """Codec metadata and round trip."""
    m = measurements(spark, sf_dir).withColumns({
        "dialnorm": F.when(F.col("asset") % 3 != 0, -20 - F.col("asset") % 9), "reference_lufs": F.when(F.col("asset") % 4 != 0, F.col("integrated_lufs") + F.col("asset") % 25 / 10 - 1.1), "reference_peak": F.col("true_peak_dbtp") + 0.3,
        "reference_seconds": F.col("duration_seconds") + F.when(F.col("asset") % 6 == 0, 0.5).otherwise(0.0), "sample_rate": F.lit(48000),
    })
    m = m.withColumns({"reference_lufs": F.col("integrated_lufs") - F.round(F.col("integrated_lufs") - F.col("reference_lufs"), 9), "dialogue_lufs": F.round("dialogue_lufs", 9), "integrated_lufs": F.round("integrated_lufs", 9)})
    q = evidence.codec_qc(m.withColumn("reference_lufs", F.round("reference_lufs", 9)), 1.0 + 1e-9)
    return q.select("asset", "loudness_basis", rounded(F.col("dialnorm_deviation")).alias("dialnorm_deviation"), "dialnorm_pass", "roundtrip_pass")


@query(
    f"""WITH {MEASURE_SQL} SELECT asset, round(0.3 * least(greatest(0, least(1, (integrated_lufs + 55) / 30)) + greatest(0, least(1, (integrated_lufs + 45 - 3) / 15)), 1) + 0.2 * (asset % 11) / 10
+ 0.2 * greatest(0, least(1, (lra / 20 - 0.15) / 0.55)) + 0.1 * greatest(0, least(1, ((asset % 40) / 100) / 0.005)) * greatest(0, least(1, (0.3 - (asset % 40) / 100) / 0.1)) + 0.1 * greatest(0, least(1, lra / 6)) + 0.1 * greatest(0, least(1, ((asset % 7) / 7 - 0.1) / 0.65)), 6) AS confidence FROM m"""
)
def dialogue_confidence(spark, sf_dir):
    """The detector's score from its features."""
    a, lra = F.col("asset"), F.col("lra")
    score = evidence.dialogue_confidence(F.col("integrated_lufs"), F.lit(-45.0), a % 11 / 10, a % 40 / 100, lra / 20, lra, a % 7 / 7)
    return measurements(spark, sf_dir).select("asset", rounded(score).alias("confidence"))


@query(
    """WITH k(kind, i, c, s) AS (VALUES ('noise', 1, 0.05::DOUBLE, 0.0::DOUBLE), ('pop', 3, 0.1, -0.1), ('dropout', 5, 0.0, 0.1)), v AS (SELECT vec_id, label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame FROM embeddings),
h AS (SELECT label AS asset, kind, frame, embedding[i]::DOUBLE AS confidence, embedding[i + 1]::DOUBLE AS severity FROM v, k WHERE embedding[i]::DOUBLE >= c AND embedding[i + 1]::DOUBLE >= s), r AS (SELECT *, frame - row_number() OVER (PARTITION BY asset, kind ORDER BY frame) AS run FROM h)
SELECT asset, kind, round(min(frame) * 0.25::DOUBLE, 6) AS start_seconds, round((max(frame) + 1) * 0.25::DOUBLE, 6) AS end_seconds, round(max(confidence), 6) AS confidence, round(max(severity), 6) AS severity FROM r GROUP BY asset, kind, run"""
)
def score_events(spark, sf_dir):
    """Model scores to events."""
    w = Window.partitionBy("label").orderBy("vec_id")
    v = read(spark, sf_dir, "embeddings").select(F.col("label").alias("asset"), (F.row_number().over(w) - 1).alias("frame"), F.transform("embedding", lambda x: x.cast("double")).alias("scores"))
    e = evidence.score_events(v, 0.25, {"noise": (0.05, 0.0), "pop": (0.1, -0.1), "dropout": (0.0, 0.1)})
    return e.select("asset", "kind", *[rounded(F.col(c)).alias(c) for c in ("start_seconds", "end_seconds", "confidence", "severity")])


@query(
    """WITH e AS (SELECT user_id AS asset, event_type AS kind, epoch_us(ts) / 1e6 AS s, epoch_us(ts) / 1e6 + value * 100 AS e, value / 500 AS confidence FROM events), o AS (SELECT *, lag(e) OVER (PARTITION BY asset, kind ORDER BY s, e) > s AS ov FROM e)
SELECT asset, kind, count(*) AS found, count(*) FILTER (confidence >= 0.5) AS selected, round(coalesce(sum(e - s) FILTER (confidence >= 0.5), 0), 3) AS selected_seconds, NOT bool_or(coalesce(ov, false)) AS in_order FROM o GROUP BY asset, kind"""
)
def provider_audit(spark, sf_dir):
    """Audit of an external detector's segments."""
    s = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("asset"), F.col("event_type").alias("kind"), s.alias("start_seconds"), (s + F.col("value") * 100).alias("end_seconds"), (F.col("value") / 500).alias("confidence"))
    return evidence.provider_audit(e, 0.5).withColumn("selected_seconds", rounded(F.col("selected_seconds"), 3))


@query(
    """WITH s AS (SELECT o_orderkey AS asset, CASE WHEN o_orderkey % 3 = 0 THEN 'pending' ELSE 'completed' END AS status, sha256(o_orderkey::VARCHAR) AS want FROM orders), f AS (SELECT o_orderkey AS asset, sha256(CASE WHEN o_orderkey % 10 = 0 THEN 'x' ELSE o_orderkey::VARCHAR END) AS actual FROM orders WHERE o_orderkey % 7 <> 0)
SELECT asset, status, CASE WHEN status = 'completed' AND actual IS NOT NULL AND actual <> want THEN 'error' WHEN status = 'completed' AND actual IS NOT NULL THEN 'skip' ELSE 'run' END AS action FROM s LEFT JOIN f USING (asset)"""
)
def batch_resume(spark, sf_dir):
    """U4: actions of a resumed batch."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("asset"))
    text = F.col("asset").cast("string")
    state = o.select("asset", F.when(F.col("asset") % 3 == 0, "pending").otherwise("completed").alias("status"), F.sha2(text, 256).alias("output_sha256"))
    outputs = o.where("asset % 7 <> 0").select("asset", F.sha2(F.when(F.col("asset") % 10 == 0, "x").otherwise(text), 256).alias("sha256"))
    return evidence.resume(state, outputs)


@query(
    """WITH r AS (SELECT l_orderkey AS job, l_partkey::VARCHAR AS asset, l_discount < 0.1 AS ok, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem)
SELECT job, CAST(row_number() OVER (PARTITION BY job ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS sequence, CASE WHEN ok THEN 'asset_completed' ELSE 'asset_failed' END AS event, asset FROM r
UNION ALL SELECT DISTINCT job, 0, 'job_started', NULL FROM r UNION ALL SELECT job, CAST(count(*) + 1 AS INT), 'job_completed', NULL FROM r GROUP BY job HAVING bool_and(ok)"""
)
def batch_lifecycle(spark, sf_dir):
    """Progress events of jobs."""
    r = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job"), F.col("l_partkey").alias("asset"), (F.col("l_discount") < 0.1).alias("ok"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("place"))
    return evidence.lifecycle(r, "job", "place")


@query("SELECT event_id, CASE WHEN user_id % 4 = 0 THEN 1 ELSE CAST(user_id % 4 AS INT) END AS from_version, (CASE WHEN user_id % 4 = 0 THEN 1 ELSE user_id % 4 END) < 3 AS changed, 3 AS version, 'kept' AS extension, CASE WHEN (CASE WHEN user_id % 4 = 0 THEN 1 ELSE user_id % 4 END) < 3 THEN 'baseband' END AS layer FROM events")
def manifest_migration(spark, sf_dir):
    """Documents of older versions brought to the current one."""
    e = read(spark, sf_dir, "events")
    doc = F.when(F.col("user_id") % 4 == 0, F.lit('{"extension":"kept"}')).otherwise(F.format_string('{"version":"%d","extension":"kept"}', F.col("user_id") % 4))
    m = evidence.migrate(e.select("event_id", doc.alias("document")))
    at = lambda k: F.element_at("migrated", F.lit(k))
    return m.select("event_id", "from_version", "changed", at("version").cast("int").alias("version"), at("extension").alias("extension"), at("layer").alias("layer"))


@query(
    f"""WITH {MEASURE_SQL} SELECT asset, concat_ws(',', CASE WHEN NOT (integrated_lufs BETWEEN -29 AND -15) THEN 'loudness' END, CASE WHEN NOT coalesce(dialogue_lufs < -20, false) THEN 'dialogue' END, CASE WHEN NOT (channels = 2) THEN 'channels' END) AS violated FROM m
WHERE NOT (integrated_lufs BETWEEN -29 AND -15) OR NOT coalesce(dialogue_lufs < -20, false) OR channels <> 2"""
)
def constraint_checks(spark, sf_dir):
    """Rows that break a constraint of the catalogue."""
    checks = {"loudness": F.col("integrated_lufs").between(-29, -15), "dialogue": F.col("dialogue_lufs") < -20, "channels": F.col("channels") == 2}
    v = evidence.violated(measurements(spark, sf_dir), checks)
    return v.where(F.size("violated") > 0).select("asset", F.array_join("violated", ",").alias("violated"))


@query(
    """WITH s AS (SELECT o_custkey AS subject, o_orderkey AS snapshot, o_orderstatus AS digest, o_orderdate AS published FROM orders), w AS (SELECT *, lag(digest) OVER p AS pd, lag(published) OVER p AS pp FROM s WINDOW p AS (PARTITION BY subject ORDER BY snapshot))
SELECT subject, snapshot, digest <> pd AS changed, published > pp AS advances FROM w WHERE pd IS NOT NULL"""
)
def snapshot_updates(spark, sf_dir):
    """Successive snapshots of a document."""
    s = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("snapshot"), F.col("o_orderstatus").alias("digest"), F.col("o_orderdate").alias("published"))
    return evidence.changed_snapshots(s, "subject", "snapshot", "digest")


@query(f"WITH {STREAM_SQL} SELECT asset, frame // 8 AS interval, round(avg(greatest(0, 20 * log10(greatest(abs(sample), 1e-9) / 0.5))), 6) AS mean_db, round(max(greatest(0, 20 * log10(greatest(abs(sample), 1e-9) / 0.5))), 6) AS max_db, count(*) AS n FROM f GROUP BY asset, frame // 8")
def limiter_statistics(spark, sf_dir):
    """Gain reduction per interval."""
    reduction = F.greatest(F.lit(0.0), 20 * F.log10(F.greatest(F.abs("sample"), F.lit(1e-9)) / 0.5))
    out = evidence.limiter_intervals(stream(spark, sf_dir).select("asset", "frame", reduction.alias("reduction")), 8)
    return out.select("asset", "interval", rounded(F.col("mean_db")).alias("mean_db"), rounded(F.col("max_db")).alias("max_db"), "n")


@query(f"WITH {STREAM_SQL} SELECT asset, frame, round(sum(energy) OVER (PARTITION BY asset ORDER BY frame ROWS UNBOUNDED PRECEDING), 6) AS cumulative FROM f")
def prefix_energy(spark, sf_dir):
    """Prefix sums, from which any window's energy is a difference."""
    w = Window.partitionBy("asset").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    return stream(spark, sf_dir).select("asset", "frame", rounded(F.sum("energy").over(w)).alias("cumulative"))


@query(f"WITH {STREAM_SQL} SELECT asset, count(*) FILTER (abs(sample) > 0.9) AS near_full_scale, count(*) FILTER (sample > 0.9) AS positive, count(*) FILTER (sample < -0.9) AS negative FROM f GROUP BY asset")
def full_scale_counts(spark, sf_dir):
    """Strict counts beyond a threshold."""
    return stream(spark, sf_dir).groupBy("asset").agg(F.count_if(F.abs("sample") > 0.9).alias("near_full_scale"), F.count_if(F.col("sample") > 0.9).alias("positive"), F.count_if(F.col("sample") < -0.9).alias("negative"))


@query("SELECT event_type, count(DISTINCT user_id) AS senders, count(DISTINCT props) AS payloads, array_to_string(list_sort(list(DISTINCT user_id % 5)), ',') AS groups FROM events GROUP BY event_type")
def distinct_sets(spark, sf_dir):
    """Cardinalities and small sets."""
    e = read(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count_distinct("user_id").alias("senders"), F.count_distinct("props").alias("payloads"), F.array_join(F.array_sort(F.collect_set(F.col("user_id") % 5)), ",").alias("groups"))


@query(
    f"""WITH {PAIR_SQL}, e AS (SELECT pair, unnest(l) AS x, unnest(r) AS y FROM p)
SELECT pair, round(sqrt(avg(x * x)), 6) AS left_rms, round(sqrt(avg(y * y)), 6) AS right_rms, round(avg(x + y) / 2, 6) + 0 AS mid_dc, round(CASE WHEN sum(x * x + y * y) > 0 THEN sum((x + y) * (x + y)) / (2 * sum(x * x + y * y)) ELSE 0 END, 6) AS mid_ratio FROM e GROUP BY pair"""
)
def stereo_levels(spark, sf_dir):
    """Levels, DC and mid share of stereo pairs."""
    e = pairs(spark, sf_dir).select("pair", F.explode(F.arrays_zip("l", "r")).alias("z")).select("pair", F.col("z.l").alias("x"), F.col("z.r").alias("y"))
    x, y = F.col("x"), F.col("y")
    s = e.groupBy("pair").agg(F.avg(x * x).alias("xx"), F.avg(y * y).alias("yy"), F.avg(x + y).alias("m"), F.sum((x + y) * (x + y)).alias("mm"), F.sum(x * x + y * y).alias("all"))
    return s.select("pair", rounded(F.sqrt("xx")).alias("left_rms"), rounded(F.sqrt("yy")).alias("right_rms"), rounded(F.col("m") / 2).alias("mid_dc"), rounded(F.when(F.col("all") > 0, F.col("mm") / (2 * F.when(F.col("all") > 0, F.col("all")))).otherwise(0.0)).alias("mid_ratio"))


@query(
    """WITH l AS (SELECT l_suppkey AS asset, count(*) AS n, max(CASE l_returnflag WHEN 'A' THEN 2 WHEN 'R' THEN 1 ELSE 0 END) AS worst FROM lineitem GROUP BY 1)
SELECT asset, n, CASE worst WHEN 2 THEN 'error' WHEN 1 THEN 'warning' ELSE 'note' END AS severity, worst < 2 AS passed FROM l"""
)
def severity_rollup(spark, sf_dir):
    """2.11: errors fail an audit, warnings only count."""
    rank = F.when(F.col("l_returnflag") == "A", 2).when(F.col("l_returnflag") == "R", 1).otherwise(0)
    r = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("asset")).agg(F.count("*").alias("n"), F.max(rank).alias("worst"))
    return r.select("asset", "n", F.when(F.col("worst") == 2, "error").when(F.col("worst") == 1, "warning").otherwise("note").alias("severity"), (F.col("worst") < 2).alias("passed"))


@query(
    """WITH p AS (SELECT l_orderkey AS playlist, l_linenumber AS part, l_quantity / 10 AS d, l_returnflag = 'R' AS independent, l_partkey, l_suppkey, l_extendedprice FROM lineitem), n AS (SELECT *, lead(part) OVER (PARTITION BY playlist ORDER BY part, l_partkey, l_suppkey, l_extendedprice) IS NULL AS last_part FROM p)
SELECT playlist, count(*) AS parts, count(*) FILTER (d > 4) AS too_long, count(*) FILTER (d < 0.85 * 4 AND NOT independent AND NOT last_part) AS too_short FROM n GROUP BY playlist"""
)
def partial_segments(spark, sf_dir):
    """2.11: low-latency parts against their target; independent and last ones may be shorter."""
    w = Window.partitionBy("playlist").orderBy("part", "l_partkey", "l_suppkey", "l_extendedprice")
    p = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("playlist"), F.col("l_linenumber").alias("part"), (F.col("l_quantity") / 10).alias("d"), (F.col("l_returnflag") == "R").alias("independent"), "l_partkey", "l_suppkey", "l_extendedprice")
    p = p.withColumn("last_part", F.lead("part").over(w).isNull())
    short = (F.col("d") < 0.85 * 4) & ~F.col("independent") & ~F.col("last_part")
    return p.groupBy("playlist").agg(F.count("*").alias("parts"), F.count_if(F.col("d") > 4).alias("too_long"), F.count_if(short).alias("too_short"))


@query(
    """WITH s AS (SELECT l_suppkey AS track, l_orderkey AS fragment, CAST(l_quantity * 90000 AS BIGINT) + l_orderkey * 4000000 AS pts, l_linenumber, l_partkey FROM lineitem), w AS (SELECT track, (pts % 8589934592 - lag(pts % 8589934592) OVER (PARTITION BY track ORDER BY fragment, l_linenumber, l_partkey, pts) + 8589934592) % 8589934592 / 90000.0 AS delta FROM s)
SELECT track, count(delta) AS steps, count(*) FILTER (delta > 0 AND delta <= 10000) AS forward, round(min(delta), 4) AS shortest FROM w GROUP BY track"""
)
def timestamp_continuity(spark, sf_dir):
    """2.11: 33-bit presentation times across segments, modulo their wrap."""
    wrap = F.lit(8589934592)
    s = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("track"), F.col("l_orderkey").alias("fragment"), ((F.col("l_quantity") * 90000).cast("long") + F.col("l_orderkey") * 4000000).alias("pts"), "l_linenumber", "l_partkey")
    w = Window.partitionBy("track").orderBy("fragment", "l_linenumber", "l_partkey", "pts")
    s = s.withColumn("delta", F.pmod(F.pmod("pts", wrap) - F.lag(F.pmod("pts", wrap)).over(w), wrap) / 90000.0)
    return s.groupBy("track").agg(F.count("delta").alias("steps"), F.count_if((F.col("delta") > 0) & (F.col("delta") <= 10000)).alias("forward"), rounded(F.min("delta"), 4).alias("shortest"))
