"""Loudness, peaks, timelines and dialogue over the mapped streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dims
from ..functions.units import ABSOLUTE_GATE, channel_weight, lufs, rounded
from ..operators import measure
from .mappings import MEASURE_SQL, STREAM_SQL, VECTOR_SQL, measurements, read, stream, vectors
from .registry import query

GATE = f"{ABSOLUTE_GATE!r}::DOUBLE"
BLOCK_SQL = f"""{STREAM_SQL},
b AS (SELECT asset, frame, avg(energy) OVER w AS block FROM f WINDOW w AS (PARTITION BY asset ORDER BY frame ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) QUALIFY count(*) OVER w = 4)"""
SHORT_SQL = f"""{STREAM_SQL},
b AS (SELECT asset, frame, avg(energy) OVER w AS block FROM f WINDOW w AS (PARTITION BY asset ORDER BY frame ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) QUALIFY count(*) OVER w = 30)"""


def gate_sql(keys: str) -> str:
    return f"""g AS (SELECT {keys}, count(*) AS n_blocks, avg(block) FILTER (block >= {GATE}) AS fm FROM b GROUP BY {keys}),
i AS (SELECT {keys}, n_blocks, count(*) FILTER (block >= greatest({GATE}, fm / 10)) AS n_gated, coalesce(avg(block) FILTER (block >= greatest({GATE}, fm / 10)), any_value(fm), 0) AS ms
      FROM b JOIN g USING ({keys}) GROUP BY {keys}, n_blocks)"""


def lufs_sql(ms: str) -> str:
    return f"CASE WHEN {ms} > 0 THEN round(-0.691 + 10 * log10({ms}), 6) END"


def db_sql(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN round(20 * log10({x}), 6) END"


@query(f"WITH {BLOCK_SQL}, {gate_sql('asset')} SELECT asset, n_blocks, n_gated, {lufs_sql('ms')} AS integrated_lufs FROM i")
def integrated_loudness(spark, sf_dir):
    """Gated loudness of each asset."""
    blocks = measure.window_energy(stream(spark, sf_dir), measure.MOMENTARY)
    return measure.gated(blocks, ["asset"], clustered=True).withColumn("integrated_lufs", rounded(F.col("integrated_lufs")))


@query(
    f"""WITH {BLOCK_SQL.replace("b AS", "b0 AS")},
b AS (SELECT 'asset' AS level, asset AS id, block FROM b0 UNION ALL SELECT 'album', asset % 7, block FROM b0 UNION ALL SELECT 'all', 0, block FROM b0),
{gate_sql("level, id")} SELECT level, id, n_blocks, n_gated, {lufs_sql("ms")} AS integrated_lufs FROM i"""
)
def album_loudness_rollup(spark, sf_dir):
    """A2: gating over the union of blocks of an asset, an album and everything, in one pass."""
    blocks = measure.window_energy(stream(spark, sf_dir), measure.MOMENTARY)
    level = lambda name, id_: F.struct(F.lit(name).alias("level"), id_.cast("long").alias("id"))
    blocks = blocks.select("block", F.explode(F.array(level("asset", F.col("asset")), level("album", F.col("asset") % 7), level("all", F.lit(0)))).alias("x")).select("block", "x.level", "x.id")
    return measure.gated(blocks, ["level", "id"]).withColumn("integrated_lufs", rounded(F.col("integrated_lufs")))


@query(
    f"""WITH {SHORT_SQL}, k AS (SELECT asset, avg(block) / 100 AS gate FROM b WHERE block >= {GATE} GROUP BY asset),
l AS (SELECT asset, -0.691 + 10 * log10(block) AS l FROM b JOIN k USING (asset) WHERE block >= {GATE} AND block >= gate),
r AS (SELECT asset, count(*) AS n_used, CASE WHEN count(*) >= 2 THEN quantile_cont(l, 0.95) - quantile_cont(l, 0.10) ELSE 0 END AS lra FROM l GROUP BY asset)
SELECT asset, round(coalesce(lra, 0), 6) AS lra, coalesce(n_used, 0) AS n_used FROM (SELECT DISTINCT asset FROM b) LEFT JOIN r USING (asset)"""
)
def loudness_range(spark, sf_dir):
    """Loudness range over short-term blocks."""
    blocks = measure.window_energy(stream(spark, sf_dir), measure.SHORT_TERM)
    return measure.loudness_range(blocks, ["asset"], clustered=True).withColumn("lra", rounded(F.col("lra")))


WINDOWED_SQL = f"""{STREAM_SQL},
w AS (SELECT *, CASE WHEN count(*) OVER m = 4 THEN avg(energy) OVER m END AS m, CASE WHEN count(*) OVER s = 30 THEN avg(energy) OVER s END AS st FROM f
      WINDOW m AS (PARTITION BY asset ORDER BY frame ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), s AS (PARTITION BY asset ORDER BY frame ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))"""


@query(f"WITH {WINDOWED_SQL} SELECT asset, {lufs_sql('max(m)')} AS max_momentary, {lufs_sql('max(st)')} AS max_short_term FROM w GROUP BY asset")
def max_momentary_short_term(spark, sf_dir):
    """A4: sliding maxima."""
    top = measure.sliding_maxima(stream(spark, sf_dir))
    return top.select("asset", *[rounded(F.col(c)).alias(c) for c in ("max_momentary", "max_short_term")])


TIMELINE_SQL = f"""{WINDOWED_SQL},
t AS (SELECT asset, frame // 10 AS interval, min(frame) AS start_frame, max(frame) + 1 AS end_frame, arg_max(coalesce(m, -1), frame) AS m, arg_max(coalesce(st, -1), frame) AS st, max(abs(sample)) AS peak FROM w GROUP BY asset, frame // 10),
tl AS (SELECT asset, interval, start_frame, end_frame, CASE WHEN m > 0 THEN -0.691 + 10 * log10(m) END AS momentary_lufs, CASE WHEN st > 0 THEN -0.691 + 10 * log10(st) END AS short_term_lufs,
       CASE WHEN peak > 0 THEN 20 * log10(peak) ELSE '-inf'::DOUBLE END AS sample_peak_dbfs FROM t)"""


@query(f"WITH {TIMELINE_SQL} SELECT asset, interval, start_frame, end_frame, round(momentary_lufs, 6) AS momentary_lufs, round(short_term_lufs, 6) AS short_term_lufs, CASE WHEN sample_peak_dbfs > -1e9 THEN round(sample_peak_dbfs, 6) END AS sample_peak_dbfs FROM tl")
def loudness_timeline(spark, sf_dir):
    """One-second intervals."""
    points = measure.timeline(stream(spark, sf_dir), 10)
    return points.select("asset", "interval", "start_frame", "end_frame", *[rounded(F.col(c)).alias(c) for c in ("momentary_lufs", "short_term_lufs", "sample_peak_dbfs")])


@query(
    f"""WITH {TIMELINE_SQL} SELECT asset, interval, concat_ws(',', CASE WHEN momentary_lufs > -4 THEN 'momentary' END, CASE WHEN short_term_lufs > -5 THEN 'short-term' END, CASE WHEN sample_peak_dbfs > -0.1 THEN 'peak' END) AS violations
FROM tl WHERE momentary_lufs > -4 OR short_term_lufs > -5 OR sample_peak_dbfs > -0.1"""
)
def timeline_violations(spark, sf_dir):
    """C4: intervals that exceed a limit."""
    points = measure.violations(measure.timeline(stream(spark, sf_dir), 10), -4.0, -5.0, -0.1)
    return points.where(F.size("violations") > 0).select("asset", "interval", F.array_join("violations", ",").alias("violations"))


@query(f"WITH {STREAM_SQL} SELECT asset, count(*) AS frames, {db_sql('sqrt(avg(sample * sample))')} AS rms_dbfs, {db_sql('max(abs(sample))')} AS peak_dbfs FROM f GROUP BY asset")
def rms_sample_peak(spark, sf_dir):
    """A5: RMS and sample peak."""
    return measure.peaks(stream(spark, sf_dir)).select("asset", "frames", rounded(F.col("rms_dbfs")).alias("rms_dbfs"), rounded(F.col("peak_dbfs")).alias("peak_dbfs"))


@query(
    f"""WITH {BLOCK_SQL}, {gate_sql("asset")}, pk AS (SELECT asset, max(abs(sample)) AS peak, count(*) / 10 AS duration FROM f GROUP BY asset)
SELECT asset, round(20 * log10(peak) - (-0.691 + 10 * log10(ms)), 6) AS plr, round(duration, 6) AS duration_seconds, duration >= 60 AS lra_stable FROM i JOIN pk USING (asset) WHERE ms > 0 AND peak > 0"""
)
def plr(spark, sf_dir):
    """P10: peak to loudness ratio, duration and whether the range is stable."""
    frames = stream(spark, sf_dir)
    loud = measure.gated(measure.window_energy(frames, measure.MOMENTARY), ["asset"], clustered=True)
    peak = measure.peaks(frames)
    both = loud.join(peak, "asset").withColumn("plr", rounded(F.col("peak_dbfs") - F.col("integrated_lufs"))).where("plr IS NOT NULL")
    return both.select("asset", "plr", rounded(F.col("frames") / 10).alias("duration_seconds"), (F.col("frames") / 10 >= 60).alias("lra_stable"))


LAYOUT_SQL = "lay(channel, label, role, azimuth, elevation) AS " + dims.values([(i, *x) for i, x in enumerate(dims.LAYOUTS["7.1.4"])])
WEIGHT_SQL = """CASE role WHEN 'main' THEN 1.0::DOUBLE WHEN 'surround' THEN 1.41::DOUBLE WHEN 'dual_mono' THEN 2.0::DOUBLE WHEN 'lfe' THEN 0.0::DOUBLE
  ELSE CASE WHEN abs(elevation) < 30 AND abs(azimuth) BETWEEN 60 AND 120 THEN 1.41::DOUBLE ELSE 1.0::DOUBLE END END"""


def multichannel(spark, sf_dir):
    """Twelve consecutive vectors as the channels of one 7.1.4 asset."""
    v = vectors(spark, sf_dir).select(F.floor(F.col("asset") / 12).cast("long").alias("asset"), (F.col("asset") % 12).cast("int").alias("channel"), "samples")
    return v.join(dims.layout(spark, "7.1.4"), "channel")


MULTI_SQL = f"{VECTOR_SQL}, {LAYOUT_SQL}, mc AS (SELECT v.asset // 12 AS asset, lay.*, samples FROM v JOIN lay ON v.asset % 12 = lay.channel)"


@query(
    f"""WITH {MULTI_SQL} SELECT asset, round(sum({WEIGHT_SQL} * list_sum(list_transform(samples, lambda x: x * x)) / len(samples)), 6) AS weighted_ms,
CASE WHEN sum({WEIGHT_SQL} * list_sum(list_transform(samples, lambda x: x * x))) > 0 THEN round(-0.691 + 10 * log10(sum({WEIGHT_SQL} * list_sum(list_transform(samples, lambda x: x * x)) / len(samples))), 6) END AS loudness FROM mc GROUP BY asset"""
)
def channel_weighting(spark, sf_dir):
    """Role-weighted mean square over the channels of a layout."""
    energy = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x * x) / F.size("samples")
    weighted = F.sum(channel_weight(F.col("role"), F.col("azimuth"), F.col("elevation")) * energy)
    out = multichannel(spark, sf_dir).groupBy("asset").agg(weighted.alias("ms"))
    return out.select("asset", rounded(F.col("ms")).alias("weighted_ms"), rounded(lufs(F.col("ms"))).alias("loudness"))


def rendered(spark, sf_dir, target):
    mixed = multichannel(spark, sf_dir).join(F.broadcast(dims.downmix(spark, target)), F.col("label") == F.col("in_label"))
    frames = mixed.select("asset", "out_label", "coef", F.posexplode("samples").alias("frame", "x"))
    out = frames.groupBy("asset", "out_label", "frame").agg(F.sum(F.col("coef") * F.col("x")).alias("y"))
    return out.groupBy("asset", "out_label").agg(F.sqrt(F.avg(F.col("y") * F.col("y"))).alias("rms"), F.max(F.abs("y")).alias("peak"), F.count_if(F.abs("y") > 1).alias("over")).select(
        "asset", "out_label", rounded(F.col("rms")).alias("rms"), rounded(F.col("peak")).alias("peak"), "over"
    )


def rendered_sql(target):
    rows = [(o, i, c) for o, own in dims.DOWNMIX[target].items() for i, c in own.items()]
    return f"""WITH {MULTI_SQL}, mx(out_label, in_label, coef) AS {dims.values(rows)},
e AS (SELECT asset, out_label, coef, unnest(samples) AS x, unnest(range(len(samples))) AS frame FROM mc JOIN mx ON label = in_label),
y AS (SELECT asset, out_label, frame, sum(coef * x) AS y FROM e GROUP BY ALL)
SELECT asset, out_label, round(sqrt(avg(y * y)), 6) AS rms, round(max(abs(y)), 6) AS peak, count(*) FILTER (abs(y) > 1) AS over FROM y GROUP BY asset, out_label"""


@query(rendered_sql("stereo"))
def downmix_stereo(spark, sf_dir):
    """7.1.4 to stereo."""
    return rendered(spark, sf_dir, "stereo")


@query(rendered_sql("5.1"))
def downmix_51(spark, sf_dir):
    """7.1.4 to 5.1."""
    return rendered(spark, sf_dir, "5.1")


RANGES_SQL = "r AS (SELECT DISTINCT asset, k AS range_no, k * 20 AS start_frame, k * 20 + 5 + asset % 7 AS end_frame FROM s, range(3) x(k))"


@query(f"WITH {STREAM_SQL}, {RANGES_SQL}, d AS (SELECT f.asset, energy FROM f JOIN r ON f.asset = r.asset AND frame >= start_frame AND frame < end_frame) SELECT asset, count(*) AS frames, {lufs_sql('avg(energy)')} AS dialogue_lufs FROM d GROUP BY asset")
def dialogue_ranges_energy(spark, sf_dir):
    """Ungated loudness over dialogue ranges."""
    frames = stream(spark, sf_dir)
    ranges = frames.select("asset").distinct().select("asset", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("range_no"))
    ranges = ranges.select("asset", (F.col("range_no") * 20).alias("start_frame"), (F.col("range_no") * 20 + 5 + F.col("asset") % 7).alias("end_frame"))
    out = measure.ungated(measure.overlapping(frames, ranges), ["asset"])
    return out.withColumn("dialogue_lufs", rounded(F.col("dialogue_lufs")))


@query(
    f"""WITH {STREAM_SQL}, {RANGES_SQL},
d AS (SELECT f.asset, range_no, frame, energy FROM f JOIN r ON f.asset = r.asset AND frame >= start_frame AND frame < end_frame),
b AS (SELECT asset, avg(energy) OVER w AS block FROM d WINDOW w AS (PARTITION BY asset, range_no ORDER BY frame ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) QUALIFY count(*) OVER w = 4),
{gate_sql("asset")} SELECT asset, n_blocks, n_gated, {lufs_sql("ms")} AS integrated_lufs FROM i"""
)
def dialogue_gated(spark, sf_dir):
    """Gating over blocks that restart at every range."""
    frames = stream(spark, sf_dir)
    ranges = frames.select("asset").distinct().select("asset", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("range_no"))
    ranges = ranges.select("asset", "range_no", (F.col("range_no") * 20).alias("start_frame"), (F.col("range_no") * 20 + 5 + F.col("asset") % 7).alias("end_frame"))
    inside = measure.overlapping(frames, ranges)
    w = Window.partitionBy("asset", "range_no").orderBy("frame").rowsBetween(-3, 0)
    blocks = inside.withColumn("block", F.avg("energy").over(w)).withColumn("whole", F.count("*").over(w)).where("whole = 4")
    return measure.gated(blocks, ["asset"], clustered=True).withColumn("integrated_lufs", rounded(F.col("integrated_lufs")))


LEVEL_SQL = f"{STREAM_SQL}, l AS (SELECT asset, 10 * log10(greatest(energy, 1e-30)) AS level FROM f)"


@query(f"WITH {LEVEL_SQL}, a AS (SELECT asset, list_sort(list(level)) AS x FROM l GROUP BY asset) SELECT asset, round(least(x[(len(x) - 1) // 5 + 1], -45), 6) AS noise_floor FROM a")
def noise_floor(spark, sf_dir):
    """The element at a fifth of the ascending levels."""
    levels = stream(spark, sf_dir).groupBy("asset").agg(F.collect_list(10 * F.log10(F.greatest("energy", F.lit(1e-30)))).alias("x"))
    return levels.select("asset", rounded(measure.noise_floor(F.col("x"))).alias("noise_floor"))


@query(f"WITH {LEVEL_SQL}, a AS (SELECT asset, list_sort(list(level)) AS x FROM l GROUP BY asset) SELECT asset, round(x[ceil((len(x) - 1) * 0.95)::INT + 1], 6) AS p95, round(x[ceil((len(x) - 1) * 0.5)::INT + 1], 6) AS p50 FROM a")
def nearest_rank_percentile(spark, sf_dir):
    """A10: nearest rank, upwards."""
    levels = stream(spark, sf_dir).groupBy("asset").agg(F.collect_list(10 * F.log10(F.greatest("energy", F.lit(1e-30)))).alias("x"))
    return levels.select("asset", rounded(measure.nearest_rank_up(F.col("x"), 0.95)).alias("p95"), rounded(measure.nearest_rank_up(F.col("x"), 0.5)).alias("p50"))


@query(
    f"""WITH {STREAM_SQL}, b AS (SELECT asset, frame // 4 AS blk, 10 * log10(greatest(avg(energy), 1e-30)) AS level FROM f GROUP BY ALL HAVING count(*) = 4)
SELECT asset, count(*) AS blocks, round(stddev_pop(level), 6) AS modulation FROM b GROUP BY asset"""
)
def amplitude_modulation(spark, sf_dir):
    """Population deviation of block levels."""
    blocks = stream(spark, sf_dir).groupBy("asset", F.floor(F.col("frame") / 4).alias("blk")).agg(F.avg("energy").alias("e"), F.count("*").alias("n")).where("n = 4")
    return blocks.groupBy("asset").agg(F.count("*").alias("blocks"), rounded(F.stddev_pop(10 * F.log10(F.greatest("e", F.lit(1e-30))))).alias("modulation"))


@query(f"WITH {STREAM_SQL}, z AS (SELECT asset, (sample < 0) <> (lag(sample) OVER (PARTITION BY asset ORDER BY frame) < 0) AS x FROM f) SELECT asset, round(count(*) FILTER (x) / count(x), 6) AS zcr FROM z GROUP BY asset HAVING count(x) > 0")
def zero_crossing_rate(spark, sf_dir):
    """Share of neighbours whose sign differs."""
    w = Window.partitionBy("asset").orderBy("frame")
    z = stream(spark, sf_dir).withColumn("x", (F.col("sample") < 0) != (F.lag("sample").over(w) < 0))
    return z.groupBy("asset").agg(F.count_if("x").alias("k"), F.count("x").alias("n")).where("n > 0").select("asset", rounded(F.col("k") / F.col("n")).alias("zcr"))


@query(f"WITH {MEASURE_SQL} SELECT asset, printf('%+.2f dB', -18.0 - (integrated_lufs + 0.00003)) AS replaygain, round(pow(10, true_peak_dbtp / 20), 6) AS peak, CAST(round((-23.0 - integrated_lufs) * 256) AS INT) AS r128_gain FROM m")
def loudness_tags(spark, sf_dir):
    """Tag values."""
    from ..functions.units import db_to_linear, r128_gain, replay_gain

    m = measurements(spark, sf_dir)
    return m.select("asset", replay_gain(F.col("integrated_lufs") + 0.00003).alias("replaygain"), rounded(db_to_linear(F.col("true_peak_dbtp"))).alias("peak"), r128_gain(F.col("integrated_lufs")).alias("r128_gain"))


@query("SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows_tumbling(spark, sf_dir):
    """Tumbling windows in event time."""
    e = read(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "5 minutes").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


@query(
    """SELECT time_bucket(INTERVAL 5 MINUTE, ts) - k * INTERVAL 5 MINUTE AS window_start, count(*) AS n, round(max(value), 4) AS top FROM events, range(3) x(k) GROUP BY ALL"""
)
def event_windows_sliding(spark, sf_dir):
    """15-minute windows every 5 minutes."""
    e = read(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "15 minutes", "5 minutes").alias("w")).agg(F.count("*").alias("n"), F.round(F.max("value"), 4).alias("top")).select(F.col("w.start").alias("window_start"), "n", "top")


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 1 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, session"""
)
def event_windows_session(spark, sf_dir):
    """Sessions that an hour without events ends."""
    e = read(spark, sf_dir, "events")
    return e.groupBy("user_id", F.session_window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
