"""Streaming queries run to their end over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.shared import shared_dir as folder
from ..functions.units import rounded
from ..sources import rtp
from ..streaming import live, watch
from .loudness import WINDOWED_SQL, lufs_sql
from .mappings import packets, read
from .registry import query


@query(f"WITH {WINDOWED_SQL} SELECT asset, count(*) AS frames, round(max(abs(sample)), 6) AS sample_peak, {lufs_sql('max(m)')} AS max_momentary, {lufs_sql('max(st)')} AS max_short_term FROM w GROUP BY asset")
def stream_meter_equals_batch(spark, sf_dir):
    """The live meter's last report of each asset, which equals the batch query's."""
    source = f"{sf_dir}/events.parque[t]"  # a pattern: the file source takes folders and patterns only
    events = live.read_stream(spark, source, read(spark, sf_dir, "events").schema)
    events = events.select(F.col("user_id").alias("asset"), "ts", "event_id", ((F.col("value") - 250) / 250).alias("sample"))
    reports = live.run_to_end(live.live_meter(events), folder(spark))
    last = reports.groupBy("asset").agg(F.max_by(F.struct("frames", "sample_peak", "max_momentary", "max_short_term"), "frames").alias("r")).select("asset", "r.*")
    return last.select("asset", "frames", *[rounded(F.col(c)).alias(c) for c in ("sample_peak", "max_momentary", "max_short_term")])


@query(
    """WITH l AS (SELECT user_id % 40 AS path, event_id // 4 % 50 AS size_bytes, (event_id // 300) AS modified_ns, event_id * 1000 AS observed_ms FROM events),
g AS (SELECT *, CASE WHEN size_bytes = lag(size_bytes) OVER w AND modified_ns = lag(modified_ns) OVER w THEN 0 ELSE 1 END AS new FROM l WINDOW w AS (PARTITION BY path ORDER BY observed_ms)),
r AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY observed_ms ROWS UNBOUNDED PRECEDING) AS run FROM g), f AS (SELECT *, min(observed_ms) OVER (PARTITION BY path, run) AS first_seen_ms FROM r)
SELECT path::VARCHAR AS path, size_bytes, first_seen_ms, min(observed_ms) AS observed_ms FROM f WHERE observed_ms > first_seen_ms AND observed_ms - first_seen_ms >= 1000 GROUP BY ALL"""
)
def watch_stability(spark, sf_dir):
    """Files whose fingerprint stayed the same for a second, from a stream of listings."""
    source = f"{sf_dir}/events.parque[t]"  # a pattern: the file source takes folders and patterns only
    e = live.read_stream(spark, source, read(spark, sf_dir, "events").schema)
    listings = e.select((F.col("user_id") % 40).cast("string").alias("path"), (F.floor(F.col("event_id") / 4) % 50).alias("size_bytes"), F.floor(F.col("event_id") / 300).alias("modified_ns"), (F.col("event_id") * 1000).alias("observed_ms"))
    changes = live.run_to_end(watch.watch(listings, 1000), folder(spark), "append")
    return changes.where("status = 'completed'").select("path", "size_bytes", "first_seen_ms", "observed_ms")


@query(
    """WITH RECURSIVE k AS (SELECT user_id AS ssrc, event_id AS capture_no, event_id % 65536 AS seq, event_id * 48 AS rtp_ts, epoch_us(ts) / 1e6 - CASE WHEN event_id % 50 = 3 THEN 7200.0 ELSE 0.0 END AS arrival FROM events WHERE event_id % 7 <> 0),
u AS (SELECT *, row_number() OVER (PARTITION BY ssrc ORDER BY arrival, capture_no) AS n FROM (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY ssrc, seq, rtp_ts ORDER BY arrival, capture_no) = 1)),
t AS (SELECT ssrc, n, seq AS last, rtp_ts AS last_ts, 0 AS gaps, 0 AS lost, 0 AS reordered, 0 AS wrong FROM u WHERE n = 1
UNION ALL SELECT ssrc, n, CASE WHEN d < 32768 THEN seq ELSE last END, CASE WHEN d < 32768 THEN rtp_ts ELSE last_ts END, gaps + CASE WHEN d > 1 AND d < 32768 THEN 1 ELSE 0 END, lost + CASE WHEN d > 1 AND d < 32768 THEN d - 1 ELSE 0 END,
  reordered + CASE WHEN d >= 32768 THEN 1 ELSE 0 END, wrong + CASE WHEN d = 1 AND (rtp_ts - last_ts + 4294967296) % 4294967296 <> 48 THEN 1 ELSE 0 END
  FROM (SELECT u.*, t.last, t.last_ts, t.gaps, t.lost, t.reordered, t.wrong, CASE WHEN u.seq = t.last THEN 65536 ELSE (u.seq - t.last + 65536) % 65536 END AS d FROM t JOIN u ON u.ssrc = t.ssrc AND u.n = t.n + 1))
SELECT ssrc, CAST(c.packets AS BIGINT) AS packets, CAST(gaps AS BIGINT) AS gaps, CAST(lost AS BIGINT) AS lost, CAST(reordered AS BIGINT) AS reordered, CAST(c.packets - n AS BIGINT) AS duplicates, CAST(wrong AS BIGINT) AS timestamp_errors
FROM (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY ssrc ORDER BY n DESC) = 1) JOIN (SELECT ssrc, count(*) AS packets FROM k GROUP BY ssrc) c USING (ssrc)"""
)
def rtp_continuity(spark, sf_dir):
    """W13 exactly, with its state machine: gaps, losses, reorders, duplicates, timestamp errors."""
    k = packets(spark, sf_dir).where("event_id % 7 <> 0").withColumn("arrival", F.col("arrival") - F.when(F.col("event_id") % 50 == 3, 7200.0).otherwise(0.0))
    return rtp.continuity(k.select("ssrc", F.col("event_id").alias("capture_no"), "arrival", "seq", "rtp_ts", F.lit(48).alias("samples")))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, user_id AS asset, count(*) AS n, round(max(abs((value - 250) / 250)), 6) AS peak FROM events GROUP BY ALL")
def streaming_hourly_windows(spark, sf_dir):
    """Event-time windows of a stream with a watermark; the last state of each window."""
    source = f"{sf_dir}/events.parque[t]"  # a pattern: the file source takes folders and patterns only
    events = live.read_stream(spark, source, read(spark, sf_dir, "events").schema)
    events = events.select(F.col("user_id").alias("asset"), "ts", ((F.col("value") - 250) / 250).alias("sample"))
    rows = live.run_to_end(live.windowed_levels(events, "3650 days"), folder(spark))
    last = rows.groupBy("start", "asset").agg(F.max_by(F.struct("n", "peak"), "n").alias("r"))
    return last.select(F.col("start").cast("timestamp_ntz").alias("start"), "asset", "r.n", rounded(F.col("r.peak")).alias("peak"))
