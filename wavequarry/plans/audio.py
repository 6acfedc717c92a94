"""Array operators over the driver's vectors as tiny PCM programmes; SQL cannot say these."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.units import rounded
from ..operators import health, render
from .mappings import pairs
from .registry import query


def chunked(spark, sf_dir):
    """Stereo pairs as one-second chunks at 64 Hz."""
    p = pairs(spark, sf_dir).where(F.size("l") == 64)
    each = p.select(F.col("pair").cast("string").alias("asset_id"), F.posexplode(F.array("l", "r")).alias("channel", "samples"))
    return each.select("asset_id", F.lit(64).alias("sample_rate"), F.lit(2).alias("channels"), "channel", F.lit(0).alias("chunk_no"), F.lit(0).cast("long").alias("frame_start"), F.transform("samples", lambda x: x.cast("float")).alias("samples"))


@query()
def signal_health_report(spark, sf_dir):
    """2.10: all rules on every pair."""
    r = health.report(chunked(spark, sf_dir), health.Options(tones=(8.0,), click=0.3, jump=0.4))
    return r.select("asset_id", "position", "rule_id", "calculated", "passed", "events_truncated", F.size("events").alias("n_events"))


@query()
def audio_comparison(spark, sf_dir):
    """Left against right of every pair."""
    side = lambda i: chunked(spark, sf_dir).where(F.col("channel") == i).withColumn("channel", F.lit(0))
    r = render.compare_audio(side(0), side(1), 8)
    return r.select("asset_id", "lag", "channel", "matched", *[rounded(F.col(x)).alias(x) for x in ("lag_cosine", "correlation", "residual_db", "null_depth_db", "exact_ratio", "gain_db")])
